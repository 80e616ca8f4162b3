"""Connected components of a table of links, in rounds of joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridscore.session import scratch_path

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(frame: DataFrame, name: str) -> DataFrame:
    """Write to the shared scratch folder and read again: cuts the lineage and survives lost executors."""
    spark = frame.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")  # the shuffle files of this write are not needed after it
    try:
        frame.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    back = spark.read.parquet(path)
    back._stored_at = path
    return back


def discard(*frames: DataFrame) -> None:
    """Delete tables made by ``stored`` that no later table reads any more."""
    for frame in frames:
        spark = frame.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(frame._stored_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Links up to which one task works on them, without shuffles.
ONE_TASK = 200_000


def components(links: DataFrame, most_rounds: int = 50) -> DataFrame:
    """``node`` and ``root`` (the smallest node of its component) for every node of a link ``a``–``b``.

    Every round hooks all neighbours of a node to the smallest one, first the larger neighbours, then the smaller ones, until
    each component is a star around its root; the number of rounds grows with the logarithm of its size. Links may repeat,
    point to themselves or be null (ignored). No links give no rows.
    """
    links = stored(links.where("a is not null and b is not null").select("a", "b"), "links")
    few = links.count() <= ONE_TASK
    kept = lambda frame: stored(frame, "edges").coalesce(1) if few else stored(frame, "edges")
    links_in = links.coalesce(1) if few else links
    pair = lambda x, y: F.struct(F.col(x).alias("u"), F.col(y).alias("v"))
    turned = lambda frame, x, y: frame.select(F.explode(F.array(pair(x, y), pair(y, x))).alias("e")).select("e.u", "e.v")
    # The smallest neighbour is stored before it is joined, so that a join on ``u`` can be split where one ``u`` has very many rows.
    nearest = lambda frame: kept(frame.groupBy("u").agg(F.min("v").alias("m")))

    nodes = turned(links_in, "a", "b").select(F.col("u").alias("node")).distinct()
    edges = kept(links_in.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    for _ in range(most_rounds):
        both = turned(edges, "u", "v")
        larger = kept(both.join(nearest(both), "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct())
        least = nearest(larger)
        # The neighbours of ``u`` are hooked to the smallest of them, and so is ``u``.
        moved = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))))
        edges = kept(larger.join(least, "u").select(moved.alias("e")).select("e.u", "e.v").where("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(edges.withColumnRenamed("u", "node"), "node", "left").select("node", F.coalesce("v", "node").alias("root"))
