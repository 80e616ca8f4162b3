"""No caps: large dimensions, long conversations, long numbers, repeated rows, gaps."""

import pytest
from pyspark.sql import functions as F

from gridscore.functions.keys import natural_key
from gridscore.operators import grid, items, runs
from gridscore.operators.windows import row_numbers
from gridscore.plans.common import spread
from gridscore.plans.items import batches
from gridscore.session import source_bytes
from gridscore.sources.files import row_digest


def test_five_thousand_participants(spark):
    people = grid.participants([f"p{n}" for n in range(5_000)])
    cells = grid.cell_grid(spark.createDataFrame([("s1",), ("s2",)], "source_id string"), ["en", "ja"], people, "run-1")
    assert cells.count() == 20_000 and cells.select("stable_key").distinct().count() == 20_000
    assert [tuple(r) for r in grid.participant_table(spark, people).where("ord in (0, 4999)").orderBy("ord").collect()] == [("p0", "p0", 0), ("p4999", "p4999", 4999)]
    source = spark.range(5_000).select(F.concat(F.lit("p"), "id").alias("participant_id"), F.lit(1).alias("x"))
    assert runs.import_participants(source.limit(0), source, [p.participant_id for p in people], 1).count() == 5_000


def test_long_conversations_keep_their_order(spark):
    turns = spark.range(1_200).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn")).union(spark.createDataFrame([(2, 0)], "conv_id int, turn bigint"))
    rows = turns.withColumns({"contextTurnCount": F.lit(1), "speakerMode": F.lit("single")})
    numbers = {(r.conv_id, r.turn): r.batch_id for r in batches(rows, 12).collect()}
    assert numbers[1, 1_199] == "ctx1-single-batch-100" and numbers[2, 0] == "ctx1-single-batch-101"
    placed = {(r.conv_id, r.turn): r.rn for r in row_numbers(turns.withColumn("k", F.lit(1)), ["k"], ["conv_id", "turn"], "rn", width=1).collect()}
    assert placed[1, 999] == 1_000 and placed[2, 0] == 1_201


def test_long_numbers_sort_as_numbers(spark):
    names = ["x" + "1" * 25, "x9", "x10", "x2::b", "x010a", "x", "1" * 26 + "y", "3y"]
    ordered = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").orderBy(natural_key("n")).collect()]
    assert ordered == ["3y", "1" * 26 + "y", "x", "x2::b", "x9", "x10", "x010a", "x" + "1" * 25]


def test_repeated_rows_change_a_digest(spark):
    digest = lambda values: spark.createDataFrame([(v,) for v in values], "v string").agg(row_digest(None, F.col("v"))).first()[0]
    assert digest("abb") != digest("a") and digest("abb") == digest("bab") and digest("ab") != digest("aabb")


def test_manifest_order_stops_at_gaps(spark):
    manifest = spark.createDataFrame([("b", 1), ("a", 2)], "sampleId string, ord int")
    table = lambda *ids: spark.createDataFrame([(i, 0) for i in ids], "sampleId string, status int")
    assert [r.sampleId for r in items.in_manifest_order(manifest, table("a", "b")).collect()] == ["b", "a"]
    for ids, problem in ((("a",), "missing"), (("a", "b", "b"), "duplicate"), (("a", "b", "c"), "unexpected")):
        with pytest.raises(Exception, match=problem):
            items.in_manifest_order(manifest, table(*ids)).collect()


def test_stray_buckets_are_not_balanced(spark):
    plan = grid.authoring_grid(spark)
    stray = plan.limit(1).withColumn("speakerMode", F.lit("choir")).withColumn("sampleId", F.lit("stray"))
    rows = items.bucket_balance(plan.union(stray)).where("not balanced").collect()
    assert [(r.expected, r.actual) for r in rows] == [(0, 1)]
    total = items.scaffold_totals(plan).first()
    assert total.complete and total.expected == total.actual == 216
    assert not items.scaffold_totals(plan.union(stray)).first().complete
    assert not items.scaffold_totals(plan.limit(215)).first().complete


def test_rows_of_one_row_group_are_dealt(spark, tmp_path):
    """A file of many splits whose rows all lie in one row group, hence in one split."""
    path = str(tmp_path / "rows")
    rows = spark.range(20_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text"))
    rows.coalesce(1).write.parquet(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        scan = spark.read.parquet(path)
        assert scan.rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
        assert scan.select(F.spark_partition_id()).distinct().count() == 1
        dealt = [r["count"] for r in spread(scan).groupBy(F.spark_partition_id()).count().collect()]
        assert len(dealt) == spark.sparkContext.defaultParallelism and max(dealt) < 2 * min(dealt)
        # A source of more bytes gives more tasks.
        assert source_bytes(scan) > 1_000_000 and source_bytes(spark.range(3)) == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
