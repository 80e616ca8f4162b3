"""Run events as streams: counters, idempotent appends, snapshots, windows, cooldowns, feeds.

Sinks write one folder per micro-batch and overwrite it when the batch is replayed, so a
restart after a lost executor or driver cannot count anything twice.
"""

from __future__ import annotations

import json
import threading
import time
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.types import StructType

from gridscore.operators.windows import latest_rows
from gridscore.sources.files import folder_names, latest_version, prune_versions, read_version, write_version


# The default format of JSON files would cut times to milliseconds.
TIMESTAMP_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def event_stream(spark: SparkSession, folder: str, schema: StructType | str, bytes_per_batch: int | None = None) -> DataFrame:
    """Events of all files below ``folder``; micro-batches of about ``bytes_per_batch``."""
    reader = spark.readStream.schema(schema).options(mode="FAILFAST", timestampFormat=TIMESTAMP_FORMAT)
    if bytes_per_batch:
        reader = reader.option("maxBytesPerTrigger", bytes_per_batch)
    return reader.json(folder)


def write_ordered_log(events: DataFrame, folder: str, order: str, files: int) -> None:
    """A log as JSON files whose age follows the column ``order``, by one job on all cores.

    A file stream takes files by age, and a watermark drops what comes after later rows. Ranges of the log are sorted and written
    together; then the times of the files are set in the order of their ranges, a millisecond apart, and read back: a store that
    does not keep them is an error. The folder must be new. Only names of files come to the driver.
    """
    spark = events.sparkSession
    dealt = events.repartitionByRange(max(1, files), order).sortWithinPartitions(order)
    dealt.write.mode("errorifexists").options(ignoreNullFields="false", timestampFormat=TIMESTAMP_FORMAT).json(folder)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    names = sorted(name for name in folder_names(spark, folder) if name.startswith("part-"))
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    begin = int(time.time() * 1000) - len(names)
    for place, name in enumerate(names):
        fs.setTimes(path(f"{folder}/{name}"), begin + place, -1)
    kept = {status.getPath().getName(): status.getModificationTime() for status in fs.listStatus(path(folder))}
    if any(kept[a] >= kept[b] for a, b in zip(names, names[1:])):
        raise RuntimeError(f"the store of {folder} does not keep the times of files")


def counters(events: DataFrame, keys: Sequence[str] = ("phase", "participant_id")) -> DataFrame:
    """Running counts per key. The same expression serves a batch and a stream (update mode)."""
    outcome = F.col("outcome")
    return events.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(outcome == "success").alias("succeeded"),
        F.count_if(outcome == "failure").alias("failed"),
        F.count_if(outcome == "retry").alias("retries"),
    )


def cooldown_ends(events: DataFrame, delay_ms: Column) -> DataFrame:
    """Latest end of a pause per bucket. Pauses only ever extend, so a running maximum is the
    whole state and no user-defined state is needed."""
    end = F.unix_micros("ts") + delay_ms * 1000
    return events.where(delay_ms.isNotNull()).groupBy("bucket_key").agg(F.max(end).alias("cooldown_until_us"))


def failure_windows(events: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """Failures that throttle, per bucket and sliding minute. How many rows came too late for their
    windows is in the progress of the query (``late_rows``)."""
    throttled = events.where(F.col("error_class").isin("rate_limit", "server_overload"))
    return (
        throttled.withWatermark("ts", watermark)
        .groupBy(F.window("ts", "60 seconds", "10 seconds"), "bucket_key")
        .agg(F.count(F.lit(1)).alias("failures"))
        .select(F.unix_micros("window.start").alias("window_start_us"), "bucket_key", "failures")
    )


def failure_counts(events: DataFrame) -> DataFrame:
    """Failures that throttle, per bucket and sliding minute, of a batch of events."""
    throttled = events.where(F.col("error_class").isin("rate_limit", "server_overload"))
    windows = throttled.groupBy(F.window("ts", "60 seconds", "10 seconds"), "bucket_key").agg(F.count(F.lit(1)).alias("failures"))
    return windows.select(F.unix_micros("window.start").alias("window_start_us"), F.unix_micros("window.end").alias("window_end_us"), "bucket_key", "failures")


def run_failure_windows(stream: DataFrame, folder: str, checkpoint: str, delay_ms: int = 600_000, every: str | None = None) -> StreamingQuery:
    """Sliding failure windows that lose no row, however late it comes.

    Every micro-batch adds its counts below ``folder/batch_id=N`` (overwritten on replay), so windows need no state and a late row
    is one more addend. ``late`` tells addends of windows that ended more than ``delay_ms`` before the newest event of the
    batches before: what readers of closed windows have to be told again. The newest event of each batch is kept beside them.
    """

    def each_batch(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        rows = rows.select("ts", "bucket_key", "error_class").persist()
        try:
            clocks = [name for name in folder_names(spark, f"{folder}/clock") if name.startswith("batch_id=") and int(name[9:]) < batch_id]
            newest = None
            if clocks:
                newest = spark.read.schema("newest_us bigint, batch_id bigint").parquet(f"{folder}/clock").where(F.col("batch_id") < batch_id).agg(F.max("newest_us")).first()[0]
            late = F.lit(False) if newest is None else F.col("window_end_us") <= newest - delay_ms * 1000
            failure_counts(rows).withColumn("late", late).write.mode("overwrite").parquet(f"{folder}/counts/batch_id={batch_id}")
            rows.agg(F.max(F.unix_micros("ts")).alias("newest_us")).write.mode("overwrite").parquet(f"{folder}/clock/batch_id={batch_id}")
        finally:
            rows.unpersist()

    return _start(stream, each_batch, checkpoint, "append", every)


def _addends(spark: SparkSession, folder: str) -> DataFrame:
    schema = "window_start_us bigint, window_end_us bigint, bucket_key string, failures bigint, late boolean, batch_id bigint"
    if not folder_names(spark, f"{folder}/counts"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{folder}/counts")


def failure_totals(spark: SparkSession, folder: str) -> DataFrame:
    """``bucket_key, window_start_us, failures`` of all windows, late rows included."""
    return _addends(spark, folder).groupBy("bucket_key", "window_start_us").agg(F.sum("failures").alias("failures"))


def corrections(spark: SparkSession, folder: str) -> DataFrame:
    """Windows that were closed when late failures came: the batch, how many it added, and the count of the window after it."""
    so_far = F.sum("failures").over(Window.partitionBy("bucket_key", "window_start_us").orderBy("batch_id"))
    rows = _addends(spark, folder).withColumn("total", so_far).where("late")
    return rows.select("batch_id", "bucket_key", "window_start_us", F.col("failures").alias("added"), "total")


def _start(stream: DataFrame, each_batch, checkpoint: str, mode: str, every: str | None) -> StreamingQuery:
    writer = stream.writeStream.outputMode(mode).foreachBatch(each_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    with _state_outside_the_heap(stream.sparkSession):
        return writer.start()


#: State lives in a store on the executors' disks, and a micro-batch sends its changes to the checkpoint, not the whole state.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def _state_outside_the_heap(spark: SparkSession) -> Iterator[None]:
    """A query takes the settings of the session as it starts. One that has a checkpoint goes on with the store and the number of
    partitions that are written there, whatever the session says. Settings that a user made are kept."""
    before = {name: spark.conf.get(name, None) for name in STATE_STORE}
    default = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    own = before["spark.sql.streaming.stateStore.providerClass"] not in (None, default)
    for name, value in STATE_STORE.items():
        if not own:
            spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if not own:
                spark.conf.set(name, value) if value is not None else spark.conf.unset(name)


def late_rows(query: StreamingQuery) -> int:
    """Rows that the stateful operators of a query dropped behind their watermark, over its recent progress."""
    return sum(int(state.numRowsDroppedByWatermark) for progress in query.recentProgress for state in progress.stateOperators)


class _Late(StreamingQueryListener):
    """Rows that came too late, by run, over all micro-batches; ``recentProgress`` holds the last ones only."""

    def __init__(self) -> None:
        self.late: Counter[str] = Counter()
        self.ended: set[str] = set()
        self.changed = threading.Condition()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        with self.changed:
            self.late[str(event.progress.runId)] += sum(int(state.numRowsDroppedByWatermark) for state in event.progress.stateOperators)

    def onQueryTerminated(self, event) -> None:
        with self.changed:
            self.ended.add(str(event.runId))
            self.changed.notify_all()


def late_rows_to_the_end(spark: SparkSession, start: Callable[[], StreamingQuery]) -> int:
    """Run a query to its end; the rows that its stateful operators dropped behind their watermark in all micro-batches."""
    listener = _Late()
    spark.streams.addListener(listener)
    try:
        query = start()
        query.awaitTermination()
        with listener.changed:
            if not listener.changed.wait_for(lambda: str(query.runId) in listener.ended, timeout=120):
                raise RuntimeError("the end of the stream was not reported")
            return listener.late[str(query.runId)]
    finally:
        spark.streams.removeListener(listener)


def run_updates(stream: DataFrame, folder: str, checkpoint: str, every: str | None = None, mode: str = "update") -> StreamingQuery:
    """Write changed rows of every micro-batch below ``folder/batch_id=N``."""

    def each_batch(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")

    return _start(stream, each_batch, checkpoint, mode, every)


def latest_updates(spark: SparkSession, folder: str, keys: Sequence[str]) -> DataFrame:
    """Current value per key out of the updates of all micro-batches."""
    updates = spark.read.parquet(folder)
    return latest_rows(updates, list(keys), ["batch_id"]).drop("batch_id")


def run_append(stream: DataFrame, folder: str, checkpoint: str, key: str = "stable_key", every: str | None = None) -> StreamingQuery:
    """Append rows whose key was not written by an earlier micro-batch, also of earlier runs.

    The keys this query has seen are its keyed state, kept in the checkpoint without a watermark: a key
    is never forgotten, however late its first event comes, and no micro-batch reads what was written before.
    Batches are kept per ``query`` (the id Spark stores in the checkpoint), so that a query that starts anew,
    without its checkpoint, counts from zero beside the old batches; only keys of such other queries are looked up.
    """

    def each_batch(rows: DataFrame, batch_id: int) -> None:
        spark, fresh = rows.sparkSession, rows
        query = json.loads(spark.read.text(f"{checkpoint}/metadata").first()["value"])["id"]
        others = [name for name in folder_names(spark, folder) if name.startswith("query=") and name != f"query={query}"]
        if others:
            written = spark.read.schema(f"{key} string").parquet(*[f"{folder}/{name}/*" for name in others])
            fresh = fresh.join(written.distinct(), key, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{folder}/query={query}/batch_id={batch_id}")

    return _start(stream.dropDuplicates([key]), each_batch, checkpoint, "append", every)


def run_snapshots(stream: DataFrame, folder: str, checkpoint: str, every: str | None = "1 second") -> StreamingQuery:
    """Keep the latest state of a small aggregate as a versioned snapshot, at most once per
    trigger; the last state always ends up written."""

    def each_batch(rows: DataFrame, batch_id: int) -> None:
        write_version(rows, folder)
        prune_versions(spark=rows.sparkSession, root=folder)

    return _start(stream, each_batch, checkpoint, "complete", every)


def run_feed(stream: DataFrame, folder: str, checkpoint: str, limit: int, schema: StructType | str, ts: str = "ts", tie: str = "seq", every: str | None = None) -> StreamingQuery:
    """The newest ``limit`` rows seen so far: top-k of the batch merged with the stored top-k."""

    def each_batch(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        order = (F.desc(ts), F.desc(tie))
        newest = rows.orderBy(*order).limit(limit)
        if latest_version(spark, folder):
            newest = newest.unionByName(read_version(spark, folder, schema)).dropDuplicates([tie]).orderBy(*order).limit(limit)
        write_version(newest, folder)
        prune_versions(spark, folder)

    return _start(stream, each_batch, checkpoint, "append", every)
