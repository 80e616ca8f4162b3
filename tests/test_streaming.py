"""Streams against batches, and restarts."""

import datetime
import json

from pyspark.sql import functions as F

from gridscore.sources.files import read_version
from gridscore.streaming import runs as streams

SCHEMA = "seq bigint, ts timestamp, stable_key string, phase string, participant_id string, outcome string"


def log(first, last):
    start = datetime.datetime(2026, 1, 1, tzinfo=datetime.timezone.utc)
    return [(i, start + datetime.timedelta(seconds=i), f"k{i % 7}", ["translation", "judge"][i % 2], f"p{i % 3}", ["success", "failure", "retry"][i % 3]) for i in range(first, last)]


def add(spark, folder, first, last):
    spark.createDataFrame(log(first, last), SCHEMA).coalesce(1).write.mode("append").option("timestampFormat", streams.TIMESTAMP_FORMAT).json(folder)


def test_counters_equal_the_batch_after_a_restart(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / name) for name in ("in", "out", "checkpoint"))
    for first, last in ((0, 20), (20, 50)):
        add(spark, folder, first, last)
        streams.run_updates(streams.counters(streams.event_stream(spark, folder, SCHEMA)), out, checkpoint).awaitTermination()
    key = ["phase", "participant_id"]
    found = {tuple(r[c] for c in (*key, "events", "succeeded", "failed", "retries")) for r in streams.latest_updates(spark, out, key).collect()}
    batch = streams.counters(spark.createDataFrame(log(0, 50), SCHEMA))
    assert found == {tuple(r[c] for c in (*key, "events", "succeeded", "failed", "retries")) for r in batch.collect()}


def test_repeated_keys_are_written_once(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / name) for name in ("in", "out", "checkpoint"))
    for first, last in ((0, 5), (3, 12)):
        add(spark, folder, first, last)
        streams.run_append(streams.event_stream(spark, folder, SCHEMA).select("stable_key"), out, checkpoint).awaitTermination()
    assert sorted(r.stable_key for r in spark.read.parquet(out).collect()) == [f"k{i}" for i in range(7)]
    # A lost checkpoint replays everything; the batches are rewritten, nothing is doubled.
    streams.run_append(streams.event_stream(spark, folder, SCHEMA).select("stable_key"), out, str(tmp_path / "fresh")).awaitTermination()
    assert sorted(r.stable_key for r in spark.read.parquet(out).collect()) == [f"k{i}" for i in range(7)]


def test_feed_keeps_the_newest(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / name) for name in ("in", "out", "checkpoint"))
    for first, last in ((0, 10), (10, 11)):
        add(spark, folder, first, last)
        stream = streams.event_stream(spark, folder, SCHEMA).select("seq", "ts")
        streams.run_feed(stream, out, checkpoint, 3, "seq bigint, ts timestamp").awaitTermination()
    assert sorted(r.seq for r in read_version(spark, out, "seq bigint, ts timestamp").collect()) == [8, 9, 10]


def test_a_first_key_is_kept_however_late(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / name) for name in ("in", "out", "checkpoint"))
    for hour, key in ((12, "a"), (18, "b"), (9, "late-first"), (9, "a")):
        at = datetime.datetime(2026, 1, 1, hour, tzinfo=datetime.timezone.utc)
        row = spark.createDataFrame([(hour, at, key, "judge", "p", "success")], SCHEMA)
        row.coalesce(1).write.mode("append").option("timestampFormat", streams.TIMESTAMP_FORMAT).json(folder)
        streams.run_append(streams.event_stream(spark, folder, SCHEMA).select("stable_key"), out, checkpoint).awaitTermination()
    assert sorted(r.stable_key for r in spark.read.parquet(out).collect()) == ["a", "b", "late-first"]


def test_late_failures_are_counted(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / name) for name in ("in", "out", "checkpoint"))
    schema, late = "ts timestamp, bucket_key string, error_class string", []
    for hour in (12, 18, 9):
        at = datetime.datetime(2026, 1, 1, hour, tzinfo=datetime.timezone.utc)
        row = spark.createDataFrame([(at, "b", "rate_limit")], schema)
        row.coalesce(1).write.mode("append").option("timestampFormat", streams.TIMESTAMP_FORMAT).json(folder)
        query = streams.run_updates(streams.failure_windows(streams.event_stream(spark, folder, schema)), out, checkpoint)
        query.awaitTermination()
        late.append(streams.late_rows(query))
    assert late[:2] == [0, 0] and late[2] > 0


def test_old_snapshots_are_pruned(spark, tmp_path):
    from gridscore.sources.files import folder_names, latest_version, prune_versions, write_version

    root = str(tmp_path / "versions")
    for n in range(6):
        write_version(spark.range(n + 1), root)
    prune_versions(spark, root, keep=2)
    assert latest_version(spark, root) == 6 and read_version(spark, root, "id bigint").count() == 6
    assert sorted(folder_names(spark, root)) == ["committed=5.marker", "committed=6.marker", "version=5", "version=6"]


def test_a_log_of_many_files_keeps_its_order_and_late_failures_fail(spark, tmp_path, monkeypatch):
    import pytest

    from gridscore import fixtures
    from gridscore.plans import streams as plans

    start = datetime.datetime(2026, 1, 1, tzinfo=datetime.timezone.utc)
    rows = [(i, start + datetime.timedelta(hours=i), "b", "rate_limit") for i in range(24)]
    log = spark.createDataFrame(rows, "seq bigint, ts timestamp, bucket_key string, error_class string").repartition(4)
    monkeypatch.setattr(fixtures, "attempts", lambda spark, sf_dir: log)
    folder = plans.staged(spark, "", rows_per_file=8)
    found = plans.failure_windows_of(spark, folder, bytes_per_batch=1)
    assert found.count() == 24 * 6 and {r.failures for r in found.collect()} == {1}
    late = str(tmp_path / "late")
    for hours in (range(12, 18), range(18, 24), range(12)):
        log.where(log.seq.isin(*hours)).coalesce(1).write.mode("append").option("timestampFormat", streams.TIMESTAMP_FORMAT).json(late)
    with pytest.raises(RuntimeError, match="too late"):
        plans.failure_windows_of(spark, late, bytes_per_batch=1)


def failures(spark, folder, *hours):
    for hour in hours:
        at = datetime.datetime(2026, 1, 1, tzinfo=datetime.timezone.utc) + datetime.timedelta(hours=hour)
        row = spark.createDataFrame([(at, "b", "rate_limit"), (at, "b", "other")], "ts timestamp, bucket_key string, error_class string")
        row.coalesce(1).write.mode("append").option("timestampFormat", streams.TIMESTAMP_FORMAT).json(folder)


def test_late_failures_are_corrections(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / name) for name in ("in", "out", "checkpoint"))
    schema = "ts timestamp, bucket_key string, error_class string"
    run = lambda: streams.run_failure_windows(streams.event_stream(spark, folder, schema), out, checkpoint).awaitTermination()
    failures(spark, folder, 1.0)
    run()
    assert streams.corrections(spark, out).count() == 0 and streams.failure_totals(spark, out).count() == 6
    failures(spark, folder, 1.0 + 9 / 60)
    run()
    # Eleven minutes behind the newest event, in the windows of the first: six windows, each of them corrected by one.
    failures(spark, folder, 1.0 - 2 / 60, 1.0)
    run()
    failures(spark, folder, 1.0 + 30 / 60)
    run()
    failures(spark, folder, 1.0)
    run()
    told = streams.corrections(spark, out).collect()
    assert len(told) == 12 and {(r.batch_id, r.added, r.total) for r in told} == {(2, 1, 1), (4, 1, 3)}
    totals = {r.window_start_us: r.failures for r in streams.failure_totals(spark, out).collect()}
    assert len(totals) == 6 * 4 and sorted(totals.values()) == [1] * 18 + [3] * 6


def test_an_ordered_log_is_one_job(spark, tmp_path):
    folder = str(tmp_path / "log")
    rows = spark.createDataFrame([(i, f"k{i}") for i in range(500)], "seq bigint, item string").repartition(4)
    streams.write_ordered_log(rows, folder, "seq", 50)
    parts = sorted((tmp_path / "log").glob("part-*"), key=lambda p: p.stat().st_mtime_ns)
    seen = [json.loads(line)["seq"] for part in parts for line in part.read_text().splitlines()]
    assert seen == list(range(500)) and len(parts) > 40


def test_state_is_kept_outside_the_heap_and_survives_other_partitions(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / name) for name in ("in", "out", "checkpoint"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    kind = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        for partitions, first, last in (("4", 0, 5), ("7", 3, 12)):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            add(spark, folder, first, last)
            query = streams.run_append(streams.event_stream(spark, folder, SCHEMA).select("stable_key"), out, checkpoint)
            query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(r.stable_key for r in spark.read.parquet(out).collect()) == [f"k{i}" for i in range(7)]
    assert any(name.startswith("rocksdb") for name in query.lastProgress.stateOperators[0].customMetrics)
    assert list((tmp_path / "checkpoint" / "state").rglob("*.changelog"))
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == kind
