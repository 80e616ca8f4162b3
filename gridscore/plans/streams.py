"""Queries that run files and streams: what is written is derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridscore import domain, fixtures
from gridscore.functions.annotations import parse_annotation
from gridscore.operators import annotate as annotating
from gridscore.operators import runs
from gridscore.operators.items import runtime_items, scaffold_problems
from gridscore.operators.normalize import normalize, repair
from gridscore.plans.annotations import METADATA, parsed
from gridscore.plans.common import spread
from gridscore.plans.items import batches, scaffold
from gridscore.plans.registry import query
from gridscore.session import scratch_path
from gridscore.sources import files
from gridscore.streaming import runs as streams

_EVENT = "seq bigint, ts timestamp, item_key string, bucket_key string, participant_id string, phase string, outcome string, error_class string, latency_ms bigint"


#: A micro-batch takes files of about this size together, however many they are.
BYTES_PER_BATCH = 128 << 20


#: About the bytes of an event as JSON, and of a file of events.
EVENT_BYTES, FILE_BYTES = 256, 32 << 20


def staged(spark: SparkSession, sf_dir: str, rows_per_file: int = FILE_BYTES // EVENT_BYTES) -> str:
    """The event log as JSON files in a shared folder whose age follows the log."""
    path = scratch_path(spark, "events")
    log = fixtures.attempts(spark, sf_dir)
    streams.write_ordered_log(log, path, "seq", -(-log.count() // rows_per_file))
    return path


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    return streams.event_stream(spark, folder, _EVENT, bytes_per_batch=BYTES_PER_BATCH)


@query("s1_jsonl_scan", "SELECT stable_key, participant_id, seq, error_class FROM run_failures")
def s1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures appended as JSON lines and scanned; a file that never existed adds nothing."""
    path = scratch_path(spark, "failures")
    schema = "stable_key string, participant_id string, seq bigint, error_class string"
    files.append_jsonl(fixtures.run_failures(spark, sf_dir).select("stable_key", "participant_id", "seq", "error_class"), path)
    return files.read_jsonl(spark, path, schema).unionByName(files.read_jsonl(spark, scratch_path(spark, "absent"), schema))


@query("s2_json_array_scan", "SELECT sample_id, mode AS speaker_mode, CAST(n_turns AS BIGINT) AS turns, array_to_string(prior_roles, ',') AS roles FROM item_rows")
def s2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items written as array documents of about ten thousand items each, and read back."""
    path = scratch_path(spark, "dataset")
    entry = F.struct("sampleId", "speakerMode", "contextTurns")
    items = runtime_items(fixtures.authored_items(spark, sf_dir))
    # A document holds the items of 5,000 conversations, so the number of documents grows with the data.
    part = F.floor(F.regexp_extract("sampleId", r"\d+", 0).cast("bigint") / 5_000)
    arrays = items.groupBy(part.alias("part")).agg(F.to_json(F.collect_list(entry)).alias("value"))
    arrays.write.partitionBy("part").text(path)
    turn = "struct<speakerRole:string,relativeTimeLabel:string,sourceText:string>"
    rows = files.read_json_array(spark, path, f"sampleId string, speakerMode string, contextTurns array<{turn}>")
    return rows.select(F.col("sampleId").alias("sample_id"), F.col("speakerMode").alias("speaker_mode"), F.size("contextTurns").cast("bigint").alias("turns"), F.array_join("contextTurns.speakerRole", ",").alias("roles"))


@query("s2_large_json_array", "SELECT sample_id, mode AS speaker_mode, CAST(n_turns AS BIGINT) AS turns, array_to_string(prior_roles, ',') AS roles FROM item_rows")
def s2_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same documents with every item over several lines, read by file splits."""
    path = scratch_path(spark, "dataset")
    items = runtime_items(fixtures.authored_items(spark, sf_dir))
    part = F.floor(F.regexp_extract("sampleId", r"\d+", 0).cast("bigint") / 5_000)
    text = lambda value: F.regexp_replace(F.to_json(F.array(value)), r"^\[|\]$", "")
    entry = F.concat(F.lit('{"sampleId":'), text(F.col("sampleId")), F.lit(',\n  "speakerMode": '), text(F.col("speakerMode")), F.lit(',\n  "contextTurns":'), F.to_json("contextTurns"), F.lit("\n}"))
    arrays = items.groupBy(part.alias("part")).agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list(entry), ",\n"), F.lit("\n]")).alias("value"))
    arrays.write.partitionBy("part").text(path)
    turn = "struct<speakerRole:string,relativeTimeLabel:string,sourceText:string>"
    rows = files.read_large_json_array(spark, path, f"sampleId string, speakerMode string, contextTurns array<{turn}>")
    return rows.select(F.col("sampleId").alias("sample_id"), F.col("speakerMode").alias("speaker_mode"), F.size("contextTurns").cast("bigint").alias("turns"), F.array_join("contextTurns.speakerRole", ",").alias("roles"))


_BATCH_SQL = """
SELECT sample_id, concat('ctx', CAST(n_turns AS VARCHAR), '-', mode, '-batch-', CASE WHEN b < 10 THEN '0' ELSE '' END, CAST(b AS VARCHAR)) AS batch_id
FROM (SELECT *, CAST(floor((row_number() OVER (PARTITION BY n_turns, mode ORDER BY conv_id, turn) - 1) / 12) AS BIGINT) + 1 AS b FROM item_rows)
"""


@query("s3_batch_folder_scan", _BATCH_SQL)
def s3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of twelve items written as one object per line, flattened again."""
    path = scratch_path(spark, "batches")
    numbered = batches(fixtures.items(spark, sf_dir), 12)
    grouped = numbered.groupBy(F.col("batch_id").alias("batchId")).agg(F.sort_array(F.collect_list(F.struct("ord", "sampleId"))).alias("items"))
    items = F.transform("items", lambda i: F.struct(i["sampleId"].alias("sampleId")))
    grouped.select(F.lit("set").alias("datasetId"), "batchId", items.alias("items")).write.json(path)
    return files.read_batches(spark, path, "struct<sampleId:string>", multi_line=False).select(F.col("sampleId").alias("sample_id"), F.col("batchId").alias("batch_id"))


@query("s6_append_sink", "SELECT participant_id, 2 * count(*) AS n, 2 * count(latency_ms) AS with_latency FROM attempts GROUP BY 1")
def s6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log appended twice; null latencies are written as nulls."""
    path = scratch_path(spark, "append")
    rows = fixtures.attempts(spark, sf_dir).select("participant_id", "latency_ms")
    files.append_jsonl(rows, path)
    files.append_jsonl(rows, path)
    back = files.read_jsonl(spark, path, "participant_id string, latency_ms bigint")
    return back.groupBy("participant_id").agg(F.count(F.lit(1)).alias("n"), F.count("latency_ms").alias("with_latency"))


@query("s7_rewrite_with_backup", """
SELECT 1 AS version, count(*) AS n, count(*) FILTER (status = 'ok' AND event_id % 4 <> 0) AS ok FROM judgments
UNION ALL SELECT 2, count(*), count(*) FILTER (status = 'ok') FROM judgments
""")
def s7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repaired judgments become version 2; version 1 stays as the backup; repairing again writes nothing."""
    root = scratch_path(spark, "judgments")
    rows = parsed(spark, sf_dir).select("stable_key", "raw_judge_output", "event_id", "status", "errors", "summary", "context_behavior", *METADATA, "problem")
    lost = F.col("event_id") % 4 == 0
    stored = rows.withColumn("status", F.when(lost, "judge_failed").otherwise(F.col("status"))).withColumn("summary", F.when(~lost, F.col("summary")))
    schema = stored.schema
    files.write_version(stored, root)
    files.rewrite_repaired(repair(files.read_version(spark, root, schema)), root)
    if files.rewrite_repaired(repair(files.read_version(spark, root, schema)), root) is not None:
        raise RuntimeError("nothing was left to repair")
    both = [files.read_version(spark, root, schema, n).select(F.lit(n).cast("bigint").alias("version"), "status") for n in (1, 2)]
    return both[0].unionByName(both[1]).groupBy("version").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "ok").alias("ok"))


@query("s7_pruned_failures", """
SELECT 1 AS version, count(*) AS n FROM judgments WHERE event_id % 4 = 0 OR status <> 'ok'
UNION ALL SELECT 2, count(*) FROM judgments WHERE status <> 'ok'
""")
def s7_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failure rows of repaired keys go with the same rewrite; the version before is kept."""
    root, failure_root = scratch_path(spark, "judgments"), scratch_path(spark, "failures")
    rows = parsed(spark, sf_dir).select("stable_key", "raw_judge_output", "event_id", "status", "errors", "summary", "context_behavior", *METADATA, "problem")
    lost = F.col("event_id") % 4 == 0
    stored = rows.withColumn("status", F.when(lost, "judge_failed").otherwise(F.col("status"))).withColumn("summary", F.when(~lost, F.col("summary")))
    files.write_version(stored, root)
    kept = files.read_version(spark, root, stored.schema)
    files.write_version(kept.where("status <> 'ok'").select("stable_key", "event_id"), failure_root)
    schema = "stable_key string, event_id bigint"
    files.rewrite_repaired(repair(kept), root, files.read_version(spark, failure_root, schema), failure_root)
    both = [files.read_version(spark, failure_root, schema, n).select(F.lit(n).cast("bigint").alias("version")) for n in (1, 2)]
    return both[0].unionByName(both[1]).groupBy("version").agg(F.count(F.lit(1)).alias("n"))


@query("s11_event_log_source", "SELECT phase, outcome, count(*) AS n FROM attempts GROUP BY 1, 2")
def s11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log read as a stream of files and stored batch by batch."""
    folder, out = staged(spark, sf_dir), scratch_path(spark, "log")
    stream = event_stream(spark, folder).select("phase", "outcome", "seq")
    streams.run_updates(stream, out, scratch_path(spark, "checkpoint"), mode="append").awaitTermination()
    return spark.read.parquet(out).groupBy("phase", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query("s13_scaffold_sink", _BATCH_SQL)
def s13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches written to folders; a second try over edited items is refused, by force it is not."""
    root = scratch_path(spark, "scaffold")
    numbered = batches(fixtures.items(spark, sf_dir), 12).select("sampleId", "batch_id", F.regexp_replace("batch_id", "-batch-.*", "").alias("bucket"))
    files.write_scaffold(numbered, None, root, by="bucket")
    try:
        files.write_scaffold(numbered, scaffold(spark, sf_dir), root, by="bucket")
    except ValueError:
        files.write_scaffold(numbered, scaffold(spark, sf_dir), root, force=True, by="bucket")
    else:
        raise RuntimeError("edited batches were overwritten")
    return spark.read.schema("sampleId string, batch_id string").json(root).select(F.col("sampleId").alias("sample_id"), "batch_id")


@query("s13_scaffold_set", f"""
SELECT b.sample_id, b.batch_id, CAST(i.n_turns AS BIGINT) AS turns, 'todo' AS status, number % 3 <> 0 AS edited FROM ({_BATCH_SQL}) b JOIN item_rows i USING (sample_id)
""")
def s13_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest and batches written, written again while untouched, refused once authors have filled items."""
    root = scratch_path(spark, "scaffold-set")

    def numbered(items: DataFrame) -> DataFrame:
        placed = batches(items.select("*", "locked.contextTurnCount", "locked.speakerMode"), 12)
        return placed.select("sampleId", "locked", "status", "fill", "batch_id", "bucket")

    plan, edited = numbered(scaffold(spark, sf_dir, filled=False)), numbered(scaffold(spark, sf_dir))
    files.write_scaffold_set(plan, root, "context", by="bucket")
    files.write_scaffold_set(plan, root, "context", by="bucket")
    manifest = files.read_scaffold(spark, root, "manifest", "sampleId string, batch_id string, locked struct<contextTurnCount:bigint>")
    untouched = files.read_scaffold(spark, root, "batches", "sampleId string, status string")
    files.write_scaffold_set(edited, root, "context", force=True, by="bucket")
    try:
        files.write_scaffold_set(plan, root, "context", by="bucket")
    except ValueError:
        problems = scaffold_problems(files.read_scaffold(spark, root, "batches", plan.schema), plan)
    else:
        raise RuntimeError("edited batches were overwritten")
    marked = manifest.join(untouched, "sampleId").join(problems, "sampleId", "left")
    return marked.select(F.col("sampleId").alias("sample_id"), "batch_id", F.col("locked.contextTurnCount").alias("turns"), "status", F.col("problem").eqNullSafe(F.lit("not pristine")).alias("edited"))


_COUNTER_SQL = """count(*) AS events, count(*) FILTER (outcome = 'success') AS succeeded, count(*) FILTER (outcome = 'failure') AS failed, count(*) FILTER (outcome = 'retry') AS retries"""


@query("t1_running_counters", f"SELECT phase, participant_id, {_COUNTER_SQL} FROM attempts GROUP BY 1, 2")
def t1(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, out = staged(spark, sf_dir), scratch_path(spark, "counters")
    streams.run_updates(streams.counters(event_stream(spark, folder)), out, scratch_path(spark, "checkpoint")).awaitTermination()
    return streams.latest_updates(spark, out, ["phase", "participant_id"])


@query("t2_idempotent_append", "SELECT DISTINCT item_key AS stable_key FROM attempts")
def t2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that come back in every micro-batch are stored once."""
    folder, out = staged(spark, sf_dir), scratch_path(spark, "keys")
    keyed = event_stream(spark, folder).select(F.col("item_key").alias("stable_key"))
    streams.run_append(keyed, out, scratch_path(spark, "checkpoint")).awaitTermination()
    return spark.read.parquet(out).select("stable_key")


@query("t3_snapshot", f"SELECT phase, {_COUNTER_SQL} FROM attempts GROUP BY 1")
def t3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State snapshots at most once a second; all input is drained before the last one is read."""
    folder, out = staged(spark, sf_dir), scratch_path(spark, "snapshot")
    running = streams.run_snapshots(streams.counters(event_stream(spark, folder), ["phase"]), out, scratch_path(spark, "checkpoint"), every="1 second")
    running.processAllAvailable()
    running.stop()
    return files.read_version(spark, out, "phase string, events bigint, succeeded bigint, failed bigint, retries bigint")


_WINDOW_SQL = """
WITH f AS (SELECT bucket_key, CAST(floor(epoch_us(ts) / 10000000) AS BIGINT) * 10000000 AS slot FROM attempts WHERE error_class IN ('rate_limit', 'server_overload'))
SELECT bucket_key, slot - k * 10000000 AS window_start_us, count(*) AS failures FROM f, (VALUES (0),(1),(2),(3),(4),(5)) v(k) GROUP BY 1, 2
"""


@query("t4_failure_windows", _WINDOW_SQL)
def t4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sliding minutes; the update with the highest batch holds the final count of a window. Rows too late for theirs are an error."""
    return failure_windows_of(spark, staged(spark, sf_dir), BYTES_PER_BATCH)


@query("t4_late_failures", f"""
WITH w AS ({_WINDOW_SQL}), half AS (SELECT *, seq % 5 = 0 AS held FROM attempts),
clock AS (SELECT max(epoch_us(ts)) FILTER (NOT held) AS newest FROM half),
l AS (SELECT bucket_key, CAST(floor(epoch_us(ts) / 10000000) AS BIGINT) * 10000000 AS slot FROM half WHERE held AND error_class IN ('rate_limit', 'server_overload')),
c AS (SELECT bucket_key, slot - k * 10000000 AS window_start_us, count(*) AS corrected FROM l, clock, (VALUES (0),(1),(2),(3),(4),(5)) v(k) WHERE slot - k * 10000000 + 60000000 <= newest - 600000000 GROUP BY 1, 2)
SELECT bucket_key, window_start_us, failures, coalesce(corrected, 0) AS corrected FROM w LEFT JOIN c USING (bucket_key, window_start_us)
""")
def t4_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fifth of the log comes after all of the rest: windows are whole, and those that had ended are corrected."""
    folder, out, checkpoint = scratch_path(spark, "events"), scratch_path(spark, "windows"), scratch_path(spark, "checkpoint")
    log = fixtures.attempts(spark, sf_dir)
    for held in (F.col("seq") % 5 != 0, F.col("seq") % 5 == 0):
        log.where(held).write.mode("append").option("timestampFormat", streams.TIMESTAMP_FORMAT).json(folder)
        # The first run takes all files of the first write in one micro-batch, so that what is late does not hang on their order.
        streams.run_failure_windows(streams.event_stream(spark, folder, _EVENT), out, checkpoint).awaitTermination()
    told = streams.corrections(spark, out).groupBy("bucket_key", "window_start_us").agg(F.sum("added").alias("corrected"))
    rows = streams.failure_totals(spark, out).join(told, ["bucket_key", "window_start_us"], "left")
    return rows.select("bucket_key", "window_start_us", "failures", F.coalesce("corrected", F.lit(0)).alias("corrected"))


def failure_windows_of(spark: SparkSession, folder: str, bytes_per_batch: int) -> DataFrame:
    out = scratch_path(spark, "windows")
    windows = streams.failure_windows(streams.event_stream(spark, folder, _EVENT, bytes_per_batch=bytes_per_batch))
    late = streams.late_rows_to_the_end(spark, lambda: streams.run_updates(windows, out, scratch_path(spark, "checkpoint")))
    if late:
        raise RuntimeError(f"{late} rows came too late for their windows")
    return streams.latest_updates(spark, out, ["bucket_key", "window_start_us"])


@query("t5_cooldown_state", """
SELECT bucket_key, max(epoch_us(ts) + CASE error_class WHEN 'rate_limit' THEN 30000 ELSE 45000 END * 1000) AS cooldown_until_us
FROM attempts WHERE error_class IN ('rate_limit', 'server_overload') GROUP BY 1
""")
def t5(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, out = staged(spark, sf_dir), scratch_path(spark, "cooldown")
    delay = F.when(F.col("error_class") == "rate_limit", 30000).when(F.col("error_class") == "server_overload", 45000)
    streams.run_updates(streams.cooldown_ends(event_stream(spark, folder), delay), out, scratch_path(spark, "checkpoint")).awaitTermination()
    return streams.latest_updates(spark, out, ["bucket_key"])


@query("t6_recent_failures_feed", "SELECT seq, item_key, error_class FROM attempts WHERE outcome = 'failure' ORDER BY ts DESC, seq DESC LIMIT 5")
def t6(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, out = staged(spark, sf_dir), scratch_path(spark, "feed")
    failures = event_stream(spark, folder).where("outcome = 'failure'").select("seq", "ts", "item_key", "error_class")
    schema = "seq bigint, ts timestamp, item_key string, error_class string"
    streams.run_feed(failures, out, scratch_path(spark, "checkpoint"), 5, schema).awaitTermination()
    return files.read_version(spark, out, schema).select("seq", "item_key", "error_class")


@query("t7_resume", "SELECT DISTINCT concat(item_key, '-', CAST(seq % 7 AS VARCHAR)) AS stable_key FROM attempts")
def t7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first run handles half of the log; the second goes on from its checkpoint and output."""
    folder, out, checkpoint = scratch_path(spark, "events"), scratch_path(spark, "done"), scratch_path(spark, "checkpoint")
    log = fixtures.attempts(spark, sf_dir)
    for half in (0, 1):
        log.where(F.col("seq") % 4 >= 2 if half else F.col("seq") % 4 < 2).write.mode("append").option("timestampFormat", streams.TIMESTAMP_FORMAT).json(folder)
        keys = event_stream(spark, folder).select(F.concat("item_key", F.lit("-"), (F.col("seq") % 7).cast("string")).alias("stable_key"))
        streams.run_append(keys, out, checkpoint).awaitTermination()
    return spark.read.parquet(out).select("stable_key")


@query("f1_annotate_pending", """
SELECT stable_key, CASE WHEN event_id % 10 = 1 THEN 'judge_failed' ELSE 'ok' END AS status, event_id % 10 = 1 AS failed,
  CASE WHEN event_id % 10 <> 1 THEN CASE WHEN event_id % 2 = 0 THEN 5 ELSE 1 END END AS total_penalty FROM judgments WHERE event_id % 3 <> 0
""")
def f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in annotator over pending cells: it fails on some rows, which become failed rows."""

    def annotator(row: dict) -> str:
        if row["event_id"] % 10 == 1:
            raise ValueError("no answer")
        line = 'Major:\nother - "x"' if row["event_id"] % 2 == 0 else 'Minor:\nother - "x"'
        return f"Critical:\nno-error\n{line}\ncontextBehavior: unclear"

    judged = fixtures.judgments(spark, sf_dir)
    # Annotators are slow per row: an explicit number of partitions is not merged by size. They are
    # partitioned by the key of the anti join, which then needs no shuffle of its own.
    slots = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cells = judged.select("stable_key", "event_id", *METADATA).repartition(slots, "stable_key")
    pending = runs.pending(cells, judged.where("event_id % 3 = 0"))
    raw = annotating.annotate(pending, annotator, ["event_id"])
    scored = normalize(raw.select("*", *[F.lit(None).cast("int" if name == "context_turn_count" else "string").alias(name) for name in METADATA]))
    return scored.select("stable_key", "status", F.col("error").isNotNull().alias("failed"), F.col("summary.total_penalty").alias("total_penalty"))


@query("f2_sql_functions", """
SELECT event_id, concat(run_id, '::', source_id, '::', target_language, '::', participant_id) AS k, CASE WHEN status = 'ok' THEN 25 * critical_count + 5 * major_count + minor_count ELSE 0 END AS penalty,
  ROUND(levenshtein(CASE WHEN speaker_mode = 'single' THEN 'sngle' ELSE 'dyadics' END, speaker_mode) * 1.0 / length(speaker_mode), 6) AS cer FROM cells
""")
def f2(spark: SparkSession, sf_dir: str) -> DataFrame:
    annotating.register_sql_functions(spark)
    parsed(spark, sf_dir).select("event_id", "run_id", "source_id", "target_language", "participant_id", "errors", "speaker_mode").createOrReplaceTempView("gridscore_parsed")
    return spark.sql("""
        SELECT event_id, cell_key(run_id, source_id, target_language, participant_id) AS k, annotation_penalty(errors) AS penalty,
          round(character_error_rate(speaker_mode, CASE WHEN speaker_mode = 'single' THEN ' sngle' ELSE 'dyadics ' END), 6) AS cer
        FROM gridscore_parsed""")


@query("f2_sql_parse", """
SELECT stable_key, status = 'ok' AS readable, CASE WHEN status = 'ok' THEN context_behavior END AS behavior,
  CASE WHEN status = 'ok' THEN CAST(critical_count + major_count + minor_count AS BIGINT) END AS errors,
  CASE WHEN status = 'ok' THEN CAST(25 * critical_count + 5 * major_count + minor_count AS BIGINT) END AS penalty
FROM judgments
""")
def f2_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw texts read and scored in SQL alone."""
    annotating.register_sql_functions(spark)
    spread(fixtures.judgments(spark, sf_dir).select("stable_key", "raw_judge_output")).createOrReplaceTempView("gridscore_texts")
    return spark.sql("""
        SELECT stable_key, p.problem IS NULL AS readable, CASE WHEN p.problem IS NULL THEN p.behavior END AS behavior,
          CASE WHEN p.problem IS NULL THEN CAST(size(p.errors) AS BIGINT) END AS errors, CASE WHEN p.problem IS NULL THEN annotation_penalty(p.errors) END AS penalty
        FROM (SELECT stable_key, parse_annotation(raw_judge_output) AS p FROM gridscore_texts)""")


@query("f3_error_table_function", """
SELECT error_class, severity, CAST(sum(n) AS BIGINT) AS errors FROM (
  SELECT 'accuracy/mistranslation' AS error_class, 'critical' AS severity, critical_count AS n FROM judgments WHERE status = 'ok'
  UNION ALL SELECT 'fluency/register', 'major', major_count FROM judgments WHERE status = 'ok'
  UNION ALL SELECT 'style/awkward', 'minor', minor_count FROM judgments WHERE status = 'ok') e GROUP BY 1, 2
""")
def f3(spark: SparkSession, sf_dir: str) -> DataFrame:
    annotating.register_error_table_function(spark)
    spread(fixtures.judgments(spark, sf_dir).select("raw_judge_output")).createOrReplaceTempView("gridscore_raw")
    return spark.sql("""
        SELECT e.class AS error_class, e.severity, count(*) AS errors
        FROM gridscore_raw r, LATERAL annotation_errors(r.raw_judge_output) e GROUP BY 1, 2""")


@query("f3_native_explode", """
SELECT error_class, severity, CAST(sum(n) AS BIGINT) AS errors FROM (
  SELECT 'accuracy/mistranslation' AS error_class, 'critical' AS severity, critical_count AS n FROM judgments WHERE status = 'ok'
  UNION ALL SELECT 'fluency/register', 'major', major_count FROM judgments WHERE status = 'ok'
  UNION ALL SELECT 'style/awkward', 'minor', minor_count FROM judgments WHERE status = 'ok') e GROUP BY 1, 2
""")
def f3_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same table by ``explode``: the path without Python."""
    rows = spread(fixtures.judgments(spark, sf_dir)).select(parse_annotation(F.col("raw_judge_output")).alias("p"))
    good = rows.select(F.explode_outer(F.when(F.col("p.problem").isNull(), F.col("p.errors"))).alias("e"))
    return good.groupBy(F.col("e.class").alias("error_class"), F.col("e.severity").alias("severity")).agg(F.count("e").alias("errors")).where("severity IS NOT NULL")
