"""Queries on cost, latency, progress and sample counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridscore import domain, fixtures
from gridscore.functions.keys import split_participant_language
from gridscore.operators import costs, progress, runs
from gridscore.operators.grid import participant_table
from gridscore.operators.validity import group_outcomes
from gridscore.operators.windows import round_robin
from gridscore.plans.common import MORE_PEOPLE, PEOPLE, rounded
from gridscore.plans.registry import query

# Prices in micro dollars per million tokens, so that the check is plain integer arithmetic.
_COST_SQL = """
p AS (SELECT provider, model, i, o FROM (VALUES ('deepseek','deepseek-v4-flash',140000,280000),('openrouter','google/gemini-3.7-flash',375000,1875000),
  ('gemini','gemini-2.5-flash-lite',100000,400000)) v(provider, model, i, o)),
cost AS (SELECT m.*, CAST((input_tokens * i + (output_tokens + coalesce(reasoning_tokens, 0)) * o + 500000) // 1000000 AS BIGINT) / 1000000.0 AS cost_usd
  FROM usage_metrics m LEFT JOIN p USING (provider, model))
"""


@query("g23_call_cost", f"""
WITH {_COST_SQL} SELECT stable_key, ROUND(cost_usd, 6) AS cost_usd, CASE WHEN cost_usd IS NULL THEN 'unknown' ELSE 'estimated' END AS cost_status FROM cost
""")
def g23(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = F.when(F.col("provider") == "openrouter", F.concat("model", F.lit(":batch"))).otherwise(F.col("model"))
    costed = costs.with_cost(fixtures.usage_metrics(spark, sf_dir).withColumn("model", batch))
    return costed.select("stable_key", F.col("cost_usd").cast("double").alias("cost_usd"), "cost_status")


@query("g24_cost_rollup", f"""
WITH {_COST_SQL}, f AS (SELECT * FROM cost)
SELECT 'phase' AS view, phase AS value, ROUND(sum(coalesce(cost_usd, 0)), 6) AS total_cost_usd, count(*) FILTER (cost_usd IS NULL) AS unknown_cost_records FROM f GROUP BY 2
UNION ALL SELECT 'model', model, ROUND(sum(coalesce(cost_usd, 0)), 6), count(*) FILTER (cost_usd IS NULL) FROM f GROUP BY 2
UNION ALL SELECT 'overall', NULL, ROUND(sum(coalesce(cost_usd, 0)), 6), count(*) FILTER (cost_usd IS NULL) FROM f
""")
def g24(spark: SparkSession, sf_dir: str) -> DataFrame:
    costed = costs.with_cost(fixtures.usage_metrics(spark, sf_dir))
    return costs.cost_rollup(costed).withColumn("total_cost_usd", F.col("total_cost_usd").cast("double"))


@query("g25_latency_summary", """
WITH m AS (SELECT stable_key, latency_ms FROM ledger WHERE latency_ms IS NOT NULL QUALIFY row_number() OVER (PARTITION BY stable_key ORDER BY seq DESC) = 1),
r AS (SELECT t.target_language, t.participant_id AS label, coalesce(m.latency_ms, 0) AS l FROM led_translations t LEFT JOIN m USING (stable_key))
SELECT target_language, label, CAST(floor(avg(l) + 0.5) AS BIGINT) AS avg_ms, min(l) AS min_ms, max(l) AS max_ms FROM r GROUP BY GROUPING SETS ((target_language, label), (label))
""")
def g25(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = fixtures.ledger(spark, sf_dir).where("latency_ms IS NOT NULL").select("stable_key", "seq", "latency_ms")
    rows = fixtures.ledger_translations(spark, sf_dir).select("stable_key", "target_language", F.col("participant_id").alias("label"))
    return costs.latency_summary(runs.with_latency(rows, metrics))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rubric scores from -2 to 7; every seventh row was not scored."""
    return fixtures.table(spark, sf_dir, "events").select(
        "event_id", "event_type",
        *[((F.col("event_id") * factor) % 10 - 2).alias(name) for name, factor in zip(costs.RUBRIC, (3, 7, 9, 11))],
    )


_CLAMP = "least(greatest({0}, 1), 5)"
_RUBRIC_SQL = ", ".join(
    f"{_CLAMP.format(f'(event_id * {factor}) % 10 - 2')} AS {name}" for name, factor in zip(costs.RUBRIC, (3, 7, 9, 11))
)


@query("g27_rubric_clamp", f"""
SELECT event_id, accuracy, fluency, tone, format, accuracy + fluency + tone + format AS total FROM (SELECT event_id, {_RUBRIC_SQL} FROM events)
""")
def g27(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = _scores(spark, sf_dir).select("event_id", *[costs.clamped(F.col(name)).alias(name) for name in costs.RUBRIC])
    return scores.withColumn("total", sum((F.col(name) for name in costs.RUBRIC[1:]), F.col(costs.RUBRIC[0])))


@query("g26_rubric_means", f"""
WITH s AS (SELECT event_type, {_RUBRIC_SQL}, event_id % 7 = 0 AS skipped FROM events)
SELECT event_type, {", ".join(f"ROUND(floor(avg({n}) * 100 + 0.5) / 100, 6) AS avg_{n}" for n in costs.RUBRIC)},
  ROUND(floor(avg(accuracy + fluency + tone + format) * 100 + 0.5) / 100, 6) AS avg_total FROM s WHERE NOT skipped GROUP BY 1
""")
def g26(spark: SparkSession, sf_dir: str) -> DataFrame:
    skipped = F.col("event_id") % 7 == 0
    scores = _scores(spark, sf_dir).select(
        "event_type", *[F.when(skipped, 0).otherwise(costs.clamped(F.col(name))).alias(name) for name in costs.RUBRIC]
    ).withColumn("total", sum((F.col(name) for name in costs.RUBRIC[1:]), F.col(costs.RUBRIC[0])))
    return costs.rubric_means(scores, ["event_type"])


@query("g28_count_and_latest", """
SELECT bucket_key, outcome, count(*) AS n, epoch_us(max(ts)) AS latest FROM attempts GROUP BY 1, 2
""")
def g28(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.attempts(spark, sf_dir).groupBy("bucket_key", "outcome").agg(
        F.count(F.lit(1)).alias("n"), F.unix_micros(F.max("ts")).alias("latest")
    )


def _totals(spark: SparkSession, total: int) -> DataFrame:
    phases = F.explode(F.array(*[F.lit(phase) for phase in domain.PHASES]))
    return participant_table(spark, MORE_PEOPLE).select("participant_id", phases.alias("phase"), F.lit(total).cast("bigint").alias("total"))


_PROGRESS_SQL = """
t AS (SELECT phase, participant_id FROM more_people CROSS JOIN (VALUES ('translation'),('judge')) v(phase)),
c AS (SELECT phase, participant_id, count(*) FILTER (outcome IN ('success','failure')) AS completed, count(*) FILTER (outcome = 'success') AS succeeded,
  count(*) FILTER (outcome = 'failure') AS failed, count(*) FILTER (outcome = 'retry') AS retries, epoch_us(max(ts) FILTER (outcome = 'failure')) AS last_failure FROM attempts GROUP BY 1, 2),
g AS (SELECT t.phase, t.participant_id, coalesce(completed, 0) AS completed, coalesce(succeeded, 0) AS succeeded, coalesce(failed, 0) AS failed,
  coalesce(retries, 0) AS retries, greatest(300 - coalesce(completed, 0), 0) AS remaining, last_failure FROM t LEFT JOIN c USING (phase, participant_id))
"""


@query("g29_participant_progress", f"WITH {_PROGRESS_SQL} SELECT * FROM g")
def g29(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = progress.participant_progress(fixtures.attempts(spark, sf_dir), _totals(spark, 300))
    return rows.withColumn("last_failure", F.unix_micros("last_failure_at")).drop("total", "last_failure_at")


@query("g29_final_progress", f"""
WITH {_PROGRESS_SQL} SELECT participant_id, CAST(sum(completed) AS BIGINT) AS completed, CAST(sum(succeeded) AS BIGINT) AS succeeded, CAST(sum(failed) AS BIGINT) AS failed,
  CAST(sum(retries) AS BIGINT) AS retries, CAST(sum(remaining) AS BIGINT) AS remaining, max(last_failure) AS last_failure FROM g GROUP BY 1
""")
def g29_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = progress.participant_progress(fixtures.attempts(spark, sf_dir), _totals(spark, 300))
    final = progress.final_progress(rows)
    return final.withColumn("last_failure", F.unix_micros("last_failure_at")).drop("last_failure_at")


@query("x23_rate_and_eta", """
SELECT participant_id, ROUND(greatest(done - 100, 0) / (ms / 60000.0), 6) AS rate,
  CASE WHEN greatest(done - 100, 0) = 0 THEN 0 ELSE CAST(ceil(greatest(2000 - done, 0) / (greatest(done - 100, 0) / (ms / 60000.0))) AS BIGINT) END AS eta_minutes
FROM (SELECT participant_id, count(*) FILTER (outcome IN ('success','failure')) AS done, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000.0 AS ms FROM attempts GROUP BY 1)
""")
def x23(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates from the event log: 100 items were done before this session."""
    totals = fixtures.attempts(spark, sf_dir).groupBy("participant_id").agg(
        F.count_if(F.col("outcome").isin("success", "failure")).alias("done"),
        ((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1000).alias("ms"),
    )
    rate, eta = progress.rate_and_eta(F.col("done"), F.lit(2000), F.col("ms"), F.lit(100))
    return rounded(totals.select("participant_id", rate.alias("rate"), eta.alias("eta_minutes")), "rate")


def service_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ok and failed counts keyed ``participant::language`` for two runs; p0 and p1 stand for partial services."""
    renamed = F.when(F.col("participant_id") == "p0", "deepl-api").when(F.col("participant_id") == "p1", "deepl-api-nocontext").otherwise(F.col("participant_id"))
    judged = fixtures.judgments(spark, sf_dir)
    lost = F.col("participant_id").isin("p0", "p1") & (F.col("event_id") % 13 < 2)
    counts = judged.where(~lost).groupBy(renamed.alias("participant_id"), "target_language").agg(
        F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") != "ok").alias("failed")
    )
    return counts.select(
        F.explode(F.array(F.lit("main"), F.lit("open"))).alias("run_id"), F.concat("participant_id", F.lit("::"), "target_language").alias("key"), "ok", "failed"
    )


_GROUP_SQL = """
svc AS (SELECT CASE participant_id WHEN 'p0' THEN 'deepl-api' WHEN 'p1' THEN 'deepl-api-nocontext' ELSE participant_id END AS participant_id, target_language,
  count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status <> 'ok') AS failed FROM judgments WHERE NOT (participant_id IN ('p0','p1') AND event_id % 13 < 2) GROUP BY 1, 2)
"""


@query("x30_split_keys", f"WITH {_GROUP_SQL} SELECT concat(participant_id, '::', target_language) AS key, participant_id, target_language AS language FROM svc")
def x30(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = service_groups(spark, sf_dir).where("run_id = 'main'").select("key", split_participant_language("key").alias("k"))
    return rows.select("key", "k.participant_id", "k.language")


def run_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest participants of the two runs, with provider and display name."""
    ids = service_groups(spark, sf_dir).select("run_id", split_participant_language("key")["participant_id"].alias("participant_id")).distinct()
    return ids.select(
        "*", F.when(F.col("participant_id").startswith("deepl"), "deepl").otherwise("llamacpp").alias("provider"),
        F.concat(F.lit("Name "), "participant_id").alias("display_name"),
    )


def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of the two runs: one with an item limit and unresolved cells, one without either."""
    sizes = fixtures.cells(spark, sf_dir).agg(F.count_distinct("source_id").cast("bigint").alias("n"))
    main = sizes.select(
        F.lit("main").alias("run_id"), F.col("n").alias("limit_applied"), F.lit(3).alias("languages"), F.lit(7).cast("bigint").alias("unresolved_total"),
        F.lit(False).alias("benchmark_valid"), F.lit(True).alias("reuse_only"), F.lit("").alias("validity_note"),
    )
    other = sizes.select(
        F.lit("open").alias("run_id"), F.lit(None).cast("bigint").alias("limit_applied"), F.lit(3).alias("languages"), F.lit(None).cast("bigint").alias("unresolved_total"),
        F.lit(True).alias("benchmark_valid"), F.lit(False).alias("reuse_only"), F.lit(None).cast("string").alias("validity_note"),
    )
    return main.unionByName(other)


_COUNTS_SQL = _GROUP_SQL + """,
sums AS (SELECT participant_id, CAST(sum(ok) AS BIGINT) AS valid, CAST(sum(failed) AS BIGINT) AS failed FROM svc GROUP BY 1),
lim AS (SELECT count(DISTINCT source_id) * 3 AS planned FROM cells),
counts AS (SELECT 'main' AS run_id, participant_id, valid, failed, CASE WHEN participant_id LIKE 'deepl%' THEN 7 ELSE greatest(planned - valid - failed, 0) END AS unresolved, planned AS expected FROM sums, lim
  UNION ALL SELECT 'open', participant_id, valid, failed, 0, valid + failed FROM sums)
"""


@query("g30_sample_counts", f"WITH {_COUNTS_SQL} SELECT * FROM counts")
def g30(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = run_status(spark, sf_dir).select("run_id", "limit_applied", "languages", "unresolved_total")
    return progress.sample_counts(service_groups(spark, sf_dir), run_people(spark, sf_dir), status)


@query("g31_partial_service_gap", f"""
WITH {_GROUP_SQL}, e AS (SELECT target_language, max(ok + failed) AS expected FROM svc GROUP BY 1),
g AS (SELECT CAST(sum(greatest(e.expected - (s.ok + s.failed), 0)) AS BIGINT) AS unresolved FROM svc s JOIN e USING (target_language) WHERE participant_id LIKE 'deepl%')
SELECT unresolved, CASE WHEN unresolved > 0 THEN concat('DeepL variants had ', CAST(unresolved AS VARCHAR), ' unresolved translation ',
  CASE WHEN unresolved = 1 THEN 'failure' ELSE 'failures' END, ' combined; bars reflect scored samples only.') END AS footnote FROM g
""")
def g31(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = service_groups(spark, sf_dir).where("run_id = 'main'")
    return progress.footnote(progress.partial_service_gap(groups))


@query("o1_recent_events", "SELECT seq, outcome FROM attempts WHERE outcome = 'retry' ORDER BY ts DESC, seq DESC LIMIT 10")
def o1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.recent_events(fixtures.attempts(spark, sf_dir).where("outcome = 'retry'"), 10).select("seq", "outcome")


@query("o2_recent_failures", """
WITH ev AS (SELECT item_key AS stable_key, ts, seq, error_class, 'event' AS origin FROM attempts WHERE outcome = 'failure' AND seq % 2 = 0),
rec AS (SELECT item_key AS stable_key, ts, seq, error_class, 'record' AS origin FROM attempts WHERE outcome = 'failure' AND seq % 2 = 1 AND user_is_odd)
SELECT stable_key, seq, error_class, origin FROM (SELECT * FROM ev UNION ALL SELECT * FROM rec WHERE stable_key NOT IN (SELECT stable_key FROM ev)) ORDER BY ts DESC, seq DESC LIMIT 5
""".replace(" AND user_is_odd", ""))
def o2(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = fixtures.attempts(spark, sf_dir).where("outcome = 'failure'").withColumnRenamed("item_key", "stable_key")
    recent = progress.recent_failures(failed.where("seq % 2 = 0"), failed.where("seq % 2 = 1"))
    return recent.select("stable_key", "seq", "error_class", "origin")


@query("o5_focus_list", """
WITH s AS (SELECT item_key AS participant_id, CAST(substring(item_key, 2) AS BIGINT) AS ord, count(*) FILTER (outcome = 'recovered') % 9 AS r,
  count(*) FILTER (outcome = 'failure') AS failed, max(ts) FILTER (outcome = 'failure') AS last_failure_at,
  greatest(100 - count(*), 0) AS remaining FROM attempts GROUP BY 1, 2),
b AS (SELECT participant_id, 0 AS branch, ord + 1 AS place FROM s WHERE r = 8
  UNION ALL SELECT * FROM (SELECT participant_id, 1, row_number() OVER (ORDER BY last_failure_at DESC NULLS LAST, failed DESC, ord) AS place FROM s WHERE failed > 0) WHERE place <= 10
  UNION ALL SELECT * FROM (SELECT participant_id, 2, row_number() OVER (ORDER BY remaining DESC, ord) AS place FROM s WHERE remaining > 0) WHERE place <= 5)
SELECT participant_id, CAST(branch AS BIGINT) AS branch, place FROM b QUALIFY row_number() OVER (PARTITION BY participant_id ORDER BY branch, place) = 1
""")
def o5(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapshots = fixtures.attempts(spark, sf_dir).groupBy(F.col("item_key").alias("participant_id")).agg(
        (F.count_if(F.col("outcome") == "recovered") % 9 == 8).cast("int").alias("inflight"),
        F.count_if(F.col("outcome") == "failure").alias("failed"),
        F.max(F.when(F.col("outcome") == "failure", F.col("ts"))).alias("last_failure_at"),
        F.greatest(100 - F.count(F.lit(1)), F.lit(0)).alias("remaining"),
    )
    snapshots = snapshots.withColumn("ord", F.substring("participant_id", F.lit(2), F.length("participant_id")).cast("bigint"))
    return progress.focus_list(snapshots, 10).select("participant_id", F.col("branch").cast("bigint").alias("branch"), F.col("place").cast("bigint").alias("place"))


@query("w9_round_robin", """
SELECT bucket_key, participant_id, seq, row_number() OVER (PARTITION BY bucket_key ORDER BY round, ord) AS position
FROM (SELECT *, row_number() OVER (PARTITION BY bucket_key, participant_id ORDER BY seq) AS round, CAST(substring(participant_id, 2) AS INT) AS ord FROM attempts)
""")
def w9(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.attempts(spark, sf_dir).select("bucket_key", "participant_id", "seq").withColumn("ord", F.substring("participant_id", F.lit(2), F.length("participant_id")).cast("int"))
    return round_robin(rows, ["bucket_key"], "participant_id", "ord", "seq").select("bucket_key", "participant_id", "seq", "position")
