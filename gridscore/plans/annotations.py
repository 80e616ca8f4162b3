"""Queries that read raw annotation texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridscore import fixtures
from gridscore.functions.annotations import (
    is_complete_annotation,
    parse_annotation,
    parse_response,
    penalty,
    severity_count,
)
from gridscore.operators import reports
from gridscore.operators.normalize import METADATA, flatten_summary, has_metadata, normalize, remaining_failures, repair
from gridscore.plans.common import MORE_PEOPLE, rounded, spread
from gridscore.plans.registry import query
from gridscore.plans.reports import parsed


@query("flagship_language_ranking", """
WITH b AS (SELECT l.target_language, p.participant_id, avg(j.total_penalty) AS m,
    count(*) FILTER (j.status = 'ok') AS samples, count(*) FILTER (j.status = 'judge_failed') AS failed_samples
  FROM langs l CROSS JOIN more_people p LEFT JOIN judgments j USING (target_language, participant_id) GROUP BY 1, 2)
SELECT target_language, participant_id, ROUND(m, 6) AS mean_penalty, samples, failed_samples,
  row_number() OVER (PARTITION BY target_language ORDER BY m ASC NULLS LAST, participant_id) AS rank FROM b
""")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw texts to a ranked leaderboard per language."""
    judgments = flatten_summary(parsed(spark, sf_dir))
    board = reports.language_leaderboard(judgments, MORE_PEOPLE)
    order = Window.partitionBy("target_language").orderBy(F.col("mean_penalty").asc_nulls_last(), "participant_id")
    ranked = board.withColumn("rank", F.row_number().over(order).cast("bigint"))
    return rounded(
        ranked.select("target_language", "participant_id", "mean_penalty", "samples", "failed_samples", "rank"), "mean_penalty"
    )


@query("x1_penalty", """
SELECT stable_key, CASE WHEN status = 'ok' THEN total_penalty ELSE 0 END AS penalty,
  CASE WHEN status = 'ok' THEN CAST(critical_count AS BIGINT) ELSE 0 END AS critical,
  CASE WHEN status = 'ok' THEN CAST(major_count AS BIGINT) ELSE 0 END AS major,
  CASE WHEN status = 'ok' THEN CAST(minor_count AS BIGINT) ELSE 0 END AS minor FROM judgments
""")
def x1(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = parsed(spark, sf_dir).select("stable_key", "errors")
    return errors.select(
        "stable_key",
        penalty(F.col("errors")).alias("penalty"),
        *[severity_count(F.col("errors"), name).cast("bigint").alias(name) for name in ("critical", "major", "minor")],
    )


@query("x2_parse_text", """
SELECT stable_key, status = 'ok' AS readable, CASE WHEN status = 'ok' THEN context_behavior END AS behavior,
  CASE WHEN status = 'ok' THEN CAST(critical_count + major_count + minor_count AS BIGINT) END AS errors,
  CASE WHEN status = 'ok' THEN concat(repeat('critical accuracy/mistranslation x;', critical_count),
    repeat('major fluency/register y;', major_count), repeat('minor style/awkward z;', minor_count)) END AS listing
FROM judgments
""")
def x2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(fixtures.judgments(spark, sf_dir)).select("stable_key", parse_annotation(F.col("raw_judge_output")).alias("p"))
    ok = F.col("p.problem").isNull()
    line = lambda e: F.concat(F.concat_ws(" ", e["severity"], e["class"], e["target_span_text"]), F.lit(";"))
    return rows.select(
        "stable_key",
        ok.alias("readable"),
        F.when(ok, F.col("p.behavior")).alias("behavior"),
        F.when(ok, F.size("p.errors").cast("bigint")).alias("errors"),
        F.when(ok, F.array_join(F.transform("p.errors", line), "")).alias("listing"),
    )


@query("x3_complete_annotation", """
SELECT stable_key, status = 'ok' AND event_id % 3 <> 1 AS complete FROM judgments
""")
def x3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third text gets a line after the behaviour line, which the gate must refuse."""
    late = F.when(F.col("event_id") % 3 == 1, F.concat("raw_judge_output", F.lit("\nsee above"))).otherwise(F.col("raw_judge_output"))
    rows = spread(fixtures.judgments(spark, sf_dir).select("stable_key", late.alias("text")))
    return rows.select("stable_key", is_complete_annotation(F.col("text")).alias("complete"))


@query("x4_stored_json", """
WITH s AS (SELECT *, critical_count + major_count + minor_count AS n FROM cells)
SELECT event_id, CASE WHEN event_id % 9 = 0 THEN false WHEN event_id % 11 = 0 AND n > 0 THEN false
    WHEN event_id % 13 = 0 THEN false WHEN event_id % 17 = 0 THEN false ELSE true END AS readable,
  CASE WHEN event_id % 9 = 0 OR (event_id % 11 = 0 AND n > 0) OR event_id % 13 = 0 OR event_id % 17 = 0 THEN NULL
    ELSE CAST(25 * critical_count + 5 * major_count + minor_count AS BIGINT) END AS penalty
FROM s
""")
def x4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored JSON annotations: some cut off, with a foreign key, a wrong flag or a wrong class."""

    def errors(severity: str, count: str):
        entry = F.struct(
            F.lit(severity).alias("severity"),
            F.when(F.col("event_id") % 17 == 0, "accuracy/unknown").otherwise("other").alias("class"),
            F.lit("span").alias("target_span_text"),
            F.lit(None).cast("string").alias("source_span_text"),
            F.when(F.col("event_id") % 11 == 0, 1).alias("weight"),
        )
        return F.array_repeat(entry, F.col(count))

    every = F.concat(errors("critical", "critical_count"), errors("major", "major_count"), errors("minor", "minor_count"))
    listed = spread(fixtures.cells(spark, sf_dir)).select("event_id", every.alias("every"))
    # A class can only be wrong where there is an error; add one where there is none.
    clean = F.size("every") == 0
    body = F.concat(
        F.lit('{"has_no_error":'),
        F.when((F.col("event_id") % 13 == 0) | ((F.col("event_id") % 17 == 0) & clean), F.when(clean, "false").otherwise("true"))
        .otherwise(F.when(clean, "true").otherwise("false")),
        F.lit(',"errors":'),
        F.regexp_replace(F.to_json("every", {"ignoreNullFields": "false"}), ',"weight":null', ""),
        F.lit(',"note":1}'),
    )
    cut = F.when(F.col("event_id") % 9 == 0, F.substring(body, F.lit(1), F.length(body) - 2)).otherwise(body)
    rows = listed.select("event_id", parse_response(cut).alias("p"))
    ok = F.col("p.problem").isNull()
    return rows.select("event_id", ok.alias("readable"), F.when(ok, penalty(F.col("p.errors"))).alias("penalty"))


@query("x5_normalize", """
SELECT stable_key, CASE WHEN ok THEN 'ok' ELSE 'judge_failed' END AS status, CASE WHEN ok THEN total_penalty END AS total_penalty,
  CASE WHEN ok THEN context_behavior END AS context_behavior,
  CASE WHEN bad THEN NULL ELSE speaker_mode END AS speaker_mode, context_turn_count
FROM (SELECT *, event_id % 19 = 0 AS bad, status = 'ok' AND event_id % 19 <> 0 AS ok FROM judgments)
""")
def x5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of every nineteenth row is illegal: strict where it would be ok, dropped where it failed."""
    source = spread(fixtures.judgments(spark, sf_dir)).select(
        "stable_key",
        "raw_judge_output",
        *[name for name in METADATA if name != "speaker_mode"],
        F.when(F.col("event_id") % 19 == 0, "trio").otherwise(F.col("speaker_mode")).alias("speaker_mode"),
    )
    return flatten_summary(normalize(source)).select(
        "stable_key", "status", "total_penalty", "context_behavior", "speaker_mode", "context_turn_count"
    )


@query("x6_repair", """
SELECT stable_key, status, event_id % 4 = 0 AND status = 'ok' AS repaired, total_penalty FROM judgments
""")
def x6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth readable row was stored as failed; reading it again must repair it."""
    rows = parsed(spark, sf_dir)
    lost = F.col("event_id") % 4 == 0
    stored = rows.withColumn("status", F.when(lost, "judge_failed").otherwise(F.col("status"))).withColumn(
        "summary", F.when(~lost, F.col("summary"))
    )
    return repair(stored).select("stable_key", "status", "repaired", F.col("summary.total_penalty").alias("total_penalty"))


@query("x6_remaining_failures", """
SELECT participant_id, count(*) AS remaining FROM judgments WHERE status = 'judge_failed' GROUP BY 1
""")
def x6_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parsed(spark, sf_dir).select("stable_key", "event_id", "status")
    lost = F.col("event_id") % 4 == 0
    stored = rows.select(
        "stable_key", F.col("status"), (lost & (F.col("status") == "ok")).alias("repaired")
    )
    listed = fixtures.judgments(spark, sf_dir).where((F.col("status") == "judge_failed") | lost).select("stable_key", "participant_id")
    return remaining_failures(listed, stored).groupBy("participant_id").agg(F.count(F.lit(1)).alias("remaining"))


@query("p25_metadata_present", """
SELECT stable_key, event_id % 6 <> 0 AS present FROM judgments
""")
def p25(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = F.col("event_id") % 6 == 0
    rows = fixtures.judgments(spark, sf_dir).select(
        "stable_key", *[F.when(~gone, F.col(name)).alias(name) for name in METADATA]
    )
    return rows.select("stable_key", has_metadata().alias("present"))
