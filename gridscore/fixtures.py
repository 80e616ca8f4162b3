"""Evaluation tables derived from the generic test tables.

``cells``/``judgments`` come from ``events``; ``attempts``, ``usage_metrics`` and the run
tables too; ``turns`` and ``items`` come from ``conversations``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridscore import domain
from gridscore.functions.keys import stable_key
from gridscore.operators.windows import previous_rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    # The files hold times without a zone; they are instants in UTC.
    if name == "events" and dict(df.dtypes)["ts"] == "timestamp_ntz":
        df = df.withColumn("ts", F.col("ts").cast("timestamp"))
    return df


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "events").selectExpr(
        "event_id",
        "ts",
        "event_type",
        "CAST(floor(event_id / 24) AS BIGINT) AS src",
        "CAST(floor(event_id / 8) AS BIGINT) % 3 AS lang_no",
        "CAST(round(value * 100) AS BIGINT) AS v",
    )
    failed = F.col("event_type") == "error"
    behavior_no = F.col("v") % 5
    behavior = F.when(failed, F.lit(None).cast("string"))
    for number, name in enumerate(domain.BEHAVIORS[:-1]):
        behavior = behavior.when(behavior_no == number, name)
    return base.select(
        "event_id",
        "ts",
        F.lit("run-1").alias("run_id"),
        F.format_string("s%06d", "src").alias("source_id"),
        F.when(F.col("lang_no") == 0, "en").when(F.col("lang_no") == 1, "ja").otherwise("zh-Hans").alias("target_language"),
        F.concat(F.lit("p"), (F.col("event_id") % 8).cast("string")).alias("participant_id"),
        F.when(failed, "judge_failed").otherwise("ok").alias("status"),
        F.when(F.col("v") % 23 == 0, 1).otherwise(0).alias("critical_count"),
        (F.col("v") % 3).cast("int").alias("major_count"),
        (F.col("v") % 4).cast("int").alias("minor_count"),
        (F.col("src") % 3 + 1).cast("int").alias("context_turn_count"),
        F.when(F.col("src") % 2 == 0, "single").otherwise("dyadic").alias("speaker_mode"),
        F.when(F.col("src") % 10 < 6, "use").otherwise("ignore").alias("context_expectation"),
        (F.col("src") % 10).cast("int").alias("phenomenon_no"),
        behavior.otherwise("unclear").alias("context_behavior"),
    )


def _section(title: str, count: str, line: str) -> Column:
    text = line.replace("'", "''")
    return F.concat(
        F.lit(f"{title}:\n"),
        F.when(F.col(count) == 0, F.lit("no-error\n")).otherwise(F.expr(f"repeat('{text}\\n', {count})")),
    )


def judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = F.col("status") == "ok"
    raw = F.concat(
        _section("Critical", "critical_count", 'accuracy/mistranslation - "x"'),
        _section("Major", "major_count", 'fluency-register - "y"'),
        _section("Minor", "minor_count", 'style/awkward - "z"'),
        F.lit("contextBehavior: "),
        F.col("context_behavior"),
    )
    points = 25 * F.col("critical_count") + 5 * F.col("major_count") + F.col("minor_count")
    phenomena = F.array(*[F.lit(name) for name in domain.PRIMARY_PHENOMENA])
    return cells(spark, sf_dir).select(
        "*",
        F.element_at(phenomena, F.col("phenomenon_no") + 1).alias("primary_phenomenon"),
        stable_key("run_id", "source_id", "target_language", "participant_id").alias("stable_key"),
        F.when(ok, points.cast("bigint")).alias("total_penalty"),
        F.when(ok, raw).otherwise(F.lit("Critical:\nunparseable line")).alias("raw_judge_output"),
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS seq",
        "ts",
        "concat('k', CAST(user_id AS STRING)) AS item_key",
        "concat('b', CAST(user_id % 4 AS STRING)) AS bucket_key",
        "concat('p', CAST(user_id % 8 AS STRING)) AS participant_id",
        "CASE WHEN event_id % 2 = 0 THEN 'translation' ELSE 'judge' END AS phase",
        """CASE event_type WHEN 'error' THEN 'failure' WHEN 'view' THEN 'retry'
           WHEN 'click' THEN 'recovered' ELSE 'success' END AS outcome""",
        """CASE event_type
             WHEN 'error' THEN CASE WHEN event_id % 3 = 0 THEN 'rate_limit'
                                    WHEN event_id % 3 = 1 THEN 'invalid_response' ELSE 'auth' END
             WHEN 'view' THEN CASE WHEN event_id % 2 = 0 THEN 'server_overload' ELSE 'timeout' END
           END AS error_class""",
        "CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(round(value * 10) AS BIGINT) END AS latency_ms",
    )


def usage_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS seq",
        "concat('k', CAST(event_id AS STRING)) AS stable_key",
        "CASE event_id % 4 WHEN 0 THEN 'deepseek' WHEN 1 THEN 'openrouter' WHEN 2 THEN 'gemini' ELSE 'local' END AS provider",
        """CASE event_id % 4 WHEN 0 THEN 'deepseek-v4-flash' WHEN 1 THEN 'google/gemini-3.7-flash'
           WHEN 2 THEN 'gemini-2.5-flash-lite' ELSE 'unpriced' END AS model""",
        "CASE WHEN event_id % 2 = 0 THEN 'translation' ELSE 'judge' END AS phase",
        "CASE WHEN event_id % 50 = 0 THEN NULL ELSE CAST(round(value * 100) AS BIGINT) END AS input_tokens",
        "CAST(round(value * 10) AS BIGINT) AS output_tokens",
        "CASE WHEN event_id % 3 = 0 THEN CAST(round(value) AS BIGINT) END AS reasoning_tokens",
    )


def run_translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        attempts(spark, sf_dir)
        .where("outcome = 'success'")
        .selectExpr("concat(item_key, '-', CAST(seq % 7 AS STRING)) AS stable_key", "participant_id")
        .distinct()
    )


def run_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        attempts(spark, sf_dir)
        .where("outcome = 'failure'")
        .selectExpr(
            "concat(item_key, '-', CAST(seq % 7 AS STRING)) AS stable_key",
            "participant_id",
            "ts AS recorded_at",
            "seq",
            "error_class",
        )
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr(
        "conv_id",
        "turn",
        "CASE WHEN role = 'user' THEN 'self' ELSE 'other' END AS speaker_role",
        "CASE WHEN turn % 4 = 0 THEN CAST(NULL AS STRING) ELSE concat(CAST(turn AS STRING), ' min ago') END AS relative_time_label",
        "text AS source_text",
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context items: every turn that has a predecessor, with up to three prior turns.

    The current turn is relabelled as ``self`` on every turn whose number is not a
    multiple of five, so that a known part of the items breaks the item rules.
    """
    payload = F.struct(
        F.col("speaker_role").alias("speakerRole"),
        F.col("relative_time_label").alias("relativeTimeLabel"),
        F.col("source_text").alias("sourceText"),
    )
    rows = turns(spark, sf_dir).select("conv_id", "turn", payload.alias("entry"))
    windowed = previous_rows(rows, ["conv_id"], "turn", "entry", 3, "prior").where(F.size("prior") > 0)
    roles = F.array_distinct(F.transform(F.concat("prior", F.array("entry")), lambda t: t["speakerRole"]))
    current = F.struct(
        F.when(F.col("turn") % 5 == 0, F.col("entry.speakerRole")).otherwise("self").alias("speakerRole"),
        F.when(F.col("turn") % 3 == 0, F.col("entry.relativeTimeLabel")).alias("relativeTimeLabel"),
        F.col("entry.sourceText").alias("sourceText"),
    )
    number = F.col("conv_id") + F.col("turn")
    phenomena = F.array(*[F.lit(name) for name in domain.PRIMARY_PHENOMENA])
    secondary = F.array(*[F.lit(name) for name in domain.SECONDARY_PHENOMENA])
    return windowed.select(
        F.format_string("c%06d-%03d", "conv_id", "turn").alias("sampleId"),
        F.size("prior").alias("contextTurnCount"),
        F.when(F.size(roles) == 1, "single").otherwise("dyadic").alias("speakerMode"),
        F.when(number % 10 < 6, "use").otherwise("ignore").alias("contextExpectation"),
        F.element_at(phenomena, (number % 10 + 1).cast("int")).alias("primaryPhenomenon"),
        F.slice(secondary, (number % 7 + 1).cast("int"), F.lit(2)).alias("secondaryPhenomena"),
        F.col("prior").alias("contextTurns"),
        current.alias("currentSource"),
        "conv_id",
        "turn",
    )


def authored_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items in the nested form authors edit: locked metadata, a status and filled content."""
    number = F.col("conv_id") + F.col("turn")
    return items(spark, sf_dir).select(
        "sampleId",
        F.struct("contextTurnCount", "speakerMode", "contextExpectation", "primaryPhenomenon").alias("locked"),
        F.when(number % 17 == 0, "drafted").otherwise("approved").alias("status"),
        F.struct(
            "secondaryPhenomena",
            "contextTurns",
            "currentSource",
            F.array((number % 4).cast("int")).alias("relevantContextIndices"),
            F.when(number % 13 == 0, F.lit("　 ")).otherwise(F.lit("reading")).alias("intendedInterpretation"),
            F.when(number % 19 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("mode"))).alias("commonFailureModes"),
            F.lit("note").alias("validationNotes"),
        ).alias("fill"),
        "conv_id",
        "turn",
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts on cells: many attempts share a key, some keys fail and later succeed."""
    rows = table(spark, sf_dir, "events").selectExpr(
        "'run-1' AS run_id",
        "user_id AS source_no",
        "concat('s', CAST(user_id AS STRING)) AS source_id",
        "CASE CAST(floor(event_id / 8) AS BIGINT) % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'ja' ELSE 'zh-Hans' END AS target_language",
        "concat('p', CAST(event_id % 8 AS STRING)) AS participant_id",
        "concat('m', CAST(event_id % 8 % 5 AS STRING)) AS participant_model_id",
        "event_id AS seq",
        "ts",
        "event_type IN ('click', 'purchase') AS succeeded",
        "event_type = 'error' AS failed",
        "CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(round(value * 10) AS BIGINT) END AS latency_ms",
    )
    return rows.withColumn("stable_key", stable_key("run_id", "source_id", "target_language", "participant_id"))


_CELL = ["stable_key", "source_no", "source_id", "target_language", "participant_id", "participant_model_id"]


def ledger_translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One translation per key that ever succeeded."""
    return ledger(spark, sf_dir).where("succeeded").groupBy(*_CELL).agg(F.min("seq").alias("seq"))


def ledger_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger(spark, sf_dir).where("failed").select(*_CELL, "seq", F.col("ts").alias("recorded_at"))


def ledger_judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger_translations(spark, sf_dir).select(
        "stable_key",
        F.lit("run-1").alias("run_id"),
        "source_id",
        "target_language",
        "participant_id",
        F.when(F.col("source_no") % 7 == 0, "judge_failed").otherwise("ok").alias("status"),
        F.when(F.col("source_no") % 3 == 0, "judge-b").otherwise("judge-a").alias("judge_model_id"),
    )
