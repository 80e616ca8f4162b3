"""Raw annotation rows to normalised judgment rows, and repair of failed ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridscore import domain
from gridscore.functions.annotations import ERRORS, SUMMARY, parse_response, summary
from gridscore.functions.text import is_blank

METADATA = ("context_turn_count", "speaker_mode", "context_expectation", "primary_phenomenon")


def metadata_checks() -> dict[str, Column]:
    """Per metadata column: null (absent) or a legal value."""
    return {
        "context_turn_count": F.col("context_turn_count").isin(*domain.TURN_COUNTS),
        "speaker_mode": F.col("speaker_mode").isin(*domain.SPEAKER_MODES),
        "context_expectation": F.col("context_expectation").isin(*domain.EXPECTATIONS),
        "primary_phenomenon": ~is_blank(F.col("primary_phenomenon")),
    }


def has_metadata() -> Column:
    """Whether any metadata column is present."""
    return F.coalesce(*[F.col(name).cast("string") for name in METADATA]).isNotNull()


def normalize(raw: DataFrame, parser: Callable[[Column], Column] = parse_response) -> DataFrame:
    """Add status, errors, summary and behaviour to rows with ``raw_judge_output``.

    A row is ``ok`` when its text can be read, its metadata is legal and, if an expectation
    is given, a behaviour was stated. Otherwise it is ``judge_failed``: no errors, a null
    summary, no behaviour, and illegal metadata is dropped instead of failing the job.
    """
    checks = metadata_checks()
    legal = F.lit(True)
    for name, check in checks.items():
        legal = legal & (F.col(name).isNull() | check)
    parsed = raw.withColumn("_parsed", parser(F.col("raw_judge_output"))).withColumn("_legal", legal)
    problem = (
        F.when(F.col("_parsed.problem").isNotNull(), F.col("_parsed.problem"))
        .when(~F.col("_legal"), "metadata is invalid")
        .when(F.col("context_expectation").isNotNull() & F.col("_parsed.behavior").isNull(), "behavior is required")
    )
    ok = F.col("problem").isNull()
    kept = [name for name in raw.columns if name not in (*METADATA, "status", "errors", "summary", "context_behavior", "problem")]
    return (
        parsed.withColumn("problem", problem)
        .select(
            *kept,
            F.when(ok, "ok").otherwise("judge_failed").alias("status"),
            F.when(ok, F.col("_parsed.errors")).otherwise(F.array().cast(ERRORS)).alias("errors"),
            F.when(ok, summary(F.col("_parsed.errors"))).otherwise(F.lit(None).cast(SUMMARY)).alias("summary"),
            F.when(ok, F.col("_parsed.behavior")).alias("context_behavior"),
            *[F.when(ok | checks[name], F.col(name)).alias(name) for name in METADATA],
            "problem",
        )
    )


def flatten_summary(judgments: DataFrame) -> DataFrame:
    """Summary fields as plain columns, for columnar scans."""
    names = ("critical_count", "major_count", "minor_count", "total_penalty")
    kept = [name for name in judgments.columns if name not in (*names, "summary")]
    return judgments.select(*kept, *[F.col(f"summary.{name}").alias(name) for name in names])


def repair(judgments: DataFrame) -> DataFrame:
    """Read the failed rows again; ``repaired`` marks rows that are ok now.

    One pass: the new reading replaces the row only where the old status was failed and the
    new one is ok, so every other row is returned unchanged.
    """
    columns = [name for name in judgments.columns]
    old = F.struct(*[F.col(name) for name in columns]).alias("_old")
    failed = F.col("status") == "judge_failed"
    again = normalize(
        judgments.select("*", old).withColumn("raw_judge_output", F.when(failed, F.col("raw_judge_output")))
    )
    repaired = (F.col("_old.status") == "judge_failed") & (F.col("status") == "ok")
    return again.select(
        *[
            F.when(repaired & (F.lit(name) != "raw_judge_output"), F.col(name)).otherwise(F.col(f"_old.{name}")).alias(name)
            for name in columns
        ],
        F.coalesce(repaired, F.lit(False)).alias("repaired"),
    )


def remaining_failures(failures: DataFrame, repaired: DataFrame) -> DataFrame:
    """Failure rows whose key still fails: drop repaired keys and keys that no longer fail."""
    fixed = repaired.where("repaired").select("stable_key").distinct()
    failing = repaired.where("status = 'judge_failed'").select("stable_key").distinct()
    return failures.join(fixed, "stable_key", "left_anti").join(failing, "stable_key", "left_semi")
