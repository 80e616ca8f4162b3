"""Whether a run is complete enough to count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridscore.operators.grid import Participant, language_table, with_participants

MAX_FAILED_SHARE = 0.01


def group_outcomes(
    judgments: DataFrame, people: Sequence[Participant], languages: Sequence[str], reused_translations: DataFrame | None = None
) -> DataFrame:
    """Ok and failed rows per participant and language, zero-filled over the expected grid.

    For a run over reused translations the grid keeps only pairs that have a translation.
    Pairs outside the grid that do have judgments are appended.
    """
    pair = ["participant_id", "target_language"]
    grid = with_participants(language_table(judgments.sparkSession, languages), people).select(*pair)
    if reused_translations is not None:
        grid = grid.join(reused_translations.select(*pair).distinct(), pair, "left_semi")
    counts = judgments.groupBy(*pair).agg(
        F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") != "ok").alias("failed")
    )
    return grid.join(counts, pair, "full").select(
        *pair, F.coalesce("ok", F.lit(0)).alias("ok"), F.coalesce("failed", F.lit(0)).alias("failed")
    )


def expected_count(reused: Column, limit: Column, languages: Column, people: Column, translations: Column) -> Column:
    """Expected cells of a run: what it reused, or the full grid."""
    return F.when(reused, translations).otherwise(limit * languages * people).cast("bigint")


def validity(
    outcomes: DataFrame, translations: DataFrame, judgments: DataFrame, unresolved: DataFrame, expected: int | None
) -> DataFrame:
    """One row of counts and the verdict. ``expected`` is None for a run over reused translations.

    Four counts, each a partial aggregate; the scalar rows are put side by side by an
    aggregate over their union.
    """

    def tagged(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n", F.lit(None).cast("boolean").alias("good"))

    total = F.col("ok") + F.col("failed")
    # ``every`` over no group at all holds.
    groups = outcomes.agg(
        F.coalesce(F.every((total > 0) & (F.col("failed") <= MAX_FAILED_SHARE * total)), F.lit(True)).alias("good")
    ).select(F.lit("groups").alias("what"), F.lit(0).cast("bigint").alias("n"), "good")
    parts = tagged(translations, "translations").unionByName(tagged(judgments, "judgments"))
    parts = parts.unionByName(tagged(unresolved, "unresolved")).unionByName(groups)

    def pick(what: str) -> Column:
        return F.max(F.when(F.col("what") == what, F.col("n")))

    counts = parts.agg(
        pick("translations").alias("total_translations"),
        pick("judgments").alias("total_normalized"),
        pick("unresolved").alias("unresolved"),
        F.bool_and(F.col("good")).alias("groups_valid"),
    )
    wanted = F.col("total_translations") if expected is None else F.lit(expected).cast("bigint")
    return counts.withColumn("total_expected", wanted).withColumn(
        "benchmark_valid",
        (F.col("total_expected") > 0)
        & (F.col("total_translations") == F.col("total_expected"))
        & (F.col("unresolved") == 0)
        & (F.col("total_normalized") == F.col("total_expected"))
        & F.col("groups_valid"),
    )
