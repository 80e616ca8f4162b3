"""Leaderboards, breakdowns and rates over normalised judgments.

Judgments carry flat summary columns (``total_penalty`` is null when the row failed). All
reports pre-aggregate per participant before anything else, so a participant or source
with most of the rows only ever reaches a reducer as partial sums.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridscore import domain
from gridscore.operators.grid import Participant, language_table, participant_table, with_participants

PERSON = ["participant_id", "participant_display_name", "ord"]


def score() -> list[Column]:
    return [
        F.avg("total_penalty").alias("mean_penalty"),
        F.count_if(F.col("status") == "ok").alias("samples"),
        F.count_if(F.col("status") == "judge_failed").alias("failed_samples"),
    ]


def slice_keys() -> dict[str, Column]:
    """Name and key of every standard slice."""
    turns = F.col("context_turn_count").cast("string")
    return {
        "context_turn_count": turns,
        "speaker_mode": F.col("speaker_mode"),
        "context_turn_count_and_speaker_mode": F.concat(turns, F.lit("::"), F.col("speaker_mode")),
        "primary_phenomenon": F.col("primary_phenomenon"),
        "context_expectation": F.col("context_expectation"),
    }


def _zero(df: DataFrame, *names: str) -> DataFrame:
    for name in names:
        df = df.withColumn(name, F.coalesce(name, F.lit(0)))
    return df


def mean_penalties(judgments: DataFrame, people: Sequence[Participant]) -> DataFrame:
    """Mean over the ok rows of each participant; null without any."""
    means = judgments.groupBy("participant_id").agg(F.avg("total_penalty").alias("mean_penalty"))
    return participant_table(judgments.sparkSession, people).join(means, "participant_id", "left")


def language_leaderboard(
    judgments: DataFrame, people: Sequence[Participant], languages: Sequence[str] = domain.LANGUAGES
) -> DataFrame:
    """Mean, ok and failed counts for every configured language and participant."""
    scores = judgments.groupBy("target_language", "participant_id").agg(*score())
    grid = with_participants(language_table(judgments.sparkSession, languages), people)
    return _zero(grid.join(scores, ["target_language", "participant_id"], "left"), "samples", "failed_samples")


def severity_totals(
    judgments: DataFrame, people: Sequence[Participant], languages: Sequence[str] = domain.LANGUAGES
) -> DataFrame:
    ok = F.col("status") == "ok"
    names = list(domain.SEVERITY_POINTS)
    totals = judgments.groupBy("target_language", "participant_id").agg(
        *[F.sum(F.when(ok, F.col(f"{name}_count"))).cast("bigint").alias(name) for name in names]
    )
    grid = with_participants(language_table(judgments.sparkSession, languages), people)
    return _zero(grid.join(totals, ["target_language", "participant_id"], "left"), *names)


def error_class_counts(judgments: DataFrame, people: Sequence[Participant], languages: Sequence[str] = domain.LANGUAGES) -> DataFrame:
    """How often each error class occurs; only classes that do occur.

    Failed rows hold no errors, so no status filter is needed. The outer explode keeps the
    optimizer from adding a size filter, which would read annotations twice when the errors
    are computed in the same job.
    """
    ids = [person.participant_id for person in people]
    return (
        judgments.where(F.col("participant_id").isin(*ids) & F.col("target_language").isin(*languages))
        .select("target_language", "participant_id", F.explode_outer("errors.class").alias("error_class"))
        .groupBy("target_language", "participant_id", "error_class")
        .agg(F.count(F.lit(1)).alias("errors"))
        .where(F.col("error_class").isNotNull())
    )


def slice_leaderboard(judgments: DataFrame, people: Sequence[Participant], key: Column) -> DataFrame:
    """Leaderboard per value of ``key``. Values come from all rows, failed ones included."""
    scores = (
        judgments.withColumn("slice", key).where(F.col("slice").isNotNull()).groupBy("slice", "participant_id").agg(*score())
    )
    grid = with_participants(scores.select("slice").distinct(), people)
    return _zero(grid.join(scores, ["slice", "participant_id"], "left"), "samples", "failed_samples")


def all_slices(judgments: DataFrame, people: Sequence[Participant], slices: dict[str, Column] | None = None) -> DataFrame:
    """All slice leaderboards from one scan.

    Rows are first reduced to one per participant and combination of slice values; only this
    small table is expanded by the grouping sets.
    """
    slices = slices or slice_keys()
    names = list(slices)
    base = (
        judgments.select("participant_id", "status", "total_penalty", *[column.alias(name) for name, column in slices.items()])
        .groupBy("participant_id", *names)
        .agg(
            F.sum("total_penalty").alias("_sum"),
            F.count("total_penalty").alias("_scored"),
            F.count_if(F.col("status") == "ok").alias("_ok"),
            F.count_if(F.col("status") == "judge_failed").alias("_failed"),
        )
    )
    sets = [[F.col("participant_id"), F.col(name)] for name in names]
    grouped = base.groupingSets(sets, "participant_id", *names).agg(
        F.grouping_id().alias("_gid"),
        (F.sum("_sum") / F.sum("_scored")).alias("mean_penalty"),
        F.sum("_ok").alias("samples"),
        F.sum("_failed").alias("failed_samples"),
    )
    # Bit i of the grouping id (from the left) is 0 for the grouped column.
    width = len(names) + 1
    kind = F.lit(None).cast("string")
    value = F.lit(None).cast("string")
    for position, name in enumerate(names, start=1):
        used = F.shiftright("_gid", width - 1 - position).bitwiseAND(F.lit(1)) == 0
        kind = F.when(used, name).otherwise(kind)
        value = F.when(used, F.col(name)).otherwise(value)
    scores = grouped.select(
        kind.alias("slice_kind"), value.alias("slice"), "participant_id", "mean_penalty", "samples", "failed_samples"
    ).where(F.col("slice").isNotNull())
    grid = with_participants(scores.select("slice_kind", "slice").distinct(), people)
    return _zero(grid.join(scores, ["slice_kind", "slice", "participant_id"], "left"), "samples", "failed_samples")


def behavior_counts(judgments: DataFrame, people: Sequence[Participant]) -> DataFrame:
    counts = judgments.groupBy("participant_id").agg(
        *[F.count_if(F.col("context_behavior") == name).alias(name) for name in domain.BEHAVIORS]
    )
    joined = participant_table(judgments.sparkSession, people).join(counts, "participant_id", "left")
    return _zero(joined, *domain.BEHAVIORS)


def behavior_rates(judgments: DataFrame, people: Sequence[Participant]) -> DataFrame:
    """Missed context among ok rows that need it; misused context among ok rows that do not."""
    ok = F.col("status") == "ok"

    def rate(expectation: str, behavior: str) -> Column:
        base = ok & (F.col("context_expectation") == expectation)
        hits = F.count_if(base & (F.col("context_behavior") == behavior))
        return (hits / F.nullif(F.count_if(base), F.lit(0))).alias(f"{behavior}_rate")

    rates = judgments.groupBy("participant_id").agg(
        rate("use", "missed_required_context"), rate("ignore", "misused_context")
    )
    joined = participant_table(judgments.sparkSession, people).join(rates, "participant_id", "left")
    return joined.select(
        *PERSON,
        *[F.coalesce(name, F.lit(0.0)).alias(name) for name in ("missed_required_context_rate", "misused_context_rate")],
    )


def normalized_macro_mean(language_board: DataFrame) -> DataFrame:
    """Min-max normalised mean per language, averaged over languages (input: a language leaderboard)."""
    within = Window.partitionBy("target_language")
    low, high = F.min("mean_penalty").over(within), F.max("mean_penalty").over(within)
    score = F.when(F.col("mean_penalty").isNull(), None).when(low == high, 0.0).otherwise(
        (F.col("mean_penalty") - low) / (high - low)
    )
    return (
        language_board.withColumn("_score", score)
        .groupBy(*PERSON)
        .agg(F.avg("_score").alias("normalized_macro_mean_penalty"))
    )


def common_cell_rows(judgments: DataFrame, people: Sequence[Participant], cell: Sequence[str] = ("source_id", "target_language")) -> DataFrame:
    """Per common cell and participant: row count and penalty sum.

    A cell is common when every listed participant has an ok row for it. The first aggregate
    keeps one row per cell and participant; the second gathers at most one entry per listed
    participant, so its arrays are bounded by the dimension.
    """
    ids = [person.participant_id for person in people]
    scored = judgments.where((F.col("status") == "ok") & F.col("total_penalty").isNotNull() & F.col("participant_id").isin(*ids))
    per_cell = scored.groupBy(*cell, "participant_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("total_penalty").alias("penalty")
    )
    gathered = per_cell.groupBy(*cell).agg(F.collect_list(F.struct("participant_id", "n", "penalty")).alias("_rows"))
    return gathered.where(F.size("_rows") == len(set(ids))).select(*cell, F.inline("_rows"))


def _common_scores(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys, "participant_id").agg(
        (F.sum("penalty") / F.sum("n")).alias("mean_penalty"), F.sum("n").alias("samples")
    )


def common_cell_leaderboard(judgments: DataFrame, people: Sequence[Participant]) -> DataFrame:
    scores = _common_scores(common_cell_rows(judgments, people), [])
    return _zero(participant_table(judgments.sparkSession, people).join(scores, "participant_id", "left"), "samples")


def common_cells_by_language(
    judgments: DataFrame, people: Sequence[Participant], languages: Sequence[str] = domain.LANGUAGES
) -> DataFrame:
    scores = _common_scores(common_cell_rows(judgments, people), ["target_language"])
    grid = with_participants(language_table(judgments.sparkSession, languages), people)
    return _zero(grid.join(scores, ["target_language", "participant_id"], "left"), "samples")


def common_cells_by_expectation(judgments: DataFrame, people: Sequence[Participant]) -> DataFrame:
    """Common cells within each expectation; only expectations that occur in the rows."""
    known = judgments.where(F.col("context_expectation").isin(*domain.EXPECTATIONS))
    rows = common_cell_rows(known, people, ("source_id", "target_language", "context_expectation"))
    scores = _common_scores(rows, ["context_expectation"])
    grid = with_participants(known.select("context_expectation").distinct(), people)
    return _zero(grid.join(scores, ["context_expectation", "participant_id"], "left"), "samples")


def common_cell_count(leaderboard: DataFrame) -> DataFrame:
    return leaderboard.agg(F.coalesce(F.max("samples"), F.lit(0)).alias("common_cell_count"))


def failed_samples(judgments: DataFrame, people: Sequence[Participant], languages: Sequence[str] = domain.LANGUAGES) -> DataFrame:
    """Failed rows with display names; an unlisted participant is named by its id."""
    failed = judgments.where((F.col("status") == "judge_failed") & F.col("target_language").isin(*languages))
    names = participant_table(judgments.sparkSession, people).select("participant_id", "participant_display_name")
    return failed.join(names, "participant_id", "left").select(
        "target_language",
        "participant_id",
        F.coalesce("participant_display_name", "participant_id").alias("participant_display_name"),
        "source_id",
        "stable_key",
    )
