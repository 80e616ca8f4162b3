"""Public leaderboards: merging runs, coverage, caveats, ranks and chart rows.

Everything here works on report rows, i.e. on aggregates: their number is bounded by runs,
participants and slices, not by judgments.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridscore import domain
from gridscore.functions.keys import display_name, is_no_context_variant, is_partial_service

def ranked(rows: DataFrame, *slices: str) -> DataFrame:
    """Dense positions by mean (missing last, ties by id), inside each slice if any."""
    window = Window.partitionBy(*slices) if slices else Window.partitionBy(F.lit(0))
    return rows.withColumn("rank", F.row_number().over(window.orderBy(F.col("mean_penalty").asc_nulls_last(), "participant_id")).cast("bigint"))


def caveat(valid: Column, reuse_only: Column, note: Column, unresolved_total: Column, own_valid: Column, own_expected: Column, own_unresolved: Column) -> Column:
    """Why a row of an invalid run needs care; empty for a valid run."""
    invalid = ~F.coalesce(valid, F.lit(False))
    partial = F.format_string("reuse-only partial row; %d/%d valid cells; %d unresolved cells", own_valid, own_expected, own_unresolved)
    carried = F.format_string("partial coverage; %d unresolved translation cells (carried forward)", unresolved_total)
    return (
        F.when(invalid & F.coalesce(reuse_only, F.lit(False)), partial)
        .when(invalid & (F.coalesce(note, F.lit("")) != ""), note)
        .when(invalid & (F.coalesce(unresolved_total, F.lit(0)) > 0), carried)
        .otherwise("")
    )


def scored_rows(rows: DataFrame, runs: DataFrame, people: DataFrame, counts: DataFrame) -> DataFrame:
    """Report rows with display name, validity, caveat and run. ``rows`` has ``run_id,
    participant_id, participant_display_name, mean_penalty`` and any slice columns."""
    named = people.select("run_id", "participant_id", F.col("display_name").alias("_manifest_name"), "provider")
    numbers = counts.select("run_id", "participant_id", F.col("valid").alias("_valid"), F.col("expected").alias("_expected"), F.col("unresolved").alias("_unresolved"))
    joined = (
        rows.join(runs, "run_id").join(named, ["run_id", "participant_id"], "left").join(numbers, ["run_id", "participant_id"], "left")
    )
    zero = lambda name: F.coalesce(name, F.lit(0))
    text = caveat(
        F.col("benchmark_valid"), F.col("reuse_only"), F.col("validity_note"), F.col("unresolved_total"),
        zero("_valid"), zero("_expected"), zero("_unresolved"),
    )
    return joined.select(
        *[name for name in rows.columns if name not in ("run_id", "participant_display_name")],
        display_name("_manifest_name", "participant_display_name", "participant_id").alias("participant_display_name"),
        "benchmark_valid", text.alias("caveat"), F.col("run_id").alias("source_run_id"), "provider",
    )


def merged_with_legacy(main: DataFrame, legacy: DataFrame, main_people: DataFrame) -> DataFrame:
    """Main rows plus legacy rows of partial services that the main run does not cover."""
    extra = legacy.where(is_partial_service("provider", "participant_id")).join(
        main_people.select("participant_id").distinct(), "participant_id", "left_anti"
    )
    return main.unionByName(extra, allowMissingColumns=True)


def with_coverage(common: DataFrame | None, full: DataFrame, empty_means_missing: bool = False) -> DataFrame:
    """Common-cell rows, or the full rows when there are none to read, labelled by ``coverage``.

    ``common`` is None when the report is absent; a slice report may also be present but empty.
    Common rows count no failures.
    """
    missing = common is None or (empty_means_missing and common.isEmpty())
    if missing:
        return full.withColumn("coverage", F.lit("full-available-fallback"))
    return common.withColumn("failed_samples", F.lit(0).cast("bigint")).withColumn("coverage", F.lit("common-cell"))


def behavior_rows(counts: DataFrame, rates: DataFrame) -> DataFrame:
    """Behaviour counts and rates side by side; what one of them lacks is zero."""
    joined = counts.join(rates, ["run_id", "participant_id"], "full")
    for name in domain.BEHAVIORS:
        joined = joined.withColumn(name, F.coalesce(name, F.lit(0)))
    for name in ("missed_required_context_rate", "misused_context_rate"):
        joined = joined.withColumn(name, F.coalesce(name, F.lit(0.0)))
    total = sum((F.col(name) for name in domain.BEHAVIORS[1:]), F.col(domain.BEHAVIORS[0]))
    return joined.withColumn("samples", total)


def common_cell_total(status_count: Column | None, rows: DataFrame) -> DataFrame:
    return rows.agg(F.coalesce(F.max("samples"), F.lit(0)).alias("common_cell_count"))


ELLIPSIS = "… omitted models …"


def slide_rows(rows: DataFrame, top: int = 5) -> DataFrame:
    """Chart rows: the best models, a gap marker, all commercial services.

    Rows without a mean are dropped; variants without context only in the model branch. Ties
    are broken by display name.
    """
    order = (F.col("mean_penalty").asc(), F.col("participant_display_name").asc(), F.col("participant_id").asc())
    scored = rows.where(F.col("mean_penalty").isNotNull())
    commercial = F.col("participant_id").isin(*domain.COMMERCIAL_IDS)
    models = scored.where(~commercial & ~is_no_context_variant("participant_id", "participant_display_name")).orderBy(*order).limit(top)
    services = scored.where(commercial)

    def placed(df: DataFrame, section: int) -> DataFrame:
        # Top-k rows or the closed list of services: a handful.
        return df.select(
            F.lit(section).alias("section"), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).cast("bigint").alias("place"),
            F.lit("bar").alias("kind"), "participant_id", bar_label().alias("label"), "mean_penalty", bar_group().alias("group"),
        )

    gap = rows.sparkSession.range(1).select(
        F.lit(1).alias("section"), F.lit(1).cast("bigint").alias("place"), F.lit("ellipsis").alias("kind"), F.lit(ELLIPSIS).alias("label")
    )
    return placed(models, 0).unionByName(gap, allowMissingColumns=True).unionByName(placed(services, 2))


def bar_label() -> Column:
    return (
        F.when(F.col("participant_id") == "deepl-api", "DeepL API (context)")
        .when(F.col("participant_id") == "deepl-api-nocontext", "DeepL API (No context)")
        .otherwise(F.col("participant_display_name"))
    )


def bar_group() -> Column:
    named = F.col("participant_id").isin("deepl-api", "deepl-api-nocontext", "google-cloud-translate-basic")
    return F.when(named, "commercial").otherwise("llm")


def column_chart_rows(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows with a mean, best first, with a short label where one is given."""
    named = rows.where(F.col("mean_penalty").isNotNull()).join(labels, "participant_id", "left")
    return named.withColumn("label", F.coalesce("label", "participant_display_name")).orderBy("mean_penalty", "participant_id")
