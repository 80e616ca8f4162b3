"""Comparisons between conditions, judges, subsets and error-rate buckets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pairs(first: DataFrame, second: DataFrame, key: Sequence[str] = ("source_id", "target_language")) -> DataFrame:
    """Cells that are ok under both conditions, with both penalties. A cell recorded twice stops the job."""
    a = first.where("status = 'ok'").select(*key, F.col("total_penalty").alias("a"), *[c for c in first.columns if c not in (*key, "total_penalty", "status")])
    b = second.where("status = 'ok'").select(*key, F.col("total_penalty").alias("b"))
    return one_to_one(a, b, key)


def outcome_aggregates(a: str = "a", b: str = "b") -> list[Column]:
    """Wins (lower is better), means and differences over paired rows."""
    left, right = F.col(a), F.col(b)
    return [
        F.count(F.lit(1)).alias("n"),
        F.count_if(left < right).alias("a_wins"),
        F.count_if(right < left).alias("b_wins"),
        F.count_if(left == right).alias("ties"),
        F.avg(left).alias("a_mean"),
        F.avg(right).alias("b_mean"),
        (F.avg(right) - F.avg(left)).alias("delta"),
        ((F.avg(right) - F.avg(left)) / F.nullif(F.avg(left), F.lit(0.0)) * 100).alias("delta_percent"),
    ]


def paired_breakdown(paired: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """Overall outcome and the outcome per value of every dimension, in one pass.

    Sums are taken once per combination of dimension values; the grouping sets then only
    expand that small table.
    """
    base = paired.groupBy(*dimensions).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("a") < F.col("b")).alias("a_wins"),
        F.count_if(F.col("b") < F.col("a")).alias("b_wins"),
        F.count_if(F.col("a") == F.col("b")).alias("ties"),
        F.sum("a").alias("a_sum"),
        F.sum("b").alias("b_sum"),
    )
    sets = [[]] + [[F.col(name)] for name in dimensions]
    sums = [F.sum(name).alias(name) for name in ("n", "a_wins", "b_wins", "ties", "a_sum", "b_sum")]
    grouped = base.groupingSets(sets, *dimensions).agg(F.grouping_id().alias("_gid"), *sums)
    width = len(dimensions)
    kind, value = F.lit("overall"), F.lit(None).cast("string")
    for position, name in enumerate(dimensions):
        used = F.shiftright("_gid", width - 1 - position).bitwiseAND(F.lit(1)) == 0
        kind = F.when(used, name).otherwise(kind)
        value = F.when(used, F.col(name).cast("string")).otherwise(value)
    mean_a, mean_b = F.col("a_sum") / F.col("n"), F.col("b_sum") / F.col("n")
    return grouped.where(F.col("n") > 0).select(
        kind.alias("dimension"), value.alias("value"), "n", "a_wins", "b_wins", "ties",
        mean_a.alias("a_mean"), mean_b.alias("b_mean"), (mean_b - mean_a).alias("delta"),
    )


def subset_comparison(judgments: DataFrame, subset_cells: DataFrame, key: Sequence[str] = ("source_id", "target_language")) -> DataFrame:
    """Mean of every participant on a subset of cells against its mean on all cells."""
    marked = judgments.where("status = 'ok'").join(
        subset_cells.select(*key).distinct().withColumn("_in", F.lit(True)), list(key), "left"
    )
    inside = F.when(F.col("_in"), F.col("total_penalty"))
    return marked.groupBy("participant_id").agg(
        F.count("_in").alias("subset_n"),
        F.avg(inside).alias("subset_mean"),
        F.avg("total_penalty").alias("full_mean"),
        (F.avg(inside) - F.avg("total_penalty")).alias("delta"),
    )


def judge_deltas(old: DataFrame, new: DataFrame, bucket: str, key: Sequence[str] = ("source_id", "target_language", "participant_id")) -> DataFrame:
    """Mean difference of two judges on the cells both scored, per bucket. A cell recorded twice stops the job."""
    a = old.select(*key, F.col("total_penalty").alias("old_penalty"))
    b = new.select(*key, bucket, F.col("total_penalty").alias("new_penalty"))
    both = one_to_one(b, a, key)
    return both.groupBy(bucket).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("old_penalty").alias("old_mean"),
        F.avg("new_penalty").alias("new_mean"),
        (F.avg("new_penalty") - F.avg("old_penalty")).alias("delta"),
    )


def one_to_one(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """Inner join that stops the job if a key occurs twice on either side.

    Both sides are counted by a combinable aggregate, so a key copied many times is found
    without gathering its rows.
    """

    def single(df: DataFrame, side: str) -> DataFrame:
        rest = [name for name in df.columns if name not in key]
        row = F.any_value(F.struct(*rest)).alias("_row")
        counted = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), row)
        message = F.concat(F.lit(f"{side} key occurs more than once: "), F.concat_ws("::", *key))
        unique = F.when(F.col("_n") == 1, F.col("_row")).otherwise(F.raise_error(message).cast(counted.schema["_row"].dataType))
        return counted.select(*key, unique.alias("_row")).select(*key, "_row.*")

    return single(left, "left").join(single(right, "right"), list(key))


def bucketed(value: Column, edges: Sequence[float], labels: Sequence[str], other: str) -> Column:
    """Left-closed buckets between ``edges``, the last one open; ``other`` without a value."""
    chain = F.when(value < edges[0], other)
    for high, label in zip(edges[1:], labels):
        chain = chain.when(value < high, label)
    return chain.when(value >= edges[-1], labels[-1]).otherwise(other)


def rank_quantiles(df: DataFrame, value: str, shares: Sequence[float], keys: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Quantile values by rank ``ceil((n-1)p)`` over the sorted values, per group.

    Equal values are counted first (or their ``weight`` summed, if rows are counts already). Running counts over the distinct values of a group then
    give each value its rank range; to keep a group with very many distinct values out of one
    task, the counts are first summed per value range and offset by a running total.
    """
    keys = list(keys)
    # Filtering on the count instead of the value keeps the filter above the aggregate, so a
    # value that is computed in the same job is computed once.
    copies = F.sum(F.when(F.col(value).isNotNull(), F.col(weight))) if weight else F.count(value)
    counts = df.groupBy(*keys, value).agg(copies.alias("_n")).where("_n > 0")

    # Ranges of values by a monotone, deterministic function of the value itself.
    span = F.floor(F.signum(value) * F.log1p(F.abs(value)) * 4096)
    names = [*keys, "_span"]
    spanned = counts.withColumn("_span", span)
    per_span = spanned.groupBy(*keys, "_span").agg(F.sum("_n").alias("_spanned"))
    before = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = per_span.select(
        *[F.col(name).alias(f"_other_{name}") for name in names],
        F.coalesce(F.sum("_spanned").over(before), F.lit(0)).alias("_offset"), F.sum("_spanned").over(whole).alias("_total"),
    )
    # A null-safe match: an ordinary one makes the optimizer test the keys for null in the scan,
    # which would compute the value there once more and keep the two sides from sharing a shuffle.
    same = [F.col(name).eqNullSafe(F.col(f"_other_{name}")) for name in names]
    inside = Window.partitionBy(*keys, "_span").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        spanned.withColumn("_upto", F.sum("_n").over(inside))
        .join(offsets, reduce(and_, same))
        .withColumn("_last", F.col("_upto") + F.col("_offset") - 1)
        .withColumn("_first", F.col("_last") - F.col("_n") + 1)
    )

    def at(share: float) -> Column:
        index = F.ceil((F.col("_total") - 1) * F.lit(share))
        return F.max(F.when((F.col("_first") <= index) & (index <= F.col("_last")), F.col(value)))

    labels = [f"p{round(share * 100)}" for share in shares]
    middle = [F.floor((F.col("_total") - 1) / 2), F.ceil((F.col("_total") - 1) / 2)]
    halves = [F.max(F.when((F.col("_first") <= m) & (m <= F.col("_last")), F.col(value))) for m in middle]
    return ranked.groupBy(*keys).agg(
        ((halves[0] + halves[1]) / 2).alias("median"), *[at(share).alias(label) for share, label in zip(shares, labels)]
    )


def spread_per_item(rates: DataFrame, item: str, value: str) -> DataFrame:
    """Mean over items of (largest - smallest value of the item)."""
    per_item = rates.groupBy(item).agg((F.max(value) - F.min(value)).alias("_spread"))
    return per_item.agg(F.count(F.lit(1)).alias("items"), F.avg("_spread").alias("mean_spread"))


def system_pairs(means: DataFrame, pair_table: DataFrame) -> DataFrame:
    """Ratio and difference of the means of named pairs (``with_context``, ``without_context``)."""
    a = means.select(F.col("participant_id").alias("with_context"), F.col("mean_penalty").alias("a"))
    b = means.select(F.col("participant_id").alias("without_context"), F.col("mean_penalty").alias("b"))
    return pair_table.join(a, "with_context").join(b, "without_context").select(
        "with_context", "without_context", (F.col("b") - F.col("a")).alias("delta"),
        (F.col("b") / F.nullif(F.col("a"), F.lit(0.0))).alias("ratio"),
    )
