"""Call costs, latencies and rubric scores."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import ROUND_HALF_UP, Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridscore import domain
from gridscore.functions.text import round_half_up
from gridscore.session import small_table

_PRICE = pa.decimal128(10, 6)
_SCHEMA = pa.schema([("provider", pa.string()), ("priced_model", pa.string()), ("input_price", _PRICE), ("output_price", _PRICE)])


def price_table(spark: SparkSession) -> DataFrame:
    """USD per million tokens."""
    six = Decimal("0.000001")

    def usd(cny: str) -> Decimal:
        return (Decimal(cny) / Decimal(str(domain.CNY_PER_USD))).quantize(six, ROUND_HALF_UP)

    rows = [(p, m, Decimal(i).quantize(six), Decimal(o).quantize(six)) for p, m, i, o in domain.USD_PRICES]
    rows += [(p, m, usd(i), usd(o)) for p, m, i, o in domain.CNY_PRICES]
    return small_table(spark, _SCHEMA, rows)


def with_cost(metrics: DataFrame) -> DataFrame:
    """Add ``cost_usd`` (six decimals) and ``cost_status``.

    Reasoning tokens are billed as output. Without a price or token count the cost is unknown.
    """
    priced = metrics.withColumn("priced_model", F.regexp_replace("model", r":batch\z", "")).join(
        price_table(metrics.sparkSession), ["provider", "priced_model"], "left"
    )
    tokens = lambda c: c.cast("decimal(14,0)")
    output = F.col("output_tokens") + F.coalesce("reasoning_tokens", F.lit(0))
    per_million = tokens(F.col("input_tokens")) * F.col("input_price") + tokens(output) * F.col("output_price")
    cost = F.round(per_million * F.lit(Decimal("0.000001")), 6).cast("decimal(18,6)")
    return (
        priced.withColumn("cost_usd", cost)
        .withColumn("cost_status", F.when(F.col("cost_usd").isNull(), "unknown").otherwise("estimated"))
        .drop("priced_model", "input_price", "output_price")
    )


def cost_rollup(costed: DataFrame) -> DataFrame:
    """Cost and unknown records by phase and overall (always there), and by model.

    Rows are summed per phase and model first; the three views only read that small table.
    """
    base = costed.groupBy("phase", "model").agg(
        F.sum(F.coalesce("cost_usd", F.lit(Decimal(0)))).alias("cost"), F.count_if(F.col("cost_usd").isNull()).alias("unknown")
    )
    views = [("phase", name) for name in domain.PHASES] + [("overall", None)]
    fixed = F.array(*[F.struct(F.lit(view).alias("view"), F.lit(value).cast("string").alias("value")) for view, value in views])
    grouped = base.groupingSets([["phase"], ["model"], []], "phase", "model").agg(
        F.grouping_id().alias("_gid"), F.sum("cost").alias("cost"), F.sum("unknown").alias("unknown")
    )
    view = F.when(F.col("_gid") == 1, "phase").when(F.col("_gid") == 2, "model").otherwise("overall")
    value = F.when(F.col("_gid") == 1, F.col("phase")).when(F.col("_gid") == 2, F.col("model"))
    rows = grouped.select(view.alias("view"), value.alias("value"), "cost", "unknown")
    always = costed.sparkSession.range(1).select(F.inline(fixed)).select("view", "value", F.lit(0).alias("cost"), F.lit(0).alias("unknown"))
    return (
        rows.unionByName(always)
        .groupBy("view", "value")
        .agg(F.coalesce(F.sum("cost"), F.lit(0)).cast("decimal(28,6)").alias("total_cost_usd"),
             F.coalesce(F.sum("unknown"), F.lit(0)).cast("bigint").alias("unknown_cost_records"))
    )


def latency_summary(results: DataFrame) -> DataFrame:
    """Rounded mean, smallest and largest latency per label, per language and overall."""
    base = results.groupBy("target_language", "label").agg(
        F.sum("latency_ms").alias("total"), F.count("latency_ms").alias("n"), F.min("latency_ms").alias("lo"), F.max("latency_ms").alias("hi")
    )
    return base.groupingSets([["target_language", "label"], ["label"]], "target_language", "label").agg(
        round_half_up(F.sum("total") / F.sum("n")).alias("avg_ms"), F.min("lo").alias("min_ms"), F.max("hi").alias("max_ms")
    )


def clamped(score: Column) -> Column:
    return F.least(F.greatest(score, F.lit(1)), F.lit(5))


RUBRIC = ("accuracy", "fluency", "tone", "format")


def rubric_means(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Two-decimal rubric means over rows that were scored (total above zero)."""
    scored = F.col("total") > 0
    mean = lambda name: (round_half_up(F.avg(F.when(scored, F.col(name))) * 100) / 100).alias(f"avg_{name}")
    return scores.groupBy(*keys).agg(*[mean(name) for name in (*RUBRIC, "total")])
