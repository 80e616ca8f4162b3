"""Queries that compare conditions, judges and error rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridscore import domain, fixtures
from gridscore.functions.transcripts import accumulate, character_error_rate
from gridscore.operators import analysis, reports
from gridscore.plans.common import PEOPLE, rounded, spread
from gridscore.plans.registry import query
from gridscore.session import small_table, strings

CER_EDGES = (0.0, 0.05, 0.15, 0.30, 0.60)
CER_LABELS = ("0-5%", "5-15%", "15-30%", "30-60%", "60%+")

_A = "SELECT source_id, target_language, context_expectation, context_turn_count, total_penalty AS a FROM judgments WHERE status = 'ok' AND participant_id = 'p0'"
_B = "SELECT source_id, target_language, total_penalty AS b FROM judgments WHERE status = 'ok' AND participant_id = 'p1'"
_PAIRS = f"pr AS (SELECT * FROM ({_A}) x JOIN ({_B}) y USING (source_id, target_language))"
_OUTCOME = """count(*) AS n, count(*) FILTER (a < b) AS a_wins, count(*) FILTER (b < a) AS b_wins, count(*) FILTER (a = b) AS ties,
  ROUND(avg(a), 6) AS a_mean, ROUND(avg(b), 6) AS b_mean, ROUND(avg(b) - avg(a), 6) AS delta"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["source_id", "target_language", "context_expectation", "context_turn_count", "status", "total_penalty"]
    judgments = fixtures.judgments(spark, sf_dir)
    first = judgments.where("participant_id = 'p0'").select(*columns)
    second = judgments.where("participant_id = 'p1'").select(*columns)
    return analysis.pairs(first, second)


@query("j18_paired_conditions", f"WITH {_PAIRS} SELECT {_OUTCOME}, ROUND((avg(b) - avg(a)) / avg(a) * 100, 6) AS delta_percent FROM pr")
def j18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_pairs(spark, sf_dir).agg(*analysis.outcome_aggregates()), "a_mean", "b_mean", "delta", "delta_percent")


@query("g32_paired_breakdown", f"""
WITH {_PAIRS}
SELECT 'overall' AS dimension, CAST(NULL AS VARCHAR) AS value, {_OUTCOME} FROM pr
UNION ALL SELECT 'context_expectation', context_expectation, {_OUTCOME} FROM pr GROUP BY 2
UNION ALL SELECT 'target_language', target_language, {_OUTCOME} FROM pr GROUP BY 2
UNION ALL SELECT 'context_turn_count', CAST(context_turn_count AS VARCHAR), {_OUTCOME} FROM pr GROUP BY 2
""")
def g32(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = analysis.paired_breakdown(_pairs(spark, sf_dir), ["context_expectation", "target_language", "context_turn_count"])
    return rounded(result, "a_mean", "b_mean", "delta")


@query("j19_subset_comparison", """
WITH s AS (SELECT source_id, target_language FROM judgments WHERE participant_id = 'p2' AND total_penalty <= 3)
SELECT j.participant_id, count(s.source_id) AS subset_n, ROUND(avg(CASE WHEN s.source_id IS NOT NULL THEN total_penalty END), 6) AS subset_mean,
  ROUND(avg(total_penalty), 6) AS full_mean, ROUND(avg(CASE WHEN s.source_id IS NOT NULL THEN total_penalty END) - avg(total_penalty), 6) AS delta
FROM judgments j LEFT JOIN s USING (source_id, target_language) WHERE j.status = 'ok' GROUP BY 1
""")
def j19(spark: SparkSession, sf_dir: str) -> DataFrame:
    judgments = fixtures.judgments(spark, sf_dir)
    subset = judgments.where("participant_id = 'p2' AND total_penalty <= 3")
    return rounded(analysis.subset_comparison(judgments, subset), "subset_mean", "full_mean", "delta")


@query("j21_judge_delta", """
SELECT context_behavior, count(*) AS n, ROUND(avg(total_penalty), 6) AS old_mean, ROUND(avg(total_penalty + event_id % 3), 6) AS new_mean,
  ROUND(avg(total_penalty + event_id % 3) - avg(total_penalty), 6) AS delta
FROM judgments WHERE status = 'ok' AND event_id % 5 <> 0 GROUP BY 1
""")
def j21(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second judge that gives up to two points more and missed every fifth cell."""
    old = fixtures.judgments(spark, sf_dir).where("status = 'ok'")
    new = old.where("event_id % 5 <> 0").withColumn("total_penalty", F.col("total_penalty") + F.col("event_id") % 3)
    return rounded(analysis.judge_deltas(old, new, "context_behavior"), "old_mean", "new_mean", "delta")


@query("g37_system_pairs", """
WITH m AS (SELECT participant_id, avg(total_penalty) AS m FROM judgments GROUP BY 1)
SELECT p.a AS with_context, p.b AS without_context, ROUND(y.m - x.m, 6) AS delta, ROUND(y.m / x.m, 6) AS ratio
FROM (VALUES ('p0','p1'),('p2','p3'),('p4','p5')) p(a, b) JOIN m x ON x.participant_id = p.a JOIN m y ON y.participant_id = p.b
""")
def g37(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair_table = small_table(spark, strings("with_context", "without_context"), [("p0", "p1"), ("p2", "p3"), ("p4", "p5")])
    means = reports.mean_penalties(fixtures.judgments(spark, sf_dir), PEOPLE)
    return rounded(analysis.system_pairs(means, pair_table), "delta", "ratio")


def recognised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference texts from events and a misheard form of each."""
    reference = F.concat(F.lit(" "), F.repeat(F.concat("event_type", F.lit(" "), "props", F.lit(" ")), (F.col("event_id") % 3 + 1).cast("int")))
    wrong = F.when(F.col("event_id") % 4 == 0, reference).when(F.col("event_id") % 4 == 1, F.replace(reference, F.lit("e"), F.lit(""))).otherwise(
        F.concat(F.replace(reference, F.lit("r"), F.lit("l")), F.lit("?"))
    )
    return spread(fixtures.table(spark, sf_dir, "events")).select("event_id", reference.alias("reference"), wrong.alias("hypothesis"))


_CER = """
heard AS (SELECT event_id, concat(' ', repeat(concat(event_type, ' ', props, ' '), CAST(event_id % 3 + 1 AS INT))) AS r FROM events),
cer AS (SELECT event_id, trim(r) AS r, trim(CASE event_id % 4 WHEN 0 THEN r WHEN 1 THEN replace(r, 'e', '') ELSE concat(replace(r, 'r', 'l'), '?') END) AS h FROM heard),
rate AS (SELECT event_id, r, h, levenshtein(h, r) * 1.0 / length(r) AS cer FROM cer)
"""


def _rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = character_error_rate(F.col("reference"), F.col("hypothesis"))
    return recognised(spark, sf_dir).withColumn("cer", rate)


@query("x18_character_error_rate", f"WITH {_CER} SELECT event_id, ROUND(cer, 6) AS cer FROM rate")
def x18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_rates(spark, sf_dir).select("event_id", "cer"), "cer")


@query("g33_cer_statistics", f"""
WITH {_CER}, o AS (SELECT cer, row_number() OVER (ORDER BY cer) - 1 AS i, count(*) OVER () AS n FROM rate)
SELECT count(*) AS n, ROUND(avg(cer), 6) AS mean, ROUND(min(cer), 6) AS smallest, ROUND(max(cer), 6) AS largest, ROUND(stddev_pop(cer), 6) AS std,
  ROUND((max(cer) FILTER (i = floor((n - 1) / 2)) + max(cer) FILTER (i = ceil((n - 1) / 2.0))) / 2, 6) AS median,
  ROUND(max(cer) FILTER (i = ceil((n - 1) * 0.1::DOUBLE)), 6) AS p10, ROUND(max(cer) FILTER (i = ceil((n - 1) * 0.9::DOUBLE)), 6) AS p90,
  ROUND(max(cer) FILTER (i = ceil((n - 1) * 0.95::DOUBLE)), 6) AS p95,
  (SELECT count(*) FROM rate WHERE h = r) AS exact, (SELECT count(*) FROM rate WHERE contains(h, '?')) AS unclear FROM o
""")
def g33(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows are counted per rate first: the distances are computed once, all figures follow from the counts."""
    counted = _rates(spark, sf_dir).groupBy(F.lit(1).alias("_all"), "cer").agg(
        F.count("cer").alias("w"), F.count_if(F.trim("hypothesis") == F.trim("reference")).alias("same"),
        F.count_if(F.contains("hypothesis", F.lit("?"))).alias("asked"),
    )
    mean = F.sum(F.col("cer") * F.col("w")) / F.sum("w")
    square = F.sum(F.col("cer") * F.col("cer") * F.col("w")) / F.sum("w")
    plain = counted.groupBy("_all").agg(
        F.sum("w").alias("n"), mean.alias("mean"), F.min("cer").alias("smallest"), F.max("cer").alias("largest"),
        F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("std"), F.sum("same").alias("exact"), F.sum("asked").alias("unclear"),
    )
    ranks = analysis.rank_quantiles(counted, "cer", (0.1, 0.9, 0.95), ["_all"], weight="w")
    joined = plain.join(ranks, "_all").drop("_all")
    return rounded(joined, "mean", "smallest", "largest", "std", "median", "p10", "p90", "p95")


@query("g34_cer_buckets", f"""
WITH {_CER}, b AS (SELECT j.*, CASE WHEN cer < 0.05 THEN '0-5%' WHEN cer < 0.15 THEN '5-15%' WHEN cer < 0.30 THEN '15-30%' WHEN cer < 0.60 THEN '30-60%' ELSE '60%+' END AS bucket
  FROM rate JOIN judgments j USING (event_id)),
o AS (SELECT bucket, total_penalty AS v, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY bucket) AS n FROM b WHERE status = 'ok' WINDOW w AS (PARTITION BY bucket ORDER BY total_penalty)),
q AS (SELECT bucket, (max(v) FILTER (i = floor((n - 1) / 2)) + max(v) FILTER (i = ceil((n - 1) / 2.0))) / 2.0 AS median, max(v) FILTER (i = ceil((n - 1) * 0.9::DOUBLE)) AS p90 FROM o GROUP BY 1)
SELECT bucket, count(*) AS n, ROUND(count(*) * 1.0 / (SELECT count(*) FROM b), 6) AS share, count(*) FILTER (status = 'ok') AS judged,
  ROUND(avg(total_penalty), 6) AS mean, max(total_penalty) AS largest, CAST(any_value(q.median) AS DOUBLE) AS median, any_value(q.p90) AS p90,
  {", ".join(f"count(*) FILTER (context_behavior = '{name}') AS {name}" for name in domain.BEHAVIORS)}
FROM b JOIN q USING (bucket) GROUP BY 1
""")
def g34(spark: SparkSession, sf_dir: str) -> DataFrame:
    bucket = analysis.bucketed(F.col("cer"), CER_EDGES, CER_LABELS, "no reference")
    rates = _rates(spark, sf_dir).select("event_id", bucket.alias("bucket"))
    joined = fixtures.judgments(spark, sf_dir).select("event_id", "status", "total_penalty", "context_behavior").join(rates, "event_id")
    # Few distinct combinations: distances and join are done once, both tables below read the counts.
    rows = joined.groupBy("bucket", "status", "total_penalty", "context_behavior").agg(F.count(F.lit(1)).alias("w"))
    weighed = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("w"))), F.lit(0))
    points = F.sum(F.col("total_penalty") * F.col("w")) / weighed(F.col("total_penalty").isNotNull())
    table = rows.groupBy("bucket").agg(
        F.sum("w").alias("n"), weighed(F.col("status") == "ok").alias("judged"), points.alias("mean"), F.max("total_penalty").alias("largest"),
        *[weighed(F.col("context_behavior") == name).alias(name) for name in domain.BEHAVIORS],
    )
    from pyspark.sql import Window

    # Five bucket rows: the share needs their total.
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    ranks = analysis.rank_quantiles(rows, "total_penalty", (0.9,), ["bucket"], weight="w")
    return rounded(table.withColumn("share", F.col("n") / total).join(ranks, "bucket"), "share", "mean")


@query("g35_correlation", f"""
WITH {_CER} SELECT count(*) AS n, ROUND(corr(cer, total_penalty), 6) AS r FROM rate JOIN judgments USING (event_id) WHERE status = 'ok'
""")
def g35(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = _rates(spark, sf_dir).select("event_id", "cer")
    rows = fixtures.judgments(spark, sf_dir).where("status = 'ok'").select("event_id", "total_penalty").join(rates, "event_id")
    return rounded(rows.agg(F.count(F.lit(1)).alias("n"), F.corr("cer", "total_penalty").alias("r")), "r")


@query("g36_spread_per_item", f"""
WITH {_CER}, s AS (SELECT source_id, max(cer) - min(cer) AS s FROM rate JOIN cells USING (event_id) GROUP BY 1)
SELECT count(*) AS items, ROUND(avg(s), 6) AS mean_spread FROM s
""")
def g36(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = _rates(spark, sf_dir).select("event_id", "cer").join(fixtures.cells(spark, sf_dir).select("event_id", "source_id"), "event_id")
    return rounded(analysis.spread_per_item(rates, "source_id", "cer"), "mean_spread")


@query("j20_one_to_one", f"""
WITH {_CER} SELECT source_id, target_language, participant_id, ROUND(cer, 6) AS cer, total_penalty FROM rate JOIN judgments USING (event_id)
""")
def j20(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = ["source_id", "target_language", "participant_id"]
    cells = fixtures.cells(spark, sf_dir).select("event_id", *key)
    rates = _rates(spark, sf_dir).select("event_id", "cer").join(cells, "event_id").select(*key, "cer")
    scores = fixtures.judgments(spark, sf_dir).select(*key, "total_penalty")
    return rounded(analysis.one_to_one(rates, scores, key), "cer")


@query("x17_transcripts", """
SELECT conv_id, turn, concat(text, ' end') AS current_text, concat(text, ' ', text) AS context_text FROM conversations
""")
def x17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments as a live service streams them: a start, the whole text, a repeated ending, an addition."""
    text = F.col("text")

    def fragment(kind: str, index: int, value):
        return F.struct(F.lit(kind).alias("kind"), F.lit(index).alias("index"), value.alias("text"))

    half = F.substring(text, F.lit(1), F.floor(F.length(text) / 2).cast("int"))
    events = F.array(
        fragment("context", 0, half), fragment("context", 1, half), fragment("current", 2, half), fragment("context", 0, text),
        fragment("current", 2, F.lit("")), fragment("current", 2, text), fragment("current", 2, F.right(text, F.lit(3))),
        fragment("context", 1, text), fragment("current", 2, F.lit(" end")),
    )
    rows = fixtures.table(spark, sf_dir, "conversations").select("conv_id", "turn", events.alias("events"))
    texts = lambda found: F.transform(found, lambda e: e["text"])
    current = accumulate(texts(F.filter("events", lambda e: e["kind"] == "current")))
    context = F.filter("events", lambda e: e["kind"] == "context")
    indexes = F.array_sort(F.array_distinct(F.transform(context, lambda e: e["index"])))
    per_turn = F.transform(indexes, lambda i: accumulate(texts(F.filter(context, lambda e: e["index"] == i))))
    return rows.select("conv_id", "turn", current.alias("current_text"), F.array_join(per_turn, " ").alias("context_text"))
