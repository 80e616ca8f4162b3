"""Report queries over judgments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridscore import domain, fixtures
from gridscore.functions.keys import natural_key
from gridscore.operators import reports
from gridscore.operators.grid import participant_table
from gridscore.operators.normalize import normalize
from gridscore.operators.validity import expected_count, group_outcomes, validity
from gridscore.operators.runs import unresolved_failures
from gridscore.plans.common import MORE_PEOPLE, PEOPLE, longs, rounded, spread
from gridscore.plans.registry import query

_BOARD = "ROUND(b.mean_penalty, 6) AS mean_penalty, coalesce(b.samples, 0) AS samples, coalesce(b.failed_samples, 0) AS failed_samples"
_SCORE = "avg(total_penalty) AS mean_penalty, count(*) FILTER (status = 'ok') AS samples, count(*) FILTER (status = 'judge_failed') AS failed_samples"
_PERSON = "p.participant_id, p.participant_display_name, CAST(p.ord AS BIGINT) AS ord"


def _person(df: DataFrame, *rest: str) -> DataFrame:
    return df.select("participant_id", "participant_display_name", *longs("ord"), *rest)


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgments read back from their raw texts."""
    source = spread(fixtures.judgments(spark, sf_dir)).drop("status", "context_behavior", "critical_count", "major_count", "minor_count", "total_penalty")
    return normalize(source)


@query("g1_mean_penalty", f"""
SELECT {_PERSON}, ROUND(b.m, 6) AS mean_penalty FROM more_people p
LEFT JOIN (SELECT participant_id, avg(total_penalty) AS m FROM judgments GROUP BY 1) b USING (participant_id)
""")
def g1(spark: SparkSession, sf_dir: str) -> DataFrame:
    board = reports.mean_penalties(fixtures.judgments(spark, sf_dir), MORE_PEOPLE)
    return rounded(_person(board, "mean_penalty"), "mean_penalty")


@query("g2_by_language", f"""
SELECT l.target_language, {_PERSON}, {_BOARD} FROM langs l CROSS JOIN more_people p
LEFT JOIN (SELECT target_language, participant_id, {_SCORE} FROM judgments GROUP BY 1, 2) b USING (target_language, participant_id)
""")
def g2(spark: SparkSession, sf_dir: str) -> DataFrame:
    board = reports.language_leaderboard(fixtures.judgments(spark, sf_dir), MORE_PEOPLE)
    return rounded(_person(board, "target_language", "mean_penalty", "samples", "failed_samples"), "mean_penalty")


@query("g3_severity_breakdown", """
SELECT l.target_language, p.participant_id, CAST(coalesce(b.c, 0) AS BIGINT) AS critical,
  CAST(coalesce(b.ma, 0) AS BIGINT) AS major, CAST(coalesce(b.mi, 0) AS BIGINT) AS minor
FROM langs l CROSS JOIN more_people p LEFT JOIN (
  SELECT target_language, participant_id, sum(critical_count) AS c, sum(major_count) AS ma, sum(minor_count) AS mi
  FROM judgments WHERE status = 'ok' GROUP BY 1, 2) b USING (target_language, participant_id)
""")
def g3(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = reports.severity_totals(fixtures.judgments(spark, sf_dir), MORE_PEOPLE)
    return totals.select("target_language", "participant_id", "critical", "major", "minor")


@query("g4_error_classes", """
SELECT target_language, participant_id, error_class, CAST(sum(n) AS BIGINT) AS errors FROM (
  SELECT target_language, participant_id, 'accuracy/mistranslation' AS error_class, critical_count AS n FROM judgments WHERE status = 'ok'
  UNION ALL SELECT target_language, participant_id, 'fluency/register', major_count FROM judgments WHERE status = 'ok'
  UNION ALL SELECT target_language, participant_id, 'style/awkward', minor_count FROM judgments WHERE status = 'ok') e
GROUP BY 1, 2, 3 HAVING sum(n) > 0
""")
def g4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.error_class_counts(parsed(spark, sf_dir), PEOPLE)


def _slice_sql(key: str) -> str:
    return f"""
WITH s AS (SELECT *, {key} AS slice FROM judgments), k AS (SELECT DISTINCT slice FROM s WHERE slice IS NOT NULL)
SELECT k.slice, {_PERSON}, {_BOARD} FROM k CROSS JOIN more_people p
LEFT JOIN (SELECT slice, participant_id, {_SCORE} FROM s GROUP BY 1, 2) b USING (slice, participant_id)
"""


_SLICE_SQL = {
    "context_turn_count": "CAST(context_turn_count AS VARCHAR)",
    "speaker_mode": "speaker_mode",
    "context_turn_count_and_speaker_mode": "concat(CAST(context_turn_count AS VARCHAR), '::', speaker_mode)",
    "primary_phenomenon": "primary_phenomenon",
    "context_expectation": "context_expectation",
}


def _slice_query(name: str, kind: str) -> None:
    @query(name, _slice_sql(_SLICE_SQL[kind]))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        board = reports.slice_leaderboard(fixtures.judgments(spark, sf_dir), MORE_PEOPLE, reports.slice_keys()[kind])
        return rounded(_person(board, "slice", "mean_penalty", "samples", "failed_samples"), "mean_penalty")


for _name, _kind in (
    ("g6_by_turn_count", "context_turn_count"),
    ("g7_by_speaker_mode", "speaker_mode"),
    ("g8_by_turn_count_and_mode", "context_turn_count_and_speaker_mode"),
    ("g9_by_phenomenon", "primary_phenomenon"),
    ("g10_by_expectation", "context_expectation"),
):
    _slice_query(_name, _kind)


@query("g5_slice_leaderboard", _slice_sql("CASE WHEN status = 'ok' THEN NULL ELSE context_behavior END").replace(
    "CASE WHEN status = 'ok' THEN NULL ELSE context_behavior END",
    "CASE WHEN major_count = 2 THEN NULL ELSE concat(CAST(minor_count AS VARCHAR), '/', status) END"))
def g5(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.when(F.col("major_count") != 2, F.concat(F.col("minor_count").cast("string"), F.lit("/"), F.col("status")))
    board = reports.slice_leaderboard(fixtures.judgments(spark, sf_dir), MORE_PEOPLE, key)
    return rounded(_person(board, "slice", "mean_penalty", "samples", "failed_samples"), "mean_penalty")


@query("g11_all_slices", """
WITH s AS (
""" + "\n UNION ALL ".join(f"SELECT '{kind}' AS slice_kind, {sql} AS slice, participant_id, status, total_penalty FROM judgments" for kind, sql in _SLICE_SQL.items()) + f"""
), k AS (SELECT DISTINCT slice_kind, slice FROM s WHERE slice IS NOT NULL)
SELECT k.slice_kind, k.slice, {_PERSON}, {_BOARD} FROM k CROSS JOIN more_people p
LEFT JOIN (SELECT slice_kind, slice, participant_id, {_SCORE} FROM s GROUP BY 1, 2, 3) b USING (slice_kind, slice, participant_id)
""")
def g11(spark: SparkSession, sf_dir: str) -> DataFrame:
    board = reports.all_slices(fixtures.judgments(spark, sf_dir), MORE_PEOPLE)
    return rounded(_person(board, "slice_kind", "slice", "mean_penalty", "samples", "failed_samples"), "mean_penalty")


@query("g12_behavior_counts", f"""
SELECT {_PERSON}, {", ".join(f"count(*) FILTER (j.context_behavior = '{b}') AS {b}" for b in domain.BEHAVIORS)}
FROM more_people p LEFT JOIN judgments j USING (participant_id) GROUP BY 1, 2, 3
""")
def g12(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = reports.behavior_counts(fixtures.judgments(spark, sf_dir), MORE_PEOPLE)
    return _person(counts, *domain.BEHAVIORS)


_RATES = """
coalesce(ROUND(count(*) FILTER (j.status = 'ok' AND j.context_expectation = 'use' AND j.context_behavior = 'missed_required_context') * 1.0
  / nullif(count(*) FILTER (j.status = 'ok' AND j.context_expectation = 'use'), 0), 6), 0) AS missed_required_context_rate,
coalesce(ROUND(count(*) FILTER (j.status = 'ok' AND j.context_expectation = 'ignore' AND j.context_behavior = 'misused_context') * 1.0
  / nullif(count(*) FILTER (j.status = 'ok' AND j.context_expectation = 'ignore'), 0), 6), 0) AS misused_context_rate
"""


@query("g13_behavior_rates", f"""
SELECT {_PERSON}, {_RATES} FROM more_people p LEFT JOIN judgments j USING (participant_id) GROUP BY 1, 2, 3
""")
def g13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = reports.behavior_rates(fixtures.judgments(spark, sf_dir), MORE_PEOPLE)
    names = ("missed_required_context_rate", "misused_context_rate")
    return rounded(_person(rates, *names), *names)


@query("g14_normalized_macro_mean", """
WITH b AS (SELECT target_language, participant_id, avg(total_penalty) AS m FROM judgments GROUP BY 1, 2),
n AS (SELECT participant_id, CASE WHEN max(m) OVER w = min(m) OVER w THEN 0.0
        ELSE (m - min(m) OVER w) / (max(m) OVER w - min(m) OVER w) END AS s
      FROM b WHERE m IS NOT NULL WINDOW w AS (PARTITION BY target_language))
SELECT p.participant_id, ROUND(avg(n.s), 6) AS normalized_macro_mean_penalty
FROM more_people p LEFT JOIN n USING (participant_id) GROUP BY 1
""")
def g14(spark: SparkSession, sf_dir: str) -> DataFrame:
    board = reports.language_leaderboard(fixtures.judgments(spark, sf_dir), MORE_PEOPLE)
    result = reports.normalized_macro_mean(board).select("participant_id", "normalized_macro_mean_penalty")
    return rounded(result, "normalized_macro_mean_penalty")


_COMMON = """
WITH ok AS (SELECT * FROM judgments WHERE status = 'ok'),
c AS (SELECT source_id, target_language FROM ok GROUP BY 1, 2 HAVING count(DISTINCT participant_id) = 8),
r AS (SELECT ok.* FROM ok JOIN c USING (source_id, target_language))
"""


@query("g15_common_cells", _COMMON + """
SELECT p.participant_id, ROUND(avg(r.total_penalty), 6) AS mean_penalty, count(r.event_id) AS samples
FROM people p LEFT JOIN r USING (participant_id) GROUP BY 1
""")
def g15(spark: SparkSession, sf_dir: str) -> DataFrame:
    board = reports.common_cell_leaderboard(fixtures.judgments(spark, sf_dir), PEOPLE)
    return rounded(board.select("participant_id", "mean_penalty", "samples"), "mean_penalty")


@query("g15_common_cells_empty_participant", """
SELECT participant_id, CAST(NULL AS DOUBLE) AS mean_penalty, CAST(0 AS BIGINT) AS samples FROM more_people
""")
def g15_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    board = reports.common_cell_leaderboard(fixtures.judgments(spark, sf_dir), MORE_PEOPLE)
    return board.select("participant_id", "mean_penalty", "samples")


@query("g16_common_cells_by_language", _COMMON + """
SELECT l.target_language, p.participant_id, ROUND(avg(r.total_penalty), 6) AS mean_penalty, count(r.event_id) AS samples
FROM langs l CROSS JOIN people p LEFT JOIN r USING (target_language, participant_id) GROUP BY 1, 2
""")
def g16(spark: SparkSession, sf_dir: str) -> DataFrame:
    board = reports.common_cells_by_language(fixtures.judgments(spark, sf_dir), PEOPLE)
    return rounded(board.select("target_language", "participant_id", "mean_penalty", "samples"), "mean_penalty")


@query("g17_common_cells_by_expectation", _COMMON + """
SELECT e.context_expectation, p.participant_id, ROUND(avg(r.total_penalty), 6) AS mean_penalty, count(r.event_id) AS samples
FROM (SELECT DISTINCT context_expectation FROM judgments) e CROSS JOIN people p
LEFT JOIN r USING (context_expectation, participant_id) GROUP BY 1, 2
""")
def g17(spark: SparkSession, sf_dir: str) -> DataFrame:
    board = reports.common_cells_by_expectation(fixtures.judgments(spark, sf_dir), PEOPLE)
    return rounded(board.select("context_expectation", "participant_id", "mean_penalty", "samples"), "mean_penalty")


@query("g18_common_cell_count", _COMMON + """
SELECT coalesce(max(n), 0) AS common_cell_count FROM (SELECT participant_id, count(*) AS n FROM r GROUP BY 1)
""")
def g18(spark: SparkSession, sf_dir: str) -> DataFrame:
    board = reports.common_cell_leaderboard(fixtures.judgments(spark, sf_dir), PEOPLE)
    return reports.common_cell_count(board)


@query("g19_failed_samples", """
SELECT j.target_language, j.participant_id, coalesce(p.participant_display_name, j.participant_id) AS participant_display_name,
  j.source_id, j.stable_key
FROM judgments j LEFT JOIN (SELECT * FROM people WHERE ord < 5) p USING (participant_id) WHERE j.status = 'judge_failed'
""")
def g19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.failed_samples(fixtures.judgments(spark, sf_dir), PEOPLE[:5])


@query("g20_group_outcomes", """
WITH grid AS (SELECT participant_id, target_language FROM langs CROSS JOIN (SELECT * FROM more_people WHERE participant_id <> 'p7')),
c AS (SELECT participant_id, target_language, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status <> 'ok') AS failed FROM judgments GROUP BY 1, 2)
SELECT participant_id, target_language, coalesce(ok, 0) AS ok, coalesce(failed, 0) AS failed FROM grid FULL JOIN c USING (participant_id, target_language)
""")
def g20(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = [person for person in MORE_PEOPLE if person.participant_id != "p7"]
    return group_outcomes(fixtures.judgments(spark, sf_dir), people, domain.LANGUAGES)


@query("g20_group_outcomes_reused", """
SELECT participant_id, target_language, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status <> 'ok') AS failed
FROM judgments GROUP BY 1, 2
""")
def g20_reused(spark: SparkSession, sf_dir: str) -> DataFrame:
    judgments = fixtures.judgments(spark, sf_dir)
    return group_outcomes(judgments, MORE_PEOPLE, domain.LANGUAGES, reused_translations=judgments)


@query("g21_expected_counts", """
SELECT run_id, target_language <> 'en' AS reused,
  CAST(CASE WHEN target_language <> 'en' THEN count(*) ELSE count(DISTINCT source_id) * 1 * 8 END AS BIGINT) AS expected
FROM judgments GROUP BY run_id, target_language
""")
def g21(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = fixtures.judgments(spark, sf_dir).groupBy("run_id", "target_language").agg(
        F.count(F.lit(1)).alias("translations"), F.count_distinct("source_id").alias("limit")
    )
    reused = F.col("target_language") != "en"
    expected = expected_count(reused, F.col("limit"), F.lit(1), F.lit(len(PEOPLE)), F.col("translations"))
    return runs.select("run_id", reused.alias("reused"), expected.alias("expected"))


@query("g22_validity_gate", """
WITH g AS (SELECT participant_id, target_language, count(*) FILTER (status <> 'ok') AS failed, count(*) AS total FROM judgments GROUP BY 1, 2),
c AS (SELECT count(*) AS n FROM judgments),
u AS (SELECT count(*) AS n FROM (SELECT DISTINCT stable_key FROM run_failures EXCEPT SELECT stable_key FROM run_translations))
SELECT c.n AS total_translations, c.n AS total_normalized, u.n AS unresolved,
  (SELECT bool_and(failed <= 0.01 * total) FROM g) AS groups_valid, c.n AS total_expected,
  u.n = 0 AND (SELECT bool_and(failed <= 0.01 * total) FROM g) AS benchmark_valid
FROM c CROSS JOIN u
""")
def g22(spark: SparkSession, sf_dir: str) -> DataFrame:
    judgments = fixtures.judgments(spark, sf_dir)
    outcomes = group_outcomes(judgments, PEOPLE, domain.LANGUAGES)
    unresolved = unresolved_failures(fixtures.run_translations(spark, sf_dir), fixtures.run_failures(spark, sf_dir))
    return validity(outcomes, judgments, judgments, unresolved, expected=None)


@query("o6_natural_order", """
SELECT slice, CAST(row_number() OVER (ORDER BY turn_no, mode) AS BIGINT) AS position FROM (
  SELECT DISTINCT concat(CAST(src AS VARCHAR), '::', speaker_mode) AS slice, src AS turn_no, speaker_mode AS mode
  FROM (SELECT *, CAST(substring(source_id, 2) AS BIGINT) % 12 AS src FROM judgments))
""")
def o6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slice keys in natural order: 2::x before 10::x."""
    from pyspark.sql import Window

    source_no = F.substring("source_id", F.lit(2), F.length("source_id")).cast("bigint") % 12
    keys = (
        fixtures.judgments(spark, sf_dir)
        .select(F.concat(source_no.cast("string"), F.lit("::"), F.col("speaker_mode")).alias("slice"))
        .distinct()
    )
    # The keys of a report are few, whatever the number of rows: one small sort.
    position = F.row_number().over(Window.orderBy(natural_key("slice"))).cast("bigint")
    return keys.select("slice", position.alias("position"))


@query("p26_participants", """
SELECT participant_id, participant_display_name, CAST(ord AS BIGINT) AS ord, count(j.event_id) AS judged
FROM more_people p LEFT JOIN judgments j USING (participant_id) GROUP BY 1, 2, 3
""")
def p26(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The participant dimension in input order, with how much of it was judged."""
    judged = fixtures.judgments(spark, sf_dir).groupBy("participant_id").agg(F.count(F.lit(1)).alias("judged"))
    joined = participant_table(spark, MORE_PEOPLE).join(judged, "participant_id", "left")
    return _person(joined.withColumn("judged", F.coalesce("judged", F.lit(0))), "judged")
