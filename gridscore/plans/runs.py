"""Queries over run tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridscore import domain, fixtures
from gridscore.functions.keys import checked_stable_key, language_code, language_label, stable_key
from gridscore.operators import grid, runs
from gridscore.operators.windows import first_rows
from gridscore.plans.common import PEOPLE
from gridscore.plans.registry import query
from gridscore.session import small_table

_OVERLAP = "participant_id IN ('p0','p1','p2','p4','p5')"


def _fork_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    translations = fixtures.ledger_translations(spark, sf_dir)
    failures = fixtures.ledger_failures(spark, sf_dir)
    unresolved = runs.unresolved_failures(translations, failures)
    overlap = grid.participant_table(spark, grid.participants(["p0", "p1", "p2", "p4", "p5"]))
    allowed = fixtures.ledger(spark, sf_dir).where("source_no % 5 <> 0").select("source_id")
    return translations, failures, unresolved, overlap, allowed


def _copied(spark: SparkSession, sf_dir: str) -> DataFrame:
    translations, _, unresolved, overlap, allowed = _fork_inputs(spark, sf_dir)
    return runs.fork_rows(translations, unresolved, overlap, allowed, "run-1", "run-2")


@query("p1_stable_key", "SELECT event_id, stable_key FROM judgments")
def p1(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = checked_stable_key("run_id", "source_id", "target_language", "participant_id")
    return fixtures.cells(spark, sf_dir).select("event_id", key.alias("stable_key"))


@query("p2_language_codes", """
SELECT event_id, CASE target_language WHEN 'en' THEN 'English' WHEN 'ja' THEN 'Japanese' ELSE 'Chinese Simplified' END AS label,
  target_language AS code FROM cells
""")
def p2(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = fixtures.cells(spark, sf_dir).select("event_id", language_label("target_language").alias("label"))
    return labelled.select("event_id", "label", language_code("label").alias("code"))


@query("j1_cell_grid", """
WITH it AS (SELECT DISTINCT source_id FROM cells)
SELECT it.source_id, l.target_language, p.participant_id, CAST(p.ord AS BIGINT) AS ord,
  concat('run-9::', it.source_id, '::', l.target_language, '::', p.participant_id) AS stable_key
FROM it CROSS JOIN langs l CROSS JOIN people p
""")
def j1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All items; a run with an item limit takes them from ``o7_first_items``."""
    items = fixtures.cells(spark, sf_dir).select("source_id").distinct()
    cells = grid.cell_grid(items, domain.LANGUAGES, PEOPLE, "run-9")
    return cells.select("source_id", "target_language", "participant_id", F.col("ord").cast("bigint").alias("ord"), "stable_key")


@query("o7_first_items", """
SELECT source_id, count(*) AS cells FROM cells
WHERE source_id IN (SELECT DISTINCT source_id FROM cells ORDER BY source_id LIMIT 25) GROUP BY 1
""")
def o7(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = fixtures.cells(spark, sf_dir).groupBy("source_id").agg(F.count(F.lit(1)).alias("cells"))
    return grid.first_items(counts, "source_id", 25)


@query("j3_pending_judge_work", "SELECT stable_key FROM judgments WHERE event_id % 3 <> 0")
def j3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed judgments count as done, so only unjudged keys remain."""
    judgments = fixtures.judgments(spark, sf_dir)
    return runs.pending(judgments.select("stable_key"), judgments.where("event_id % 3 = 0"))


@query("j4_item_lookup", """
SELECT stable_key, source_id, CASE WHEN CAST(substring(source_id, 2) AS BIGINT) % 7 = 0 THEN NULL
  ELSE concat('item ', source_id) END AS item FROM judgments
""")
def j4(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.substring("source_id", F.lit(2), F.length("source_id")).cast("bigint")
    cells = fixtures.judgments(spark, sf_dir).select("stable_key", "source_id", (number % 7 != 0).alias("is_context"))
    items = cells.where("is_context").select("source_id", F.concat(F.lit("item "), "source_id").alias("item")).distinct()
    return runs.with_items(cells, items, F.col("is_context")).select("stable_key", "source_id", "item")


_GRID_SQL = "SELECT concat('run-1::', s.source_id, '::', l.target_language, '::', p.participant_id) AS stable_key FROM (SELECT DISTINCT source_id FROM ledger) s CROSS JOIN langs l CROSS JOIN people p"


@query("j5_pending_translations", f"""
{_GRID_SQL} EXCEPT SELECT stable_key FROM led_translations EXCEPT SELECT stable_key FROM led_unresolved
""")
def j5(spark: SparkSession, sf_dir: str) -> DataFrame:
    translations, failures, unresolved, _, _ = _fork_inputs(spark, sf_dir)
    items = fixtures.ledger(spark, sf_dir).select("source_id").distinct()
    cells = grid.cell_grid(items, domain.LANGUAGES, PEOPLE, "run-1").select("stable_key")
    return runs.pending(cells, translations, unresolved)


@query("u3_missing_cells", f"{_GRID_SQL} EXCEPT SELECT stable_key FROM led_judgments")
def u3(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = fixtures.ledger(spark, sf_dir).select("source_id").distinct()
    cells = grid.cell_grid(items, domain.LANGUAGES, PEOPLE, "run-1").select("stable_key")
    return runs.pending(cells, fixtures.ledger_judgments(spark, sf_dir))


@query("w1_latest_failure", """
SELECT stable_key, seq, participant_id FROM run_failures
QUALIFY row_number() OVER (PARTITION BY stable_key ORDER BY recorded_at DESC, seq DESC) = 1
""")
def w1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.latest_failures(fixtures.run_failures(spark, sf_dir)).select("stable_key", "seq", "participant_id")


@query("j6_unresolved_failures", """
SELECT stable_key, seq, error_class FROM (SELECT * FROM run_failures
QUALIFY row_number() OVER (PARTITION BY stable_key ORDER BY recorded_at DESC, seq DESC) = 1)
WHERE stable_key NOT IN (SELECT stable_key FROM run_translations)
""")
def j6(spark: SparkSession, sf_dir: str) -> DataFrame:
    unresolved = runs.unresolved_failures(fixtures.run_translations(spark, sf_dir), fixtures.run_failures(spark, sf_dir))
    return unresolved.select("stable_key", "seq", "error_class")


@query("j7_fork_copy", "SELECT source_stable_key, new_key AS stable_key, 'run-1' AS source_run_id FROM led_copied")
def j7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _copied(spark, sf_dir).select("source_stable_key", "stable_key", "source_run_id")


@query("j8_carried_failures", f"""
SELECT concat('run-2::', source_id, '::', target_language, '::', participant_id) AS stable_key, seq FROM led_failures
WHERE {_OVERLAP} AND source_no % 5 <> 0 AND stable_key IN (SELECT stable_key FROM led_unresolved)
""")
def j8(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, failures, unresolved, overlap, allowed = _fork_inputs(spark, sf_dir)
    return runs.carried_failures(failures, unresolved, overlap, allowed, "run-2").select("stable_key", "seq")


@query("j9_reused_judgments", """
SELECT c.new_key AS stable_key, 'run-2' AS run_id, j.judge_model_id FROM led_judgments j JOIN led_copied c ON c.source_stable_key = j.stable_key
WHERE j.status = 'ok' AND j.judge_model_id = 'judge-a'
""")
def j9(spark: SparkSession, sf_dir: str) -> DataFrame:
    if not runs.may_reuse_judgments(False, ("judge-a", "vertex"), ("judge-a", "vertex")):
        raise ValueError("the judge differs")
    moved = runs.reused_judgments(fixtures.ledger_judgments(spark, sf_dir), _copied(spark, sf_dir), "judge-a", "run-2")
    return moved.select("stable_key", "run_id", "judge_model_id")


_REUSED_SQL = """
SELECT c.new_key AS stable_key, l.seq{more} FROM ledger l JOIN led_copied c ON c.source_stable_key = l.stable_key
WHERE l.stable_key IN (SELECT stable_key FROM led_judgments WHERE status = 'ok' AND judge_model_id = 'judge-a'){where}
"""


def _reused(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    return runs.rekey_metrics(rows, runs.reused_keys(fixtures.ledger_judgments(spark, sf_dir), _copied(spark, sf_dir), "judge-a"))


@query("j9_reused_raw_rows", _REUSED_SQL.format(more="", where=""))
def j9_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw judge rows of reused keys only."""
    return _reused(spark, sf_dir, fixtures.ledger(spark, sf_dir).select("stable_key", "seq"))


@query("j9_reused_judge_metrics", _REUSED_SQL.format(more=", l.latency_ms", where=" AND l.latency_ms IS NOT NULL"))
def j9_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge usage of reused keys only."""
    metrics = fixtures.ledger(spark, sf_dir).where("latency_ms IS NOT NULL").select("stable_key", "seq", "latency_ms")
    return _reused(spark, sf_dir, metrics)


@query("j10_rekey_metrics", """
SELECT c.new_key AS stable_key, l.seq, l.latency_ms FROM ledger l JOIN led_copied c ON c.source_stable_key = l.stable_key
""")
def j10(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = fixtures.ledger(spark, sf_dir).select("stable_key", "seq", "latency_ms")
    return runs.rekey_metrics(metrics, _copied(spark, sf_dir))


@query("j11_import_participants", """
SELECT participant_id, count(*) AS n FROM cells WHERE participant_id IN ('p0','p1','p2','p3','p4','p5') GROUP BY 1
""")
def j11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other run holds the rest; each of p2..p5 must bring as many rows as p0 has in the target run."""
    cells = fixtures.cells(spark, sf_dir)
    target = cells.where("participant_id IN ('p0', 'p1')").select("participant_id", "source_id")
    source = cells.where("participant_id NOT IN ('p0', 'p1')").select("participant_id", "source_id", "status")
    expected = target.where("participant_id = 'p0'").count()
    merged = runs.import_participants(target, source, ["p2", "p3", "p4", "p5"], expected)
    return merged.groupBy("participant_id").agg(F.count(F.lit(1)).alias("n"))


@query("j12_latency", """
SELECT t.stable_key, coalesce(m.latency_ms, 0) AS latency_ms FROM led_translations t LEFT JOIN (
  SELECT stable_key, latency_ms FROM ledger WHERE latency_ms IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY stable_key ORDER BY seq DESC) = 1) m USING (stable_key)
""")
def j12(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = fixtures.ledger(spark, sf_dir).where("latency_ms IS NOT NULL").select("stable_key", "seq", "latency_ms")
    rows = fixtures.ledger_translations(spark, sf_dir).select("stable_key")
    return runs.with_latency(rows, metrics)


def conditions(spark: SparkSession) -> DataFrame:
    schema = pa.schema([("participant_id", pa.string()), ("participant_model_id", pa.string()), ("label", pa.string()), ("ord", pa.int32())])
    return small_table(spark, schema, [("p0", "m0", "zero", 0), ("p1", "m3", "one", 1), ("x", "m3", "three", 2), ("y", "m2", "two", 3)])


_CONDITION_SQL = "CASE WHEN participant_id = 'p0' THEN 'zero' WHEN participant_id = 'p1' THEN 'one' WHEN participant_model_id = 'm0' THEN 'zero' WHEN participant_model_id = 'm3' THEN 'three' WHEN participant_model_id = 'm2' THEN 'two' END"


@query("j13_condition", f"SELECT stable_key, {_CONDITION_SQL} AS label FROM led_translations")
def j13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.with_condition(fixtures.ledger_translations(spark, sf_dir), conditions(spark)).select("stable_key", "label")


@query("g38_nested_results", f"""
WITH o AS (SELECT source_id, target_language, {_CONDITION_SQL} AS label, seq FROM led_translations),
l AS (SELECT source_id, target_language, concat(target_language, '[', string_agg(concat(label, '=', CAST(seq AS VARCHAR)), ',' ORDER BY label, CAST(seq AS VARCHAR)), ']') AS t
      FROM o WHERE label IS NOT NULL GROUP BY 1, 2)
SELECT source_id, string_agg(t, ';' ORDER BY target_language) AS document FROM l GROUP BY 1
""")
def g38(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = runs.with_condition(fixtures.ledger_translations(spark, sf_dir), conditions(spark)).where(F.col("label").isNotNull())
    outputs = rows.select(
        F.col("source_no").alias("item_ord"), "source_id", "target_language", "label",
        F.col("seq").cast("string").alias("output"), F.lit(0).cast("bigint").alias("latency_ms"),
    )
    nested = runs.nested_results(outputs)
    text = F.array_join(
        F.transform(
            "translations",
            lambda t: F.concat(
                t["target_language"], F.lit("["),
                F.array_join(F.transform(t["outputs"], lambda o: F.concat(o["label"], F.lit("="), o["output"])), ","), F.lit("]"),
            ),
        ),
        ";",
    )
    return nested.select("source_id", text.alias("document"))


@query("j24_rejudge_admission", """
SELECT (SELECT count(DISTINCT stable_key) FROM led_translations) AS distinct_keys, (SELECT count(*) FROM led_unresolved) AS unresolved,
  CAST(10 * 3 * 8 AS BIGINT) AS expected,
  (SELECT count(*) FROM led_unresolved) = 0 AND (SELECT count(DISTINCT stable_key) FROM led_translations) = 240 AS admitted
""")
def j24(spark: SparkSession, sf_dir: str) -> DataFrame:
    translations, failures, unresolved, _, _ = _fork_inputs(spark, sf_dir)
    return runs.rejudge_admission(translations, unresolved, expected=10 * len(domain.LANGUAGES) * len(PEOPLE))


@query("j26_rekey", """
SELECT concat('run-3::', source_id, '::', target_language, '::', participant_id) AS stable_key, 'run-1' AS source_run_id,
  stable_key AS source_stable_key FROM led_translations
""")
def j26(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = runs.rekey(fixtures.ledger_translations(spark, sf_dir), "run-1", "run-3")
    return moved.select("stable_key", "source_run_id", "source_stable_key")


@query("u1_common_cell_set", """
SELECT source_id, target_language FROM led_translations WHERE participant_id = 'p0'
INTERSECT SELECT source_id, target_language FROM led_translations WHERE participant_id = 'p1'
""")
def u1(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = fixtures.ledger_translations(spark, sf_dir)
    pick = lambda who: cells.where(F.col("participant_id") == who).select("source_id", "target_language")
    return pick("p0").intersect(pick("p1"))


@query("u2_union_of_runs", """
SELECT run, participant_id, count(*) AS n, count(status) AS judged FROM (
  SELECT 'a' AS run, participant_id, status FROM led_judgments UNION ALL SELECT 'b', participant_id, NULL FROM led_translations WHERE source_no % 2 = 0)
GROUP BY 1, 2
""")
def u2(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = fixtures.ledger_judgments(spark, sf_dir).select(F.lit("a").alias("run"), "participant_id", "status")
    second = fixtures.ledger_translations(spark, sf_dir).where("source_no % 2 = 0").select(F.lit("b").alias("run"), "participant_id")
    merged = first.unionByName(second, allowMissingColumns=True)
    return merged.groupBy("run", "participant_id").agg(F.count(F.lit(1)).alias("n"), F.count("status").alias("judged"))


@query("u4_keep_first", """
SELECT lang, source, doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) = 1
""")
def u4(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = fixtures.table(spark, sf_dir, "documents").select("lang", "source", "doc_id", "n_chars")
    return first_rows(documents, ["lang", "source"], ["doc_id"])


@query("u5_exact_set", """
SELECT source, list_sort(list_distinct(list(lang))) = list_sort(list_distinct(list(CASE WHEN doc_id % 2 = 0 THEN lang END))) AS same
FROM documents GROUP BY 1
""")
def u5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Do the documents with even ids of a source use exactly the languages of all of them?"""
    even = F.when(F.col("doc_id") % 2 == 0, F.col("lang"))
    sets = fixtures.table(spark, sf_dir, "documents").groupBy("source").agg(
        F.collect_set("lang").alias("expected"), F.collect_set(even).alias("actual")
    )
    return sets.select("source", (F.array_sort("expected") == F.array_sort("actual")).alias("same"))
