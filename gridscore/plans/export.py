"""Queries on public leaderboards, report files, manifests, release checks and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridscore import domain, fixtures
from gridscore.functions.csvcells import csv_lines
from gridscore.functions.keys import display_name, is_no_context_variant, participant_category
from gridscore.operators import audit, batches, costs, manifests, progress, ranking, report_set, reports
from gridscore.operators.normalize import flatten_summary
from gridscore.plans.common import MORE_PEOPLE, PEOPLE, rounded, spread
from gridscore.plans.progress import _COUNTS_SQL, run_people, run_status, service_groups
from gridscore.plans.registry import query
from gridscore.plans.reports import parsed
from gridscore.session import scratch_path, small_table, strings
from gridscore.sources import files
from gridscore.sources.reports import keyed_document, read_document_set, read_keyed_report, read_optional_rows, run_summary, source_runs, write_document_set

_RANK = "row_number() OVER ({0}ORDER BY mean_penalty ASC NULLS LAST, participant_id) AS rank"


@query("w2_overall_rank", f"""
WITH b AS (SELECT p.participant_id, avg(j.total_penalty) AS mean_penalty FROM more_people p LEFT JOIN judgments j USING (participant_id) GROUP BY 1)
SELECT participant_id, ROUND(mean_penalty, 6) AS mean_penalty, {_RANK.format('')} FROM b
""")
def w2(spark: SparkSession, sf_dir: str) -> DataFrame:
    board = reports.mean_penalties(fixtures.judgments(spark, sf_dir), MORE_PEOPLE)
    return rounded(ranking.ranked(board).select("participant_id", "mean_penalty", "rank"), "mean_penalty")


@query("w3_rank_in_slice", f"""
WITH b AS (SELECT k.primary_phenomenon AS slice, p.participant_id, avg(j.total_penalty) AS mean_penalty FROM (SELECT DISTINCT primary_phenomenon FROM judgments) k CROSS JOIN more_people p
  LEFT JOIN judgments j USING (primary_phenomenon, participant_id) GROUP BY 1, 2)
SELECT slice, participant_id, ROUND(mean_penalty, 6) AS mean_penalty, {_RANK.format('PARTITION BY slice ')} FROM b
""")
def w3(spark: SparkSession, sf_dir: str) -> DataFrame:
    board = reports.slice_leaderboard(fixtures.judgments(spark, sf_dir), MORE_PEOPLE, F.col("primary_phenomenon"))
    return rounded(ranking.ranked(board, "slice").select("slice", "participant_id", "mean_penalty", "rank"), "mean_penalty")


def _renamed(column: str = "participant_id"):
    return F.when(F.col(column) == "p0", "deepl-api").when(F.col(column) == "p1", "deepl-api-nocontext").otherwise(F.col(column))


_RENAMED_SQL = "CASE participant_id WHEN 'p0' THEN 'deepl-api' WHEN 'p1' THEN 'deepl-api-nocontext' ELSE participant_id END"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report rows of the two runs with caveats."""
    judged = fixtures.judgments(spark, sf_dir)
    means = judged.groupBy(_renamed().alias("participant_id")).agg(F.avg("total_penalty").alias("mean_penalty"))
    rows = means.select(
        F.explode(F.array(F.lit("main"), F.lit("open"))).alias("run_id"), "participant_id",
        F.concat(F.lit("Row "), "participant_id").alias("participant_display_name"), "mean_penalty",
    )
    status = run_status(spark, sf_dir)
    counts = progress.sample_counts(service_groups(spark, sf_dir), run_people(spark, sf_dir), status.select("run_id", "limit_applied", "languages", "unresolved_total"))
    people = run_people(spark, sf_dir).withColumn("display_name", F.when(F.col("participant_id") == "p2", "").otherwise(F.col("display_name")))
    return ranking.scored_rows(rows, status.drop("limit_applied", "languages"), people, counts)


_CAVEAT_SQL = _COUNTS_SQL + f""",
means AS (SELECT {_RENAMED_SQL} AS participant_id, avg(total_penalty) AS mean_penalty FROM judgments GROUP BY 1),
scored AS (SELECT c.run_id, c.participant_id, m.mean_penalty, CASE WHEN c.participant_id = 'p2' THEN 'Row p2' ELSE concat('Name ', c.participant_id) END AS participant_display_name,
  CASE WHEN c.run_id = 'main' THEN concat('reuse-only partial row; ', CAST(valid AS VARCHAR), '/', CAST(expected AS VARCHAR), ' valid cells; ', CAST(unresolved AS VARCHAR), ' unresolved cells') ELSE '' END AS caveat
  FROM counts c JOIN means m USING (participant_id))
"""


@query("p9_caveats", f"WITH {_CAVEAT_SQL} SELECT run_id AS source_run_id, participant_id, participant_display_name, caveat, ROUND(mean_penalty, 6) AS mean_penalty FROM scored")
def p9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_scored(spark, sf_dir).select("source_run_id", "participant_id", "participant_display_name", "caveat", "mean_penalty"), "mean_penalty")


@query("j16_merge_legacy", f"""
WITH {_CAVEAT_SQL}, u AS (SELECT * FROM scored WHERE run_id = 'main' AND participant_id <> 'deepl-api-nocontext'
  UNION ALL SELECT * FROM scored WHERE run_id = 'open' AND participant_id = 'deepl-api-nocontext')
SELECT run_id AS source_run_id, participant_id, ROUND(mean_penalty, 6) AS mean_penalty, {_RANK.format('')} FROM u
""")
def j16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second run adds only the service the main run lacks."""
    scored = _scored(spark, sf_dir)
    main = scored.where("source_run_id = 'main' AND participant_id <> 'deepl-api-nocontext'")
    people = run_people(spark, sf_dir).where("run_id = 'main' AND participant_id <> 'deepl-api-nocontext'")
    merged = ranking.merged_with_legacy(main, scored.where("source_run_id = 'open'"), people)
    return rounded(ranking.ranked(merged).select("source_run_id", "participant_id", "mean_penalty", "rank"), "mean_penalty")


@query("j17_behavior_rows", f"""
SELECT participant_id, {", ".join(f"CASE WHEN participant_id <> 'p3' THEN count(*) FILTER (context_behavior = '{b}') ELSE 0 END AS {b}" for b in domain.BEHAVIORS)},
  CASE WHEN participant_id <> 'p4' THEN ROUND(count(*) FILTER (status = 'ok' AND context_expectation = 'use' AND context_behavior = 'missed_required_context') * 1.0 / count(*) FILTER (status = 'ok' AND context_expectation = 'use'), 6) ELSE 0 END AS missed_required_context_rate,
  CASE WHEN participant_id <> 'p4' THEN ROUND(count(*) FILTER (status = 'ok' AND context_expectation = 'ignore' AND context_behavior = 'misused_context') * 1.0 / count(*) FILTER (status = 'ok' AND context_expectation = 'ignore'), 6) ELSE 0 END AS misused_context_rate,
  CASE WHEN participant_id <> 'p3' THEN count(context_behavior) ELSE 0 END AS samples
FROM judgments GROUP BY 1
""")
def j17(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = fixtures.judgments(spark, sf_dir)
    run = F.lit("main").alias("run_id")
    counts = reports.behavior_counts(judged, PEOPLE).where("participant_id <> 'p3'").select(run, "participant_id", *domain.BEHAVIORS)
    rates = reports.behavior_rates(judged, PEOPLE).where("participant_id <> 'p4'").select(run, "participant_id", "missed_required_context_rate", "misused_context_rate")
    rows = ranking.behavior_rows(counts, rates).drop("run_id")
    return rounded(rows, "missed_required_context_rate", "misused_context_rate")


_BOARD_FIELDS = ["participant_id", "participant_display_name", "mean_penalty", "samples", "failed_samples"]


def _report(spark: SparkSession, board: DataFrame, key: str, name: str) -> str:
    path = scratch_path(spark, name)
    keyed_document(board, key, "ord", _BOARD_FIELDS).write.text(path)
    return path


@query("s4_keyed_report_scan", """
SELECT target_language AS slice, participant_id, ROUND(avg(total_penalty), 6) AS mean_penalty, count(*) FILTER (status = 'ok') AS samples, count(*) FILTER (status <> 'ok') AS failed_samples FROM judgments GROUP BY 1, 2
""")
def s4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A leaderboard written as a keyed JSON report and read back."""
    path = _report(spark, reports.language_leaderboard(fixtures.judgments(spark, sf_dir), PEOPLE), "target_language", "by-language")
    rows = read_keyed_report(spark, path)
    return rounded(rows.select("slice", "participant_id", "mean_penalty", "samples", "failed_samples"), "mean_penalty")


@query("s5_optional_scan", """
SELECT participant_id, ROUND(avg(total_penalty), 6) AS mean_penalty, 'full-available-fallback' AS coverage FROM judgments GROUP BY 1
""")
def s5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The common-cell report was never written, so the full rows step in."""
    common = read_optional_rows(spark, scratch_path(spark, "absent"))
    board = reports.mean_penalties(fixtures.judgments(spark, sf_dir), PEOPLE)
    return rounded(ranking.with_coverage(common, board).select("participant_id", "mean_penalty", "coverage"), "mean_penalty")


@query("j25_public_common_cells", f"""
WITH ok AS (SELECT * FROM judgments WHERE status = 'ok'), c AS (SELECT source_id, target_language FROM ok GROUP BY 1, 2 HAVING count(DISTINCT participant_id) = 8),
b AS (SELECT l.target_language AS slice, p.participant_id, avg(r.total_penalty) AS mean_penalty, count(r.event_id) AS samples FROM langs l CROSS JOIN people p
  LEFT JOIN (SELECT ok.* FROM ok JOIN c USING (source_id, target_language)) r USING (target_language, participant_id) GROUP BY 1, 2)
SELECT slice, participant_id, ROUND(mean_penalty, 6) AS mean_penalty, samples, CAST(0 AS BIGINT) AS failed_samples, 'common-cell' AS coverage, {_RANK.format('PARTITION BY slice ')} FROM b
""")
def j25(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = fixtures.judgments(spark, sf_dir)
    common = reports.common_cells_by_language(judged, PEOPLE).withColumnRenamed("target_language", "slice")
    full = reports.language_leaderboard(judged, PEOPLE).withColumnRenamed("target_language", "slice")
    rows = ranking.ranked(ranking.with_coverage(common, full, empty_means_missing=True), "slice")
    return rounded(rows.select("slice", "participant_id", "mean_penalty", "samples", "failed_samples", "coverage", "rank"), "mean_penalty")


_BOARD_TYPE = "struct<participant_id:string,participant_display_name:string,mean_penalty:double,samples:bigint,failed_samples:bigint>"


@query("s8_keyed_report", """
SELECT k.slice, CAST(p.ord AS BIGINT) AS position, p.participant_id, p.participant_display_name, ROUND(avg(j.total_penalty), 6) AS mean_penalty,
  count(*) FILTER (j.status = 'ok') AS samples, count(*) FILTER (j.status = 'judge_failed') AS failed_samples
FROM (SELECT DISTINCT context_expectation AS slice FROM judgments) k CROSS JOIN more_people p
LEFT JOIN judgments j ON j.context_expectation = k.slice AND j.participant_id = p.participant_id GROUP BY 1, 2, 3, 4
""")
def s8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report as one JSON document; shown as the rows that document holds."""
    board = reports.slice_leaderboard(fixtures.judgments(spark, sf_dir), MORE_PEOPLE, F.col("context_expectation"))
    document = keyed_document(board, "slice", "ord", _BOARD_FIELDS)
    slices = document.select(F.explode(F.from_json("value", f"map<string,array<{_BOARD_TYPE}>>")).alias("slice", "rows"))
    rows = slices.select("slice", F.posexplode("rows").alias("position", "row"))
    return rounded(rows.select("slice", F.col("position").cast("bigint").alias("position"), "row.*"), "mean_penalty")


def _report_set_sql() -> str:
    slices = {"leaderboard.by-language": "target_language", **{
        "leaderboard.by-context-turn-count": "CAST(context_turn_count AS VARCHAR)", "leaderboard.by-speaker-mode": "speaker_mode",
        "leaderboard.by-context-turn-count-and-speaker-mode": "concat(CAST(context_turn_count AS VARCHAR), '::', speaker_mode)",
        "leaderboard.by-primary-phenomenon": "primary_phenomenon", "leaderboard.by-context-expectation": "context_expectation",
    }}
    board = "avg(j.total_penalty) AS mean_penalty, count(j.event_id) FILTER (j.status = 'ok') AS samples, count(j.event_id) FILTER (j.status = 'judge_failed') AS failed_samples"
    parts = [
        f"SELECT '{report}' AS report, k.key, p.participant_id, p.ord, {board} FROM (SELECT DISTINCT {key} AS key FROM judgments) k CROSS JOIN people p "
        f"LEFT JOIN (SELECT *, {key} AS key FROM judgments) j ON j.key = k.key AND j.participant_id = p.participant_id GROUP BY ALL"
        for report, key in slices.items()
    ]
    cells = "SELECT source_id, target_language{0} FROM judgments WHERE status = 'ok' GROUP BY ALL HAVING count(DISTINCT participant_id) = 8"
    common = {
        "summary-overall.penalty.common-cell": ("''", ""), "leaderboard.by-language.common-cell": ("target_language", ""),
        "leaderboard.by-context-expectation.common-cell": ("context_expectation", ", context_expectation"),
    }
    parts += [
        f"SELECT '{report}', k.key, p.participant_id, p.ord, avg(j.total_penalty), count(j.event_id), NULL FROM (SELECT DISTINCT {key} AS key FROM judgments) k CROSS JOIN people p "
        f"LEFT JOIN (SELECT j.*, {key} AS key FROM judgments j SEMI JOIN ({cells.format(more)}) c USING (source_id, target_language{more}) WHERE status = 'ok') j "
        "ON j.key = k.key AND j.participant_id = p.participant_id GROUP BY ALL"
        for report, (key, more) in common.items()
    ]
    parts.append("SELECT 'summary-overall.penalty', '', p.participant_id, p.ord, avg(j.total_penalty), NULL, NULL FROM people p LEFT JOIN judgments j USING (participant_id) GROUP BY ALL")
    normal = """SELECT 'summary-overall.normalized', '', participant_id, ord, avg(CASE WHEN hi = lo THEN 0 ELSE (m - lo) / (hi - lo) END), NULL, NULL FROM (
      SELECT *, min(m) OVER (PARTITION BY target_language) AS lo, max(m) OVER (PARTITION BY target_language) AS hi
      FROM (SELECT target_language, p.participant_id, p.ord, avg(total_penalty) AS m FROM people p JOIN judgments USING (participant_id) GROUP BY ALL)) GROUP BY ALL"""
    return f"SELECT report, key, participant_id, CAST(ord AS BIGINT) AS position, ROUND(mean_penalty, 6) AS mean_penalty, samples, failed_samples FROM ({' UNION ALL '.join([*parts, normal])})"


def _report_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reports of the run, written as one set and read again."""
    judgments = flatten_summary(parsed(spark, sf_dir))
    costed = costs.cost_rollup(costs.with_cost(fixtures.usage_metrics(spark, sf_dir)))
    root = scratch_path(spark, "report-set")
    write_document_set(report_set.report_documents(judgments, PEOPLE, domain.LANGUAGES, costs=costed), root)
    return read_document_set(spark, root)


@query("s8_report_set", _report_set_sql())
def s8_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaderboards that the documents of the set hold."""
    row = "array<struct<participant_id:string,mean_penalty:double,normalized_macro_mean_penalty:double,samples:bigint,failed_samples:bigint>>"
    report, flat = F.col("report"), F.col("report").startswith("summary-overall")
    keyed = F.when(report == "leaderboard.by-language", F.transform_values(F.from_json("value", f"map<string,struct<leaderboard:{row}>>"), lambda _, v: v["leaderboard"]))
    keyed = keyed.when(flat, F.create_map(F.lit(""), F.from_json("value", row))).otherwise(F.from_json("value", f"map<string,{row}>"))
    rows = _report_set(spark, sf_dir).where(flat | report.startswith("leaderboard")).select("report", F.explode(keyed).alias("key", "rows"))
    rows = rows.select("report", "key", F.posexplode("rows").alias("position", "r"))
    mean = F.coalesce("r.mean_penalty", "r.normalized_macro_mean_penalty").alias("mean_penalty")
    return rounded(rows.select("report", "key", "r.participant_id", F.col("position").cast("bigint").alias("position"), mean, "r.samples", "r.failed_samples"), "mean_penalty")


@query("s8_report_counts", """
SELECT report, key, participant_id, name, CAST(value AS BIGINT) AS value FROM (
  SELECT 'severity-breakdown.by-language' AS report, target_language AS key, participant_id, name, sum(CASE name WHEN 'critical' THEN critical_count WHEN 'major' THEN major_count ELSE minor_count END) AS value
  FROM judgments, (VALUES ('critical'), ('major'), ('minor')) n(name) WHERE status = 'ok' GROUP BY ALL
  UNION ALL SELECT 'error-class-breakdown.by-language', target_language, participant_id, name,
    sum(CASE name WHEN 'accuracy/mistranslation' THEN critical_count WHEN 'fluency/register' THEN major_count ELSE minor_count END) AS value
  FROM judgments, (VALUES ('accuracy/mistranslation'), ('fluency/register'), ('style/awkward')) n(name) WHERE status = 'ok' GROUP BY ALL HAVING value > 0
  UNION ALL SELECT 'context-behavior.counts', '', participant_id, name, count(*) FILTER (context_behavior = name)
  FROM judgments, (VALUES ('used_correctly'), ('missed_required_context'), ('ignored_irrelevant_context'), ('misused_context'), ('unclear')) n(name) GROUP BY ALL
  UNION ALL SELECT 'failed-samples.by-language', target_language, participant_id, 'failed', count(*) FROM judgments WHERE status = 'judge_failed' GROUP BY ALL
)
""")
def s8_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts that the documents of the set hold, and how many failed samples they list."""
    report = F.col("report")
    counts = F.when(report == "context-behavior.counts", F.create_map(F.lit(""), F.from_json("value", "map<string,map<string,bigint>>")))
    counts = counts.otherwise(F.from_json("value", "map<string,map<string,map<string,bigint>>>"))
    rows = _report_set(spark, sf_dir)
    wanted = rows.where(report.isin("severity-breakdown.by-language", "error-class-breakdown.by-language", "context-behavior.counts"))
    by_name = wanted.select("report", F.explode(counts).alias("key", "people")).select("report", "key", F.explode("people").alias("participant_id", "counts"))
    by_name = by_name.select("report", "key", "participant_id", F.explode("counts").alias("name", "value"))
    failed = rows.where(report == "failed-samples.by-language").select("report", F.explode(F.from_json("value", "map<string,array<struct<participant_id:string>>>")).alias("key", "rows"))
    failed = failed.select("report", "key", F.explode("rows.participant_id").alias("participant_id")).groupBy("report", "key", "participant_id")
    return by_name.union(failed.agg(F.lit("failed").alias("name"), F.count(F.lit(1)).alias("value")))


_CSV_COLUMNS = ["participant_id", "participant_display_name", "mean_penalty", "samples", "benchmark_valid", "caveat"]


@query("s9_csv_lines", """
WITH b AS (SELECT participant_id, avg(total_penalty) AS m, count(*) FILTER (status = 'ok') AS n FROM judgments GROUP BY 1)
SELECT concat(participant_id, ',', CASE participant_id WHEN 'p1' THEN '''=sum(A1)' WHEN 'p2' THEN concat('"a, ""b""', '"') ELSE concat('System ', participant_id) END, ',',
  CASE WHEN participant_id = 'p3' THEN '' ELSE printf('%.6f', m) END, ',', CAST(n AS VARCHAR), ',', CASE WHEN participant_id = 'p4' THEN '' WHEN participant_id = 'p5' THEN 'false' ELSE 'true' END, ',',
  CASE WHEN participant_id < 'p3' THEN '' ELSE '"some caveat"' END) AS value FROM b
""")
def s9(spark: SparkSession, sf_dir: str) -> DataFrame:
    board = fixtures.judgments(spark, sf_dir).groupBy("participant_id").agg(F.avg("total_penalty").alias("m"), F.count_if(F.col("status") == "ok").alias("samples"))
    person = F.col("participant_id")
    rows = board.select(
        "participant_id", F.when(person == "p1", "=sum(A1)").when(person == "p2", 'a, "b"').otherwise(F.concat(F.lit("System "), person)).alias("participant_display_name"),
        F.when(person == "p3", F.lit(float("nan"))).otherwise(F.col("m")).alias("mean_penalty"), "samples",
        F.when(person != "p4", person != "p5").alias("benchmark_valid"), F.when(person < "p3", "").otherwise("some caveat").alias("caveat"),
    )
    return csv_lines(rows, _CSV_COLUMNS).select("value")


@query("x15_csv_cells", """
SELECT doc_id, CASE WHEN text = '' THEN '' WHEN contains(t, '"') OR contains(t, ',') OR contains(t, chr(10)) OR contains(t, chr(13)) THEN concat('"', replace(t, '"', '""'), '"') ELSE t END AS value
FROM (SELECT doc_id, text, CASE WHEN substring(text, 1, 1) IN ('=', '+', '-', '@', chr(9), chr(13), chr(10)) THEN concat('''', text) ELSE text END AS t FROM documents)
""")
def x15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return csv_lines(fixtures.table(spark, sf_dir, "documents").select("doc_id", "text"), ["text"]).select("doc_id", "value")


_SUMMARY_ROW = "rank:bigint,participantId:string,meanPenalty:double,caveat:string"
_SUMMARY_TYPE = (
    "caveats array<string>, commonCellCount bigint, sourceRuns array<struct<run_id:string>>, "
    f"leaderboard array<struct<{_SUMMARY_ROW},samples:bigint>>, primaryCommonCellLeaderboard array<struct<{_SUMMARY_ROW},commonCellSamples:bigint>>"
)


@query("s12_run_summary", f"""
WITH {_CAVEAT_SQL}, n AS (SELECT {_RENAMED_SQL} AS participant_id, count(*) FILTER (status = 'ok') AS samples FROM judgments GROUP BY 1),
ok AS (SELECT * FROM judgments WHERE status = 'ok'), c AS (SELECT source_id, target_language FROM ok GROUP BY 1, 2 HAVING count(DISTINCT participant_id) = 8),
cb AS (SELECT p.participant_id, avg(r.total_penalty) AS mean_penalty, count(r.event_id) AS samples FROM people p
  LEFT JOIN (SELECT ok.* FROM ok JOIN c USING (source_id, target_language)) r USING (participant_id) GROUP BY 1),
b AS (SELECT 'all' AS board, {_RANK.format('')}, participant_id, mean_penalty, samples, caveat FROM scored JOIN n USING (participant_id) WHERE run_id = 'main'
  UNION ALL SELECT 'common', {_RANK.format('')}, participant_id, mean_penalty, samples, '' FROM cb)
SELECT board, rank, participant_id, ROUND(mean_penalty, 6) AS mean_penalty, samples, caveat, (SELECT max(samples) FROM cb) AS common_cell_count,
  CAST(5 AS BIGINT) AS caveats, CAST(2 AS BIGINT) AS runs FROM b
""")
def s12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary as one JSON document; shown as the leaderboard rows that document holds."""
    judged = fixtures.judgments(spark, sf_dir)
    scored = _scored(spark, sf_dir).where("source_run_id = 'main'")
    samples = judged.groupBy(_renamed().alias("participant_id")).agg(F.count_if(F.col("status") == "ok").alias("samples"))
    overall = ranking.ranked(scored.join(samples, "participant_id", "left"))
    common = ranking.ranked(reports.common_cell_leaderboard(judged, PEOPLE)).select(
        "*", F.lit(False).alias("benchmark_valid"), F.lit("").alias("caveat"), F.lit("main").alias("source_run_id"), F.lit("common-cell").alias("coverage")
    )
    runs = run_status(spark, sf_dir).select("run_id", "limit_applied", "benchmark_valid", "reuse_only", "unresolved_total")
    document = run_summary(overall, common, runs, "2026-01-01T00:00:00Z", with_legacy=True)
    summary = document.select(F.from_json("value", _SUMMARY_TYPE).alias("s")).select("s.*")

    def shown(board: str, rows: str, samples: str):
        return F.transform(rows, lambda r: F.struct(
            F.lit(board).alias("board"), r["rank"].alias("rank"), r["participantId"].alias("participant_id"), r["meanPenalty"].alias("mean_penalty"),
            r[samples].alias("samples"), r["caveat"].alias("caveat"),
        ))

    both = F.concat(shown("all", "leaderboard", "samples"), shown("common", "primaryCommonCellLeaderboard", "commonCellSamples"))
    totals = [F.col("commonCellCount").alias("common_cell_count"), *[F.size(name).cast("bigint").alias(short) for name, short in (("caveats", "caveats"), ("sourceRuns", "runs"))]]
    return rounded(summary.select(F.inline(both), *totals), "mean_penalty")


@query("s12_source_runs", f"""
WITH {_COUNTS_SQL}
SELECT CASE run_id WHEN 'main' THEN 1 ELSE 2 END AS place, run_id, participant_id, valid AS valid_samples, expected AS expected_samples, unresolved AS unresolved_cells,
  run_id <> 'main' AS benchmark_valid, CASE run_id WHEN 'main' THEN CAST(7 AS DOUBLE) END AS unresolved_total, 'data/benchmarks/bench-1.json' AS config,
  CAST(8 AS BIGINT) AS files, 'leaderboard.overall.csv' AS secondary
FROM counts WHERE participant_id <> 'nobody'
""")
def s12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source runs that the summary document holds, status and sample counts included."""
    status, people = run_status(spark, sf_dir), run_people(spark, sf_dir)
    counts = progress.sample_counts(service_groups(spark, sf_dir), people, status.select("run_id", "limit_applied", "languages", "unresolved_total"))
    # The status as a run wrote it: untyped, with fields that must not be published and values of the wrong type.
    raw = F.concat(
        F.lit('{"benchmarkValid":'), F.col("benchmark_valid").cast("string"), F.lit(',"totalExpected":"many","secret":1'),
        F.coalesce(F.concat(F.lit(',"translationFailureUnresolvedCount":'), F.col("unresolved_total").cast("string")), F.lit("")), F.lit("}"),
    )
    public = status.select(F.col("run_id").alias("runId"), manifests.public_status(raw).alias("s")).select("runId", "s.*")
    named = people.groupBy(F.col("run_id").alias("_folder")).agg(F.array_sort(F.collect_list(F.struct(
        F.col("participant_id").alias("participantId"), F.col("display_name").alias("displayName"), "provider", F.lit("").alias("providerModelId"),
    ))).alias("participants"))
    empty = {name: F.lit(None).cast("string").alias(name) for name in (
        "runId", "datasetVersion", "datasetFingerprintSha256", "promptVersion", "judgeBackend", "datasetKind", "promptFingerprintSha256", "judgePromptVersion", "judgePromptSetId", "judgeModelId",
    )}
    runs = named.select(
        "_folder", "participants", *empty.values(), F.lit("bench-1").alias("benchmarkId"), F.lit(None).cast("array<string>").alias("targetLanguages"),
        F.lit(None).cast("map<string,string>").alias("targetLanguageLabels"), F.lit(None).cast("bigint").alias("limitApplied"),
    )
    published = manifests.public_manifests(runs, "_folder").select(F.when(F.col("runId") == "main", 1).otherwise(2).alias("ord"), "*")
    board = spark.createDataFrame([], "rank bigint, participant_id string, participant_display_name string, mean_penalty double, samples bigint, benchmark_valid boolean, caveat string, source_run_id string, coverage string")
    document = run_summary(board, board, source_runs(published, public, counts), "2026-01-01T00:00:00Z", with_legacy=False, benchmark_id="bench-1")
    run_type = "array<struct<runId:string,runStatus:struct<benchmarkValid:boolean,totalExpected:double,translationFailureUnresolvedCount:double>,participantSampleCounts:array<struct<participantId:string,validSamples:bigint,expectedSamples:bigint,unresolvedCells:bigint>>>>"
    summary = document.select(F.from_json("value", f"benchmarkConfig string, publicReports array<string>, secondaryScore struct<source:string>, sourceRuns {run_type}").alias("s")).select("s.*")
    rows = summary.select("*", F.posexplode("sourceRuns").alias("at", "run")).select("*", F.explode("run.participantSampleCounts").alias("p"))
    return rows.select(
        (F.col("at") + 1).alias("place"), F.col("run.runId").alias("run_id"), F.col("p.participantId").alias("participant_id"), F.col("p.validSamples").alias("valid_samples"),
        F.col("p.expectedSamples").alias("expected_samples"), F.col("p.unresolvedCells").alias("unresolved_cells"), F.col("run.runStatus.benchmarkValid").alias("benchmark_valid"),
        F.col("run.runStatus.translationFailureUnresolvedCount").alias("unresolved_total"), F.col("benchmarkConfig").alias("config"),
        F.size("publicReports").cast("bigint").alias("files"), F.col("secondaryScore.source").alias("secondary"),
    )


@query("p11_public_status", """
SELECT concat('run-', CAST(c_custkey AS VARCHAR)) AS run_id, c_custkey % 3 = 0 AS valid, CASE c_custkey % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false END AS reuse_only,
  CASE WHEN c_custkey % 5 = 0 THEN CAST(c_custkey AS DOUBLE) END AS total, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS note,
  CASE WHEN c_custkey % 7 <> 0 THEN 'a;b' END AS missing, CASE WHEN c_custkey % 6 <> 0 THEN concat('p::en=', CAST(c_custkey % 11 AS VARCHAR), '.0/') END AS groups FROM customer
""")
def p11_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses with strings for booleans and numbers, notes of other types and groups that are no objects."""
    key = F.col("c_custkey")
    pick = lambda n, *texts: F.element_at(F.array(*map(F.lit, texts)), (key % n + 1).cast("int"))
    raw = F.concat(
        F.lit('{"benchmarkValid":'), pick(3, "true", '"true"', "1"), pick(4, ',"reuseOnly":true', ',"reuseOnly":false', ',"reuseOnly":"yes"', ""),
        F.lit(',"totalExpected":'), F.when(key % 5 == 0, key.cast("string")).otherwise('"12"'),
        F.lit(',"benchmarkValidityNote":'), F.when(key % 2 == 0, F.to_json(F.array("c_mktsegment")).substr(F.lit(2), F.length(F.to_json(F.array("c_mktsegment"))) - 2)).otherwise("[1]"),
        F.when(key % 7 == 0, "").otherwise(',"missingDeepLKeys":["a","",7,null,"b"]'),
        F.when(key % 6 == 0, "").otherwise(F.concat(F.lit(',"judgeFailureRatesByParticipantLanguage":{"p::en":{"ok":'), (key % 11).cast("string"), F.lit(',"failed":"x"},"q::en":3}'))),
        F.lit(',"token":"hidden"}'),
    )
    rows = fixtures.table(spark, sf_dir, "customer").select(F.concat(F.lit("run-"), key.cast("string")).alias("run_id"), manifests.public_status(raw).alias("s"))
    text = lambda value: F.coalesce(value.cast("string"), F.lit(""))
    shown = F.transform(F.map_entries("s.judgeFailureRatesByParticipantLanguage"), lambda e: F.concat(e["key"], F.lit("="), text(e["value"]["ok"]), F.lit("/"), text(e["value"]["failed"])))
    return rows.select(
        "run_id", F.col("s.benchmarkValid").alias("valid"), F.col("s.reuseOnly").alias("reuse_only"), F.col("s.totalExpected").alias("total"), F.col("s.benchmarkValidityNote").alias("note"),
        F.array_join("s.missingDeepLKeys", ";").alias("missing"), F.array_join(shown, ";").alias("groups"),
    )


_CHART_NAMES = (
    "gemini35-live-two", "gemma4-e4b-fp16", "milmmt-4b", "deepl-api", "other-model-nocontext", "papago-web", "gemma4-31b", "google-cloud-translate-basic",
)
_CHART_SQL = "CASE participant_id " + " ".join(f"WHEN 'p{i}' THEN '{name}'" for i, name in enumerate(_CHART_NAMES)) + " END"


def _chart_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.element_at(F.array(*[F.lit(name) for name in _CHART_NAMES]), F.substring("participant_id", F.lit(2), F.length("participant_id")).cast("int") + 1)
    board = fixtures.judgments(spark, sf_dir).groupBy("participant_id").agg(F.avg("total_penalty").alias("m"))
    return board.select(
        names.alias("participant_id"), F.concat(F.lit("Show "), names).alias("participant_display_name"),
        F.when(F.col("participant_id") != "p2", F.col("m")).alias("mean_penalty"),
    )


_CHART_CTE = f"ch AS (SELECT {_CHART_SQL} AS participant_id, concat('Show ', {_CHART_SQL}) AS name, CASE WHEN participant_id <> 'p2' THEN avg(total_penalty) END AS m FROM judgments GROUP BY judgments.participant_id)"


@query("o3_slide_rows", f"""
WITH {_CHART_CTE}, m AS (SELECT participant_id, name, m, row_number() OVER (ORDER BY m, name) AS place FROM ch WHERE m IS NOT NULL AND participant_id IN ('gemini35-live-two','gemma4-e4b-fp16','milmmt-4b','gemma4-31b')),
c AS (SELECT participant_id, name, m, row_number() OVER (ORDER BY m, name) AS place FROM ch WHERE m IS NOT NULL AND participant_id IN ('deepl-api','papago-web','google-cloud-translate-basic'))
SELECT CAST(0 AS BIGINT) AS section, place, 'bar' AS kind, participant_id, name AS label, ROUND(m, 6) AS mean_penalty, 'llm' AS "group" FROM m WHERE place <= 5
UNION ALL SELECT 1, 1, 'ellipsis', NULL, '… omitted models …', NULL, NULL
UNION ALL SELECT 2, place, 'bar', participant_id, CASE participant_id WHEN 'deepl-api' THEN 'DeepL API (context)' ELSE name END, ROUND(m, 6), CASE WHEN participant_id = 'papago-web' THEN 'llm' ELSE 'commercial' END FROM c
""")
def o3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranking.slide_rows(_chart_rows(spark, sf_dir))
    return rounded(rows.withColumn("section", F.col("section").cast("bigint")), "mean_penalty")


@query("o4_column_chart", f"WITH {_CHART_CTE} SELECT participant_id, CASE WHEN participant_id = 'papago-web' THEN 'Papago Web' ELSE name END AS label, ROUND(m, 6) AS mean_penalty FROM ch WHERE m IS NOT NULL")
def o4(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = small_table(spark, strings("participant_id", "label"), [("papago-web", "Papago Web")])
    return rounded(ranking.column_chart_rows(_chart_rows(spark, sf_dir), labels).select("participant_id", "label", "mean_penalty"), "mean_penalty")


@query("p7_participant_category", f"""
SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'live' WHEN 1 THEN 'local-llm' WHEN 2 THEN 'dedicated-mt' WHEN 3 THEN 'commercial' WHEN 5 THEN 'commercial' WHEN 7 THEN 'commercial' ELSE 'api-llm' END AS category FROM cells
""")
def p7(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.element_at(F.array(*[F.lit(name) for name in _CHART_NAMES]), (F.col("event_id") % 8 + 1).cast("int"))
    return fixtures.cells(spark, sf_dir).select("event_id", participant_category(names).alias("category"))


@query("p8_no_context_variant", "SELECT event_id, event_id % 3 <> 2 AS no_context FROM cells")
def p8(spark: SparkSession, sf_dir: str) -> DataFrame:
    case = F.col("event_id") % 3
    name = F.when(case == 0, F.concat("participant_id", F.lit("-nocontext"))).otherwise(F.concat(F.lit("nocontext-"), "participant_id"))
    shown = F.when(case == 1, "Model (NO context)").otherwise("Model no context")
    return fixtures.cells(spark, sf_dir).select("event_id", is_no_context_variant(name, shown).alias("no_context"))


@query("p10_display_name", """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'Manifest' WHEN 1 THEN 'Row' WHEN 2 THEN participant_id ELSE 'Row' END AS name FROM cells
""")
def p10(spark: SparkSession, sf_dir: str) -> DataFrame:
    case = F.col("event_id") % 4
    manifest = F.when(case == 0, "Manifest").when(case != 3, "")
    row = F.when(case != 2, "Row").otherwise("")
    return fixtures.cells(spark, sf_dir).select("event_id", display_name(manifest, row, F.col("participant_id")).alias("name"))


def run_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers seen as run manifests, some of them broken."""
    key = F.col("c_custkey")
    good = F.sha2("c_mktsegment", 256)
    fingerprint = F.when(key % 7 == 0, F.upper(good)).when(key % 11 == 0, F.substring(good, 1, 63)).otherwise(good)

    def person(number: int, provider, url):
        return F.struct(
            F.lit(f"p{number}").alias("participantId"), F.when(key % 23 == 0, "").otherwise(f"System {number}").alias("displayName"), provider.alias("provider"),
            F.concat(F.lit("m"), (key % 2).cast("string")).alias("providerModelId"), F.lit(None).cast("string").alias("messageLayout"),
            F.when(key % 17 == 0, "p.md").alias("promptFile"), F.lit(None).cast("string").alias("promptFingerprintSha256"), url.alias("llamaCppServerUrl"), F.lit(None).cast("string").alias("llamaCppMode"),
        )

    people = F.array(person(0, F.lit("qwen"), F.lit(None).cast("string")), person(1, F.lit("llamacpp"), F.when(key % 13 != 0, "http://local")))
    return fixtures.table(spark, sf_dir, "customer").select(
        F.when(key % 19 == 0, 2).otherwise(3).alias("manifestVersion"), F.concat(F.lit("run-"), key.cast("string")).alias("runId"),
        F.concat(F.lit("bench-"), (key % 3).cast("string")).alias("benchmarkId"), F.lit("v1").alias("datasetVersion"),
        F.when(key % 2 == 0, "context").alias("datasetKind"), fingerprint.alias("datasetFingerprintSha256"), F.lit("prompt").alias("promptVersion"),
        F.sha2(F.lit("prompt"), 256).alias("promptFingerprintSha256"), F.lit("judge-v1").alias("judgePromptVersion"), F.lit(None).cast("string").alias("judgePromptSetId"),
        F.when(key % 5 == 0, "vertex").when(key % 29 == 0, "other").alias("judgeBackend"), F.when(key % 4 != 0, "judge").alias("judgeModelId"),
        F.array(F.lit("en"), F.lit("ja")).alias("targetLanguages"), F.create_map(F.lit("en"), F.lit("English"), F.lit("ja"), F.lit("Japanese")).alias("targetLanguageLabels"),
        (key % 6 - 1).alias("limitApplied"), people.alias("participants"), F.lit(4).cast("bigint").alias("translationConcurrencyPerModel"), F.lit(False).alias("resume"),
        F.lit(None).cast("string").alias("forkFromRunId"), F.lit(None).cast("string").alias("rejudgeFromRunId"), F.lit(None).cast("boolean").alias("reusedTranslations"),
        F.lit(None).cast("boolean").alias("forkPromptMismatchAllowed"), key.alias("c_custkey"),
    )


@query("p23_manifest_rules", """
SELECT concat('run-', CAST(c_custkey AS VARCHAR)) AS run_id, CASE WHEN c_custkey % 2 = 0 THEN 'context' ELSE 'sentence' END AS dataset_kind,
  CASE WHEN c_custkey % 5 = 0 THEN 'vertex' WHEN c_custkey % 29 = 0 THEN 'other' ELSE 'vertex' END AS judge_backend,
  concat_ws(',', CASE WHEN c_custkey % 19 = 0 THEN 'manifestVersion' END, CASE WHEN c_custkey % 11 = 0 AND c_custkey % 7 <> 0 THEN 'datasetFingerprintSha256' END,
    CASE WHEN c_custkey % 29 = 0 AND c_custkey % 5 <> 0 THEN 'judgeBackend' END, CASE WHEN c_custkey % 6 = 0 THEN 'limitApplied' END,
    CASE WHEN c_custkey % 23 = 0 THEN 'participants[0].displayName' END, CASE WHEN c_custkey % 17 = 0 THEN 'participants[0].prompt file and fingerprint' END,
    CASE WHEN c_custkey % 23 = 0 THEN 'participants[1].displayName' END, CASE WHEN c_custkey % 13 = 0 THEN 'participants[1].llamaCppServerUrl' END,
    CASE WHEN c_custkey % 17 = 0 THEN 'participants[1].prompt file and fingerprint' END) AS violations,
  CASE WHEN c_custkey % 11 = 0 AND c_custkey % 7 <> 0 THEN substring(sha256(c_mktsegment), 1, 63) ELSE sha256(c_mktsegment) END AS fingerprint FROM customer
""")
def p23(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifests.checked_manifests(run_table(spark, sf_dir)).select(
        F.col("runId").alias("run_id"), F.col("datasetKind").alias("dataset_kind"), F.col("judgeBackend").alias("judge_backend"),
        F.array_join("violations", ",").alias("violations"), F.col("datasetFingerprintSha256").alias("fingerprint"),
    )


@query("p11_public_manifest", """
SELECT concat('run-', CAST(c_custkey AS VARCHAR)) AS run_id, CASE WHEN c_custkey % 5 = 0 THEN 'vertex' WHEN c_custkey % 29 = 0 THEN 'other' ELSE '' END AS judge_backend,
  CASE WHEN c_custkey % 4 <> 0 THEN 'judge' END AS judge_model, concat('p0/', CASE WHEN c_custkey % 23 = 0 THEN '' ELSE 'System 0' END, ';p1/', CASE WHEN c_custkey % 23 = 0 THEN '' ELSE 'System 1' END) AS participants FROM customer
""")
def p11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two real participants and one without an id, which must vanish."""
    nameless = F.transform(F.slice("participants", 1, 1), lambda p: p.withField("participantId", F.lit("")))
    runs = run_table(spark, sf_dir).withColumn("participants", F.concat("participants", nameless))
    shown = F.transform("participants", lambda p: F.concat(p["participantId"], F.lit("/"), p["displayName"]))
    return manifests.public_manifests(runs).select(
        F.col("runId").alias("run_id"), F.col("judgeBackend").alias("judge_backend"), F.col("judgeModelId").alias("judge_model"), F.array_join(shown, ";").alias("participants")
    )


def _pair_sql(mode: str) -> str:
    kind = lambda s: f"CASE WHEN {s}.c_custkey % 2 = 0 THEN 'context' END"
    fp = lambda s: f"CASE WHEN {s}.c_custkey % 7 = 0 THEN upper(sha256({s}.c_mktsegment)) WHEN {s}.c_custkey % 11 = 0 THEN substring(sha256({s}.c_mktsegment), 1, 63) ELSE sha256({s}.c_mktsegment) END"
    backend = lambda s: f"CASE WHEN {s}.c_custkey % 5 = 0 THEN 'vertex' WHEN {s}.c_custkey % 29 = 0 THEN 'other' END"
    people = "participants"
    changed = """(a.c_custkey % 2 <> b.c_custkey % 2 OR (a.c_custkey % 23 = 0) <> (b.c_custkey % 23 = 0) OR (a.c_custkey % 17 = 0) <> (b.c_custkey % 17 = 0) OR (a.c_custkey % 13 = 0) <> (b.c_custkey % 13 = 0))"""
    parts = ["CASE WHEN a.c_custkey % 3 <> b.c_custkey % 3 THEN 'benchmarkId' END", f"CASE WHEN {kind('a')} IS DISTINCT FROM {kind('b')} THEN 'datasetKind' END",
             f"CASE WHEN {fp('a')} <> {fp('b')} THEN 'datasetFingerprintSha256' END"]
    if mode == "resume":
        parts += [f"CASE WHEN {backend('a')} IS DISTINCT FROM {backend('b')} THEN 'judgeBackend' END", "CASE WHEN a.c_custkey % 6 <> b.c_custkey % 6 THEN 'limitApplied' END"]
    if mode in ("fork", "resume"):
        parts.append(f"CASE WHEN {changed} THEN '{people}' END")
    return f"SELECT a.c_custkey AS id, concat_ws(',', {', '.join(parts)}) AS mismatches FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 6"


def _compatibility(name: str, mode: str) -> None:
    @query(name, _pair_sql(mode))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Each run against the sixth one after it."""
        runs = run_table(spark, sf_dir)
        row = F.struct(*runs.columns)
        left = runs.select(F.col("c_custkey").alias("id"), row.alias("a"))
        right = runs.select((F.col("c_custkey") - 6).alias("id"), row.alias("b"))
        return manifests.compatibility(left.join(right, "id"), mode).select("id", F.array_join("mismatches", ",").alias("mismatches"))


for _mode in ("fork", "rejudge", "resume"):
    _compatibility(f"p21_{_mode}_compatibility", _mode)


@query("p24_registry", """
WITH r AS (SELECT s_suppkey, concat('s', CAST(s_suppkey - CASE WHEN s_suppkey % 10 = 0 THEN 1 ELSE 0 END AS VARCHAR)) AS participant_id, CASE s_suppkey % 4 WHEN 0 THEN 'qwen' WHEN 1 THEN 'llamacpp' WHEN 2 THEN 'papago' ELSE 'unlisted' END AS provider FROM supplier)
SELECT s_suppkey, concat_ws(',', CASE WHEN provider = 'unlisted' THEN 'provider' END, CASE WHEN s_suppkey % 6 = 0 THEN 'messageLayout' END, CASE WHEN provider = 'llamacpp' AND s_suppkey % 3 = 0 THEN 'llamaCppServerUrl' END,
  CASE WHEN count(*) OVER (PARTITION BY participant_id) > 1 THEN 'unique id' END) AS violations FROM r
""")
def p24(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    entries = fixtures.table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.concat(F.lit("s"), (key - F.when(key % 10 == 0, 1).otherwise(0)).cast("string")).alias("participantId"), F.col("s_name").alias("displayName"),
        F.when(key % 4 == 0, "qwen").when(key % 4 == 1, "llamacpp").when(key % 4 == 2, "papago").otherwise("unlisted").alias("provider"), F.lit("model").alias("providerModelId"),
        F.when(key % 6 == 0, "sideways").alias("messageLayout"), F.when(key % 3 != 0, "http://local").alias("llamaCppServerUrl"),
    )
    return manifests.checked_registry(entries).select("s_suppkey", F.array_join("violations", ",").alias("violations"))


@query("p24_registry_selection", """
SELECT o_orderkey AS ord, concat('s', CAST(o_custkey AS VARCHAR)) AS participant_id, s_suppkey IS NULL AS unknown FROM orders LEFT JOIN supplier ON s_suppkey = o_custkey
""")
def p24_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = fixtures.table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("participantId"), "s_name")
    wanted = fixtures.table(spark, sf_dir, "orders").select(F.concat(F.lit("s"), F.col("o_custkey").cast("string")).alias("participantId"), F.col("o_orderkey").alias("ord"))
    return manifests.selected(registry, wanted).select("ord", F.col("participantId").alias("participant_id"), "unknown")


def _finding_sql() -> str:
    parts = []
    for label, pattern in audit.GENERIC_PATTERNS + audit.PRIVATE_PATTERNS:
        parts.append("CASE WHEN regexp_matches(text, '" + pattern.replace("'", "''") + f"') THEN '{label}' END")
    return "concat_ws(',', " + ", ".join(parts) + ")"


@query("x20_sensitive_text", f"SELECT doc_id, findings FROM (SELECT doc_id, CASE WHEN contains(text, chr(0)) THEN '' ELSE {_finding_sql()} END AS findings FROM documents)")
def x20(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(fixtures.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.array_join(audit.findings(F.col("text")), ",").alias("findings"))


@query("x21_path_audit", """
WITH p AS (SELECT regexp_replace(url, '^[a-z]+://[^/]+/([^?]*).*$', '\\1') AS path FROM pages)
SELECT path, CASE WHEN path = 'de' OR starts_with(path, 'de/') THEN 'blocked' WHEN NOT regexp_matches(path, '^(en|fr)/') AND path <> 'README.md' THEN 'unexpected' END AS verdict FROM p
WHERE path = 'de' OR starts_with(path, 'de/') OR (NOT regexp_matches(path, '^(en|fr)/') AND path <> 'README.md')
UNION ALL SELECT 'README.md', 'missing' WHERE NOT EXISTS (SELECT 1 FROM p WHERE path = 'README.md')
""")
def x21(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page paths against a release list: English and French allowed, German blocked, a readme required."""
    paths = fixtures.table(spark, sf_dir, "pages").select(F.regexp_replace("url", "^[a-z]+://[^/]+/([^?]*).*$", "$1").alias("path"))
    return audit.path_audit(paths, required=["README.md"], blocked=["de"], allowed=["^(en|fr)/"])


@query("j22_batch_correlation", """
SELECT stable_key, CASE WHEN event_id % 31 = 0 THEN 'no result' WHEN event_id % 29 = 0 THEN 'duplicate result line' WHEN event_id % 23 = 0 THEN 'both response and error'
  WHEN event_id % 19 = 0 THEN 'upstream' WHEN event_id % 17 = 0 THEN 'response status 500' WHEN status <> 'ok' THEN 'invalid annotation' END AS problem FROM judgments
""")
def j22(spark: SparkSession, sf_dir: str) -> DataFrame:
    event = F.col("event_id")
    judged = fixtures.judgments(spark, sf_dir).select("event_id", "stable_key", "raw_judge_output", F.concat(F.lit("j2-"), F.sha2("stable_key", 256)).alias("custom_id"))
    copies = F.array_repeat(F.lit(1), F.when(event % 31 == 0, 0).when(event % 29 == 0, 2).otherwise(1))
    results = judged.select(
        "custom_id", F.when((event % 23 == 0) | (event % 19 == 0), "upstream").alias("error"), F.when(event % 17 == 0, 500).otherwise(200).alias("status_code"),
        F.col("raw_judge_output").alias("content"), ((event % 23 == 0) | (event % 19 != 0)).alias("has_response"), F.explode(copies).alias("_"),
    ).drop("_")
    return batches.correlate(judged.select("stable_key", "custom_id"), spread(results)).select("stable_key", "problem")


@query("j22_batch_costs", """
WITH r AS (SELECT stable_key, event_id, status = 'ok' AND event_id % 29 <> 0 AND event_id % 31 <> 0 AS ok FROM judgments)
SELECT stable_key, CASE WHEN event_id % 2 = 0 THEN 'old-' ELSE 'new-' END AS scheme, ok,
  CASE WHEN ok AND event_id % 5 <> 0 THEN ROUND(CAST(((900 + event_id % 4000) * 187500 + (event_id % 700 + CASE WHEN event_id % 3 = 0 THEN 50 ELSE 0 END) * 937500 + 500000) // 1000000 AS BIGINT) / 1000000.0, 6) END AS cost_usd
FROM r
""")
def j22_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of a stored map (half of an older scheme), results under these ids, and the cost of every good line."""
    event = F.col("event_id")
    judged = fixtures.judgments(spark, sf_dir).select("event_id", "stable_key", "raw_judge_output")
    scheme = F.when(event % 2 == 0, "old-").otherwise("new-")
    id_map = judged.select("stable_key", F.concat(scheme, F.sha2("stable_key", 256)).alias("custom_id"))
    requests = batches.with_custom_ids(judged.select("stable_key"), F.lit(None).cast("string"), id_map, jobs_recorded=True)
    copies = F.array_repeat(F.lit(1), F.when(event % 31 == 0, 0).when(event % 29 == 0, 2).otherwise(1))
    results = judged.select(
        F.concat(scheme, F.sha2("stable_key", 256)).alias("custom_id"), F.lit(None).cast("string").alias("error"), F.lit(200).alias("status_code"),
        F.col("raw_judge_output").alias("content"), F.lit(True).alias("has_response"), F.lit("openrouter-batch").alias("provider"),
        F.lit("google/gemini-3.7-flash:batch").alias("model"), F.when(event % 5 != 0, 900 + event % 4000).alias("input_tokens"),
        (event % 700).alias("output_tokens"), F.when(event % 3 == 0, 50).alias("reasoning_tokens"), F.explode(copies).alias("_"),
    ).drop("_")
    found = batches.correlate(requests, spread(results))
    return found.select("stable_key", F.substring("custom_id", 1, 4).alias("scheme"), "ok", F.col("cost_usd").cast("double").alias("cost_usd"))


@query("j22_id_map_problems", """
SELECT 'shared id' AS problem, concat('c', CAST(user_id AS VARCHAR)) AS id FROM events GROUP BY user_id HAVING count(*) > 1
""")
def j22_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    id_map = fixtures.table(spark, sf_dir, "events").select(F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("custom_id"), F.concat(F.lit("k"), F.col("event_id").cast("string")).alias("stable_key"))
    return batches.id_map_problems(id_map)


@query("j23_orphaned_attempts", """
WITH a AS (SELECT seq, CAST(floor(seq / 10) AS BIGINT) AS attempt_id, CAST(floor(seq / 10) AS BIGINT) % 9 = 0 AS rejected, concat(item_key, '-', CAST(seq % 50 AS VARCHAR)) AS custom_id FROM attempts),
c AS (SELECT custom_id FROM a WHERE rejected UNION SELECT concat(item_key, '-', CAST(seq % 50 AS VARCHAR)) FROM attempts WHERE seq % 40 = 0)
SELECT attempt_id, count(*) AS uncovered_ids FROM a WHERE NOT rejected AND custom_id NOT IN (SELECT custom_id FROM c) GROUP BY 1
""")
def j23(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten ids per attempt, every ninth attempt rejected; a few ids are in recorded jobs."""
    rows = fixtures.attempts(spark, sf_dir).select(F.floor(F.col("seq") / 10).alias("attempt_id"), F.concat("item_key", F.lit("-"), (F.col("seq") % 50).cast("string")).alias("item_key"), "seq")
    attempts = rows.groupBy("attempt_id").agg(F.collect_list("item_key").alias("custom_ids")).withColumn("rejected", F.col("attempt_id") % 9 == 0)
    recorded = rows.where("seq % 40 = 0").select(F.col("item_key").alias("custom_id"))
    return batches.orphaned_attempts(attempts, recorded)


_DIGEST_PARTS = ", ".join(f"CAST(sum(CAST(CAST(('0x' || substring(h, {16 * k + 1}, 16)) AS UBIGINT) AS HUGEINT)) AS VARCHAR)" for k in range(4))


@query("s10_fingerprint", f"""
SELECT source, count(*) AS n, concat_ws('-', CAST(count(*) AS VARCHAR), {_DIGEST_PARTS}) AS digest
FROM (SELECT source, sha256(concat(CAST(doc_id AS VARCHAR), chr(31), text)) AS h FROM documents) GROUP BY 1
""")
def s10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.table(spark, sf_dir, "documents")
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), files.row_digest(rows, F.col("doc_id").cast("string"), F.col("text")).alias("digest"))
