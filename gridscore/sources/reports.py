"""Report files: keyed leaderboards, optional reports, the run summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridscore.session import path_exists
from gridscore.sources.files import latest_version, write_marker


def _rows(value: Column) -> Column:
    """Leaderboard rows of a slice: the value itself if an array, else its ``leaderboard``."""
    direct = F.try_variant_get(value, "$", "array<variant>")
    nested = F.try_variant_get(value, "$.leaderboard", "array<variant>")
    return F.coalesce(direct, nested, F.array().cast("array<variant>"))


def _typed(row: Column, name: str, kind: str) -> Column:
    """Field value if it has the wanted JSON type, else null."""
    value = F.try_variant_get(row, f"$.{name}", "variant")
    json_type = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
    wanted = json_type == "STRING" if kind == "string" else json_type.isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")
    return F.when(wanted, F.try_variant_get(row, f"$.{name}", kind))


def leaderboard_fields(row: Column) -> list[Column]:
    """Defaults: name falls back to the id, a mean that is no number is null, counts are zero."""
    participant = F.coalesce(_typed(row, "participant_id", "string"), F.lit(""))
    return [
        participant.alias("participant_id"),
        F.coalesce(_typed(row, "participant_display_name", "string"), participant).alias("participant_display_name"),
        _typed(row, "mean_penalty", "double").alias("mean_penalty"),
        F.coalesce(_typed(row, "samples", "bigint"), F.lit(0)).alias("samples"),
        F.coalesce(_typed(row, "failed_samples", "bigint"), F.lit(0)).alias("failed_samples"),
    ]


def _documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("document"))


def read_keyed_report(spark: SparkSession, path: str) -> DataFrame:
    """``{slice: rows}`` or ``{slice: {leaderboard: rows}}`` as rows with a ``slice`` column."""
    slices = _documents(spark, path).select(F.explode(F.try_variant_get("document", "$", "map<string,variant>")).alias("slice", "value"))
    rows = slices.select("slice", F.posexplode(_rows(F.col("value"))).alias("ord", "row"))
    return rows.select("slice", "ord", *leaderboard_fields(F.col("row")))


def read_optional_rows(spark: SparkSession, path: str) -> DataFrame | None:
    """Rows of an array report; None if the file is absent or not an array, so that the caller
    falls back."""
    if not path_exists(spark, path):
        return None
    documents = _documents(spark, path).select(F.try_variant_get("document", "$", "array<variant>").alias("rows"))
    if not documents.where("rows IS NULL").isEmpty():
        return None
    return documents.select(F.posexplode("rows").alias("ord", "row")).select("ord", *leaderboard_fields(F.col("row")))


def keyed_document(rows: DataFrame, key: str, order: str, columns: Sequence[str]) -> DataFrame:
    """All rows of a report as one JSON object, keyed by ``key``.

    Input is a report (one row per participant and slice), so every array is bounded by the
    participant dimension. Null fields are written.
    """
    entry = F.struct(F.col(order).alias("_ord"), *columns)
    slices = rows.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("_rows"))
    plain = F.transform("_rows", lambda r: F.struct(*[r[name].alias(name) for name in columns]))
    whole = slices.agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("key"), plain.alias("value")))).alias("_entries"))
    return whole.select(F.to_json(F.map_from_entries("_entries"), {"ignoreNullFields": "false"}).alias("value"))


# Sentences of the run summary.
SUMMARY_CAVEATS = (
    "Primary score: raw mean penalty over common cells (intersection of cells judged for every participant); lower is better.",
    "Secondary score: raw mean penalty over all valid cells available per participant; lower is better.",
    "DeepL rows are reuse-only partial rows with missing cells and are marked benchmark_valid=false.",
    "Full reruns require paid APIs, credentials, and the configured judge backend/model.",
)
# The published files and how their scores are described.
PUBLIC_REPORTS = (
    "leaderboard.overall.csv", "leaderboard.overall.common-cell.csv", "leaderboard.by-language.csv", "leaderboard.by-language.common-cell.csv",
    "leaderboard.by-context-expectation.csv", "leaderboard.by-context-expectation.common-cell.csv", "context-behavior.csv", "run-summary.json",
)
PRIMARY_SCORE = ("raw mean penalty over common cells (cells judged for every participant)", "leaderboard.overall.common-cell.csv")
SECONDARY_SCORE = ("raw mean penalty over all valid judged cells available per participant", "leaderboard.overall.csv")
LEGACY_CAVEAT = "Common-cell leaderboards cover only the main run participants; separate legacy DeepL runs are excluded from the common-cell view."


def benchmark_config(benchmark_id: Column) -> Column:
    return F.concat(F.lit("data/benchmarks/"), benchmark_id, F.lit(".json"))


def source_runs(manifests: DataFrame, status: DataFrame, counts: DataFrame) -> DataFrame:
    """One row per run for the summary: its identity, its participants, its status and their sample counts.

    ``manifests``: public manifests with ``ord``, the place of the run in the summary. ``status``: ``runId`` and the fields of the
    public status. ``counts``: ``run_id, participant_id, valid, expected, unresolved``, gathered per run in the order of its
    participants, so they are bounded by these. A participant without counts has zeros.
    """
    samples = counts.groupBy(F.col("run_id").alias("runId")).agg(F.map_from_entries(F.collect_list(F.struct("participant_id", F.struct("valid", "expected", "unresolved")))).alias("_samples"))
    shown = [name for name in status.columns if name not in ("runId", "judgeFailureRatesByParticipantLanguage")]
    state = status.select("runId", F.struct(*shown).alias("runStatus"))
    of = lambda p: F.element_at("_samples", p["participantId"])
    zero = lambda value: F.coalesce(value, F.lit(0)).cast("bigint")
    own = F.transform("participants", lambda p: F.struct(
        p["participantId"].alias("participantId"), zero(of(p)["valid"]).alias("validSamples"), zero(of(p)["expected"]).alias("expectedSamples"),
        zero(of(p)["unresolved"]).alias("unresolvedCells"),
    ))
    rows = manifests.join(state, "runId", "left").join(samples, "runId", "left")
    fields = [name for name in manifests.columns if name not in ("ord", "runId", "participants")]
    return rows.select(
        "ord", "runId", benchmark_config(F.col("benchmarkId")).alias("benchmarkConfig"), *fields, F.col("participants").alias("participantSet"), "runStatus",
        own.alias("participantSampleCounts"),
    )


def run_summary(
    overall: DataFrame, common: DataFrame, runs: DataFrame, generated_at: str, with_legacy: bool, benchmark_id: str | None = None, common_cells: int | None = None,
) -> DataFrame:
    """One JSON document: runs, both leaderboards in rank order, how they are scored, caveats.

    ``overall`` and ``common`` are ranked report rows; ``runs`` has one row per source run, in the order of its first column if
    that is ``ord``. ``common_cells`` is the count that the run status gives, if it does; else the fullest common row counts.
    """
    def board(rows: DataFrame, tag: str, columns: dict[str, Column]) -> DataFrame:
        entry = F.struct(*[column.alias(name) for name, column in columns.items()])
        text = F.to_json(entry, {"ignoreNullFields": "false"})
        ordered = F.array_sort(F.collect_list(F.struct(F.col(rows.columns[0] if "rank" not in rows.columns else "rank").alias("place"), text.alias("text"))))
        joined = F.array_join(F.transform(ordered, lambda e: e["text"]), ",")
        return rows.agg(F.concat(F.lit("["), joined, F.lit("]")).alias("json")).select(F.lit(tag).alias("tag"), "json")

    def columns(**names: str) -> dict[str, Column]:
        return {name: F.col(source) for name, source in names.items()}

    shared = columns(rank="rank", participantId="participant_id", displayName="participant_display_name", meanPenalty="mean_penalty")
    tail = columns(benchmarkValid="benchmark_valid", caveat="caveat", sourceRunId="source_run_id")
    parts = board(overall, "leaderboard", {**shared, **columns(samples="samples"), **tail})
    parts = parts.unionByName(board(common, "primaryCommonCellLeaderboard", {**shared, **columns(commonCellSamples="samples"), **tail, **columns(coverage="coverage")}))
    parts = parts.unionByName(board(runs, "sourceRuns", {name: F.col(name) for name in runs.columns if name != "ord"}))
    cells = F.coalesce(F.lit(common_cells).cast("bigint"), F.max("samples"), F.lit(0)).cast("string")
    parts = parts.unionByName(common.agg(cells.alias("json")).select(F.lit("commonCellCount").alias("tag"), "json"))
    caveats = [*SUMMARY_CAVEATS, *([LEGACY_CAVEAT] if with_legacy else [])]
    merged = parts.agg(F.array_sort(F.collect_list(F.struct("tag", "json"))).alias("parts"))
    fields = F.transform("parts", lambda p: F.concat(F.lit('"'), p["tag"], F.lit('":'), p["json"]))
    scored = lambda metric, source: F.struct(F.lit(metric).alias("metric"), F.lit(True).alias("lowerIsBetter"), F.lit(source).alias("source"))
    fixed = F.to_json(F.struct(
        F.lit(generated_at).alias("generatedAtUtc"), F.lit(2).alias("reportVersion"), benchmark_config(F.lit(benchmark_id).cast("string")).alias("benchmarkConfig"),
        F.array(*map(F.lit, PUBLIC_REPORTS)).alias("publicReports"), scored(*PRIMARY_SCORE).alias("primaryScore"), scored(*SECONDARY_SCORE).alias("secondaryScore"),
        F.array(*map(F.lit, caveats)).alias("caveats"),
    ))
    return merged.select(F.concat(F.regexp_replace(fixed, r"\}\z", ","), F.array_join(fields, ","), F.lit("}")).alias("value"))


def write_document_set(documents: DataFrame, root: str) -> int:
    """Write rows (``report, value``) as a new version of a set of files and return its number.

    One job writes all reports, each part to its own folder; ``ord`` (optional) orders the lines of a part. Every part lies in one
    task, since it is one document or a table of participants; a report that grows with the run has many (``part``, optional).
    A marker written last makes the whole set visible at once.
    """
    spark = documents.sparkSession
    number = latest_version(spark, root) + 1
    lines = documents.withColumns({name: F.lit(0) for name in ("part", "ord") if name not in documents.columns})
    dealt = lines.repartition("report", "part").sortWithinPartitions("report", "part", "ord").select("report", "part", "value")
    dealt.write.mode("overwrite").partitionBy("report", "part").text(f"{root}/version={number}")
    write_marker(spark, root, number)
    return number


def read_document_set(spark: SparkSession, root: str) -> DataFrame:
    """``report``, ``part`` and ``value`` of the newest whole set; lines of one part are in order within its file."""
    number = latest_version(spark, root)
    if not number:
        raise ValueError(f"no complete set of reports in {root}")
    return spark.read.schema("value string, report string, part int").text(f"{root}/version={number}")


def csv_documents(tables: dict[str, tuple[DataFrame, Sequence[str], Sequence[str]]]) -> DataFrame:
    """Lines (``report, ord, value``) of CSV reports for ``write_document_set``: per report its rows, columns and order.

    Rows are reports, bounded by participants and slices, so numbering those of one report in one task is enough.
    """
    from gridscore.functions.csvcells import csv_lines

    result = None
    for report, (rows, columns, order) in tables.items():
        place = F.row_number().over(Window.partitionBy(F.lit(report)).orderBy(*order))
        body = csv_lines(rows.withColumn("ord", place), columns).select(F.lit(report).alias("report"), "ord", "value")
        header = rows.sparkSession.range(1).select(F.lit(report).alias("report"), F.lit(0).alias("ord"), F.lit(",".join(columns)).alias("value"))
        lines = header.unionByName(body)
        result = lines if result is None else result.unionByName(lines)
    return result
