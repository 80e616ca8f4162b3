"""All report documents of a run from one table of partial scores.

Judgments are read once; what reports need of them is written narrow. That is reduced to a row per participant and combination
of slice values. Grouping sets over this small table, and the common cells, give scores per participant for every kind of report and every key in it; these are gathered per key (as
many entries as there are participants), then per kind, and all documents are put together in one row. Participants and
languages come in the given order, other keys in natural order.

Lists of failed samples alone grow with the run. They are cut in order into bounded parts: a document that lists more goes on in
further rows with ``part`` 1, 2, ..., each a JSON document of the same form that holds the next samples of every language.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridscore import domain
from gridscore.functions.keys import natural_key
from gridscore.operators.grid import Participant, participant_array
from gridscore.operators.reports import common_cell_rows, slice_keys
from gridscore.operators.windows import row_numbers
from gridscore.session import scratch_path

# The report files, and the slices of those that are keyed by a slice.
SLICE_REPORTS = {
    "context_turn_count": "leaderboard.by-context-turn-count",
    "speaker_mode": "leaderboard.by-speaker-mode",
    "context_turn_count_and_speaker_mode": "leaderboard.by-context-turn-count-and-speaker-mode",
    "primary_phenomenon": "leaderboard.by-primary-phenomenon",
    "context_expectation": "leaderboard.by-context-expectation",
}
REPORTS = (
    "run-status", "leaderboard.by-language", "severity-breakdown.by-language", "error-class-breakdown.by-language", "failed-samples.by-language",
    "summary-overall.penalty", "summary-overall.penalty.common-cell", "leaderboard.by-language.common-cell", "leaderboard.by-context-expectation.common-cell",
    "summary-overall.normalized", *SLICE_REPORTS.values(), "context-behavior.counts", "context-behavior.rates", "cost-summary", "cost-by-model",
)
#: Failed samples of a language in one part of a document; what is more goes on in the next part.
FAILURES_PER_PART = 20_000

_COUNTS = ("samples", "failed_samples", *domain.SEVERITY_POINTS, *domain.BEHAVIORS, "use", "missed", "ignore", "misused")
_SCORES = "struct<mean_penalty:double," + ",".join(f"{name}:bigint" for name in _COUNTS) + ",classes:map<string,bigint>>"


def narrow_rows(judgments: DataFrame) -> DataFrame:
    """Keys, status, counts and error classes alone, written once to the shared folder: texts are read and parsed one time, however
    many reports are made of them."""
    errors = [F.col("errors.class").alias("error_classes")] if "errors" in judgments.columns else []
    rows = judgments.select(
        "participant_id", "source_id", "target_language", "stable_key", "status", "total_penalty", *[f"{name}_count" for name in domain.SEVERITY_POINTS],
        "context_behavior", "context_turn_count", "speaker_mode", "primary_phenomenon", "context_expectation", *errors,
    )
    path = scratch_path(judgments.sparkSession, "report-rows")
    rows.write.parquet(path)
    return judgments.sparkSession.read.parquet(path)


def partial_scores(judgments: DataFrame) -> DataFrame:
    """Sums and counts per participant, language and combination of slice values: one scan, no text."""
    slices = slice_keys()
    del slices["context_turn_count_and_speaker_mode"]
    ok, behavior = F.col("status") == "ok", F.col("context_behavior")
    expects = lambda kind: ok & (F.col("_expects") == kind)
    rows = judgments.select(
        "participant_id", "target_language", "status", "total_penalty", "context_behavior", *[f"{name}_count" for name in domain.SEVERITY_POINTS],
        F.col("context_expectation").alias("_expects"), *[column.alias(f"_{name}") for name, column in slices.items()],
    )
    return rows.groupBy("participant_id", "target_language", *[f"_{name}" for name in slices]).agg(
        F.sum("total_penalty").alias("penalty"), F.count("total_penalty").alias("scored"), F.count_if(ok).alias("samples"),
        F.count_if(F.col("status") == "judge_failed").alias("failed_samples"),
        *[F.coalesce(F.sum(F.when(ok, F.col(f"{name}_count"))), F.lit(0)).cast("bigint").alias(name) for name in domain.SEVERITY_POINTS],
        *[F.count_if(behavior == name).alias(name) for name in domain.BEHAVIORS],
        F.count_if(expects("use")).alias("use"), F.count_if(expects("use") & (behavior == "missed_required_context")).alias("missed"),
        F.count_if(expects("ignore")).alias("ignore"), F.count_if(expects("ignore") & (behavior == "misused_context")).alias("misused"),
    )


def _scored(**fields: Column) -> Column:
    """A scores struct; what is not given is null."""
    kinds = {"mean_penalty": "double", **{name: "bigint" for name in _COUNTS}, "classes": "map<string,bigint>"}
    return F.struct(*[fields.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in kinds.items()])


def slice_scores(partial: DataFrame) -> DataFrame:
    """``kind, key, participant_id, scores`` for the whole run, every language and every slice value, from one expansion."""
    names = [c for c in partial.columns if c.startswith("_")]
    groups = {"overall": [], "language": ["target_language"], **{name[1:]: [name] for name in names}}
    groups["context_turn_count_and_speaker_mode"] = ["_context_turn_count", "_speaker_mode"]
    columns = ["participant_id", "target_language", *names]
    sets = [[F.col("participant_id"), *map(F.col, keys)] for keys in groups.values()]
    grouped = partial.groupingSets(sets, *columns).agg(
        F.grouping_id().alias("_gid"), (F.sum("penalty") / F.sum("scored")).alias("mean_penalty"), *[F.sum(name).alias(name) for name in _COUNTS],
    )
    kind = key = F.lit(None).cast("string")
    for name, keys in groups.items():
        # Bit i of the grouping id (from the left) is 0 for a grouped column.
        here = F.col("_gid") == sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in ("participant_id", *keys))
        kind = F.when(here, name).otherwise(kind)
        value = keys and F.when(F.forall(F.array(*keys), lambda v: v.isNotNull()), F.concat_ws("::", *keys))
        key = F.when(here, value if keys else F.lit("")).otherwise(key)
    scores = _scored(**{name: F.col(name) for name in ("mean_penalty", *_COUNTS)})
    return grouped.select(kind.alias("kind"), key.alias("key"), "participant_id", scores.alias("scores")).where("key is not null")


def common_scores(judgments: DataFrame, people: Sequence[Participant]) -> DataFrame:
    """The same over common cells: overall and by language from one gathering of cells, and cells within each expectation."""
    known = judgments.where(F.col("context_expectation").isin(*domain.EXPECTATIONS))
    expected = common_cell_rows(known, people, ("source_id", "target_language", "context_expectation"))
    parts = common_cell_rows(judgments, people).groupBy("target_language", "participant_id").agg(F.sum("penalty").alias("penalty"), F.sum("n").alias("n"))
    both = F.explode(F.array(F.struct(F.lit("common").alias("kind"), F.lit("").alias("key")), F.struct(F.lit("common_language").alias("kind"), F.col("target_language").alias("key"))))
    rows = parts.select(both.alias("g"), "participant_id", "penalty", "n").select("g.*", "participant_id", "penalty", "n")
    rows = rows.union(expected.select(F.lit("common_expectation"), "context_expectation", "participant_id", "penalty", "n"))
    summed = rows.groupBy("kind", "key", "participant_id").agg((F.sum("penalty") / F.sum("n")).alias("mean"), F.sum("n").alias("n"))
    return summed.select("kind", "key", "participant_id", _scored(mean_penalty=F.col("mean"), samples=F.col("n")).alias("scores"))


def error_scores(judgments: DataFrame) -> DataFrame:
    """Error classes per language and participant; their set is closed, so the map is bounded."""
    rows = judgments.select("target_language", "participant_id", F.explode_outer("error_classes").alias("class"))
    counts = rows.where("class is not null").groupBy("target_language", "participant_id", "class").agg(F.count(F.lit(1)).alias("n"))
    entries = F.array_sort(F.collect_list(F.struct("class", "n")))
    return counts.groupBy("target_language", "participant_id").agg(F.map_from_entries(entries).alias("classes")).select(
        F.lit("error_class").alias("kind"), F.col("target_language").alias("key"), "participant_id", _scored(classes=F.col("classes")).alias("scores"),
    )


def failed_entries(
    judgments: DataFrame, people: Sequence[Participant], languages: Sequence[str] = domain.LANGUAGES, per_part: int = FAILURES_PER_PART, most: int | None = None,
) -> DataFrame:
    """The failed samples as JSON arrays of at most ``per_part`` (``key, part, text``), in order per language (``key``).

    Samples are ranged over the tasks, stored, and numbered by the counts of the ranges before them, so no task holds all of a
    language. ``most``: an error if there are more in all, checked on counts before anything is gathered.
    """
    named = F.map_from_arrays(participant_array(people)["participant_id"], participant_array(people)["participant_display_name"])
    failed = judgments.where((F.col("status") == "judge_failed") & F.col("target_language").isin(*languages))
    entry = F.struct("participant_id", F.coalesce(F.element_at(named, F.col("participant_id")), "participant_id").alias("participant_display_name"), "source_id", "stable_key")
    rows = failed.select(F.col("target_language").alias("key"), "stable_key", "participant_id", entry.alias("entry"))
    if most is not None:
        total = failed.agg(F.count(F.lit(1)).alias("_total"))
        fits = F.when(F.col("_total") <= most, True).otherwise(
            F.raise_error(F.concat(F.col("_total").cast("string"), F.lit(f" failed samples are too many for one document (at most {most})"))).cast("boolean")
        )
        # The count is one row; joined first, it stops a run that is too large before its samples meet.
        rows = rows.withColumn("_one", F.lit(1)).join(total.select(F.lit(1).alias("_one"), fits.alias("_fits")), "_one").where("_fits").drop("_one", "_fits")
    path = scratch_path(judgments.sparkSession, "failed-samples")
    last = [F.col(name).asc_nulls_last() for name in ("stable_key", "participant_id")]
    rows.repartitionByRange("key", *last).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    stored = judgments.sparkSession.read.parquet(path).withColumns({f"_no_{name}": F.col(name).isNull() for name in ("stable_key", "participant_id")})
    order = ["_range", "_no_stable_key", "stable_key", "_no_participant_id", "participant_id"]
    numbered = row_numbers(stored, ["key"], order, "_number", width=1)
    parts = numbered.groupBy("key", F.floor((F.col("_number") - 1) / per_part).cast("int").alias("part"))
    return parts.agg(F.array_sort(F.collect_list(F.struct("_number", "entry"))).alias("_rows")).select(
        "key", "part", F.to_json(F.transform("_rows", lambda r: r["entry"])).alias("text")
    )


def _ordered(*names: str):
    """Comparison of structs by these fields; a null sorts last."""

    def compare(a: Column, b: Column) -> Column:
        result = F.lit(0)
        for name in reversed(names):
            less = (a[name] < b[name]) | (a[name].isNotNull() & b[name].isNull())
            more = (a[name] > b[name]) | (a[name].isNull() & b[name].isNotNull())
            result = F.when(less, -1).when(more, 1).otherwise(result)
        return result

    return compare


def _object(entries: Column) -> Column:
    """A JSON object of (name, JSON text) entries in their order."""

    def member(e: Column) -> Column:
        quoted = F.regexp_replace(F.to_json(F.array(e["name"])), r"^\[|\]$", "")
        return F.concat(quoted, F.lit(":"), e["text"])

    return F.concat(F.lit("{"), F.array_join(F.transform(entries, member), ","), F.lit("}"))


def _list(texts: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]"))


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[value.alias(name) for name, value in fields.items()]), {"ignoreNullFields": "false"})


def report_documents(
    judgments: DataFrame, people: Sequence[Participant], languages: Sequence[str] = domain.LANGUAGES, status: DataFrame | None = None,
    costs: DataFrame | None = None, most_failures: int | None = None, failures_per_part: int = FAILURES_PER_PART,
) -> DataFrame:
    """``report``, ``part`` and ``value`` (a JSON document) of every report.

    Every report has part 0; those that list failed samples go on in further parts if a language has more than
    ``failures_per_part`` of them. ``most_failures`` refuses runs with more in all.

    ``judgments``: normalised rows; ``errors`` may be absent. ``status``: one row of the fields of the run status. ``costs``: what
    ``cost_rollup`` returns. Without them the reports that they feed are left out. No judgments give empty leaderboards.
    """
    ids = [person.participant_id for person in people]
    judgments = narrow_rows(judgments)
    every = slice_scores(partial_scores(judgments)).union(common_scores(judgments, people))
    if "error_classes" in judgments.columns:
        every = every.union(error_scores(judgments))
    listed = every.where(F.col("participant_id").isin(*ids) | ~F.col("kind").isin("overall", "language"))
    entry = F.when(F.col("participant_id").isin(*ids), F.struct("participant_id", "scores"))
    keys = listed.groupBy("kind", "key").agg(F.map_from_entries(F.collect_list(entry)).alias("scores"))
    kinds = keys.groupBy("kind").agg(F.array_sort(F.collect_list(F.struct(natural_key("key").alias("place"), "key", "scores")), _ordered("place", "key")).alias("keys"))
    parts = kinds.agg(F.map_from_entries(F.collect_list(F.struct("kind", "keys"))).alias("found"), F.lit(None).cast("map<string,string>").alias("failed"))
    listed_failures = failed_entries(judgments, people, languages, failures_per_part, most_failures)
    gathered = F.map_from_entries(F.collect_list(F.struct("key", "text"))).alias("failed")
    failures = listed_failures.where("part = 0").agg(gathered)
    parts = parts.unionByName(failures.select(F.lit(None).cast(parts.schema["found"].dataType).alias("found"), "failed"))
    extra = []
    if status is not None:
        extra.append(status.select(F.lit("run-status").alias("report"), F.to_json(F.struct(*status.columns), {"ignoreNullFields": "false"}).alias("value")))
    if costs is not None:
        extra.append(_cost_documents(costs))
    row = parts.agg(F.max_by("found", F.col("found").isNotNull()).alias("found"), F.max_by("failed", F.col("failed").isNotNull()).alias("failed"))

    person = participant_array(people)
    nothing = F.array().cast(f"array<struct<place:string,key:string,scores:map<string,{_SCORES}>>>")
    of_kind = lambda kind: F.coalesce(F.element_at("found", F.lit(kind)), nothing)
    zero = lambda value: F.coalesce(value, F.lit(0))
    name = lambda p: {"participant_id": p["participant_id"], "participant_display_name": p["participant_display_name"]}

    def board(scores: Column) -> Column:
        def line(p: Column) -> Column:
            s = F.element_at(scores, p["participant_id"])
            return _json(**name(p), mean_penalty=s["mean_penalty"], samples=zero(s["samples"]), failed_samples=zero(s["failed_samples"]))

        return _list(F.transform(person, line))

    def common_board(scores: Column) -> Column:
        def line(p: Column) -> Column:
            s = F.element_at(scores, p["participant_id"])
            return _json(**name(p), mean_penalty=s["mean_penalty"], samples=zero(s["samples"]))

        return _list(F.transform(person, line))

    def by_person(scores: Column, fields) -> Column:
        return _object(F.transform(person, lambda p: F.struct(p["participant_id"].alias("name"), fields(F.element_at(scores, p["participant_id"])).alias("text"))))

    def severity(s: Column) -> Column:
        return _json(**{n: zero(s[n]) for n in domain.SEVERITY_POINTS})

    def behaviors(s: Column) -> Column:
        return _json(**{n: zero(s[n]) for n in domain.BEHAVIORS})

    def rates(s: Column) -> Column:
        rate = lambda hits, base: F.coalesce(s[hits] / F.nullif(s[base], F.lit(0)), F.lit(0.0))
        return _json(missed_required_context_rate=rate("missed", "use"), misused_context_rate=rate("misused", "ignore"))

    def classes(s: Column) -> Column:
        return F.coalesce(F.to_json(s["classes"]), F.lit("{}"))

    def of_key(kind: str, key: Column) -> Column:
        return F.get(F.filter(of_kind(kind), lambda k: k["key"] == key), F.lit(0))["scores"]

    def by_language(document) -> Column:
        return _object(F.transform(F.array(*map(F.lit, languages)), lambda code: F.struct(code.alias("name"), document(code).alias("text"))))

    def by_key(kind: str, document) -> Column:
        return _object(F.transform(of_kind(kind), lambda k: F.struct(k["key"].alias("name"), document(k["scores"]).alias("text"))))

    failed = lambda code: F.coalesce(F.element_at("failed", code), F.lit("[]"))
    whole = of_key("overall", F.lit(""))

    def language_document(code: Column) -> Column:
        return F.concat(
            F.lit('{"leaderboard":'), board(of_key("language", code)), F.lit(',"severityBreakdown":'), by_person(of_key("language", code), severity),
            F.lit(',"errorClassBreakdown":'), by_person(of_key("error_class", code), classes), F.lit(',"failures":'), failed(code), F.lit("}"),
        )

    documents = {
        "leaderboard.by-language": by_language(language_document),
        "severity-breakdown.by-language": by_language(lambda code: by_person(of_key("language", code), severity)),
        "error-class-breakdown.by-language": by_language(lambda code: by_person(of_key("error_class", code), classes)),
        "failed-samples.by-language": by_language(failed),
        "summary-overall.penalty": _list(F.transform(person, lambda p: _json(**name(p), mean_penalty=F.element_at(whole, p["participant_id"])["mean_penalty"]))),
        "summary-overall.penalty.common-cell": common_board(of_key("common", F.lit(""))),
        "leaderboard.by-language.common-cell": by_language(lambda code: common_board(of_key("common_language", code))),
        "leaderboard.by-context-expectation.common-cell": _object(F.transform(
            F.filter(of_kind("context_expectation"), lambda k: k["key"].isin(*domain.EXPECTATIONS)),
            lambda k: F.struct(k["key"].alias("name"), common_board(of_key("common_expectation", k["key"])).alias("text")),
        )),
        "summary-overall.normalized": _list(F.transform(person, lambda p: _json(**name(p), normalized_macro_mean_penalty=_normalized(p, languages, of_key, person)))),
        **{report: by_key(kind, board) for kind, report in SLICE_REPORTS.items()},
        "context-behavior.counts": by_person(whole, behaviors),
        "context-behavior.rates": by_person(whole, rates),
    }
    if "error_classes" not in judgments.columns:
        del documents["error-class-breakdown.by-language"]
    result = row.select(F.inline(F.array(*[F.struct(F.lit(report).alias("report"), value.alias("value")) for report, value in documents.items()])))
    for more in extra:
        result = result.unionByName(more)

    # Later parts: the languages that have samples left.
    left = F.filter(F.array(*map(F.lit, languages)), lambda code: F.element_at("failed", code).isNotNull())
    of_left = lambda document: _object(F.transform(left, lambda code: F.struct(code.alias("name"), document(F.element_at("failed", code)).alias("text"))))
    later = {"leaderboard.by-language": of_left(lambda text: F.concat(F.lit('{"failures":'), text, F.lit("}"))), "failed-samples.by-language": of_left(lambda text: text)}
    rest = listed_failures.where("part > 0").groupBy("part").agg(gathered)
    rest = rest.select("part", F.inline(F.array(*[F.struct(F.lit(report).alias("report"), value.alias("value")) for report, value in later.items()])))
    return result.select("report", F.lit(0).alias("part"), "value").unionByName(rest)


def _normalized(p: Column, languages: Sequence[str], of_key, person: Column) -> Column:
    """Mean over the languages of the participant's place between the best (0) and the worst (1) mean penalty."""

    def place(code: Column) -> Column:
        scores = of_key("language", code)
        means = F.transform(person, lambda q: F.element_at(scores, q["participant_id"])["mean_penalty"])
        own, low, high = F.element_at(scores, p["participant_id"])["mean_penalty"], F.array_min(means), F.array_max(means)
        return F.when(own.isNotNull(), F.coalesce((own - low) / F.nullif(high - low, F.lit(0.0)), F.lit(0.0)))

    places = F.filter(F.transform(F.array(*map(F.lit, languages)), place), lambda x: x.isNotNull())
    total = F.aggregate(places, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(places) > 0, total / F.size(places))


def _cost_documents(costs: DataFrame) -> DataFrame:
    """Costs by phase, by model and overall as one document, and by model alone."""
    text = F.to_json(F.struct(F.col("total_cost_usd").cast("double").alias("totalCostUsd"), F.col("unknown_cost_records").alias("unknownCostRecordCount")))
    entries = costs.select("view", F.struct(F.coalesce("value", F.lit("")).alias("name"), text.alias("text")).alias("e"))
    views = entries.groupBy("view").agg(F.array_sort(F.collect_list("e")).alias("entries"))
    row = views.agg(F.map_from_entries(F.collect_list(F.struct("view", "entries"))).alias("views"))
    empty = F.array().cast("array<struct<name:string,text:string>>")
    of = lambda view: F.coalesce(F.element_at("views", F.lit(view)), empty)
    summary = F.concat(F.lit('{"byPhase":'), _object(of("phase")), F.lit(',"byModel":'), _object(of("model")), F.lit(',"overall":'), F.get(of("overall"), F.lit(0))["text"], F.lit("}"))
    both = F.array(F.struct(F.lit("cost-summary").alias("report"), summary.alias("value")), F.struct(F.lit("cost-by-model").alias("report"), _object(of("model")).alias("value")))
    return row.select(F.inline(both))
