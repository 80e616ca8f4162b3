"""Leaderboards and rates: known small rows, empty input, and invariants on random grids."""

import json
import random

import pytest
from pyspark.sql import functions as F

from gridscore import domain
from gridscore.operators import report_set, reports
from gridscore.operators.grid import cell_grid, participants
from gridscore.operators.validity import group_outcomes, validity
from gridscore.sources import reports as sources

SCHEMA = (
    "source_id string, target_language string, participant_id string, status string, critical_count int, major_count int, minor_count int, "
    "total_penalty bigint, context_behavior string, context_turn_count int, speaker_mode string, context_expectation string, primary_phenomenon string, stable_key string"
)


def row(source, lang, person, penalty, behavior=None, turns=None, mode=None, expectation=None, phenomenon=None):
    ok = penalty is not None
    critical, rest = divmod(penalty or 0, 25)
    return (
        source, lang, person, "ok" if ok else "judge_failed", critical if ok else None, rest // 5 if ok else None, rest % 5 if ok else None, penalty,
        behavior, turns, mode, expectation, phenomenon, f"r::{source}::{lang}::{person}",
    )


KNOWN = [
    row("i1", "en", "a", 0, "used_correctly", 1, "dyadic", "use", "referent_resolution"),
    row("i2", "ja", "a", 5, "missed_required_context", 2, "single", "use", "register_carryover"),
    row("i3", "zh-Hans", "a", 1, "misused_context", 3, "dyadic", "ignore", "false_lead_trap"),
    row("i4", "en", "a", 0, "ignored_irrelevant_context", 1, "single", "ignore", "topic_shift_independence"),
    row("i5", "en", "b", None, None, 2, "dyadic", "use", "pragmatic_intent_resolution"),
]
PEOPLE = participants(["a", "b"])


@pytest.fixture(scope="module")
def known(spark):
    return spark.createDataFrame(KNOWN, SCHEMA).cache()


def by(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_means_and_slices(known):
    means = by(reports.mean_penalties(known, PEOPLE), "participant_id")
    assert means[("a",)].mean_penalty == 1.5 and means[("b",)].mean_penalty is None
    slices = by(reports.all_slices(known, PEOPLE), "slice_kind", "slice", "participant_id")
    assert slices[("context_turn_count", "1", "a")].samples == 2
    assert slices[("speaker_mode", "single", "a")].samples == 2
    assert slices[("context_turn_count_and_speaker_mode", "1::single", "a")].samples == 1
    assert slices[("primary_phenomenon", "referent_resolution", "a")].mean_penalty == 0
    assert slices[("context_expectation", "use", "a")].samples == 2
    # A failed row alone opens a slice value.
    assert slices[("primary_phenomenon", "pragmatic_intent_resolution", "b")].failed_samples == 1
    assert slices[("primary_phenomenon", "pragmatic_intent_resolution", "a")].mean_penalty is None


def test_behaviors(known):
    counts = by(reports.behavior_counts(known, PEOPLE), "participant_id")
    assert [counts[("a",)][name] for name in domain.BEHAVIORS] == [1, 1, 1, 1, 0]
    assert [counts[("b",)][name] for name in domain.BEHAVIORS] == [0] * 5
    rates = by(reports.behavior_rates(known, PEOPLE), "participant_id")
    assert (rates[("a",)].missed_required_context_rate, rates[("a",)].misused_context_rate) == (0.5, 0.5)
    assert rates[("b",)].missed_required_context_rate == 0


def test_languages_come_from_the_argument(known):
    rows = reports.language_leaderboard(known, PEOPLE, ["en"]).collect()
    assert {r.target_language for r in rows} == {"en"} and len(rows) == 2
    quiet = reports.language_leaderboard(known, PEOPLE, ["ko"]).collect()
    assert [(r.samples, r.mean_penalty) for r in quiet] == [(0, None)] * 2


def test_participant_order_is_input_order(known):
    rows = reports.mean_penalties(known, participants(["b", {"participantId": "a", "displayName": "Model A"}])).orderBy("ord").collect()
    assert [(r.participant_id, r.participant_display_name) for r in rows] == [("b", "b"), ("a", "Model A")]


def test_failed_samples_fall_back_to_the_id(known):
    rows = reports.failed_samples(known, participants([("a", "Model A")])).collect()
    assert [(r.participant_id, r.participant_display_name, r.source_id) for r in rows] == [("b", "b", "i5")]


def random_rows(seed):
    rng = random.Random(seed)
    rows = []
    for item in range(30):
        for lang in domain.LANGUAGES:
            for person in "abc":
                if rng.random() < 0.15:
                    continue
                penalty = None if rng.random() < 0.1 else rng.choice([0, 1, 2, 5, 6, 25, 31])
                for _ in range(2 if rng.random() < 0.05 else 1):
                    rows.append(row(f"i{item}", lang, person, penalty, rng.choice(domain.BEHAVIORS), item % 3 + 1, "single", rng.choice(domain.EXPECTATIONS), "p"))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_invariants(spark, seed):
    data = random_rows(seed)
    rows, people = spark.createDataFrame(data, SCHEMA), participants(["a", "b", "c"])
    board = reports.language_leaderboard(rows, people)
    total = {r.participant_id: r.mean_penalty for r in reports.mean_penalties(rows, people).collect()}
    for person in "abc":
        parts = [r for r in board.collect() if r.participant_id == person and r.samples]
        weighted = sum(r.samples * r.mean_penalty for r in parts) / sum(r.samples for r in parts)
        assert weighted == pytest.approx(total[person])
    points = {r.participant_id: (25 * r.critical + 5 * r.major + r.minor) for r in reports.severity_totals(rows, people).groupBy("participant_id").agg(
        *[F.sum(name).alias(name) for name in domain.SEVERITY_POINTS]).collect()}
    assert points == {p: sum(r[7] for r in data if r[2] == p and r[7] is not None) for p in "abc"}
    # Common cells by plain set logic.
    ok = {p: {(r[0], r[1]) for r in data if r[2] == p and r[7] is not None} for p in "abc"}
    common = ok["a"] & ok["b"] & ok["c"]
    expected = {p: [r[7] for r in data if r[2] == p and r[7] is not None and (r[0], r[1]) in common] for p in "abc"}
    for r in reports.common_cell_leaderboard(rows, people).collect():
        assert r.samples == len(expected[r.participant_id])
        assert r.mean_penalty == pytest.approx(sum(expected[r.participant_id]) / r.samples)
    for r in reports.normalized_macro_mean(board).collect():
        assert 0 <= r.normalized_macro_mean_penalty <= 1


def test_slices_in_one_pass_equal_single_slices(spark):
    rows, people = spark.createDataFrame(random_rows(3), SCHEMA), participants(["a", "b", "c"])
    key = ("slice", "participant_id", "mean_penalty", "samples", "failed_samples")
    together = reports.all_slices(rows, people)
    for kind, column in reports.slice_keys().items():
        single = {tuple(r[k] for k in key) for r in reports.slice_leaderboard(rows, people, column).collect()}
        assert {tuple(r[k] for k in key) for r in together.where(F.col("slice_kind") == kind).collect()} == single


def test_empty_input(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert [r.mean_penalty for r in reports.mean_penalties(none, PEOPLE).collect()] == [None, None]
    assert {r.samples for r in reports.common_cell_leaderboard(none, PEOPLE).collect()} == {0}
    assert reports.all_slices(none, PEOPLE).count() == 0
    assert reports.normalized_macro_mean(reports.language_leaderboard(none, PEOPLE)).first().normalized_macro_mean_penalty is None


@pytest.mark.parametrize("failed, valid", [(1, True), (2, False)])
def test_one_percent_of_failures_is_the_limit(spark, failed, valid):
    rows = spark.range(100).select(
        F.lit("a").alias("participant_id"), F.lit("en").alias("target_language"), F.when(F.col("id") < failed, "judge_failed").otherwise("ok").alias("status")
    )
    outcomes = group_outcomes(rows, participants(["a"]), ["en"])
    verdict = validity(outcomes, rows, rows, rows.limit(0), expected=100).first()
    assert verdict.benchmark_valid is valid
    assert validity(outcomes, rows, rows, rows.limit(1), expected=100).first().benchmark_valid is False
    assert validity(outcomes, rows, rows, rows.limit(0), expected=101).first().benchmark_valid is False


def test_cell_grid(spark):
    cells = cell_grid(spark.createDataFrame([("s1",), ("s2",)], "source_id string"), ["en", "ja"], PEOPLE, "r")
    assert cells.count() == 8 and cells.select("stable_key").distinct().count() == 8
    assert "r::s2::ja::b" in {r.stable_key for r in cells.collect()}


def whole_set(spark, tmp_path, rows, people, **more):
    root = str(tmp_path / "set")
    sources.write_document_set(report_set.report_documents(rows, people, ("en", "ja", "zh-Hans"), **more), root)
    return {r.report: json.loads(r.value) for r in sources.read_document_set(spark, root).collect()}


def test_report_set_of_known_rows(spark, tmp_path, known):
    classes = F.when(F.col("major_count") > 0, F.array(F.struct(F.lit("fluency/register").alias("class")))).otherwise(F.array().cast("array<struct<class:string>>"))
    status = spark.createDataFrame([(False, 5, None)], "benchmarkValid boolean, totalExpected bigint, note string")
    costed = spark.createDataFrame([("phase", "judge", 1.5, 1), ("phase", "translation", 0.0, 0), ("model", 'm"1', 1.5, 1), ("overall", None, 1.5, 1)], "view string, value string, total_cost_usd double, unknown_cost_records bigint")
    found = whole_set(spark, tmp_path, known.withColumn("errors", classes), participants([("a", 'Model "A"'), ("b", "b")]), status=status, costs=costed)
    assert set(found) == set(report_set.REPORTS)
    english = found["leaderboard.by-language"]["en"]
    assert english["leaderboard"][0] == {"participant_id": "a", "participant_display_name": 'Model "A"', "mean_penalty": 0.0, "samples": 2, "failed_samples": 0}
    assert english["leaderboard"][1]["mean_penalty"] is None and english["leaderboard"][1]["failed_samples"] == 1
    assert english["failures"] == [{"participant_id": "b", "participant_display_name": "b", "source_id": "i5", "stable_key": "r::i5::en::b"}]
    assert found["failed-samples.by-language"]["ja"] == [] and len(found["failed-samples.by-language"]["en"]) == 1
    assert found["severity-breakdown.by-language"]["ja"]["a"] == {"critical": 0, "major": 1, "minor": 0}
    assert found["error-class-breakdown.by-language"]["ja"] == {"a": {"fluency/register": 1}, "b": {}}
    assert [r["mean_penalty"] for r in found["summary-overall.penalty"]] == [1.5, None]
    assert found["summary-overall.normalized"][0]["normalized_macro_mean_penalty"] == 0 and found["summary-overall.normalized"][1]["normalized_macro_mean_penalty"] is None
    assert list(found["leaderboard.by-context-turn-count"]) == ["1", "2", "3"]
    assert found["leaderboard.by-context-turn-count-and-speaker-mode"]["1::single"][0]["samples"] == 1
    assert found["context-behavior.counts"]["a"]["missed_required_context"] == 1 and found["context-behavior.counts"]["b"]["unclear"] == 0
    assert found["context-behavior.rates"] == {"a": {"missed_required_context_rate": 0.5, "misused_context_rate": 0.5}, "b": {"missed_required_context_rate": 0.0, "misused_context_rate": 0.0}}
    assert list(found["leaderboard.by-context-expectation.common-cell"]) == ["ignore", "use"]
    assert found["summary-overall.penalty.common-cell"][0] == {"participant_id": "a", "participant_display_name": 'Model "A"', "mean_penalty": None, "samples": 0}
    assert found["run-status"] == {"benchmarkValid": False, "totalExpected": 5, "note": None}
    assert found["cost-by-model"] == {'m"1': {"totalCostUsd": 1.5, "unknownCostRecordCount": 1}}
    assert found["cost-summary"]["overall"] == {"totalCostUsd": 1.5, "unknownCostRecordCount": 1} and set(found["cost-summary"]["byPhase"]) == {"judge", "translation"}


@pytest.mark.parametrize("n", [0, 400])
def test_report_set_equals_the_single_reports(spark, tmp_path, n):
    rows, people = spark.createDataFrame(random_rows(5)[:n], SCHEMA), participants(["c", "a", "b"])
    found = whole_set(spark, tmp_path, rows, people)
    shown = lambda r: (r["participant_id"], pytest.approx(r["mean_penalty"]), r["samples"], r["failed_samples"])
    for kind, report in report_set.SLICE_REPORTS.items():
        single = reports.slice_leaderboard(rows, people, reports.slice_keys()[kind]).orderBy("slice", "ord").collect()
        assert [shown(r) for r in single] == [(r["participant_id"], r["mean_penalty"], r["samples"], r["failed_samples"]) for key in sorted(found[report]) for r in found[report][key]]
    by_language = reports.language_leaderboard(rows, people, ("en", "ja", "zh-Hans")).orderBy("target_language", "ord").collect()
    assert [shown(r) for r in by_language] == [
        (r["participant_id"], r["mean_penalty"], r["samples"], r["failed_samples"]) for code in ("en", "ja", "zh-Hans") for r in found["leaderboard.by-language"][code]["leaderboard"]
    ]
    common = {r.participant_id: r for r in reports.common_cell_leaderboard(rows, people).collect()}
    for r in found["summary-overall.penalty.common-cell"]:
        assert (r["mean_penalty"], r["samples"]) == (pytest.approx(common[r["participant_id"]].mean_penalty), common[r["participant_id"]].samples)
    normal = {r.participant_id: r.normalized_macro_mean_penalty for r in reports.normalized_macro_mean(reports.language_leaderboard(rows, people, ("en", "ja", "zh-Hans"))).collect()}
    for r in found["summary-overall.normalized"]:
        assert r["normalized_macro_mean_penalty"] == pytest.approx(normal[r["participant_id"]])


def test_too_many_failures_and_unfinished_sets(spark, tmp_path, known):
    with pytest.raises(Exception, match="too many for one document"):
        report_set.report_documents(known, PEOPLE, most_failures=0).collect()
    with pytest.raises(ValueError, match="no complete set"):
        sources.read_document_set(spark, str(tmp_path / "nothing"))


def test_failed_samples_go_on_in_parts(spark, tmp_path):
    rows, people = spark.createDataFrame(random_rows(5), SCHEMA), participants(["c", "a", "b"])
    codes = ("en", "ja", "zh-Hans")
    whole = whole_set(spark, tmp_path, rows, people)
    root = str(tmp_path / "parts")
    sources.write_document_set(report_set.report_documents(rows, people, codes, failures_per_part=2), root)
    parts = {(r.report, r.part): json.loads(r.value) for r in sources.read_document_set(spark, root).collect()}
    first = {report: value for (report, part), value in parts.items() if part == 0}
    last = max(part for _, part in parts)
    assert last > 2
    joined = lambda report, of: {code: [e for part in range(last + 1) for e in of(parts.get((report, part), {}).get(code, {}))] for code in codes}
    assert joined("failed-samples.by-language", list) == whole["failed-samples.by-language"]
    assert joined("leaderboard.by-language", lambda v: v.get("failures", [])) == whole["failed-samples.by-language"]
    assert all(len(v) <= 2 for (report, _), value in parts.items() if report == "failed-samples.by-language" for v in value.values())
    for report in set(whole) - {"failed-samples.by-language", "leaderboard.by-language"}:
        assert first[report] == whole[report]
    assert {code: dict(v, failures=whole["failed-samples.by-language"][code]) for code, v in first["leaderboard.by-language"].items()} == whole["leaderboard.by-language"]


def test_no_limit_on_failed_samples(spark, tmp_path):
    """More failed samples than a document once could hold."""
    number = F.col("id").cast("string")
    rows = spark.range(100_500).select(*[
        {"source_id": number, "target_language": F.lit("en"), "participant_id": F.lit("a"), "status": F.lit("judge_failed"), "stable_key": F.concat(F.lit("r::"), F.lpad(number, 6, "0"))}
        .get(name, F.lit(None)).cast(kind).alias(name) for name, kind in (field.split() for field in SCHEMA.split(", "))
    ])
    root = str(tmp_path / "many")
    sources.write_document_set(report_set.report_documents(rows, PEOPLE, ("en",)), root)
    found = sources.read_document_set(spark, root).where("report = 'failed-samples.by-language'").orderBy("part").collect()
    listed = [e["source_id"] for r in found for e in json.loads(r.value)["en"]]
    assert len(found) == 6 and listed == [str(n) for n in range(100_500)]


def test_csv_set(spark, tmp_path):
    board = spark.createDataFrame([(2, "b", 0.5), (1, "=a", None)], "rank int, participant_id string, mean_penalty double")
    root = str(tmp_path / "csv")
    lines = sources.csv_documents({"overall": (board, ["rank", "participant_id", "mean_penalty"], ["rank"]), "empty": (board.where("false"), ["rank"], ["rank"])})
    assert sources.write_document_set(lines, root) == 1 and sources.write_document_set(lines, root) == 2
    found = {}
    for r in sources.read_document_set(spark, root).collect():
        found.setdefault(r.report, []).append(r.value)
    assert found == {"overall": ["rank,participant_id,mean_penalty", "1,'=a,", "2,b,0.500000"], "empty": ["rank"]}
