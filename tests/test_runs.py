"""Run tables, manifests, batches, costs and progress on small literal rows."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from gridscore.operators import batches, costs, manifests, progress, ranking, runs

FAILURES = "stable_key string, recorded_at string, seq int, participant_id string, source_id string, target_language string"


def test_unresolved_failures_keep_the_newest(spark):
    failures = spark.createDataFrame(
        [("a", "2026-01-01", 1, "p", "s", "en"), ("a", "2026-01-01", 2, "p", "s", "en"), ("b", "2026-01-03", 3, "p", "s", "ja"), ("a", "2025-12-31", 4, "p", "s", "en")], FAILURES)
    done = spark.createDataFrame([("b",)], "stable_key string")
    unresolved = runs.unresolved_failures(done, failures)
    assert [(r.stable_key, r.seq) for r in unresolved.collect()] == [("a", 2)]
    ids = spark.createDataFrame([("p", "s")], "participant_id string, source_id string")
    carried = runs.carried_failures(failures, unresolved, ids, ids, "new")
    assert sorted(r.seq for r in carried.collect()) == [1, 2, 4] and {r.stable_key for r in carried.collect()} == {"new::s::en::p"}


def test_missing_item_stops_the_job(spark):
    cells = spark.createDataFrame([("k", "s1", True)], "stable_key string, source_id string, ctx boolean")
    items = spark.createDataFrame([("s2", "x")], "source_id string, item string")
    assert runs.with_items(cells, items, F.lit(False)).count() == 1
    with pytest.raises(Exception, match="no context item for s1"):
        runs.with_items(cells, items, F.col("ctx")).collect()


def test_import_checks_the_row_count(spark):
    source = spark.createDataFrame([("p", 1), ("p", 2), ("q", 1)], "participant_id string, x int")
    target = source.limit(0)
    assert runs.import_participants(target, source, ["p"], 2).count() == 2
    with pytest.raises(Exception, match="q has 1 rows, expected 2"):
        runs.import_participants(target, source, ["p", "q"], 2).collect()


def test_conditions_and_latency(spark):
    rows = spark.createDataFrame([("k1", "p", "m"), ("k2", "z", "m"), ("k3", "z", "n")], "stable_key string, participant_id string, participant_model_id string")
    conditions = spark.createDataFrame([("p", "m", "A", 0), ("y", "m", "B", 1)], "participant_id string, participant_model_id string, label string, ord int")
    assert {r.stable_key: r.label for r in runs.with_condition(rows, conditions).collect()} == {"k1": "A", "k2": "B", "k3": None}
    metrics = spark.createDataFrame([("k1", 5, 1), ("k1", 9, 2)], "stable_key string, latency_ms int, seq int")
    assert {r.stable_key: r.latency_ms for r in runs.with_latency(rows, metrics).collect()} == {"k1": 9, "k2": 0, "k3": 0}


def test_an_item_is_one_document_whatever_its_size(spark):
    outputs = spark.range(20_000).select(
        F.lit(1).alias("item_ord"), F.lit("a").alias("source_id"), F.concat(F.lit("l"), F.col("id") % 3).alias("target_language"),
        F.format_string("%05d", "id").alias("label"), F.lit("text").alias("output"), F.lit(0).alias("latency_ms"),
    )
    (document,) = runs.nested_results(outputs).collect()
    assert [t.target_language for t in document.translations] == ["l0", "l1", "l2"]
    assert sum(len(t.outputs) for t in document.translations) == 20_000


def test_costs(spark):
    schema = "phase string, provider string, model string, input_tokens bigint, output_tokens bigint, reasoning_tokens bigint"
    rows = [
        ("judge", "deepseek", "deepseek-v4-flash", 1_000_000, 0, 500_000), ("judge", "openrouter-batch", "google/gemini-3.7-flash:batch", 1_000_000, 1_000_000, None),
        ("judge", "qwen", "qwen3.6-plus", 1_000_000, 0, None), ("judge", "local", "x", 1, 1, None), ("judge", "deepseek", "deepseek-v4-flash", None, 1, None),
    ]
    costed = costs.with_cost(spark.createDataFrame(rows, schema))
    assert [r.cost_usd for r in costed.orderBy(F.monotonically_increasing_id()).collect()].count(None) == 2
    assert sorted(r.cost_usd for r in costed.collect() if r.cost_usd is not None) == [Decimal("0.275862"), Decimal("0.280000"), Decimal("1.125000")]
    views = {(r.view, r.value): (r.total_cost_usd, r.unknown_cost_records) for r in costs.cost_rollup(costed).collect()}
    assert views[("overall", None)] == (Decimal("1.680862"), 2) and views[("phase", "translation")] == (Decimal("0.000000"), 0)
    empty = {(r.view, r.value): r.total_cost_usd for r in costs.cost_rollup(costed.limit(0)).collect()}
    assert empty == {("overall", None): 0, ("phase", "translation"): 0, ("phase", "judge"): 0}


def test_rate_and_eta(spark):
    df = spark.createDataFrame([(10, 20, 60000, 4), (4, 20, 60000, 4), (30, 20, 60000, 0), (5, 6, 0, 0)], "done int, total int, ms int, start int")
    rate, eta = progress.rate_and_eta(F.col("done"), F.col("total"), F.col("ms"), F.col("start"))
    found = [(round(r[0], 3), r[1]) for r in df.select(rate, eta).collect()]
    assert found == [(6.0, 2), (0.0, 0), (30.0, 0), (300000.0, 1)]


def test_focus_list(spark):
    schema = "participant_id string, ord int, inflight int, failed int, remaining int, last_failure_at string"
    rows = [(f"p{i}", i, int(i == 3), int(i % 2), 20 - i, "2026" if i == 5 else None) for i in range(12)]
    listed = progress.focus_list(spark.createDataFrame(rows, schema), 4).orderBy("branch", "place").collect()
    assert [r.participant_id for r in listed] == ["p3", "p5", "p1", "p7", "p9", "p11", "p0", "p2", "p4"]
    assert progress.focus_list(spark.createDataFrame(rows[:4], schema), 4).count() == 4


def test_batch_outcomes(spark):
    text = "Critical:\nno-error\nMajor:\nno-error\nMinor:\nno-error\ncontextBehavior: unclear"
    schema = "custom_id string, error string, status_code int, content string, has_response boolean"
    results = spark.createDataFrame(
        [("a", None, 200, text, True), ("b", None, 200, text, True), ("b", None, 200, text, True), ("c", "e", 200, text, True), ("d", None, 404, text, True), ("e", None, 200, "contextBehavior: unclear", True)], schema)
    requests = spark.createDataFrame([(f"k{x}", x) for x in "abcdef"], "stable_key string, custom_id string")
    found = {r.custom_id: r.problem for r in batches.correlate(requests, results).collect()}
    assert found == {"a": None, "b": "duplicate result line", "c": "both response and error", "d": "response status 404", "e": "invalid annotation", "f": "no result"}


def test_batch_usage_and_costs(spark):
    text = "Critical:\nno-error\nMajor:\nno-error\nMinor:\nno-error\ncontextBehavior: unclear"
    schema = "custom_id string, error string, status_code int, content string, has_response boolean, provider string, model string, input_tokens int, output_tokens int, reasoning_tokens int"
    usage = ("openrouter-batch", "google/gemini-3.7-flash", 1_000_000, 1_000, None)
    rows = [("a", None, 200, text, True, *usage), ("b", None, 500, text, True, *usage), *[("c", None, 200, text, True, *usage)] * 3, (None, None, 200, text, True, *usage)]
    requests = spark.createDataFrame([(f"k{x}", x) for x in "abcd"], "stable_key string, custom_id string")
    found = {r.custom_id: (r.problem, r.cost_usd and float(r.cost_usd), r.cost_status) for r in batches.correlate(requests, spark.createDataFrame(rows, schema)).collect()}
    assert found == {"a": (None, 0.188438, "estimated"), "b": ("response status 500", None, "unknown"), "c": ("duplicate result line", None, "unknown"), "d": ("no result", None, "unknown")}
    assert batches.correlate(requests, spark.createDataFrame([], schema)).where("problem = 'no result'").count() == 4


def test_stored_ids_win_and_must_cover_every_request(spark):
    requests = spark.createDataFrame([("1",), ("2",), ("2",)], "stable_key string")
    derived = F.concat(F.lit("new-"), F.col("stable_key"))

    def ids(entries, keys=requests, **options):
        id_map = None if entries is None else spark.createDataFrame(entries, "stable_key string, custom_id string")
        return {r.stable_key: r.custom_id for r in batches.with_custom_ids(keys, derived, id_map, **options).collect()}

    assert ids(None) == {"1": "new-1", "2": "new-2"}
    assert ids([("1", "a"), ("2", "b"), ("3", "c")], jobs_recorded=True) == {"1": "a", "2": "b"}
    assert ids([("1", "a"), ("2", "b"), ("2", "b")]) == {"1": "a", "2": "b"}
    with pytest.raises(ValueError):
        ids(None, jobs_recorded=True)
    for entries, message in (
        ([("1", "a")], "does not cover a key: 2"), ([("1", "a"), ("2", " ")], "blank id for a key: 2"), ([("1", "a"), ("2", "b"), ("2", None)], "blank id"),
        ([("1", "a"), ("2", "b"), ("2", "c")], "two ids for a key: 2"), ([("1", "a"), ("2", "a")], "shared by keys"),
    ):
        with pytest.raises(Exception, match=message):
            ids(entries)
    texts = spark.createDataFrame([("1", "x"), ("1", "y")], "stable_key string, stable string")
    with pytest.raises(Exception, match="two ids for a key: 1"):
        batches.with_custom_ids(texts, F.col("stable")).collect()


def test_id_map(spark):
    id_map = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1"), (" ", "3"), ("c", None)], "custom_id string, stable_key string")
    assert {(r.problem, r.id) for r in batches.id_map_problems(id_map).collect()} >= {("shared id", "a"), ("two ids for a key", "1"), ("blank entry", " "), ("blank entry", "c")}


def test_ranks_and_coverage(spark):
    rows = spark.createDataFrame([("b", 1.0, 3), ("a", 1.0, 2), ("c", None, 0), ("d", 0.5, 1)], "participant_id string, mean_penalty double, samples bigint")
    assert [r.participant_id for r in ranking.ranked(rows).orderBy("rank").collect()] == ["d", "a", "b", "c"]
    full = rows.withColumn("failed_samples", F.lit(7))
    assert {r.coverage for r in ranking.with_coverage(None, full).collect()} == {"full-available-fallback"}
    assert {(r.coverage, r.failed_samples) for r in ranking.with_coverage(rows, full).collect()} == {("common-cell", 0)}
    assert {r.coverage for r in ranking.with_coverage(rows.limit(0), full, empty_means_missing=True).collect()} == {"full-available-fallback"}
    assert ranking.with_coverage(rows.limit(0), full).count() == 0


@pytest.mark.parametrize("mode, allowed, expected", [("fork", False, {"promptVersion", "participants"}), ("fork", True, {"participants"}), ("rejudge", False, set()), ("resume", False, {"promptVersion", "limitApplied"})])
def test_compatibility(spark, mode, allowed, expected):
    person = {"participantId": "p", "displayName": "P", "provider": "qwen", "providerModelId": "m"}
    base = {"manifestVersion": 3, "runId": "a", "benchmarkId": "b", "datasetVersion": "v", "targetLanguages": ["en"], "targetLanguageLabels": {"en": "English"}, "limitApplied": 5, "promptVersion": "1", "participants": [person, {**person, "participantId": "q"}]}
    other = {**base, "runId": "b", "promptVersion": "2", "limitApplied": 6, "participants": [{**person, "displayName": "Changed"}] if mode == "fork" else [person]}
    table = spark.createDataFrame([base, other], manifests.MANIFEST)
    row = F.struct(*table.columns)
    pair = table.where("runId = 'a'").select(row.alias("a")).join(table.where("runId = 'b'").select(row.alias("b")))
    assert set(manifests.compatibility(pair, mode, allowed).first().mismatches) == expected


def test_public_status(spark):
    texts = ['{}', '{"benchmarkValid":true,"reuseOnly":null,"totalExpected":1.5,"missingDeepLKeys":"a"}', '{"judgeFailureRatesByParticipantLanguage":{"a":{},"b":{"ok":2}}}']
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(manifests.public_status(F.col("t")).alias("s")).select("s.*").collect()
    assert [r.benchmarkValid for r in rows] == [False, True, False] and [r.reuseOnly for r in rows] == [None, False, None]
    assert rows[1].totalExpected == 1.5 and rows[1].missingDeepLKeys is None
    groups = rows[2].judgeFailureRatesByParticipantLanguage
    assert (groups["a"].ok, groups["a"].failed, groups["b"].ok) == (None, None, 2)
    for bad in ("[]", "3", "no json", None):
        with pytest.raises(Exception, match="must be an object"):
            spark.createDataFrame([(bad,)], "t string").select(manifests.public_status(F.col("t")).alias("s")).collect()
