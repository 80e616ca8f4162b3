"""The annotation grammar, stored JSON, normalisation and repair."""

import json

import pytest
from pyspark.sql import functions as F

from gridscore.functions.annotations import is_complete_annotation, parse_annotation, parse_response
from gridscore.operators.annotate import register_error_table_function, register_sql_functions
from gridscore.operators.normalize import flatten_summary, normalize, remaining_failures, repair

CLEAN = "Critical:\nno-error\nMajor:\nno-error\nMinor:\nno-error\ncontextBehavior: used_correctly"
BAD = None
# text, errors as (severity, class, span) or BAD, behaviour, complete
MATRIX = [
    (CLEAN, [], "used_correctly", True),
    ('prose\nCritical:\naccuracy/omission - "a"\nMajor:\nno-error\nMinor:\nno-error\ncontextBehavior=unclear', [("critical", "accuracy/omission", "a")], "unclear", True),
    ('Major:\nfluency-register - "accuracy/omission"', [("major", "fluency/register", "accuracy/omission")], None, False),
    ("contextBehavior: unclear", [], "unclear", False),
    ("Critical:\nMajor:\nno-error\nMinor:\nno-error\ncontextBehavior: unclear", [], "unclear", False),
    ("Minor:\nsome other thing", [("minor", "other", None)], None, False),
    ("Minor:\nno class here", BAD, None, False),
    ("Minor:\nbrother", BAD, None, False),
    (CLEAN + "\ncontextBehavior: unclear", BAD, None, False),
    ("Minor:\nno-error\ncontextBehavior: maybe", BAD, None, False),
    ("plain prose", BAD, None, False),
    ("", BAD, None, False),
    (CLEAN + "\nMinor:\nno-error", [], "used_correctly", False),
    ("```\n  CRITICAL :  \r\n NO-ERROR \nmajor:\n```\nMINOR:\nStyle/Awkward - \"é 　ü\"\nCONTEXTBEHAVIOR =  Unclear", [("minor", "style/awkward", "é 　ü")], "unclear", False),
    ("﻿Major:\nThe fluency grammar is off, terminology/inconsistent use too", [("major", "terminology/inconsistent use", None)], None, False),
    ('Major:\nfluency/grammar - "x"\nMinor:\nnon-translation - ""', [("major", "fluency/grammar", "x"), ("minor", "non-translation", None)], None, False),
    ("Critical: accuracy/omission\nMinor:\nother", [("minor", "other", None)], None, False),
]


@pytest.fixture(scope="module")
def parsed(spark):
    rows = spark.createDataFrame([(i, m[0]) for i, m in enumerate(MATRIX)], "n int, text string")
    result = rows.select("n", parse_annotation(F.col("text")).alias("p"), is_complete_annotation(F.col("text")).alias("complete"))
    return {r.n: r for r in result.collect()}


@pytest.mark.parametrize("number", range(len(MATRIX)))
def test_grammar(parsed, number):
    _, errors, behavior, complete = MATRIX[number]
    found = parsed[number]
    assert (found.p.problem is not None) == (errors is BAD), found
    if errors is not BAD:
        assert [(e["severity"], e["class"], e["target_span_text"]) for e in found.p.errors] == errors
        assert found.p.behavior == behavior
    assert found.complete is complete


def test_table_function_agrees(spark):
    spark.createDataFrame([(i, m[0]) for i, m in enumerate(MATRIX)], "n int, text string").createOrReplaceTempView("matrix_texts")
    register_error_table_function(spark, "matrix_errors")
    found = {}
    for r in spark.sql("SELECT n, e.* FROM matrix_texts, LATERAL matrix_errors(text) e").collect():
        found.setdefault(r.n, []).append((r.severity, r["class"], r.target_span_text))
    assert found == {i: m[1] for i, m in enumerate(MATRIX) if m[1]}


def test_sql_functions_agree_with_columns(spark):
    """``parse_annotation`` of SQL and of columns give equal rows; neither SQL form leaves the JVM or joins texts."""
    texts = [(i, m[0]) for i, m in enumerate(MATRIX)] + [(-1, None), (-2, ""), (-3, "Major:\n" + 'fluency/grammar - "x"\n' * 5000)]
    spark.createDataFrame(texts, "n int, text string").createOrReplaceTempView("sql_texts")
    register_sql_functions(spark)
    register_error_table_function(spark, "sql_errors")
    both = spark.table("sql_texts").select("n", F.expr("parse_annotation(text)").alias("s"), parse_annotation(F.col("text")).alias("c"))
    rows = both.collect()
    assert len(rows) == len(texts) and all(r.s == r.c for r in rows)
    listed = spark.sql("SELECT n, e.* FROM sql_texts, LATERAL sql_errors(text) e")
    assert listed.where("n = -3").count() == 5000
    for frame in (both, listed):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan
        assert "Join" not in plan and "Exchange" not in plan


ERROR = {"severity": "major", "class": "other", "target_span_text": "x", "source_span_text": None}
STORED = [
    ({"has_no_error": True, "errors": []}, True),
    ({"has_no_error": False, "errors": [ERROR], "contextBehavior": "unclear", "note": 1}, True),
    ({"has_no_error": False, "errors": [{**ERROR, "explanation": "why"}]}, True),
    ({"has_no_error": True, "errors": [ERROR]}, False),
    ({"has_no_error": False, "errors": []}, False),
    ({"has_no_error": False, "errors": [{**ERROR, "weight": 1}]}, False),
    ({"has_no_error": False, "errors": [{k: v for k, v in ERROR.items() if k != "source_span_text"}]}, False),
    ({"has_no_error": False, "errors": [{**ERROR, "severity": "huge"}]}, False),
    ({"has_no_error": False, "errors": [{**ERROR, "class": "fluency-grammar"}]}, False),
    ({"has_no_error": False, "errors": [{**ERROR, "target_span_text": 3}]}, False),
    ({"has_no_error": True, "errors": [], "contextBehavior": "maybe"}, False),
    ({"has_no_error": "yes", "errors": []}, False),
    ({"errors": []}, False),
]


def test_stored_json(spark):
    rows = spark.createDataFrame([(i, json.dumps(d)) for i, (d, _) in enumerate(STORED)], "n int, text string")
    good = {r.n: r.good for r in rows.select("n", parse_response(F.col("text"))["problem"].isNull().alias("good")).collect()}
    assert good == {i: ok for i, (_, ok) in enumerate(STORED)}


def test_text_that_only_starts_like_json(spark):
    texts = [(0, "{ see below }\n" + CLEAN), (1, '{"has_no_error": true, "errors": []} tail'), (2, '{"has_no_error": true')]
    rows = spark.createDataFrame(texts, "n int, text string").select("n", parse_response(F.col("text")).alias("p"))
    found = {r.n: r.p for r in rows.collect()}
    assert found[0].problem is None and found[0].behavior == "used_correctly"
    assert found[1].problem is not None and found[2].problem is not None


RAW = "stable_key string, raw_judge_output string, context_turn_count int, speaker_mode string, context_expectation string, primary_phenomenon string"


def test_normalise_is_strict_for_ok_and_tolerant_for_failed(spark):
    silent = "Minor:\nother"
    rows = spark.createDataFrame(
        [
            ("ok", CLEAN, 1, "single", "use", "p"), ("mode", CLEAN, 1, "trio", "use", "p"), ("turns", CLEAN, 4, "single", "use", "p"),
            ("silent", silent, 1, "single", "use", "p"), ("sentence", silent, None, None, None, None), ("bad", "nothing", 9, "trio", "use", " "),
        ], RAW,
    )
    found = {r.stable_key: r for r in flatten_summary(normalize(rows)).collect()}
    assert {k: r.status for k, r in found.items()} == {
        "ok": "ok", "mode": "judge_failed", "turns": "judge_failed", "silent": "judge_failed", "sentence": "ok", "bad": "judge_failed"}
    assert found["sentence"].total_penalty == 1 and found["bad"].total_penalty is None
    assert (found["bad"].context_turn_count, found["bad"].speaker_mode, found["bad"].context_expectation, found["bad"].primary_phenomenon) == (None, None, "use", None)
    assert found["mode"].speaker_mode is None and found["mode"].context_behavior is None


def test_repair(spark):
    rows = normalize(spark.createDataFrame([("a", CLEAN, 1, "single", "use", "p"), ("b", "nothing", 1, "single", "use", "p"), ("c", CLEAN, 1, "single", "use", "p")], RAW))
    stored = rows.withColumn("status", F.when(F.col("stable_key") == "a", "judge_failed").otherwise(F.col("status"))).withColumn(
        "summary", F.when(F.col("stable_key") != "a", F.col("summary")))
    fixed = repair(stored)
    found = {r.stable_key: (r.status, r.repaired, r.summary is not None) for r in fixed.collect()}
    assert found == {"a": ("ok", True, True), "b": ("judge_failed", False, False), "c": ("ok", False, True)}
    failures = spark.createDataFrame([("a",), ("b",), ("c",), ("gone",)], "stable_key string")
    assert [r.stable_key for r in remaining_failures(failures, fixed).collect()] == ["b"]


def test_equally_long_classes_go_by_list_order(spark):
    row = spark.createDataFrame([("Minor:\nspelling: fluency/spelling or fluency-register",)], "text string")
    assert row.select(parse_annotation(F.col("text"))["errors"][0]["class"]).first()[0] == "fluency/register"
