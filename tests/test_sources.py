"""Files: scans, sinks, versions, reports."""

import json
import random

import pytest
from pyspark.sql import functions as F

from gridscore.functions.csvcells import csv_lines
from gridscore.operators.items import pristine_rules, scaffold_problems, violations
from gridscore.sources import files, reports


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_jsonl(spark, tmp_path):
    schema = "a int, b string"
    assert files.read_jsonl(spark, str(tmp_path / "none.jsonl"), schema).collect() == []
    good = write(tmp_path / "good.jsonl", '{"a":1}\n\n  \n{"b":"x","c":3}\n')
    assert {(r.a, r.b) for r in files.read_jsonl(spark, good, schema).collect()} == {(1, None), (None, "x")}
    bad = write(tmp_path / "bad.jsonl", '{"a":1}\n{"a":\n')
    with pytest.raises(Exception):
        files.read_jsonl(spark, bad, schema).collect()


def test_appended_rows_keep_nulls(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([(1, None)], "a int, b string").coalesce(1)
    files.append_jsonl(rows, path)
    files.append_jsonl(rows, path)
    assert [r.value for r in spark.read.text(path).collect()] == ['{"a":1,"b":null}'] * 2


def test_json_array(spark, tmp_path):
    good = write(tmp_path / "items.json", '\n [ {"a": 1},\n {"a": 2} ]\n')
    assert [(r.pos, r.a) for r in files.read_json_array(spark, good, "a int").orderBy("pos").collect()] == [(0, 1), (1, 2)]
    other = write(tmp_path / "object.json", '{"a": 1}')
    with pytest.raises(Exception, match="must be an array"):
        files.read_json_array(spark, other, "a int").collect()


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "200", "spark.sql.files.openCostInBytes": "0"}
    before = {name: spark.conf.get(name) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


@pytest.mark.parametrize("indent", [None, 0, 2])
def test_large_json_array(spark, tmp_path, small_splits, indent):
    rnd = random.Random(indent)
    odd = ["", "]},{[", '\\"]', "a\\\\", "é\u2028😀", "x" * 700, "\n\t"]
    elements = [{"a": i, "b": {"c": rnd.choice(odd), "d": [[rnd.choice(odd)], []]}} for i in range(300)]
    texts = [json.dumps(e, indent=indent, ensure_ascii=i % 2 == 0) for i, e in enumerate(elements)]
    text = "[" + "".join(t + rnd.choice([",", ",\n", "\n,", ",\n\n  "]) for t in texts[:-1]) + texts[-1] + rnd.choice(["]", "\n]\n"])
    path = write(tmp_path / "items.json", text)
    schema = "a int, b struct<c:string,d:array<array<string>>>"
    assert spark.read.text(path).rdd.getNumPartitions() > 20
    large = [(r.pos, r.a, r.b.c, r.b.d) for r in files.read_large_json_array(spark, path, schema).orderBy("pos").collect()]
    assert large == [(i, e["a"], e["b"]["c"], e["b"]["d"]) for i, e in enumerate(elements)]
    assert large == [(r.pos, r.a, r.b.c, r.b.d) for r in files.read_json_array(spark, path, schema).orderBy("pos").collect()]


def test_what_is_no_array(spark, tmp_path, small_splits):
    assert files.read_large_json_array(spark, write(tmp_path / "none.json", " \n[\n ]\n"), "a int").collect() == []
    for name, text in (("object", '{"a":\n 1}'), ("open", '[\n{"a":1},\n'), ("word", "[\n{\"a\":1},\nx\n]"), ("more", '[\n{"a":1}\n]\n{"a":2}\n')):
        with pytest.raises(Exception):
            files.read_large_json_array(spark, write(tmp_path / f"{name}.json", text), "a int").collect()


def test_batch_folder(spark, tmp_path):
    for name, ids in (("b2.json", ["x"]), ("b1.json", ["y", "z"])):
        write(tmp_path / "batches" / name, json.dumps({"datasetId": "d", "batchId": name[:2], "items": [{"sampleId": i} for i in ids]}, indent=2))
    rows = files.read_batches(spark, str(tmp_path / "batches"), "struct<sampleId:string>").orderBy("file", "pos").collect()
    assert [(r.file, r.pos, r.sampleId) for r in rows] == [("b1.json", 0, "y"), ("b1.json", 1, "z"), ("b2.json", 0, "x")]


def test_versions(spark, tmp_path):
    root, schema = str(tmp_path / "table"), "k string, repaired boolean"
    one = spark.createDataFrame([("a", True)], schema)
    assert files.latest_version(spark, root) == 0
    assert files.write_version(one.drop("repaired"), root) == 1
    assert files.rewrite_repaired(one.where("NOT repaired"), root) is None
    assert files.rewrite_repaired(one, root) == 2
    # A version without its marker was not finished and is not seen.
    one.write.json(f"{root}/version=3")
    assert files.latest_version(spark, root) == 2


def empty_turn():
    return {"speakerRole": "self", "relativeTimeLabel": None, "sourceText": ""}


ITEM = (
    "sampleId string, batch_id string, status string, locked struct<contextTurnCount:int>, fill struct<secondaryPhenomena:array<string>,contextTurns:array<struct<speakerRole:string,"
    "relativeTimeLabel:string,sourceText:string>>,currentSource:struct<speakerRole:string,relativeTimeLabel:string,sourceText:string>,relevantContextIndices:array<int>,"
    "intendedInterpretation:string,commonFailureModes:array<string>,validationNotes:string>"
)


def item(sample, **changes):
    fill = {"secondaryPhenomena": [], "contextTurns": [empty_turn()], "currentSource": empty_turn(), "relevantContextIndices": [], "intendedInterpretation": "",
            "commonFailureModes": [], "validationNotes": "", **changes}
    return {"sampleId": sample, "batch_id": "b-01", "status": "todo", "locked": {"contextTurnCount": 1}, "fill": fill}


def test_scaffold_is_not_overwritten_once_edited(spark, tmp_path):
    root = str(tmp_path / "scaffold")
    pristine, edited = spark.createDataFrame([item("a")], ITEM), spark.createDataFrame([item("a"), item("b", validationNotes="x")], ITEM)
    assert [list(r.violations) for r in violations(edited, pristine_rules()).orderBy("sampleId").collect()] == [[], ["notes filled"]]
    files.write_scaffold(pristine, None, root)
    files.write_scaffold(pristine, pristine, root)
    with pytest.raises(ValueError):
        files.write_scaffold(pristine, edited, root)
    files.write_scaffold(pristine, edited, root, force=True)
    assert spark.read.schema(ITEM).json(root).count() == 1


def test_scaffold_set_is_gated_by_its_plan(spark, tmp_path):
    root = str(tmp_path / "set")
    items = lambda *rows: spark.createDataFrame(list(rows), ITEM)
    plan = items(item("a"), item("b"))
    changed = {**item("b"), "locked": {"contextTurnCount": 2}}
    for existing, wanted in (
        (items(item("a")), {"b": "missing"}), (items(item("a"), item("b"), item("c")), {"c": "unexpected"}), (items(item("a"), item("a"), item("b")), {"a": "duplicate"}),
        (items(item("a"), changed), {"b": "locked fields differ"}), (items(item("a"), item("b", validationNotes="x")), {"b": "not pristine"}), (plan, {}),
        (items({**item("a"), "sampleId": None}, item("b")), {"a": "missing", None: "unexpected"}), (items(item("a"), {**item("b"), "locked": None}), {"b": "locked fields differ"}),
    ):
        assert {r.sampleId: r.problem for r in scaffold_problems(existing, plan).collect()} == wanted
    assert scaffold_problems(items(), items()).count() == 0
    assert files.read_scaffold(spark, root, "batches", ITEM).count() == 0
    assert files.write_scaffold_set(plan, root, "d") == 1 and files.write_scaffold_set(plan, root, "d") == 2
    assert files.write_scaffold_set(items(item("a", validationNotes="x"), item("b")), root, "d", force=True) == 3
    with pytest.raises(ValueError, match="a \\(not pristine\\)"):
        files.write_scaffold_set(plan, root, "d")
    lines = files.read_scaffold(spark, root, "manifest", "datasetId string, sampleId string, batch_id string").collect()
    assert {tuple(r) for r in lines} == {("d", "a", "b-01"), ("d", "b", "b-01")} and files.latest_version(spark, root) == 3


def test_keyed_report_in_both_shapes(spark, tmp_path):
    path = write(tmp_path / "report.json", json.dumps({
        "en": [{"participant_id": "a", "mean_penalty": 1.5, "samples": 2}, {"participant_id": "b", "participant_display_name": "B", "mean_penalty": "x", "samples": "9", "failed_samples": 1}],
        "ja": {"leaderboard": [{"participant_id": "a", "mean_penalty": None}], "other": 1}, "ko": 5,
    }, indent=2))
    rows = {(r.slice, r.ord): tuple(r)[2:] for r in reports.read_keyed_report(spark, path).collect()}
    assert rows == {("en", 0): ("a", "a", 1.5, 2, 0), ("en", 1): ("b", "B", None, 0, 1), ("ja", 0): ("a", "a", None, 0, 0)}


def test_optional_report(spark, tmp_path):
    assert reports.read_optional_rows(spark, str(tmp_path / "none.json")) is None
    assert reports.read_optional_rows(spark, write(tmp_path / "object.json", "{}")) is None
    rows = reports.read_optional_rows(spark, write(tmp_path / "rows.json", '[{"participant_id":"a","samples":3}]'))
    assert [(r.participant_id, r.samples) for r in rows.collect()] == [("a", 3)]


def test_csv(spark, tmp_path):
    schema = "participant_id string, mean_penalty double, samples bigint, score double, ok boolean, caveat string, n int"
    rows = spark.createDataFrame(
        [("a,b", 1.0, 2, 2.0, True, "x", 0), ('=1+1 "q"', float("nan"), None, 0.25, None, "", 1), ("-x\ny", None, 1, None, False, None, 2), ("\tt", 0.5, 1, float("inf"), True, "@", 3)], schema)
    names = ["participant_id", "mean_penalty", "samples", "score", "ok", "caveat"]
    lines = [r.value for r in csv_lines(rows, names).orderBy("n").collect()]
    assert lines == ['"a,b",1.000000,2,2,true,"x"', '"\'=1+1 ""q""",,,0.25,,', '"\'-x\ny",,1,,false,', '\'\tt,0.500000,1,,true,"\'@"']
    path = str(tmp_path / "csv")
    files.write_csv(csv_lines(rows.where("n < 2"), names), names, path, ["n"])
    assert [r.value for r in spark.read.text(path).collect()] == [",".join(names), *lines[:2]]


def test_digest_ignores_order_and_sees_changes(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "n int, t string")
    digest = lambda df: df.agg(files.row_digest(df, F.col("n").cast("string"), F.col("t"))).first()[0]
    assert digest(rows) == digest(rows.orderBy(F.desc("n"))) != digest(rows.withColumn("t", F.upper("t")))


def test_fingerprint(spark, tmp_path):
    path = write(tmp_path / "f.txt", "abc")
    assert files.fingerprint(spark, path).first().sha256 == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
