"""Error messages, redaction, rendering, transcripts, keys."""

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from gridscore.functions import errors, keys, languages, redaction, rendering, text, transcripts
from gridscore.operators import audit, events


def values(spark, rows, expression, kind="string"):
    """The expression over a one-column table, in input order."""
    df = spark.createDataFrame(list(enumerate(rows)), f"n int, v {kind}")
    return [r.out for r in df.select("n", expression(F.col("v")).alias("out")).orderBy("n").collect()]


def test_status_and_retry_hints(spark):
    messages = ["HTTP 429!", "code4290", "x429", "Retry-After: 2", "retry after 1.5 seconds", "retry-after: 250ms", "retry after: 3 secs", "none", "(503)"]
    assert values(spark, messages, errors.http_status) == [429, None, None, None, None, None, None, None, 503]
    assert values(spark, messages, errors.retry_after_ms) == [None, None, None, 2000, 1500, 250, 3000, None, None]
    now = F.lit(datetime.datetime(2026, 1, 1, tzinfo=datetime.timezone.utc))
    headers = ["2", " 0.5 ", "Thu, 01 Jan 2026 00:00:10 GMT", "Wed, 31 Dec 2025 00:00:00 GMT", "soon", "-3", None]
    assert values(spark, headers, lambda h: errors.retry_after_header_ms(h, now)) == [2000, 500, 10000, 0, None, 0, None]


def test_error_classes(spark):
    rows = spark.createDataFrame([
        ("deepl", "HTTP 456 Quota exceeded", "rate_limit", True, "throttle_bucket"), ("qwen", "Too Many Requests", "unknown", True, "none"),
        ("papago", "403 Forbidden", "auth", True, "throttle_bucket"), ("gemini", "DEADLINE EXCEEDED", "timeout", True, "item"),
        ("openrouter-batch", "model is overloaded", "bad_request", False, "none"), ("deepseek", "402 Insufficient Balance", "auth", False, "none"),
        ("vertex", "400 Invalid argument", "bad_request", False, "none"), ("llamacpp", "connection refused", "network", True, "item"),
    ], "provider string, message string, c string, r boolean, s string")
    for r in events.classified(rows).collect():
        assert (r.error_class, r.retryable, r.cooldown_scope) == (r.c, r.r, r.s), r


REDACTED = [
    ('{"api_key": "a\\"b", "x": 1}', '{"api_key":"***", "x": 1}'),
    ("Authorization: Bearer abc.def\nnext", "authorization: Bearer ***\nnext"),
    ("authorization: Basic Zm9v more\nnext", "authorization: ***\nnext"),
    ("x-api-key=abc, y", "x-api-key: ***, y"),
    ('failed request body: {"a":[1,{"b":"}"}]} at the end', "failed request body: [redacted] at the end"),
    ("system prompt: you are everything after", "system prompt: [redacted]"),
    ('{"systemPrompt":"a \\" b","requestBody":{"m":["]"]},"id":7}', '{"systemPrompt":"[redacted]","requestBody":"[redacted]","id":7}'),
    ("nothing to hide", "nothing to hide"),
    (None, None),
]


def test_redaction(spark):
    assert values(spark, [m for m, _ in REDACTED], errors.persisted_error_text) == [want for _, want in REDACTED]
    assert len(values(spark, ["é😀" * 3000], errors.persisted_error_text)[0]) == 4000


_STRING = re.compile(r'"(?:\\[\s\S]|[^"\\])*(?:"|\\?\Z)')


def value_end(message, at, plain):
    """End of the value at ``at``, found character by character."""
    if message[at : at + 1] == '"':
        return _STRING.match(message, at).end()
    if message[at : at + 1] not in ("{", "["):
        return plain(message, at)
    depth = 0
    while at < len(message):
        if message[at] == '"':
            at = _STRING.match(message, at).end()
            continue
        depth += (message[at] in "{[") - (message[at] in "}]")
        at += 1
        if depth == 0:
            break
    return at


def directly_redacted(message):
    def once(message, pattern, shown, plain):
        out, at = "", 0
        while found := re.compile(pattern, re.I | re.A).search(message, at):
            out += message[at : found.start()] + shown(found[1])
            at = value_end(message, found.end(), plain)
        return out + message[at:]

    space, name = text.SPACE, lambda n: "system prompt" if n.lower().startswith("system") else "request body"
    plain_end = lambda message, at: m.start() if (m := re.compile(r"[\r\n,}\]]").search(message, at)) else len(message)
    label = rf"(request[-_ ]?(?:body|payload|json)|system[-_ ]?(?:prompt|instruction)){space}*:{space}*"
    field = rf'"(systemPrompt|systemInstruction|requestBody|requestPayload|requestJson)"{space}*:{space}*'
    message = once(message, label, lambda n: f"{name(n)}: [redacted]", lambda message, at: len(message))
    return once(message, field, lambda n: f'"{n}":"[redacted]"', plain_end)


def test_payloads_equal_a_direct_scan(spark):
    rnd = random.Random(11)
    parts = [
        *'""\\{}[],\n a:\r', '\\"', "é😀", '"requestBody": ', '"systemPrompt":\n', '"requestJson"\n: ', "Request Body: ", "system-prompt:", "request payload :\u00a0",
        '"x":', "requestbody", "systeminstruction:{",
    ]
    messages = ["".join(rnd.choices(parts, k=rnd.randint(0, 30))) for _ in range(6000)] + ["", "request body:", '"requestBody":', 'request body: {"a":"\\']
    assert values(spark, messages, redaction.redact_payloads) == [directly_redacted(m) for m in messages]
    assert values(spark, [None], redaction.redact_payloads) == [None]


def test_long_payload(spark):
    inside = '{\\"é' * 200_000
    found = values(spark, [f'request body: {{"a":"{inside}"}} end', "a," * 300_000 + '"requestBody":[1] z'], redaction.redact_payloads)
    assert found[0] == "request body: [redacted] end" and found[1] == "a," * 300_000 + '"requestBody":"[redacted]" z'


def test_redaction_needs_no_python_worker(spark):
    plan = spark.range(1).select(errors.persisted_error_text(F.col("id").cast("string")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_cooldown_order(spark):
    df = spark.createDataFrame([("throttle_bucket", 40000, 0), ("item", 10000, 9), ("item", 9999, 3), ("item", None, 2)], "s string, after int, n int")
    found = [r.c and tuple(r.c) for r in df.select(errors.cooldown(F.col("s"), F.col("after"), F.col("n")).alias("c")).collect()]
    assert found == [("provider_signal", 40000), ("retry_after", 30000), ("failure_streak", 30000), None]


def test_retry_delays(spark):
    df = spark.createDataFrame([(1, 0.0, None), (2, 0.5, None), (9, 0.5, None), (1, 0.5, 9000)], "a int, j double, after int")
    assert [r[0] for r in df.select(errors.retry_delay_ms(F.col("a"), F.col("j"), F.col("after"))).collect()] == [1600, 5000, 20000, 9000]


def test_trim_and_rounding(spark):
    assert values(spark, ["﻿ 　x \t", " ", None], text.trimmed) == ["x", "", None]
    assert values(spark, ["﻿ 　x \t", " ", None], text.is_blank) == [False, True, True]
    assert values(spark, [-2.5, 2.5, 2.4], text.round_half_up, "double") == [-2, 3, 2]
    assert values(spark, ["<a href='x'>&\"</a>"], text.escape_xml) == ["&lt;a href=&apos;x&apos;&gt;&amp;&quot;&lt;/a&gt;"]


TURN = "struct<speakerRole:string,relativeTimeLabel:string,sourceText:string>"


def test_rendering_and_back(spark):
    turns = [("self", "1 min ago", "hi"), ("other", "", "line $1 ${x}"), ("other", None, "last")]
    df = spark.createDataFrame([(turns, ("self", None, "now\nhere"))], f"t array<{TURN}>, c {TURN}")
    rendered = df.select(rendering.model_input(F.col("t"), F.col("c")).alias("m"))
    assert rendered.first().m == "<context>\n[self, 1 min ago] hi\n[other] line $1 ${x}\n[other] last\n</context>\n\n<input>\nnow\nhere\n</input>"
    back = rendered.select(rendering.read_model_input(F.col("m")).alias("r")).first().r
    assert back.current_source == "now\nhere" and back.context_turns.split("\n")[1] == "2. [other] line $1 ${x}"
    legacy = "<context>\n a \n\nb\n</context>\n\nText to translate:\nsource"
    assert values(spark, [legacy, "plain"], lambda v: rendering.read_model_input(v)["context_turns"]) == ["1. a\n2. b", None]


def test_templates(spark):
    fill = lambda v: rendering.fill_prompt("a ${x} ${y} $z", {"x": v})
    assert values(spark, ["${y} $1 \\"], fill) == ["a ${y} $1 \\ ${y} $z"]
    judge = lambda v: rendering.fill_judge_template("```\n${x}\n```", {"x": v})
    assert values(spark, ["a\r\nb\rc ```"], judge) == ["```\na\nb\nc ``\\`\n```"]
    with pytest.raises(ValueError, match="missing template variables: y"):
        rendering.fill_judge_template("${x} ${y}", {"x": F.lit("")})


def test_transcripts(spark):
    fragments = [["a", "ab", "b", "c", ""], [], ["x", "x"]]
    assert values(spark, fragments, transcripts.accumulate, "array<string>") == ["abc", "", "x"]
    df = spark.createDataFrame([(" abc ", "abd"), ("é", "e"), (" ", "x"), ("ab", "abcdef")], "r string, h string")
    assert [r[0] for r in df.select(transcripts.character_error_rate(F.col("r"), F.col("h"))).collect()] == [pytest.approx(1 / 3), 1.0, None, 2.0]


def test_keys(spark):
    assert [tuple(v) if v else None for v in values(spark, ["a::en", "a::b::c", "none"], keys.split_participant_language)] == [("a", "en"), ("a", "b::c"), None]
    assert sorted(["10::x", "2::x", "2::a"], key=dict(zip(["10::x", "2::x", "2::a"], values(spark, ["10::x", "2::x", "2::a"], keys.natural_key))).get) == ["2::a", "2::x", "10::x"]
    assert values(spark, ["en", "zh-Hans"], lambda v: keys.language_code(keys.language_label(v))) == ["en", "zh-Hans"]
    with pytest.raises(Exception, match="unsupported"):
        values(spark, ["Klingon"], keys.language_code)
    with pytest.raises(Exception, match="missing part"):
        values(spark, [None], lambda v: keys.checked_stable_key(v, F.lit("s"), F.lit("en"), F.lit("p")))


def test_service_languages(spark):
    schema = "service string, role string, language string"
    rows = spark.createDataFrame([("deepl", "source", " KOREAN "), ("deepl", "source", "Latin"), ("deepl", "target", "zh-Hans"), ("papago", "target", "chinese traditional")], schema)
    assert [r.code for r in languages.with_service_codes(rows).orderBy("language").collect()] == ["KO", None, "zh-TW", "ZH-HANS"]
    with pytest.raises(Exception, match="does not support"):
        languages.with_service_codes(spark.createDataFrame([("papago", "source", "Latin")], schema)).collect()


def test_sensitive_text(spark):
    texts = ["key sk-" + "a" * 20, "see C:\\Users\\me and /home/x", "Bearer short", "sk-" + "a" * 30 + "\x00", "-----BEGIN RSA PRIVATE KEY-----"]
    found = values(spark, texts, audit.findings)
    assert found[0] == ["secret key"] and set(found[1]) == {"windows drive", "home folder", "user profile path"} and found[2:4] == [[], []] and found[4] == ["private key block"]


def test_path_audit(spark):
    paths = spark.createDataFrame([("src/a",), ("dist",), ("dist/x",), ("distant",), ("notes",)], "path string")
    found = {r.path: r.verdict for r in audit.path_audit(paths, ["README", "notes"], ["dist"], ["^src/"]).collect()}
    assert found == {"dist": "blocked", "dist/x": "blocked", "distant": "unexpected", "README": "missing"}
