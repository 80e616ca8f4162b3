"""Queries on error messages, retries and stored events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridscore import domain, fixtures
from gridscore.functions import errors, responses
from gridscore.functions.text import escape_xml, truncated
from gridscore.operators import events
from gridscore.plans.common import spread
from gridscore.plans.registry import query


@query("w5_recent_throttle_failures", """
SELECT seq, CAST(count(*) FILTER (error_class IN ('rate_limit','server_overload') AND seq % 7 <> 0) OVER
  (PARTITION BY item_key ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW) AS BIGINT) AS recent_failures
FROM attempts WHERE error_class IS NOT NULL
""")
def w5(spark: SparkSession, sf_dir: str) -> DataFrame:
    failures = fixtures.attempts(spark, sf_dir).where("error_class IS NOT NULL").withColumn("retryable", F.col("seq") % 7 != 0)
    return events.recent_throttle_failures(failures, ["item_key"]).select("seq", "recent_failures")


@query("w6_invalid_streak", """
WITH f AS (SELECT *, error_class = 'invalid_response' AS hit FROM attempts WHERE error_class IS NOT NULL),
i AS (SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY item_key ORDER BY seq) AS island FROM f),
s AS (SELECT seq, CAST(sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY item_key, island ORDER BY seq) AS BIGINT) AS streak FROM i)
SELECT seq, streak, streak >= 2 AS stops_retry FROM s
""")
def w6(spark: SparkSession, sf_dir: str) -> DataFrame:
    failures = fixtures.attempts(spark, sf_dir).where("error_class IS NOT NULL")
    return events.invalid_streaks(failures, ["item_key"]).select("seq", "streak", "stops_retry")


@query("w7_cooldown_verdict", """
WITH f AS (SELECT seq, error_class, (seq % 5) * 4000 AS retry_after, count(*) FILTER (error_class IN ('rate_limit','server_overload') AND seq % 7 <> 0) OVER
    (PARTITION BY item_key ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW) AS recent
  FROM attempts WHERE error_class IS NOT NULL)
SELECT seq, CASE WHEN error_class = 'rate_limit' THEN 'provider_signal' WHEN retry_after >= 10000 THEN 'retry_after' WHEN recent >= 3 THEN 'failure_streak' END AS reason,
  CASE WHEN error_class = 'rate_limit' OR retry_after >= 10000 OR recent >= 3 THEN CAST(greatest(30000, retry_after) AS BIGINT) END AS delay_ms
FROM f
""")
def w7(spark: SparkSession, sf_dir: str) -> DataFrame:
    failures = fixtures.attempts(spark, sf_dir).where("error_class IS NOT NULL").withColumn("retryable", F.col("seq") % 7 != 0)
    recent = events.recent_throttle_failures(failures, ["item_key"])
    scope = errors.cooldown_scope(F.lit("gemini"), F.col("error_class"))
    verdict = errors.cooldown(scope, F.col("seq") % 5 * 4000, F.col("recent_failures"))
    return recent.select("seq", verdict.alias("v")).select("seq", "v.reason", "v.delay_ms")


_PROVIDERS = tuple(errors.PROVIDER_RULES)
# Message, and the class every provider gives it unless listed otherwise below.
_MESSAGES = (
    ("Error 429 slow down", "rate_limit"), ("status 401 denied", "auth"), ("status 422 in field", "bad_request"), ("Request timed out", "timeout"),
    ("got 503 from host", "server_overload"), ("Socket hang up", "network"), ("something odd", "unknown"), ("The response did not contain text", "invalid_response"),
    ("insufficient balance", "unknown"), ("no permission here", "unknown"), ("this model is odd", "unknown"), ("Quota used up", "rate_limit"),
)
_OTHERWISE = {
    ("openrouter-batch", 0): "unknown", ("openrouter-batch", 1): "unknown", ("openrouter-batch", 2): "unknown", ("openrouter-batch", 4): "unknown",
    ("openrouter-batch", 7): "unknown", ("deepseek", 8): "auth", ("papago", 9): "auth", ("google-translate-basic", 9): "auth", ("openrouter-batch", 10): "bad_request",
    ("papago", 11): "unknown", ("llamacpp", 11): "unknown",
}
_EXPECTED_SQL = (
    "CASE " + " ".join(f"WHEN provider = '{p}' AND m = {i} THEN '{c}'" for (p, i), c in _OTHERWISE.items())
    + " ELSE CASE m " + " ".join(f"WHEN {i} THEN '{c}'" for i, (_, c) in enumerate(_MESSAGES)) + " END END"
)
_PROVIDER_SQL = "CASE seq % 11 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(_PROVIDERS)) + " END"


@query("x13_error_class", f"""
WITH m AS (SELECT seq, {_PROVIDER_SQL} AS provider, CAST(floor(seq / 11) AS BIGINT) % 12 AS m FROM attempts),
c AS (SELECT seq, provider, {_EXPECTED_SQL} AS error_class FROM m)
SELECT seq, error_class, CASE WHEN provider = 'openrouter-batch' THEN false WHEN provider = 'papago' AND error_class = 'auth' THEN true
    ELSE error_class NOT IN ('auth', 'bad_request') END AS retryable,
  CASE WHEN provider = 'openrouter-batch' THEN 'none' WHEN error_class = 'rate_limit' OR (provider = 'papago' AND error_class = 'auth') THEN 'throttle_bucket'
    WHEN error_class IN ('timeout','network','invalid_response') THEN 'item' ELSE 'none' END AS scope FROM c
""")
def x13(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda values, number: F.element_at(F.array(*[F.lit(v) for v in values]), (number + 1).cast("int"))
    rows = spread(fixtures.attempts(spark, sf_dir)).select(
        "seq", pick(_PROVIDERS, F.col("seq") % 11).alias("provider"),
        pick([text for text, _ in _MESSAGES], F.floor(F.col("seq") / 11) % 12).alias("message"),
    )
    return events.classified(rows).select("seq", "error_class", "retryable", F.col("cooldown_scope").alias("scope"))


@query("x12_status_and_retry_after", """
SELECT seq, CASE WHEN seq % 3 = 0 THEN CASE WHEN seq % 2 = 0 THEN 429 ELSE 503 END END AS status,
  CASE seq % 4 WHEN 0 THEN NULL WHEN 1 THEN seq % 60 * 1000 + 500 WHEN 2 THEN seq % 900 ELSE seq % 60 * 1000 END AS retry_after_ms,
  CASE WHEN seq % 5 = 0 THEN 60000 WHEN seq % 5 = 1 THEN seq % 90 * 1000 WHEN seq % 5 = 2 THEN 0 END AS header_ms FROM attempts
""")
def x12(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = F.col("seq")
    status = F.when(seq % 3 == 0, F.when(seq % 2 == 0, "HTTP 429 ").otherwise("(503) ")).otherwise("code 4290 ")
    after = (
        F.when(seq % 4 == 0, "later").when(seq % 4 == 1, F.format_string("Retry-After: %d.5 seconds", seq % 60))
        .when(seq % 4 == 2, F.format_string("retry after %dms", seq % 900)).otherwise(F.format_string("retryafter:%d", seq % 60))
    )
    minute_later = F.date_format(F.date_trunc("second", "ts") + F.expr("INTERVAL 60 SECONDS"), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    header = (
        F.when(seq % 5 == 0, minute_later).when(seq % 5 == 1, (seq % 90).cast("string"))
        .when(seq % 5 == 2, "Mon, 01 Jan 2001 00:00:00 GMT").when(seq % 5 == 3, "soon")
    )
    message = F.concat(status, after)
    return fixtures.attempts(spark, sf_dir).select(
        "seq", errors.http_status(message).alias("status"), errors.retry_after_ms(message).alias("retry_after_ms"),
        errors.retry_after_header_ms(header, F.date_trunc("second", "ts")).alias("header_ms"),
    )


@query("x25_retry_delays", """
SELECT seq, CAST(floor(CASE seq % 6 + 1 WHEN 1 THEN 2000 WHEN 2 THEN 5000 WHEN 3 THEN 10000 ELSE 20000 END * (0.8 + (seq % 10) / 10.0 * 0.4) + 0.5) AS BIGINT) AS delay_ms,
  true AS plausible, seq % 6 + 1 >= 4 AS plausible_at_20s FROM attempts
""")
def x25(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempt = F.col("seq") % 6 + 1
    delay = errors.retry_delay_ms(attempt, F.col("seq") % 10 / 10, F.lit(None))
    return fixtures.attempts(spark, sf_dir).select(
        "seq", delay.alias("delay_ms"), errors.delay_is_plausible(attempt, delay, F.lit(None)).alias("plausible"),
        errors.delay_is_plausible(attempt, F.lit(20000), F.lit(None)).alias("plausible_at_20s"),
    )


@query("x10_redaction", """
SELECT seq, CASE seq % 6
  WHEN 0 THEN concat('bad "apiKey":"***" for ', item_key)
  WHEN 1 THEN concat('authorization: Bearer ***', chr(10), item_key)
  WHEN 2 THEN concat('x authorization: ***', chr(10), item_key)
  WHEN 3 THEN concat('got Bearer *** and api_key: ***, ', item_key)
  WHEN 4 THEN concat('call request body: [redacted] after ', item_key)
  ELSE concat('{"requestBody":"[redacted]" ,"id":"', item_key, '"} system prompt: [redacted]') END AS text FROM attempts
""")
def x10(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, case = F.col("item_key"), F.col("seq") % 6
    secret = F.concat(F.lit("s3cr3t-"), F.col("seq").cast("string"))
    message = (
        F.when(case == 0, F.concat(F.lit('bad "apiKey" : "a\\"b'), secret, F.lit('" for '), key))
        .when(case == 1, F.concat(F.lit("Authorization: bearer "), secret, F.lit("\n"), key))
        .when(case == 2, F.concat(F.lit("x authorization: Basic "), secret, F.lit(" more\n"), key))
        .when(case == 3, F.concat(F.lit("got bearer "), secret, F.lit(" and api_key="), secret, F.lit(", "), key))
        .when(case == 4, F.concat(F.lit('call Request-Body: {"a":[1,{"b":"}"}],"c":"'), secret, F.lit('"} after '), key))
        .otherwise(F.concat(F.lit('{"requestBody": {"deep":["]",{}]} ,"id":"'), key, F.lit('"} systemPrompt: '), secret, F.lit(" to the end")))
    )
    rows = spread(fixtures.attempts(spark, sf_dir).select("seq", message.alias("message")))
    return rows.select("seq", errors.persisted_error_text(F.col("message")).alias("text"))


@query("x10_page_redaction", """
SELECT page_id, CASE page_id % 3 WHEN 0 THEN concat('page ', page_id, ' request body: [redacted] of ', octet_length(encode(coalesce(html, ''))))
  WHEN 1 THEN concat('{"id":', page_id, ',"requestBody":"[redacted]","n":[1]}') ELSE concat('{"systemPrompt":"[redacted]", "id":', page_id, '}') END AS text,
  concat('cut ', page_id, ' request body: [redacted]') AS cut_off FROM pages
""")
def x10_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole pages as quoted and nested payloads, and as payloads whose end is missing."""
    page, html = F.col("page_id").cast("string"), F.coalesce("html", F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(F.replace(html, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    nested = F.concat(F.lit('{"page":[{"html":'), quoted, F.lit(',"left":["]",{}]}, '), quoted, F.lit("]}"))
    message = (
        F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("page "), page, F.lit(" Request-Payload: "), nested, F.lit(" of "), F.octet_length(html).cast("string")))
        .when(F.col("page_id") % 3 == 1, F.concat(F.lit('{"id":'), page, F.lit(',"requestBody" : '), nested, F.lit(',"n":[1]}')))
        .otherwise(F.concat(F.lit('{"systemPrompt":\n'), quoted, F.lit(', "id":'), page, F.lit("}")))
    )
    cut_off = F.concat(F.lit("cut "), page, F.lit(" request body: "), F.substring(nested, 1, F.length(nested) - 2 - F.col("page_id") % 2))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select(
        "page_id", errors.persisted_error_text(message).alias("text"), errors.persisted_error_text(cut_off).alias("cut_off"),
    )


@query("x11_truncate", """
SELECT doc_id, substring(text, 1, 120) AS preview, length(substring(text, 1, 4000)) AS kept FROM documents
""")
def x11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.table(spark, sf_dir, "documents").select(
        "doc_id", truncated(F.col("text"), domain.PREVIEW_CODE_POINTS).alias("preview"),
        F.length(truncated(F.col("text"), domain.ERROR_TEXT_CODE_POINTS)).cast("bigint").alias("kept"),
    )


@query("x16_escape_xml", """
SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS escaped FROM pages
""")
def x16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.table(spark, sf_dir, "pages").select("page_id", escape_xml(F.col("html")).alias("escaped"))


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a client would log them: scopes in turn, numbers of which some are not finite, one that is a text."""
    seq = F.col("seq")
    scope = F.when(seq % 4 == 0, "item").when(seq % 4 == 1, "participant").when(seq % 4 == 2, "throttle_bucket")
    return fixtures.attempts(spark, sf_dir).select(
        scope.alias("scope"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"), "phase",
        F.col("outcome").alias("event_type"), F.col("bucket_key").alias("throttle_bucket_key"),
        F.concat(F.lit("key-"), seq.cast("string")).alias("stable_key"), "participant_id",
        F.repeat(F.lit("é"), F.lit(200)).alias("source"), F.when(seq % 3 == 0, float("nan")).otherwise((seq % 5).cast("double")).alias("attempt"),
        F.lit(5).alias("max_attempts"), "latency_ms", F.lit("250").alias("next_delay_ms"), "error_class",
        F.when(F.col("error_class").isNotNull(), F.concat(F.lit("failed with api_key=abc"), seq.cast("string"))).alias("error_summary"),
        seq.alias("seq"),
    )


_EVENT_SQL = """
ev AS (SELECT seq, CASE seq % 4 WHEN 0 THEN 'item' WHEN 1 THEN 'participant' WHEN 2 THEN 'throttle_bucket' ELSE 'phase' END AS scope, phase, outcome AS event_type,
  CASE WHEN seq % 4 <> 3 THEN bucket_key END AS throttle_bucket_key, CASE WHEN seq % 4 = 0 THEN concat('key-', CAST(seq AS VARCHAR)) END AS stable_key,
  CASE WHEN seq % 4 < 2 THEN participant_id END AS participant_id, CASE WHEN seq % 4 = 0 THEN 120 END AS preview,
  CASE WHEN seq % 3 <> 0 THEN CAST(seq % 5 AS DOUBLE) END AS attempt, CAST(latency_ms AS DOUBLE) AS latency_ms, error_class,
  CASE WHEN error_class IS NOT NULL THEN 'failed with api_key: ***' END AS error_summary FROM attempts)
"""


@query("p22_sanitized_events", f"WITH {_EVENT_SQL} SELECT scope, phase, event_type, throttle_bucket_key, stable_key, participant_id, preview, attempt, latency_ms, error_class, error_summary FROM ev")
def p22(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = events.sanitize(raw_events(spark, sf_dir).drop("seq"))
    return clean.select(
        "scope", "phase", "event_type", "throttle_bucket_key", "stable_key", "participant_id", F.length("source_preview").cast("bigint").alias("preview"),
        "attempt", "latency_ms", "error_class", "error_summary",
    )


@query("x22_event_lines", f"""
WITH {_EVENT_SQL} SELECT concat_ws(' | ', concat(phase, ' ', event_type), 'bucket ' || throttle_bucket_key, 'participant ' || participant_id, 'stable ' || stable_key,
  'attempt ' || CAST(CAST(attempt AS BIGINT) AS VARCHAR) || '/5', 'class ' || error_class) AS line FROM ev
""")
def x22(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = events.sanitize(raw_events(spark, sf_dir).drop("seq"))
    return clean.select(F.struct(*events.EVENT_COLUMNS).alias("event")).select(errors.event_line(F.col("event")).alias("line"))


@query("x26_answer_text", """
SELECT event_id, CASE event_id % 8 WHEN 0 THEN concat('a ', event_type) WHEN 1 THEN concat('x', chr(10), event_type) WHEN 2 THEN NULL WHEN 3 THEN event_type
  WHEN 4 THEN event_type WHEN 5 THEN concat('one ', event_type) WHEN 6 THEN NULL ELSE NULL END AS text, event_id % 8 IN (2, 6, 7) AS invalid FROM events
""")
def x26(spark: SparkSession, sf_dir: str) -> DataFrame:
    case = F.col("event_id") % 8
    word = F.col("event_type")

    def body(template: str):
        before, after = template.split("@")
        return F.concat(F.lit(before), word, F.lit(after))

    bodies = (
        ("qwen", '{"choices":[{"message":{"content":" a @ "}}]}'),
        ("openrouter", '{"choices":[{"message":{"content":[{"text":" x "},{"text":"  "},{"kind":1},{"text":"@"}]}}]}'),
        ("deepseek", '{"choices":[{"message":{"content":"  ","other":"@"}}]}'),
        ("deepl", '{"translations":[{"text":"@"},{"text":"second"}]}'),
        ("google-translate-basic", '{"data":{"translations":[{"translatedText":" @"}]}}'),
        ("google-web", '{"sentences":[{"trans":"one "},{"orig":"z"},{"trans":"@"}]}'),
        ("llamacpp", '{"choices":[{"message":{"content":"<|channel>thought @"}}]}'),
        ("papago", '{"translatedText":5,"note":"@"'),
    )
    provider, text = F.lit(None).cast("string"), F.lit(None).cast("string")
    for number, (name, template) in enumerate(bodies):
        provider = F.when(case == number, name).otherwise(provider)
        text = F.when(case == number, body(template)).otherwise(text)
    rows = spread(fixtures.table(spark, sf_dir, "events")).select("event_id", responses.answer_text(provider, text).alias("r"))
    return rows.select("event_id", "r.text", F.col("r.problem").isNotNull().alias("invalid"))
