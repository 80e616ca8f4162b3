"""Run events: what may be stored of them, retry analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from gridscore import domain
from gridscore.functions.errors import cooldown_scope, error_class, http_status, is_retryable, persisted_error_text
from gridscore.functions.text import truncated
from gridscore.operators.windows import running_streak, trailing_count

ITEM_TEXTS = ("stable_key", "source_id", "source_lang", "target_language")
PARTICIPANT_TEXTS = ("participant_id", "participant_model_id", "provider")
NUMBERS = ("attempt", "max_attempts", "latency_ms", "next_delay_ms")
EVENT_COLUMNS = (
    "scope", "timestamp", "phase", "event_type", "throttle_bucket_key", "stable_key", "source_id", "source_preview",
    "source_lang", "target_language", "participant_id", "participant_model_id", "provider", "attempt", "max_attempts",
    "latency_ms", "error_class", "error_summary", "raw_error_message", "next_delay_ms",
)


def sanitize(raw: DataFrame) -> DataFrame:
    """Events as they may be stored: columns a scope does not own are null, numbers are finite,
    previews and error texts are cut and cleaned. Absent input columns count as null, and so does a text
    where a number belongs."""
    have, kinds = set(raw.columns), {f.name: f.dataType for f in raw.schema}
    column = lambda name: F.col(name) if name in have else F.lit(None).cast("string")
    scope = F.coalesce(column("scope"), F.lit("phase"))
    item, person = scope == "item", scope.isin("item", "participant")
    preview = F.coalesce(column("source_preview"), column("sourcePreview"), column("source")).cast("string")

    def number(name: str):
        value = column(name).cast("double") if isinstance(kinds.get(name), NumericType) else F.lit(None).cast("double")
        return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value).alias(name)

    columns = {
        "scope": scope,
        "timestamp": F.coalesce(column("timestamp").cast("string"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")),
        "phase": F.coalesce(column("phase"), F.lit("translation")),
        "event_type": F.coalesce(column("event_type"), F.lit("unknown")),
        "throttle_bucket_key": F.when(scope != "phase", column("throttle_bucket_key").cast("string")),
        "source_preview": F.when(item, truncated(preview, domain.PREVIEW_CODE_POINTS)),
        "error_class": column("error_class"),
        "error_summary": persisted_error_text(column("error_summary")),
        "raw_error_message": persisted_error_text(column("raw_error_message")),
    }
    for name in ITEM_TEXTS:
        columns[name] = F.when(item, column(name).cast("string"))
    for name in PARTICIPANT_TEXTS:
        columns[name] = F.when(person, column(name).cast("string"))
    for name in NUMBERS:
        columns[name] = number(name)
    return raw.select(*[columns[name].alias(name) for name in EVENT_COLUMNS])


def classified(messages: DataFrame, provider: str = "provider", message: str = "message") -> DataFrame:
    """Add ``error_class, retryable, cooldown_scope``.

    Status and lower-cased text are columns of their own first, so that the many rules that look
    at them do not compute them again.
    """
    person = F.col(provider)
    prepared = messages.withColumns({"_status": http_status(F.col(message)), "_lowered": F.lower(message)})
    classed = prepared.withColumn("error_class", error_class(person, F.col("_lowered"), F.col("_status"))).drop("_status", "_lowered")
    return classed.withColumns(
        {"retryable": is_retryable(person, F.col("error_class")), "cooldown_scope": cooldown_scope(person, F.col("error_class"))}
    )


def recent_throttle_failures(failures: DataFrame, keys: list[str], ts: str = "ts", retryable: str = "retryable") -> DataFrame:
    """Retryable rate-limit and overload failures of the key (an item) in the last minute, per failure."""
    counted = F.col("error_class").isin("rate_limit", "server_overload") & F.col(retryable)
    return trailing_count(failures, keys, ts, counted, domain.FAILURE_WINDOW_SECONDS, "recent_failures")


def invalid_streaks(failures: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """Run length of invalid responses that ends at each failure; two in a row end the retries."""
    streaks = running_streak(failures, keys, seq, F.col("error_class") == "invalid_response", "streak")
    return streaks.withColumn("stops_retry", F.col("streak") >= 2)
