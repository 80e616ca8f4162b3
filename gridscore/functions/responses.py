"""Answer text out of stored provider responses (JSON)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridscore.functions.annotations import bind
from gridscore.functions.text import trimmed

CHAT_PROVIDERS = ("qwen", "openrouter", "deepseek")
# Where each plain translation service keeps its text.
TEXT_PATHS = {
    "deepl": "$.translations[0].text",
    "google-translate-basic": "$.data.translations[0].translatedText",
    "papago": "$.translatedText",
}
_THOUGHT = "<|channel>"


def _at(document: Column, path: str) -> Column:
    return F.try_variant_get(document, path, "variant")


def _text(value: Column) -> Column:
    """The value if it is a JSON string; numbers and objects are not taken for text."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def _list(value: Column) -> Column:
    return F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array().cast("array<variant>"))


def _filled(text: Column) -> Column:
    return F.nullif(trimmed(text), F.lit(""))


def chat_content(content: Column) -> Column:
    """String content, or the non-empty text parts joined by line feeds."""
    parts = F.filter(F.transform(_list(content), lambda p: _filled(_text(_at(p, "$.text")))), lambda t: t.isNotNull())
    return F.coalesce(_filled(_text(content)), F.nullif(F.array_join(parts, "\n"), F.lit("")))


def answer_text(provider: Column, body: Column) -> Column:
    """Struct of ``text`` and ``problem`` (``invalid_response`` when there is no usable text)."""

    def read(document: Column) -> Column:
        first = F.coalesce(_text(_at(document, "$.choices[0].message.content")), _text(_at(document, "$.choices[0].text")))
        local = F.when(~trimmed(first).startswith(_THOUGHT), _filled(first))
        sentences = F.transform(_list(_at(document, "$.sentences")), lambda s: _text(_at(s, "$.trans")))
        nested = F.transform(_list(_at(document, "$[0]")), lambda s: _text(_at(s, "$[0]")))
        joined = lambda texts: _filled(F.array_join(F.array_compact(texts), ""))
        text = F.when(provider.isin(*CHAT_PROVIDERS), chat_content(_at(document, "$.choices[0].message.content")))
        text = text.when(provider == "llamacpp", local)
        text = text.when(provider == "google-web", F.coalesce(joined(sentences), joined(nested)))
        for name, path in TEXT_PATHS.items():
            text = text.when(provider == name, _filled(_text(_at(document, path))))
        return text

    found = bind(F.try_parse_json(body), read)
    return bind(found, lambda text: F.struct(text.alias("text"), F.when(text.isNull(), "invalid_response").alias("problem")))
