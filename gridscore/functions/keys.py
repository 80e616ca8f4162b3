"""Keys and labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridscore import domain


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def stable_key(run: Column | str, source: Column | str, language: Column | str, participant: Column | str) -> Column:
    """``run::source::language::participant``; null when any part is null (``concat`` keeps nulls)."""
    parts = [_col(run), _col(source).cast("string"), _col(language), _col(participant)]
    pieces: list[Column] = []
    for part in parts:
        pieces += [part, F.lit("::")]
    return F.concat(*pieces[:-1])


def checked_stable_key(run: Column | str, source: Column | str, language: Column | str, participant: Column | str) -> Column:
    """As :func:`stable_key`, but a missing part stops the job."""
    key = stable_key(run, source, language, participant)
    return F.coalesce(key, F.raise_error(F.lit("stable key has a missing part")).cast("string"))


def _lookup(value: Column | str, mapping: dict[str, str], what: str, strict: bool) -> Column:
    column = _col(value)
    expression = None
    for key, result in mapping.items():
        expression = F.when(column == key, result) if expression is None else expression.when(column == key, result)
    if not strict:
        return expression
    message = F.concat(F.lit(f"unsupported {what}: "), F.coalesce(column, F.lit("null")))
    return expression.otherwise(F.raise_error(message).cast("string"))


def language_code(label: Column | str, strict: bool = True) -> Column:
    return _lookup(label, domain.LANGUAGE_CODES, "target language label", strict)


def language_label(code: Column | str, strict: bool = True) -> Column:
    reverse = {code_: label for label, code_ in domain.LANGUAGE_CODES.items()}
    return _lookup(code, reverse, "target language code", strict)


def bucket_key(turn_count: Column | str, mode: Column | str, expectation: Column | str, phenomenon: Column | str) -> Column:
    return F.concat_ws("::", _col(turn_count).cast("string"), _col(mode), _col(expectation), _col(phenomenon))


def structural_bucket(turn_count: Column | str, mode: Column | str) -> Column:
    return F.concat(F.lit("ctx"), _col(turn_count).cast("string"), F.lit("-"), _col(mode))


def split_participant_language(key: Column | str) -> Column:
    """Struct of the parts around the first ``::``; null without a separator."""
    column = _col(key)
    position = F.instr(column, "::")
    return F.when(
        position > 0,
        F.struct(
            F.substring(column, F.lit(1), position - 1).alias("participant_id"),
            F.substring(column, position + 2, F.length(column)).alias("language"),
        ),
    )


def natural_key(key: Column | str) -> Column:
    """Sort key under which digit runs compare as numbers of any length: each run, without leading zeros, follows its
    number of digits in ten places."""
    parts = F.regexp_extract_all(_col(key), F.lit(r"\d+|\D+"), F.lit(0))

    def numbered(part: Column) -> Column:
        digits = F.regexp_replace(part, r"^0+(?=\d)", "")
        return F.when(part.rlike(r"^\d"), F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits)).otherwise(part)

    return F.array_join(F.transform(parts, numbered), "")


def is_context_blind(participant: Column | str) -> Column:
    """Systems that are handed the current text only."""
    column = _col(participant)
    return (
        column.endswith("-nocontext")
        | column.endswith("-nocontext-baseline")
        | column.isin(*domain.CONTEXT_BLIND_IDS)
    )


def is_no_context_variant(participant: Column | str, display_name: Column | str) -> Column:
    return _col(participant).endswith("-nocontext") | _col(display_name).rlike(r"(?i)\(No context\)")


def participant_category(participant: Column | str) -> Column:
    """First matching group by identifier prefix."""
    column = _col(participant)
    return (
        F.when(column.startswith("gemini35-live"), "live")
        .when(column.startswith("gemma4-e4b-") | column.startswith("gemma4-12b-"), "local-llm")
        .when(column.startswith("milmmt-") | column.startswith("hymt2-"), "dedicated-mt")
        .when(column.isin(*domain.COMMERCIAL_IDS), "commercial")
        .otherwise("api-llm")
    )


def is_partial_service(provider: Column | str, participant: Column | str) -> Column:
    """Services whose legacy runs cover only part of the grid."""
    return F.coalesce(_col(provider) == "deepl", F.lit(False)) | _col(participant).startswith("deepl-")


def display_name(manifest_name: Column | str, row_name: Column | str, participant: Column | str) -> Column:
    """First non-empty name; an empty text falls through."""
    return F.coalesce(F.nullif(_col(manifest_name), F.lit("")), F.nullif(_col(row_name), F.lit("")), _col(participant))
