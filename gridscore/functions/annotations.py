"""Reading free-text error annotations into nested columns, without a UDF.

The text is cut at its severity headings, then the lines of every section are read with
regular expressions. See ``ANNOTATION`` for the result type.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridscore import domain
from gridscore.functions.text import ANY, SPACE, trimmed

ERROR = "struct<severity:string,class:string,target_span_text:string,source_span_text:string,explanation:string>"
ERRORS = f"array<{ERROR}>"
ANNOTATION = f"struct<errors:{ERRORS},behavior:string,problem:string>"
SUMMARY = "struct<has_no_error:boolean,critical_count:int,major_count:int,minor_count:int,total_penalty:bigint>"

_BEHAVIOR = f"(?i)^contextBehavior{SPACE}*[=:]{SPACE}*({ANY}+)\\z"
_ANCHORED = f'(?i)^[A-Za-z0-9_/ -]+{SPACE}*-{SPACE}*"[^"]+"{SPACE}*\\z'
_SPAN = '"([^"]+)"'
_SEPARATOR = ' - "'


def penalty(errors: Column) -> Column:
    """Sum of severity points over an array of errors."""
    points = lambda e: (
        F.when(e["severity"] == "critical", domain.SEVERITY_POINTS["critical"])
        .when(e["severity"] == "major", domain.SEVERITY_POINTS["major"])
        .when(e["severity"] == "minor", domain.SEVERITY_POINTS["minor"])
        .otherwise(0)
        .cast("bigint")
    )
    return F.aggregate(errors, F.lit(0).cast("bigint"), lambda acc, e: acc + points(e))


def severity_count(errors: Column, severity: str) -> Column:
    return F.size(F.filter(errors, lambda e: e["severity"] == severity))


def summary(errors: Column) -> Column:
    return F.struct(
        (F.size(errors) == 0).alias("has_no_error"),
        *[severity_count(errors, name).cast("int").alias(f"{name}_count") for name in domain.SEVERITY_POINTS],
        penalty(errors).alias("total_penalty"),
    ).cast(SUMMARY)


def _class_table() -> Column:
    """Map of every accepted spelling to its class."""
    entries: list[Column] = []
    for name in domain.ERROR_CLASSES:
        for spelling in dict.fromkeys((name, name.replace("/", "-"))):
            entries += [F.lit(spelling), F.lit(name)]
    return F.create_map(*entries)


def _class_field(line: Column) -> Column:
    """Class named before the first separator, if it is exactly a known one."""
    field = F.lower(trimmed(F.substring_index(line, _SEPARATOR, 1)))
    return F.when(F.contains(line, F.lit(_SEPARATOR)), F.try_element_at(_class_table(), field))


def _class_anywhere(line: Column) -> Column:
    """Longest class that stands as a word anywhere in the line."""
    lowered = F.lower(line)
    found = F.lit(None).cast("string")
    # The longest name decides; of equally long ones the first in the list, hence the reversal.
    for name in sorted(reversed(domain.ERROR_CLASSES), key=len):
        spelled = name.replace("/", "[/-]")
        found = F.when(lowered.rlike(f"(?<![a-z0-9]){spelled}(?![a-z0-9])"), name).otherwise(found)
    return found


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``, like a local variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _lines(raw: Column) -> Column:
    """Trimmed lines without blank lines and code fences."""
    lines = F.transform(F.split(raw, "\n", -1), trimmed)
    return F.filter(lines, lambda line: (line != "") & ~line.startswith("```"))


def _severity(line: Column) -> Column:
    """Severity a heading line names; null for any other line."""
    word = F.lower(trimmed(F.substring(line, F.lit(1), F.length(line) - 1)))
    return F.when(line.endswith(":") & word.isin(*domain.SEVERITY_POINTS), word)


# The two tests below run on every line; a cheap look at the bytes settles most lines.
def _is_no_error(line: Column) -> Column:
    return (F.octet_length(line) == 8) & (F.lower(line) == "no-error")


def _is_behavior(line: Column) -> Column:
    has_sign = F.contains(line, F.lit(":")) | F.contains(line, F.lit("="))
    return F.coalesce(has_sign, F.lit(False)) & (F.lower(F.substring(line, 1, 15)) == "contextbehavior") & line.rlike(_BEHAVIOR)


def _sections(lines: Column) -> Column:
    """Severity and lines of every section; behaviour lines belong to none."""
    marks = F.transform(lines, lambda line, i: F.when(_severity(line).isNotNull(), i))
    starts = F.filter(marks, lambda i: i.isNotNull())

    def cut(at: Column) -> Column:
        ends = F.slice(F.concat(at, F.array(F.size(lines))), F.lit(2), F.size(at))
        return F.zip_with(
            at,
            ends,
            lambda start, end: F.struct(
                _severity(F.get(lines, start)).alias("severity"),
                F.filter(F.slice(lines, start + 2, end - start - 1), lambda line: ~_is_behavior(line)).alias("lines"),
            ),
        )

    return bind(starts, cut)


def _behaviors(lines: Column) -> Column:
    found = F.filter(lines, _is_behavior)
    return F.transform(found, lambda line: F.lower(trimmed(F.regexp_extract(line, _BEHAVIOR, 1))))


def _read_line(line: Column, severity: Column) -> Column:
    span = F.regexp_extract(line, _SPAN, 1)
    return F.struct(
        severity.alias("severity"),
        F.coalesce(_class_field(line), _class_anywhere(line)).alias("class"),
        F.when(span != "", span).alias("target_span_text"),
        F.lit(None).cast("string").alias("source_span_text"),
        F.lit(None).cast("string").alias("explanation"),
    )


def _section_errors(section: Column) -> Column:
    lines = F.filter(section["lines"], lambda line: ~_is_no_error(line))
    return F.transform(lines, lambda line: _read_line(line, section["severity"]))


def parse_annotation(raw: Column) -> Column:
    """Tolerant reading of a text: errors and behaviour, or why it cannot be read."""

    def read(lines: Column) -> Column:
        return F.struct(_sections(lines).alias("sections"), _behaviors(lines).alias("behaviors"))

    def with_errors(parts: Column) -> Column:
        return F.struct(
            F.flatten(F.transform(parts["sections"], _section_errors)).alias("errors"),
            parts["behaviors"].alias("behaviors"),
            (F.size(parts["sections"]) > 0).alias("saw"),
        )

    def judged(parts: Column) -> Column:
        behavior = F.try_element_at(parts["behaviors"], F.lit(1))
        problem = (
            F.when(F.size(parts["behaviors"]) > 1, "duplicate behavior line")
            .when(behavior.isNotNull() & ~behavior.isin(*domain.BEHAVIORS), "invalid behavior")
            .when(F.exists(parts["errors"], lambda e: e["class"].isNull()), "no known class in error line")
            .when(~parts["saw"] & behavior.isNull(), "no severity sections")
        )
        return F.struct(parts["errors"].alias("errors"), behavior.alias("behavior"), problem.alias("problem"))

    return bind(bind(bind(_lines(raw), read), with_errors), judged)


def is_complete_annotation(raw: Column) -> Column:
    """Strict gate: three filled sections, one valid behaviour line, and that line last."""

    def is_content(line: Column) -> Column:
        return _is_no_error(line) | (line.rlike(_ANCHORED) & _class_field(line).isNotNull())

    def gate(lines: Column) -> Column:
        return F.struct(
            _sections(lines).alias("sections"),
            _behaviors(lines).alias("behaviors"),
            F.coalesce(_is_behavior(F.try_element_at(lines, F.lit(-1))), F.lit(False)).alias("last"),
        )

    def judged(parts: Column) -> Column:
        names = F.transform(parts["sections"], lambda s: s["severity"])
        filled = F.forall(parts["sections"], lambda s: (F.size(s["lines"]) > 0) & F.forall(s["lines"], is_content))
        one_valid = (F.size(parts["behaviors"]) == 1) & parts["behaviors"][0].isin(*domain.BEHAVIORS)
        return parts["last"] & F.coalesce(one_valid, F.lit(False)) & filled & (F.size(F.array_distinct(names)) == 3)

    return bind(bind(_lines(raw), gate), judged)


def _kind_of(value: Column) -> Column:
    """Leading type name of a variant (``OBJECT``, ``ARRAY``, ``STRING``, ``VOID`` ...)."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def _checked_json_error(error: Column) -> Column:
    """Problem of one stored error object, null when it obeys the record format."""
    required = ("severity", "class", "target_span_text", "source_span_text")
    allowed = F.array(*[F.lit(name) for name in (*required, "explanation")])

    def one_of(value: Column, names: Sequence[str]) -> Column:
        # Only a text can be read as one of these names.
        return F.coalesce(F.try_variant_get(value, "$", "string").isin(*names), F.lit(False))

    def checked(fields: Column) -> Column:
        names = F.map_keys(fields)
        return (
            F.when(fields.isNull(), "error is not an object")
            .when(F.size(F.array_except(names, allowed)) > 0, "error has unexpected keys")
            .when(F.size(F.array_except(F.array(*map(F.lit, required)), names)) > 0, "error lacks a required key")
            .when(~one_of(fields["severity"], list(domain.SEVERITY_POINTS)), "severity is invalid")
            .when(~one_of(fields["class"], domain.ERROR_CLASSES), "class is invalid")
            .when(~_kind_of(fields["target_span_text"]).isin("STRING", "VOID"), "target span is neither text nor null")
            .when(~_kind_of(fields["source_span_text"]).isin("STRING", "VOID"), "source span is neither text nor null")
            .when(F.array_contains(names, "explanation") & (_kind_of(fields["explanation"]) != "STRING"), "explanation is not text")
        )

    return bind(F.try_variant_get(error, "$", "map<string,variant>"), checked)


def parse_json_annotation(document: Column) -> Column:
    """Strict reading of a stored JSON annotation (a variant) to ``ANNOTATION``.

    Every value is taken out of the document once: what a lambda names twice is evaluated twice.
    """
    fields = F.struct(
        F.map_keys(F.try_variant_get(document, "$", "map<string,variant>")).alias("names"),
        F.coalesce(_kind_of(F.try_variant_get(document, "$.has_no_error", "variant")) == "BOOLEAN", F.lit(False)).alias("has_flag"),
        F.try_variant_get(document, "$.has_no_error", "boolean").alias("is_clean"),
        F.try_variant_get(document, "$.errors", "array<variant>").alias("elements"),
        F.try_variant_get(document, "$.contextBehavior", "string").alias("behavior"),
    )

    def checked(d: Column) -> Column:
        form = (
            F.when(d["names"].isNull(), "annotation is not an object")
            .when(~d["has_flag"], "has_no_error is not a boolean")
            .when(d["elements"].isNull(), "errors is not an array")
            .when(d["is_clean"] & (F.size(d["elements"]) > 0), "has_no_error with errors")
            .when(~d["is_clean"] & (F.size(d["elements"]) == 0), "errors missing")
        )
        in_errors = F.get(F.filter(F.transform(d["elements"], _checked_json_error), lambda p: p.isNotNull()), F.lit(0))
        wrong_behavior = F.array_contains(d["names"], "contextBehavior") & ~F.coalesce(d["behavior"].isin(*domain.BEHAVIORS), F.lit(False))
        return F.struct(F.coalesce(form, in_errors, F.when(wrong_behavior, "behavior is invalid")).alias("problem"), d["elements"].alias("elements"), d["behavior"].alias("behavior"))

    def read(d: Column) -> Column:
        errors = F.transform(
            d["elements"],
            lambda e: F.struct(
                *[
                    F.try_variant_get(e, f"$.{name}", "string").alias(name)
                    for name in ("severity", "class", "target_span_text", "source_span_text", "explanation")
                ]
            ),
        )
        ok = d["problem"].isNull()
        return F.struct(
            F.when(ok, errors).otherwise(F.array().cast(ERRORS)).alias("errors"),
            F.when(ok, d["behavior"]).alias("behavior"),
            d["problem"].alias("problem"),
        )

    return bind(bind(fields, checked), read)


def parse_response(raw: Column) -> Column:
    """Stored JSON if the whole text is one JSON object, else a text annotation.

    The text is parsed inside an array so that anything after the object makes it invalid. ``raw`` is evaluated once.
    """

    def stored(wrapped: Column) -> Column:
        document = F.try_variant_get(wrapped, "$[0]", "variant")
        several = F.try_variant_get(wrapped, "$[1]", "variant").isNotNull()
        return F.when(document.isNotNull() & ~several, bind(document, parse_json_annotation))

    def read(parts: Column) -> Column:
        wrapped = F.try_parse_json(F.concat(F.lit("["), parts["text"], F.lit("]")))
        return F.coalesce(F.when(parts["text"].startswith("{"), bind(wrapped, stored)), parse_annotation(parts["raw"]))

    both = lambda value: F.struct(value.alias("raw"), trimmed(value).alias("text"))
    return bind(bind(raw, both), read)
