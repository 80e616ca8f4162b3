"""Running a user's annotator over pending cells, and functions for SQL users."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType

from gridscore import domain
from gridscore.functions.annotations import ANNOTATION, ERRORS
from gridscore.functions.text import ANY, SPACE, SPACE_CHARACTERS


def annotate(cells: DataFrame, annotator: Callable[[dict], str], inputs: list[str], key: str = "stable_key") -> DataFrame:
    """Raw annotation per cell: ``key, raw_judge_output, error``.

    The annotator gets one row as a dict. Its exception fails that row, not the task. Cells
    come in Arrow batches; how many run at once is Spark's number of partitions.
    """
    schema = StructType([StructField(key, StringType()), StructField("raw_judge_output", StringType()), StructField("error", StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, problems = [], []
            for row in batch.to_dict("records"):
                try:
                    texts.append(annotator(row))
                    problems.append(None)
                except Exception as error:  # noqa: BLE001 - any failure belongs to its row
                    texts.append("")
                    problems.append(str(error))
            yield pd.DataFrame({key: batch[key], "raw_judge_output": texts, "error": problems})

    return cells.select(key, *[name for name in inputs if name != key]).mapInPandas(run, schema)


def register_sql_functions(spark: SparkSession) -> None:
    """Temporary SQL functions made of native expressions; nothing leaves the JVM."""
    points = " ".join(f"WHEN '{name}' THEN {value}L" for name, value in domain.SEVERITY_POINTS.items())
    space = "'" + "".join(f"\\u{ord(character):04x}" for character in SPACE_CHARACTERS) + "'"
    statements = {
        "annotation_penalty": f"(errors {ERRORS}) RETURNS BIGINT RETURN aggregate(errors, 0L, (total, e) -> total + CASE e.severity {points} ELSE 0L END)",
        "character_error_rate": f"(reference STRING, hypothesis STRING) RETURNS DOUBLE RETURN levenshtein(btrim(hypothesis, {space}), btrim(reference, {space})) / nullif(char_length(btrim(reference, {space})), 0)",
        "parse_annotation": f"(annotation STRING) RETURNS {ANNOTATION} RETURN {_annotation_sql('annotation')}",
        "cell_key": "(run STRING, source STRING, language STRING, participant STRING) RETURNS STRING RETURN concat(run, '::', source, '::', language, '::', participant)",
    }
    for name, body in statements.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")


def _annotation_sql(raw: str) -> str:
    """SQL text of :func:`gridscore.functions.annotations.parse_annotation`: a SQL function can neither take a column
    expression nor be called inside a lambda, so the parts are put together as text."""
    space = "'" + "".join(f"\\u{ord(character):04x}" for character in SPACE_CHARACTERS) + "'"
    severities = ", ".join(f"'{name}'" for name in domain.SEVERITY_POINTS)
    behaviors = ", ".join(f"'{name}'" for name in domain.BEHAVIORS)
    spellings = {spelling: name for name in domain.ERROR_CLASSES for spelling in (name, name.replace("/", "-"))}
    table = "map(" + ", ".join(f"'{spelling}', '{name}'" for spelling, name in spellings.items()) + ")"
    behavior = f"r'(?i)^contextBehavior{SPACE}*[=:]{SPACE}*({ANY}+)\\z'"

    def trim(text: str) -> str:
        return f"btrim({text}, {space})"

    def bind(value: str, name: str, body: str) -> str:
        return f"element_at(transform(array({value}), {name} -> {body}), 1)"

    def severity(line: str) -> str:
        word = f"lower({trim(f'substring({line}, 1, length({line}) - 1)')})"
        return f"CASE WHEN endswith({line}, ':') AND {word} IN ({severities}) THEN {word} END"

    def is_behavior(line: str) -> str:
        return f"((contains({line}, ':') OR contains({line}, '=')) AND lower(substring({line}, 1, 15)) = 'contextbehavior' AND {line} RLIKE {behavior})"

    def error_class(line: str) -> str:
        field = f"""CASE WHEN contains({line}, ' - "') THEN try_element_at({table}, lower({trim(f"substring_index({line}, ' - \"', 1)")})) END"""
        # The longest name decides; of equally long ones the first in the list.
        longest = sorted(domain.ERROR_CLASSES, key=len, reverse=True)
        cases = " ".join(f"WHEN lower({line}) RLIKE r'(?<![a-z0-9]){name.replace('/', '[/-]')}(?![a-z0-9])' THEN '{name}'" for name in longest)
        return f"coalesce({field}, CASE {cases} END)"

    lines = f"filter(transform(split({raw}, '\\n', -1), l -> {trim('l')}), l -> l <> '' AND NOT startswith(l, '```'))"
    starts = f"filter(transform(lines, (l, i) -> CASE WHEN {severity('l')} IS NOT NULL THEN i END), i -> i IS NOT NULL)"
    section = (
        f"named_struct('severity', {severity('get(lines, a)')}, "
        f"'lines', filter(slice(lines, a + 2, z - a - 1), l -> NOT ({is_behavior('l')} OR lower(l) = 'no-error')))"
    )
    sections = bind(starts, "s", f"zip_with(s, slice(concat(s, array(size(lines))), 2, size(s)), (a, z) -> {section})")
    stated = f"transform(filter(lines, l -> {is_behavior('l')}), l -> lower({trim(f'regexp_extract(l, {behavior}, 1)')}))"
    error = (
        f"named_struct('severity', s.severity, 'class', {error_class('l')}, 'target_span_text', nullif(regexp_extract(l, r'\"([^\"]+)\"', 1), ''), "
        "'source_span_text', CAST(NULL AS STRING), 'explanation', CAST(NULL AS STRING))"
    )
    read = f"named_struct('errors', flatten(transform(parts.sections, s -> transform(s.lines, l -> {error}))), 'stated', parts.stated, 'saw', size(parts.sections) > 0)"
    first = "try_element_at(p.stated, 1)"
    problem = (
        f"CASE WHEN size(p.stated) > 1 THEN 'duplicate behavior line' WHEN {first} NOT IN ({behaviors}) THEN 'invalid behavior' "
        f"WHEN exists(p.errors, e -> e.class IS NULL) THEN 'no known class in error line' WHEN NOT p.saw AND {first} IS NULL THEN 'no severity sections' END"
    )
    judged = f"named_struct('errors', p.errors, 'behavior', {first}, 'problem', {problem})"
    return bind(bind(bind(lines, "lines", f"named_struct('sections', {sections}, 'stated', {stated})"), "parts", read), "p", judged)


def register_error_table_function(spark: SparkSession, name: str = "annotation_errors") -> None:
    """Table function for ``LATERAL``: one row per error of an annotation text, none for a text that cannot be read.

    It is a SQL function over the same native expressions as ``parse_annotation``; nothing leaves the JVM.
    """
    errors = f"element_at(transform(array({_annotation_sql('annotation')}), read -> CASE WHEN read.problem IS NULL THEN read.errors END), 1)"
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(annotation STRING) RETURNS TABLE(severity STRING, class STRING, target_span_text STRING) "
        f"RETURN SELECT e.severity, e.class, e.target_span_text FROM (SELECT explode({errors}) AS e)"
    )
