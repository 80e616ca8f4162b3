"""Context items and prompts as text, and back."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridscore.functions.text import trimmed


def turn_text(turn: Column) -> Column:
    """``[role, label] text``; an empty label counts as absent."""
    label = F.nullif(turn["relativeTimeLabel"], F.lit(""))
    head = F.when(label.isNotNull(), F.concat(turn["speakerRole"], F.lit(", "), label)).otherwise(turn["speakerRole"])
    return F.concat(F.lit("["), head, F.lit("] "), turn["sourceText"])


def model_input(turns: Column, current: Column) -> Column:
    """Tagged context and input blocks."""
    lines = F.concat(
        F.array(F.lit("<context>")),
        F.transform(turns, turn_text),
        F.array(F.lit("</context>"), F.lit(""), F.lit("<input>"), current["sourceText"], F.lit("</input>")),
    )
    return F.array_join(lines, "\n")


def numbered(lines: Column) -> Column:
    return F.array_join(F.transform(lines, lambda line, i: F.concat((i + 1).cast("string"), F.lit(". "), line)), "\n")


def judge_variables(turns: Column, current: Column, translation: Column, language_label: Column) -> dict[str, Column]:
    return {
        "targetLanguageLabel": language_label,
        "contextBlock": numbered(F.transform(turns, turn_text)),
        "currentSource": current["sourceText"],
        "translation": translation,
    }


_TAGGED = r"(?s)^<context>\n(.*?)\n</context>\n\n<input>\n(.*)\n</input>\z"
_HEADED = r"(?s)^<context>\n(.*?)\n</context>\n\n(?:Text to translate|Current input):\n(.*)\z"


def read_model_input(text: Column) -> Column:
    """Struct of current text, raw context lines and renumbered context; null for plain text."""

    def parts(pattern: str) -> Column:
        context = F.regexp_extract(text, pattern, 1)
        lines = F.filter(F.transform(F.split(context, "\r?\n", -1), trimmed), lambda line: line != "")
        return F.struct(
            F.regexp_extract(text, pattern, 2).alias("current_source"),
            context.alias("context"),
            numbered(lines).alias("context_turns"),
        )

    return F.when(text.rlike(_TAGGED), parts(_TAGGED)).when(text.rlike(_HEADED), parts(_HEADED))


def request_parts(text: Column) -> Column:
    """What a plain translation service is sent: current text and, where given, its context."""
    read = read_model_input(text)
    current = trimmed(read["current_source"])
    usable = read.isNotNull() & (F.length(current) > 0)
    return F.struct(
        F.when(usable, current).otherwise(text).alias("text"),
        F.when(usable, F.nullif(trimmed(read["context"]), F.lit(""))).alias("context"),
    )


def _pieces(template: str, pattern: str) -> list[str]:
    """Constant text and variable names in turn: text, name, text, ..., text."""
    return re.split(pattern, template)


def fill_prompt(template: str, variables: Mapping[str, Column]) -> Column:
    """Fill ``${name}``; unknown names stay. The template is constant and cut once, so values
    that look like variables are never filled again."""
    pieces = _pieces(template, r"\$\{(\w+)\}")
    parts: list[Column] = []
    for number, piece in enumerate(pieces):
        if number % 2 == 0:
            parts.append(F.lit(piece))
        elif piece in variables:
            parts.append(F.coalesce(variables[piece], F.lit("${" + piece + "}")))
        else:
            parts.append(F.lit("${" + piece + "}"))
    return F.concat(*parts)


def fill_judge_template(template: str, variables: Mapping[str, Column]) -> Column:
    """As :func:`fill_prompt`, but a missing variable is an error, and values are made safe
    for a fenced block: line ends become line feeds and triple backticks are broken up."""
    pieces = _pieces(template, r"\$\{([^}]+)\}")
    missing = [name for name in dict.fromkeys(pieces[1::2]) if name not in variables]
    if missing:
        raise ValueError("missing template variables: " + ", ".join(missing))

    def safe(value: Column) -> Column:
        lines = F.replace(F.replace(value, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
        return F.replace(lines, F.lit("```"), F.lit("``\\`"))

    return F.concat(*[F.lit(piece) if n % 2 == 0 else safe(variables[piece]) for n, piece in enumerate(pieces)])


def message_list(system: str, examples: list[tuple[str, str]], user_prompt: Column) -> Column:
    """Role and content of every message of a judge request; ``model`` speaks as ``assistant``."""
    fixed = [("system", system.strip())] if system.strip() else []
    fixed += [("assistant" if role == "model" else role, text) for role, text in examples]
    entries = [F.struct(F.lit(role).alias("role"), F.lit(text).alias("content")) for role, text in fixed]
    return F.array(*entries, F.struct(F.lit("user").alias("role"), user_prompt.alias("content")))


def flat_prompt(messages: Column, output_format: str) -> Column:
    """One labelled text of a message list whose last entry is the task.

    The system text comes first, then the output format, the examples and the task.
    """
    system = F.try_element_at(F.filter(messages, lambda m: m["role"] == "system"), F.lit(1))["content"]
    shown = F.filter(messages, lambda m: m["role"] != "system")
    examples = F.slice(shown, F.lit(1), F.greatest(F.size(shown) - 1, F.lit(0)))
    label = lambda m: F.when(m["role"] == "assistant", "Judge").otherwise("User")
    rendered = F.transform(examples, lambda m: F.concat(label(m), F.lit(":\n"), m["content"]))
    return F.concat_ws(
        "\n\n",
        F.concat(F.lit("System instructions:\n"), system),
        F.lit(output_format),
        F.when(F.size(examples) > 0, F.concat_ws("\n\n", F.lit("Examples:"), rendered)),
        F.concat(F.lit("Task:\n"), F.element_at(shown, -1)["content"]),
    )


def custom_id(messages: Column, key: Column) -> Column:
    """Content-addressed request id: message hash plus key hash."""
    content = F.substring(F.sha2(F.to_json(messages), 256), 1, 24)
    return F.concat(F.lit("j2-"), content, F.lit("-"), F.substring(F.sha2(key, 256), 1, 8))
