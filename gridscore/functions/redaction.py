"""Named request and prompt payloads taken out of texts by an automaton over tokens, in the JVM.

Nested brackets rule out a regular expression for a whole payload, but its parts are simple: one expression finds the names,
another cuts what lies between them into quotes, brackets, escapes and plain runs. A fold over these tokens keeps depth, quote
state and position, and records from where to where a payload goes; the text is put together once in the end. The time is in
proportion to the text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridscore.functions.text import SPACE


@dataclass(frozen=True)
class Payloads:
    """How payloads are named. A field stands in quotes and its value ends like a JSON value; a label is free text, and an
    unstructured value after it goes on to the end of the text."""

    pattern: str
    quoted: bool

    def shown(self, name: Column) -> Column:
        if self.quoted:
            return F.concat(F.regexp_extract(name, '^("[A-Za-z]+")', 1), F.lit(':"[redacted]"'))
        return F.when(F.lower(name).startswith("system"), "system prompt: [redacted]").otherwise("request body: [redacted]")


# The names of payloads.
LABELS = Payloads(f"(?i)(?:request(?:[-_ ]?(?:body|payload|json))|system(?:[-_ ]?(?:prompt|instruction))){SPACE}*:{SPACE}*", quoted=False)
FIELDS = Payloads(f'(?i)"(?:systemPrompt|systemInstruction|requestBody|requestPayload|requestJson)"{SPACE}*:{SPACE}*', quoted=True)
#: Texts without this name no payload.
NAMED = r"(?i)request[-_ ]?(body|payload|json)|system[-_ ]?(prompt|instruction)"

_TOKEN = r'\\["\\{}\[\]]|["{}\[\]\\]|[^"\\{}\[\]]+'
_PLAIN = r"^[^\r\n,}\]]*"
_CUTS = "array<struct<start:int,stop:int,shown:string>>"
# Where the fold is: outside, before a value, in a quoted or bracketed one, in a plain one, in one that has no end.
_OUTSIDE, _BEFORE, _STRUCTURED, _UNQUOTED, _ENDLESS = range(5)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def tokens(text: Column, payloads: Payloads) -> Column:
    """All of the text as (token, is a name) in its order."""
    gaps, names = F.split(text, payloads.pattern, -1), F.regexp_extract_all(text, F.lit(payloads.pattern), F.lit(0))
    token = lambda value, is_name: F.struct(value.alias("text"), F.lit(is_name).alias("is_name"))

    def of_gap(gap: Column, i: Column) -> Column:
        plain = F.transform(F.regexp_extract_all(gap, F.lit(_TOKEN), F.lit(0)), lambda t: token(t, False))
        return F.when(i < F.size(names), F.concat(plain, F.array(token(F.get(names, i), True)))).otherwise(plain)

    return F.flatten(F.transform(gaps, of_gap))


def _state(at: Column, mode: Column | int, depth: Column, quoted: Column, escaped: Column, start: Column, shown: Column, cuts: Column) -> Column:
    mode = mode if isinstance(mode, Column) else F.lit(mode)
    return F.struct(
        at.alias("at"), mode.alias("mode"), depth.alias("depth"), quoted.alias("quoted"), escaped.alias("escaped"), start.alias("start"),
        shown.alias("shown"), cuts.alias("cuts"),
    )


def _step(payloads: Payloads) -> Callable[[Column, Column], Column]:
    def step(s: Column, token: Column) -> Column:
        text, is_name = token["text"], token["is_name"]
        after = s["at"] + F.length(text)
        escaped = text == "\\"  # a backslash that escapes the quote of the name behind it
        mark = F.right(text, F.lit(1))  # of an escape: what is escaped
        opens, closes, quote = mark.isin("{", "["), mark.isin("}", "]"), mark == '"'
        special = ~is_name & (F.length(text) <= 2) & (opens | closes | quote) & ((F.length(text) == 1) | text.startswith("\\"))
        bare = special & (F.length(text) == 1)
        field = is_name if payloads.quoted else F.lit(False)
        spelled = F.length(F.regexp_extract(text, '^("[A-Za-z]+")', 1))  # of a name in quotes, with them
        no, yes = F.lit(False), F.lit(True)

        def state(mode, depth=s["depth"], quoted=s["quoted"], start=s["start"], shown=s["shown"], cuts=s["cuts"]):
            return _state(after, mode, depth, quoted, escaped, start, shown, cuts)

        def ended(stop: Column) -> Column:
            cut = F.array(F.struct(s["start"].alias("start"), stop.alias("stop"), s["shown"].alias("shown")))
            return state(_OUTSIDE, depth=F.lit(0), quoted=no, cuts=F.concat(s["cuts"], cut))

        outside = F.when(is_name, state(_BEFORE, F.lit(0), no, s["at"], payloads.shown(text))).otherwise(state(_OUTSIDE))
        inside = F.length(F.regexp_extract(text, _PLAIN, 0))
        plain = F.when(inside < F.length(text), ended(s["at"] + inside)).otherwise(state(_UNQUOTED))
        begin = F.when(bare & quote, state(_STRUCTURED, F.lit(0), yes)).when(bare & opens, state(_STRUCTURED, F.lit(1), no))
        begin = begin.when(field, ended(s["at"] + spelled)).otherwise(plain) if payloads.quoted else begin.otherwise(state(_ENDLESS))
        # A name in quotes inside a value: its first quote may be escaped, which turns the parts of it around.
        in_quotes = F.when(
            bare & quote, F.when(s["depth"] == 0, ended(after)).otherwise(state(_STRUCTURED, quoted=no))
        ).when(
            field & s["escaped"], F.when(s["depth"] == 0, ended(s["at"] + spelled)).otherwise(state(_STRUCTURED, quoted=no))
        ).when(
            field, F.when(s["depth"] == 0, ended(s["at"] + 1)).otherwise(state(_STRUCTURED))
        ).otherwise(state(_STRUCTURED))
        in_brackets = (
            F.when(special & quote, state(_STRUCTURED, quoted=yes))
            .when(special & opens, state(_STRUCTURED, s["depth"] + 1))
            .when(special & closes, F.when(s["depth"] == 1, ended(after)).otherwise(state(_STRUCTURED, s["depth"] - 1)))
            .otherwise(state(_STRUCTURED))
        )
        return (
            F.when(s["mode"] == _OUTSIDE, outside).when(s["mode"] == _BEFORE, begin)
            .when(s["mode"] == _STRUCTURED, F.when(s["quoted"], in_quotes).otherwise(in_brackets))
            .when(s["mode"] == _UNQUOTED, plain).otherwise(state(_ENDLESS))
        )

    return step


def without_payloads(text: Column, payloads: Payloads) -> Column:
    """The text with each named payload replaced; null stays null."""

    def redacted(text: Column) -> Column:
        zero = F.lit(0)
        first = _state(zero, _OUTSIDE, zero, F.lit(False), F.lit(False), zero, F.lit("").cast("string"), F.lit(None).cast(_CUTS))
        first = first.withField("cuts", F.array().cast(_CUTS))
        last = F.aggregate(tokens(text, payloads), first, _step(payloads))
        return let(last, lambda s: put_together(text, s))

    def put_together(text: Column, s: Column) -> Column:
        rest = F.struct(s["start"].alias("start"), F.length(text).alias("stop"), s["shown"].alias("shown"))
        cuts = F.when(s["mode"] == _OUTSIDE, s["cuts"]).otherwise(F.concat(s["cuts"], F.array(rest)))

        def pieces(cuts: Column) -> Column:
            before = lambda i: F.coalesce(F.get(cuts, i - 1)["stop"], F.lit(0))
            shown = F.transform(cuts, lambda cut, i: F.concat(F.substring(text, before(i) + 1, cut["start"] - before(i)), cut["shown"]))
            tail = F.substring(text, before(F.size(cuts)) + 1, F.length(text))
            return F.concat(F.array_join(shown, ""), tail)

        return let(cuts, pieces)

    return let(text, redacted)


def redact_payloads(text: Column) -> Column:
    """Payloads after labels are taken out first, then values of fields. Texts that name none are not looked at further."""
    named = lambda t: without_payloads(without_payloads(t, LABELS), FIELDS)
    return let(text, lambda t: F.when(t.rlike(NAMED), named(t)).otherwise(t))
