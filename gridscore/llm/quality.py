"""Quality rules: a ledger of failure bits and measurements, and policies applied to the bits afterwards.

Every rule is evaluated once per text. The ledger keeps what was measured and one bit per failed rule, so a new policy
version, or the effect of leaving a rule out, needs the stored bits only and never the texts again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridscore.llm import ragged

REPEAT_WINDOW = 8
SYMBOLS = "#*$%&|<>"

MEASURES = T.StructType([
    T.StructField(name, T.LongType(), False)
    for name in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
])


@dataclass(frozen=True)
class Rule:
    bit: int
    name: str
    failed: Callable[[Column], Column]  # of the struct of measurements


RULES = (
    Rule(0, "few_words", lambda m: m.n_words < 20),
    Rule(1, "repeated_windows", lambda m: 100 * m.n_repeat_words > 30 * m.n_words),
    Rule(2, "symbols", lambda m: 10 * m.n_symbols > m.n_words),
    Rule(3, "repeated_lines", lambda m: (m.n_lines >= 4) & (100 * m.n_dup_lines > 30 * m.n_lines)),
    Rule(4, "short_words", lambda m: m.word_chars < 2 * m.n_words),
    Rule(5, "long_words", lambda m: m.word_chars > 20 * m.n_words),
    Rule(6, "any_repeated_line", lambda m: m.n_dup_lines > 0),
)
BASE = ("few_words", "repeated_windows")


@dataclass(frozen=True)
class Policy:
    """A version and the rules it enforces. Bits of other rules stay in the ledger unused."""

    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        bits = {rule.name: rule.bit for rule in RULES}
        return sum(1 << bits[name] for name in self.rules)


POLICIES = (
    Policy(1, BASE),
    Policy(2, (*BASE, "symbols", "repeated_lines")),
    Policy(3, (*BASE, "symbols", "repeated_lines", "short_words", "long_words")),
)
CURRENT = POLICIES[-1]


def measure(column: pa.Array) -> list[pa.Array]:
    """Measurements of a batch of texts, in the order of ``MEASURES``."""
    batch = ragged.texts(column)
    words = ragged.runs(batch, ragged.SPACED_WORD)
    n_words = np.diff(words.first)
    in_words = ragged.SPACED_WORD[batch.data]
    in_words &= (batch.data & 0xC0) != 0x80
    word_chars = batch.sums(in_words)
    n_symbols = batch.sums(ragged.flag_table(SYMBOLS.encode())[batch.data])

    lines = ragged.lines(batch)
    worded = np.searchsorted(words.starts, lines.ends) > np.searchsorted(words.starts, lines.starts)
    row = lines.rows()[worded]
    kept = ragged.Ranges(lines.starts[worded], lines.ends[worded], lines.first)
    n_lines = np.bincount(row, minlength=len(batch))
    again = equal_to_another(ragged.fingerprints(batch.data, kept), row)[1]
    n_dup_lines = np.bincount(row[again], minlength=len(batch))

    prints = ragged.fingerprints(batch.data, words)
    starts = ragged.whole_windows(words.first, REPEAT_WINDOW)
    word_row = words.rows()
    several, _ = equal_to_another(ragged.window_prints(prints, REPEAT_WINDOW)[starts], word_row[starts])
    change = np.zeros(len(prints) + 1, np.int64)
    np.add.at(change, starts[several], 1)
    np.add.at(change, starts[several] + REPEAT_WINDOW, -1)
    n_repeat = np.bincount(word_row[np.cumsum(change)[:-1] > 0], minlength=len(batch))
    return [pa.array(x.astype(np.int64)) for x in (n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat)]


def equal_to_another(prints: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per entry: whether another entry of its row has the same print, and whether an earlier one has."""
    key = ragged.mixed(prints + row.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    several, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    several[order[1:][same]] = True
    several[order[:-1][same]] = True
    later[order[1:][same]] = True
    return several, later


def ledger(docs: DataFrame, text: str = "text", carry: Sequence[str] = ("doc_id",), rules: Sequence[Rule] = RULES, into: str = "ledger") -> DataFrame:
    """``carry`` columns and struct ``into``: the measurements and ``failures``, one bit for each failed rule.

    A null or empty text has no words and fails ``few_words``; rows are never merged, so repeated rows stay as they are,
    and an empty table gives an empty ledger. Texts are read whole.
    """
    measured = ragged.annotate(docs, text, MEASURES, measure, carry, into)
    values = F.col(f"`{into}`")
    bits = F.lit(0).cast("bigint")
    for rule in rules:
        bits = bits.bitwiseOR(F.when(rule.failed(values), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("bigint"))
    return measured.withColumn(into, values.withField("failures", bits))


def passes(failures: Column, policy: Policy = CURRENT) -> Column:
    """Whether none of the policy's rules failed."""
    return failures.bitwiseAND(F.lit(policy.mask).cast("bigint")) == 0


def ablation(failures: DataFrame, column: str = "failures", policies: Sequence[Policy] = POLICIES, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Per policy and rule: rows that fail the rule, rows the policy rejects, and rows it would keep without the rule.

    Rows are first counted per distinct bit pattern, so only these counts are shuffled and expanded, however many
    texts the ledger has. Null bits count as no failure.
    """
    patterns = failures.groupBy(F.coalesce(F.col(column), F.lit(0).cast("bigint")).alias("bits")).agg(F.count("*").alias("n"))
    grid = F.explode(F.array(*[
        F.struct(F.lit(p.version).alias("policy"), F.lit(p.mask).cast("bigint").alias("mask"), F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("bigint").alias("bit"))
        for p in policies for r in rules if r.name in p.rules
    ]))
    rows = patterns.select("bits", "n", grid.alias("g"))
    hit = F.col("bits").bitwiseAND(F.col("g.mask"))
    count = lambda condition: F.sum(F.when(condition, F.col("n")).otherwise(0))
    return rows.groupBy(F.col("g.policy").alias("policy"), F.col("g.rule").alias("rule")).agg(
        count(hit.bitwiseAND(F.col("g.bit")) != 0).alias("n_failed"),
        count(hit != 0).alias("n_rejected"),
        count(hit == F.col("g.bit")).alias("n_only_this"),
        F.bit_or("bits").alias("bits_seen"),
    )
