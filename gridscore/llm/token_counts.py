"""Token counts of byte-level pair merging, computed for many pre-tokens at once.

Pre-tokens of a batch are ragged numpy arrays of symbols. In every round each sequence finds its own lowest-ranked pair and
all its occurrences are merged, in all sequences at the same time; sequences without a ranked pair are done. The count
of a pre-token is the number of symbols that survive.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gridscore.llm import ragged

# Fixed value: how the vocabulary's pre-tokens are cut.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Counts of pre-tokens a worker remembers; the memory is cleared when full.
REMEMBERED = 400_000
_NO_RANK = np.int32(1 << 30)

RESULT = T.StructType([T.StructField("n_bytes", T.LongType(), False), T.StructField("n_tokens", T.LongType(), False)])


@dataclass
class Merges:
    """Pair codes (left id * 2**32 + right id), sorted, with rank and merged id; ids of single bytes; whole-token strings."""

    codes: np.ndarray
    ranks: np.ndarray
    merged: np.ndarray
    byte_ids: np.ndarray
    specials: tuple[str, ...]


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable bytes for themselves, the rest from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def load_merges(path: str) -> Merges:
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    cutter = spec["pre_tokenizer"]
    if spec["model"]["type"] != "BPE" or spec["normalizer"] or cutter["type"] != "ByteLevel" or cutter["add_prefix_space"] or not cutter["use_regex"]:
        raise ValueError(f"{path} is no plain byte-level vocabulary")
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
        raise ValueError(f"{path} has added tokens with white-space or word rules")
    vocab = spec["model"]["vocab"]
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    codes = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], np.int64)
    merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
    order = np.argsort(codes, kind="stable")
    return Merges(
        codes[order], order.astype(np.int32), merged[order], np.array([vocab[c] for c in byte_letters()], np.int32),
        tuple(t["content"] for t in spec["added_tokens"]),
    )


def merged_lengths(tokens: Sequence[bytes], merges: Merges) -> np.ndarray:
    """Number of symbols each byte string ends with."""
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    result = lengths.copy()
    owner = np.repeat(np.arange(len(tokens)), lengths)
    symbols = merges.byte_ids[np.frombuffer(b"".join(tokens), np.uint8)].astype(np.int64)
    last = len(merges.codes) - 1
    while len(symbols) > 1:
        code = (symbols[:-1] << 32) | symbols[1:]
        slot = np.minimum(np.searchsorted(merges.codes, code), last)
        ranked = (merges.codes[slot] == code) & (owner[:-1] == owner[1:])
        rank = np.append(np.where(ranked, merges.ranks[slot], _NO_RANK), _NO_RANK)
        starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        lowest = np.minimum.reduceat(rank, starts)
        sizes = np.diff(np.append(starts, len(symbols)))
        alive = np.repeat(lowest != _NO_RANK, sizes)
        chosen = np.flatnonzero((rank == np.repeat(lowest, sizes)) & (rank != _NO_RANK))
        # Of overlapping pairs (x x x) every second one is merged, from the left.
        begins = np.append(True, np.diff(chosen) != 1)
        if not begins.all():
            index = np.arange(len(chosen))
            chosen = chosen[(index - np.maximum.accumulate(np.where(begins, index, 0))) % 2 == 0]
        symbols[chosen] = merges.merged[slot[chosen]]
        alive[chosen + 1] = False
        np.subtract.at(result, owner[chosen], 1)
        symbols, owner = symbols[alive], owner[alive]
    return result


class Counter:
    """Counts tokens of texts; remembers the counts of pre-tokens it has seen."""

    def __init__(self, merges: Merges) -> None:
        self.merges = merges
        self.known: dict[str, int] = {}
        self.cut = regex.compile(PRE_TOKEN).findall
        self.special = regex.compile("|".join(map(regex.escape, sorted(merges.specials, key=len, reverse=True)))) if merges.specials else None

    def __call__(self, texts: Sequence[str]) -> list[int]:
        rows, whole = [], []
        for text in texts:
            parts = self.special.split(text) if self.special and any(s in text for s in self.merges.specials) else [text]
            whole.append(len(parts) - 1)
            rows.append(list(chain.from_iterable(map(self.cut, parts))))
        distinct = set(chain.from_iterable(rows))
        if len(self.known) + len(distinct) > REMEMBERED:
            self.known = {}
        fresh = list(distinct.difference(self.known))
        if fresh:
            self.known.update(zip(fresh, merged_lengths([c.encode() for c in fresh], self.merges).tolist()))
        count = self.known.__getitem__
        return [n + sum(map(count, row)) for n, row in zip(whole, rows)]


def token_counts(docs: DataFrame, path: str, text: str = "text", carry: Sequence[str] = ("doc_id",), into: str = "counts") -> DataFrame:
    """``carry`` columns and struct ``into``: ``n_bytes`` (UTF-8) and ``n_tokens`` of each whole text.

    ``path``: a byte-level vocabulary file of the ``tokenizers`` library. Strings of its added tokens count as one token,
    as by that library's default; no begin or end tokens are added. Null and empty texts have no tokens. Repeated rows stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_merges(path))
    made: list[Counter] = []  # one for each task, made where the task runs

    def compute(column: pa.Array) -> list[pa.Array]:
        if not made:
            made.append(Counter(shared.value))
        counter = made[0]
        values = [value or "" for value in column.to_pylist()]
        sizes = np.diff(ragged.texts(column).offsets)
        return [pa.array(sizes), pa.array(counter(values), pa.int64())]

    return ragged.annotate(docs, text, RESULT, compute, carry, into)
