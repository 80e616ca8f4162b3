"""Byte-level pair encoding and decoding by replaying the merges over many words at once.

The distinct words (pre-tokens) of a block of texts form one array of symbols in which neighbours are linked. An inverted index
leads from each rank to the places whose pair makes that token. Ranks are taken in ascending order; all places of a rank are
merged in one go, and only their two neighbours get new entries in the index. Each distinct word of a block is thus encoded once,
however often it occurs. What was encoded is remembered for the next blocks of the task, within a bound.

A merge may rarely make a pair of lower rank than the one being replayed. Such a word is taken out and encoded alone, lowest
rank first, leftmost first, because there the order in which one word alone merges could differ from that of the replay.

Blocks need nothing of each other, so there is no shuffle: to replay over the whole corpus at once would mean to send every word
of every text to its codes and back.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gridscore.llm import ragged

#: Bytes of distinct words whose codes a worker remembers; the memory is cleared when full.
REMEMBERED_BYTES = 24 << 20


class Ranks:
    """A vocabulary of byte strings numbered by rank, and for pairs of tokens the token that they make."""

    def __init__(self, tokens: Sequence[bytes]) -> None:
        self.number = {token: rank for rank, token in enumerate(tokens)}
        self.bytes = np.array([self.number[bytes([b])] for b in range(256)], np.int64)
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.offsets = np.append(0, np.cumsum([len(t) for t in tokens]))
        pairs = []
        for rank, token in enumerate(tokens):
            for cut in range(1, len(token)):
                left, right = self.number.get(token[:cut]), self.number.get(token[cut:])
                if left is not None and right is not None:
                    pairs.append((left << 32 | right, rank))
        self.made = dict(pairs)
        ordered = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        self.codes, self.ranks = ordered[:, 0], ordered[:, 1]

    def of_pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank that each pair makes, or -1."""
        code = left << 32 | right
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.ranks[at], -1) if len(self.codes) else np.full(len(code), -1)


def load_ranks(path: str) -> list[bytes]:
    """Tokens of a file with a base64 token and its rank per line; ranks must be gapless from 0."""
    with open(path, "rb") as file:
        rows = [line.split() for line in file if line.strip()]
    tokens: list[bytes | None] = [None] * len(rows)
    for token, rank in rows:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


def encode_alone(word: bytes, ranks: Ranks) -> list[int]:
    """One word: always the leftmost pair of lowest rank."""
    symbols = [int(ranks.bytes[b]) for b in word]
    after, before = [*range(1, len(symbols)), -1], [*range(-1, len(symbols) - 1)]
    heap = [(r, i) for i in range(len(symbols) - 1) if (r := ranks.made.get(symbols[i] << 32 | symbols[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i]
        if symbols[i] < 0 or j < 0 or ranks.made.get(symbols[i] << 32 | symbols[j]) != rank:
            continue
        symbols[i], symbols[j], after[i] = rank, -1, after[j]
        if after[i] >= 0:
            before[after[i]] = i
        for left, right in ((before[i], i), (i, after[i])):
            if left >= 0 and right >= 0 and (r := ranks.made.get(symbols[left] << 32 | symbols[right])) is not None:
                heapq.heappush(heap, (r, left))
    return [s for s in symbols if s >= 0]


def replay(words: Sequence[bytes], ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all (distinct, non-empty) words one after the other, and how many each has."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    n = int(lengths.sum())
    owner = np.repeat(np.arange(len(words)), lengths)
    start = np.frombuffer(b"".join(words), np.uint8)
    coded = ranks.bytes[start]
    inside = owner[1:] == owner[:-1]
    rank = np.where(inside, ranks.of_pairs(coded[:-1], coded[1:]), -1)
    places = np.flatnonzero(rank >= 0)
    places = places[np.argsort(rank[places], kind="stable")]
    borders = np.flatnonzero(np.diff(rank[places], prepend=-1))
    index = {int(rank[places[a]]): p.tolist() for a, p in zip(borders, np.split(places, borders[1:]))}
    symbols, current = coded.tolist(), np.append(rank, -1).tolist()
    after = np.append(np.where(inside, np.arange(1, n), -1), -1).tolist()
    before = np.append(-1, np.where(inside, np.arange(n - 1), -1)).tolist()
    made, entries = ranks.made.get, index.get
    irregular: list[int] = []
    waiting = list(index)
    heapq.heapify(waiting)
    while waiting:
        now = heapq.heappop(waiting)
        found = index.pop(now)
        found.sort()
        for i in found:
            if current[i] != now:  # the pair there has changed since
                continue
            j = after[i]
            symbols[i] = now
            symbols[j] = current[j] = -1
            k = after[i] = after[j]
            h = before[i]
            if k >= 0:
                before[k] = i
                new = current[i] = made(now << 32 | symbols[k], -1)
                if new >= 0:
                    at = entries(new)
                    if at is not None:
                        at.append(i)
                    elif new > now:
                        index[new] = [i]
                        heapq.heappush(waiting, new)
                    else:
                        irregular.append(i)
            else:
                current[i] = -1
            if h >= 0:
                new = current[h] = made(symbols[h] << 32 | now, -1)
                if new >= 0:
                    at = entries(new)
                    if at is not None:
                        at.append(h)
                    elif new > now:
                        index[new] = [h]
                        heapq.heappush(waiting, new)
                    else:
                        irregular.append(i)
    ids = np.array(symbols, np.int64)
    alive = ids >= 0
    counts = np.bincount(owner[alive], minlength=len(words))
    ids = ids[alive]
    # A whole word of the vocabulary is its own code, also if no merges lead there.
    alone = {w: [r] for w, word in enumerate(words) if counts[w] != 1 and (r := ranks.number.get(word)) is not None}
    alone |= {w: encode_alone(words[w], ranks) for w in set(owner[irregular].tolist()) if words[w] not in ranks.number}
    if alone:
        parts = np.split(ids, np.cumsum(counts)[:-1])
        for w, own in alone.items():
            parts[w], counts[w] = np.array(own, np.int64), len(own)
        ids = np.concatenate(parts)
    return ids, counts


class Coder:
    """Encodes texts; remembers the codes of the words it has seen as one flat array."""

    def __init__(self, tokens: Sequence[bytes], pattern: str) -> None:
        self.ranks = Ranks(tokens)
        self.cut = regex.compile(pattern).findall
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.offsets, self.held = np.zeros(0, np.int32), np.zeros(1, np.int64), 0

    def learn(self, fresh: list[str]) -> None:
        words = [w.encode() for w in fresh]
        ids, counts = replay(words, self.ranks)
        self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh))))
        self.offsets = np.append(self.offsets, self.offsets[-1] + np.cumsum(counts))
        self.ids = np.append(self.ids, ids.astype(np.int32))
        self.held += sum(map(len, words))

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each has."""
        rows = [self.cut(text) for text in texts]
        distinct = set(chain.from_iterable(rows))
        if self.held > REMEMBERED_BYTES:
            self.clear()
        fresh = list(distinct.difference(self.known))
        if fresh:
            self.learn(fresh)
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(rows)), np.int64, int(sizes.sum()))
        ids, counts = gathered(self.ids, self.offsets, at)
        ends = np.append(0, np.cumsum(counts))[np.append(0, np.cumsum(sizes))]
        return ids, np.diff(ends)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the tokens one after the other, and how many each has."""
        return gathered(self.ranks.flat, self.ranks.offsets, ids)


def gathered(flat: np.ndarray, offsets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches ``at`` of a ragged array, one after the other, and their lengths."""
    lengths = offsets[at + 1] - offsets[at]
    begins = np.cumsum(lengths) - lengths
    return flat[np.arange(int(lengths.sum())) + np.repeat(offsets[at] - begins, lengths)], lengths


IDS = T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)
DECODED = T.StructField("decoded", T.BinaryType(), False)


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.append(0, np.cumsum(counts)).astype(np.int32), pa.array(values, pa.int32()))


def _strings(data: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = np.append(0, np.cumsum(counts)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _coders(frame: DataFrame, path: str, pattern: str):
    """A function that gives the task's coder, made where the task runs."""
    shared = frame.sparkSession.sparkContext.broadcast(load_ranks(path))  # as large as the vocabulary file
    made: list[Coder] = []

    def coder() -> Coder:
        if not made:
            made.append(Coder(shared.value, pattern))
        return made[0]

    return coder


def encoded(docs: DataFrame, path: str, pattern: str, text: str = "text", carry: Sequence[str] = ("doc_id",), into: str = "encoded", decoded: bool = False) -> DataFrame:
    """``carry`` columns and struct ``into`` with ``ids`` of each whole text, with ``decoded`` also the bytes that these give back.

    ``path``: a file of base64 tokens and ranks; ``pattern`` cuts texts into words, and each is encoded by itself, without special
    tokens. Null and empty texts have no ids. Repeated rows stay. A text is held whole by one task.
    """
    coder = _coders(docs, path, pattern)

    def compute(column: pa.Array) -> list[pa.Array]:
        ids, counts = coder().encode([value or "" for value in column.to_pylist()])
        if not decoded:
            return [_lists(ids, counts)]
        data, sizes = coder().decode(ids)
        ends = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(counts))]
        return [_lists(ids, counts), _strings(data, np.diff(ends))]

    return ragged.annotate(docs, text, T.StructType([IDS, DECODED] if decoded else [IDS]), compute, carry, into)


def decoded(rows: DataFrame, path: str, ids: str = "ids", carry: Sequence[str] = ("doc_id",), into: str = "decoded") -> DataFrame:
    """``carry`` columns and the bytes ``into`` of each row's token ``ids``; no ids and null ones give no bytes. An id that the
    vocabulary lacks is an error."""
    shared = rows.sparkSession.sparkContext.broadcast(load_ranks(path))
    schema = T.StructType([*(rows.schema[name] for name in carry), T.StructField(into, T.BinaryType(), False)])

    def run(batches):
        tokens = shared.value
        flat = np.frombuffer(b"".join(tokens), np.uint8)
        offsets = np.append(0, np.cumsum([len(t) for t in tokens]))
        for batch in batches:
            lists = batch.column(ids).to_pylist()
            made = []
            for one in lists:
                at = np.array([i for i in one or () if i is not None], np.int64)
                if len(at) and (at.min() < 0 or at.max() >= len(tokens)):
                    raise ValueError(f"no token {at.min() if at.min() < 0 else at.max()} in the vocabulary")
                made.append(gathered(flat, offsets, at)[0].tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), pa.array(made, pa.binary())], schema.names)

    return rows.select(*dict.fromkeys([*carry, ids])).mapInArrow(run, schema)
