"""Benchmark decontamination by Wu-Manber search for many strings at once.

Every test item gives its windows of consecutive words as search strings. A table of block shifts tells how far a search
can advance from any position without missing a string; where the shift is nil, the hash of the block selects the bucket
of strings that end their first part there, and these are compared byte by byte. Many stretches of a batch are searched in
lockstep: each step advances all of them by their own shifts.

The strings are a query set: they are taken in blocks of bounded size, each broadcast and searched in one pass over
the texts, so the size of a broadcast does not depend on the size of the benchmark.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridscore.llm import ragged
from gridscore.llm.components import stored

WINDOW = 10
#: Search strings of one broadcast, in bytes of item text.
BLOCK_BYTES = 1 << 20
#: Bytes of a text searched by one lane.
LANE = 1024
#: Shortest strings of each search table; short strings would keep the shifts of the long ones small.
CLASSES = (48, 24, 8, 3)

RESULT = T.StructType([
    T.StructField("n_words", T.LongType(), False),
    T.StructField("n_hit", T.LongType(), False),
    T.StructField("hits", T.ArrayType(T.LongType(), False), False),
    T.StructField("items", T.ArrayType(T.LongType(), False), False),
])


@dataclass
class Table:
    """Strings of at least ``shortest`` bytes, searched by their first ``shortest`` bytes in blocks of ``block``."""

    shortest: int
    block: int
    bits: int
    shift: np.ndarray
    codes: np.ndarray  # distinct last blocks, sorted
    first: np.ndarray  # bucket of each code
    strings: list[bytes]  # in bucket order
    words: np.ndarray
    items: list[np.ndarray]


def block_codes(buffer: np.ndarray, block: int) -> np.ndarray:
    """The ``block`` bytes from each position of ``buffer`` (8 spare bytes at its end) as one number."""
    view = np.ndarray((max(0, len(buffer) - 8),), "<u8", buffer, strides=(1,))
    return view if block == 8 else view & np.uint64((1 << 8 * block) - 1)


def slots(codes: np.ndarray, bits: int) -> np.ndarray:
    return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def build_tables(windows: dict[bytes, tuple[int, set[int]]]) -> list[Table]:
    """``windows``: search string to its number of words and the items it comes from."""
    tables = []
    rest = sorted(windows)
    for limit in CLASSES:
        chosen = [s for s in rest if len(s) >= limit]
        rest = [s for s in rest if len(s) < limit]
        if not chosen:
            continue
        shortest = min(map(len, chosen))
        block = min(8, shortest)
        heads = np.array([np.frombuffer(s[:shortest], np.uint8) for s in chosen])
        bits = max(10, min(20, int(heads.size).bit_length() + 2))
        shift = np.full(1 << bits, shortest - block + 1, np.int64)
        for stop in range(block, shortest + 1):
            padded = np.zeros((len(chosen), 8), np.uint8)
            padded[:, :block] = heads[:, stop - block : stop]
            codes = padded.view("<u8").ravel()
            np.minimum.at(shift, slots(codes, bits), shortest - stop)
        order = np.argsort(codes, kind="stable")  # of the last block
        unique, first = np.unique(codes[order], return_index=True)
        strings = [chosen[i] for i in order]
        tables.append(Table(
            shortest, block, bits, shift, unique, np.append(first, len(order)), strings,
            np.array([windows[s][0] for s in strings]), [np.array(sorted(windows[s][1]), np.int64) for s in strings],
        ))
    return tables


def candidates(table: Table, codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Start positions in a text of ``n`` bytes and the bucket of strings to compare there."""
    none = np.zeros(0, np.int64)
    reach = table.shortest - table.block  # from the start of a window to its last block
    total = n - table.shortest + 1
    if total <= 0:
        return none, none
    at = np.arange(0, total, LANE)
    stop = np.minimum(at + LANE, total)
    found: list[np.ndarray] = []
    while len(at):
        step = table.shift[slots(codes[at + reach], table.bits)]
        found.append(at[step == 0])
        at = at + np.maximum(step, 1)
        alive = at < stop
        if not alive.all():
            at, stop = at[alive], stop[alive]
    position = np.sort(np.concatenate(found))
    code = codes[position + reach]
    bucket = np.minimum(np.searchsorted(table.codes, code), len(table.codes) - 1)
    same = table.codes[bucket] == code
    return position[same], bucket[same]


def plain_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words, each after a blank, texts ended by a blank and a zero; starts of the words; words of each text."""
    batch = ragged.texts(column)
    batch = ragged.Texts(ragged.LOWER[batch.data], batch.offsets)
    words = ragged.runs(batch, ragged.PLAIN_WORD)
    lengths = words.ends - words.starts
    row = words.rows()
    begins = np.cumsum(lengths) - lengths + np.arange(len(lengths)) + 1 + 2 * row
    n = int(lengths.sum()) + len(lengths) + 2 * len(batch)
    buffer = np.full(n + 16, 32, np.uint8)
    inside = ragged.PLAIN_WORD[batch.data]
    buffer[np.repeat(begins - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())] = batch.data[inside]
    per_text = np.bincount(row, weights=lengths + 1, minlength=len(batch)).astype(np.int64)
    buffer[np.cumsum(per_text + 2) - 1] = 0
    buffer[n:] = 0
    return buffer, begins, words.first


def search(column: pa.Array, tables: Sequence[Table]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Per text: number of words, the hit words (positions), the items that occur."""
    buffer, begins, first = plain_words(column)
    raw, n = buffer.tobytes(), len(buffer) - 16
    change = np.zeros(len(begins) + 1, np.int64)
    pairs: list[np.ndarray] = []
    for table in tables:
        position, bucket = candidates(table, block_codes(buffer, table.block), n)
        for at, b in zip(position.tolist(), bucket.tolist()):
            for j in range(table.first[b], table.first[b + 1]):
                string = table.strings[j]
                if raw.startswith(string, at):
                    word = int(np.searchsorted(begins, at + 1))
                    change[word] += 1
                    change[word + table.words[j]] -= 1
                    text = int(np.searchsorted(first, word, side="right")) - 1
                    pairs.append(np.stack([np.full(len(table.items[j]), text), table.items[j]], 1))
    hit = np.flatnonzero(np.cumsum(change)[:-1] > 0)
    owner = np.searchsorted(first, hit, side="right") - 1
    cuts = np.searchsorted(owner, np.arange(1, len(first) - 1))
    hits = [h - first[i] for i, h in enumerate(np.split(hit, cuts))] if len(first) > 1 else []
    items = [np.zeros(0, np.int64)] * (len(first) - 1)
    if pairs:
        distinct = np.unique(np.concatenate(pairs), axis=0)
        for text in np.unique(distinct[:, 0]):
            items[text] = distinct[distinct[:, 0] == text, 1]
    return np.diff(first), hits, items


def item_windows(rows: Sequence[tuple[int | None, str | None]], width: int) -> dict[bytes, tuple[int, set[int]]]:
    windows: dict[bytes, tuple[int, set[int]]] = {}
    if not rows:
        return windows
    buffer, begins, first = plain_words(pa.array([text for _, text in rows], pa.string()))
    raw = buffer.tobytes()
    for (item, _), start, stop in zip(rows, first[:-1].tolist(), first[1:].tolist()):
        count = min(width, stop - start)
        for j in range(start, stop - count + 1) if count else ():
            end = begins[j + count] if j + count < stop else raw.index(b"\0", begins[stop - 1])
            found = windows.setdefault(raw[begins[j] - 1 : end], (count, set()))[1]
            if item is not None:
                found.add(item)
    return windows


def blocks(items: DataFrame, item_id: str, text: str, limit: int) -> Iterator[list[tuple[int | None, str]]]:
    """Items in blocks of at most ``limit`` bytes (a longer item is a block of its own), one block on the driver at a time."""
    block: list[tuple[int | None, str]] = []
    size = 0
    rows = items.where(items[f"`{text}`"].isNotNull()).select(items[f"`{item_id}`"].cast("bigint"), items[f"`{text}`"])
    for item, value in rows.toLocalIterator():
        n = len(value.encode())
        if block and size + n > limit:
            yield block
            block, size = [], 0
        block.append((item, value))
        size += n
    if block:
        yield block


def at_least_one(rows: Iterator[list]) -> Iterator[list]:
    """The blocks, or an empty one if there is none."""
    first = next(rows, [])
    yield first
    yield from rows


def find_items(
    docs: DataFrame, items: DataFrame, text: str = "text", carry: Sequence[str] = ("doc_id",), item_id: str = "item_id", item_text: str = "text",
    width: int = WINDOW, block_bytes: int = BLOCK_BYTES, into: str = "found",
) -> DataFrame:
    """``carry`` columns and struct ``into``: ``n_words``, ``n_hit``, the positions of the hit words and the sorted item ids.

    A window is ``width`` consecutive words of an item; an item of fewer words is one window. Null texts have no words;
    items with a null text, or without words, are never found; words of items with a null id are hit, but no id is listed;
    repeated items count once. Repeated rows of ``docs`` stay. Texts are searched whole. Without items every text has ``n_hit`` 0.

    The driver holds one block of items. With more than one, what a block found is written before the next is read.
    """
    spark = docs.sparkSession
    frame, partial, shared = docs, None, None
    names = list(carry)
    for block in at_least_one(blocks(items, item_id, item_text, block_bytes)):
        if partial:
            frame = stored(frame, "found")
            shared.destroy()
        shared = spark.sparkContext.broadcast(build_tables(item_windows(block, width)))
        name = ragged.spare_name([*frame.columns, into], "_block")

        def compute(column: pa.Array, shared=shared) -> list[pa.Array]:
            n_words, hits, found = search(column, shared.value)
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (hits, found)]
            return [pa.array(n_words.astype(np.int64)), pa.array([len(h) for h in hits], pa.int64()), *lists]

        kept = list(dict.fromkeys([*names, text, *([partial] if partial else [])]))
        frame = ragged.annotate(frame, text, RESULT, compute, kept, name)
        if partial:
            both = {k: F.array_sort(F.array_union(F.col(f"{partial}.{k}"), F.col(f"{name}.{k}"))) for k in ("hits", "items")}
            merged = F.struct(F.col(f"{name}.n_words"), F.size(both["hits"]).cast("bigint").alias("n_hit"), both["hits"].alias("hits"), both["items"].alias("items"))
            frame = frame.withColumn(name, merged).drop(partial)
        partial = name
    return frame.select(*[f"`{n}`" for n in names], F.col(partial).alias(into))
