"""Removal of byte strings that repeat anywhere in the corpus, by suffix arrays.

Each stretch of ``length`` bytes (a window) is assigned to its core: the substring of ``length - slack + 1`` bytes in it with
the smallest fingerprint, so equal windows have equal cores at equal offsets. Consecutive windows of one core form a segment;
with the core read as a single symbol, a segment is the core and fewer than ``slack`` bytes at either side, and its windows
are exactly its substrings of ``slack`` symbols. Segments meet by core. Equal segments are counted first; the different
ones of a core are concatenated, their suffix array is built by linear grouping, and windows that start suffixes with a
common prefix of ``slack`` symbols repeat.

A first pass with long slack keeps only cores that occur twice, so few texts take part in the second.
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
from gridscore.llm.components import discard, stored
from gridscore.llm.suffix_sorting import suffix_array

#: Bytes hashed at once; longer texts are taken in overlapping blocks.
BLOCK = 1 << 20
#: Symbols of one suffix array, unless a single core needs more.
ARRAY_SYMBOLS = 100_000
#: Different segments of a core up to which they share a suffix array; the windows of other cores are divided by offset.
MOST_VARIANTS = 2_000

_long = lambda name: T.StructField(name, T.LongType(), False)
_int = lambda name: T.StructField(name, T.IntegerType(), False)
ANCHOR = T.StructType([_long("core"), _int("at"), _int("low"), _int("high")])
SEGMENT = T.StructType([*ANCHOR, T.StructField("sides", T.BinaryType(), False)])
REPEATED = T.StructType([_long("segment"), _int("low"), _int("high")])
KEPT = T.StructType([T.StructField("kept", T.BinaryType(), False)])

_inverse_powers = np.ones(1, np.uint64)


def inverse_powers(n: int) -> np.ndarray:
    global _inverse_powers
    if len(_inverse_powers) < n:
        factors = np.full(max(n, 4096), pow(int(ragged._MULTIPLIER), -1, 1 << 64), np.uint64)
        factors[0] = 1
        _inverse_powers = np.multiply.accumulate(factors)
    return _inverse_powers[:n]


def substring_prints(data: np.ndarray, width: int) -> np.ndarray:
    """Fingerprint of the ``width`` bytes from each position."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(ragged._BYTE_CODES[data] * ragged.powers(len(data)), out=total[1:])
    return ragged.mixed((total[width:] - total[:-width]) * inverse_powers(len(data) - width + 1))


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while 2 * done <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    rest = width - done
    return np.minimum(values[:-rest], values[rest:]) if rest else values


@dataclass
class Segments:
    """Per segment: text, fingerprint and position of the core, and the range of its windows' distances before it."""

    row: np.ndarray
    core: np.ndarray
    at: np.ndarray
    low: np.ndarray
    high: np.ndarray


def block_segments(data: np.ndarray, starts: np.ndarray, row: np.ndarray, length: int, slack: int) -> Segments:
    """``starts``: the window starts that count, ascending; ``row``: their texts."""
    prints = substring_prints(data, length - slack + 1)
    bits = np.uint64(max(1, int(len(prints)).bit_length()))
    packed = (prints >> bits << bits) | np.arange(len(prints), dtype=np.uint64)
    best = (sliding_minimum(packed, slack)[starts] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    change = np.append(True, (best[1:] != best[:-1]) | (starts[1:] != starts[:-1] + 1) | (row[1:] != row[:-1]))
    first = np.flatnonzero(change)
    last = np.append(first[1:], len(starts)) - 1
    return Segments(row[first], prints[best[first]].view(np.int64), best[first], best[first] - starts[last], best[first] - starts[first])


def segments(batch: ragged.Texts, length: int, slack: int, wanted: np.ndarray | None = None) -> Segments:
    """Segments of all texts; positions count from the start of the text. ``wanted``: flags of window starts to keep."""
    found: list[Segments] = []
    sizes = np.diff(batch.offsets)

    def take(begin: int, end: int, starts: np.ndarray, row: np.ndarray) -> None:
        if wanted is not None:
            keep = wanted[starts]
            starts, row = starts[keep], row[keep]
        if len(starts):
            s = block_segments(batch.data[begin:end], starts - begin, row, length, slack)
            found.append(Segments(s.row, s.core, s.at + begin - batch.offsets[s.row], s.low, s.high))

    i = 0
    while i < len(batch):
        if sizes[i] > BLOCK:
            for begin in range(int(batch.offsets[i]), int(batch.offsets[i + 1]) - length + 1, BLOCK):
                end = min(begin + BLOCK + length - 1, int(batch.offsets[i + 1]))
                starts = np.arange(begin, end - length + 1)
                take(begin, end, starts, np.full(len(starts), i))
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(batch.offsets, batch.offsets[i] + BLOCK, side="right")) - 1)
        while j > i + 1 and sizes[i:j].max() > BLOCK:
            j -= 1
        count = np.maximum(sizes[i:j] - length + 1, 0)
        row = np.repeat(np.arange(i, j), count)
        starts = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + batch.offsets[row]
        take(int(batch.offsets[i]), int(batch.offsets[j]), starts, row)
        i = j
    if not found:
        none = np.zeros(0, np.int64)
        return Segments(none, none, none, none, none)
    return Segments(*(np.concatenate([getattr(s, name) for s in found]) for name in ("row", "core", "at", "low", "high")))


def anchor_columns(s: Segments) -> list[pa.Array]:
    return [pa.array(s.core), *(pa.array(x.astype(np.int32)) for x in (s.at, s.low, s.high))]


def flagged(batch: ragged.Texts, ranges: pa.Array) -> np.ndarray:
    """Flags of the bytes in each text's ranges (list of structs start, end)."""
    flat, counts = ranges.flatten(), np.diff(ranges.offsets.to_numpy())
    base = np.repeat(batch.offsets[:-1], counts)
    change = np.zeros(len(batch.data) + 1, np.int32)
    np.add.at(change, base + flat.field("start").to_numpy(), 1)
    np.add.at(change, base + flat.field("end").to_numpy(), -1)
    return np.cumsum(change)[:-1] > 0


def compute_anchors(length: int, slack: int):
    def compute(column: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
        s = segments(ragged.texts(column), length, slack)
        return s.row, anchor_columns(s)

    return compute


def compute_segments(length: int, slack: int):
    def compute(column: pa.Array, ranges: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
        batch = ragged.texts(column)
        s = segments(batch, length, slack, flagged(batch, ranges))
        core_bytes = length - slack + 1
        at = batch.offsets[s.row] + s.at if len(s.row) else s.at
        after = slack - 1 - s.low
        sizes = s.high + after
        step = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        left = np.repeat(s.high, sizes)
        where = np.repeat(at - s.high, sizes) + step + np.where(step >= left, core_bytes, 0)
        sides = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(batch.data[where]))])
        return s.row, [*anchor_columns(s), sides]

    return compute


def repeated_windows(cores: Sequence[int], low: Sequence[int], sides: Sequence[bytes], several: Sequence[bool], slack: int) -> np.ndarray:
    """Distances before the core of the windows that repeat, as rows (segment, distance).

    ``several`` marks segments that occur at more than one place. Segments of one core are adjacent; a core's only segment
    is a single symbol here, as its windows have nothing to meet but each other's copies.
    """
    symbols: list[int] = []
    starts, owners, distances = [], [], []
    core_number = 257
    for i, (core, least, text) in enumerate(zip(cores, low, sides)):
        core_number += i > 0 and core != cores[i - 1]
        high = len(text) - (slack - 1 - least)
        alone = (i == 0 or cores[i - 1] != core) and (i + 1 == len(cores) or cores[i + 1] != core)
        if alone:
            starts.append(len(symbols))
            owners.append(i)
            distances.append(-1)
            symbols += [core_number, 1]
            continue
        base = len(symbols)
        starts += range(base, base + high - least + 1)
        owners += [i] * (high - least + 1)
        distances += range(high, least - 1, -1)
        symbols += [b + 2 for b in text[:high]]
        symbols.append(core_number)
        symbols += [b + 2 for b in text[high:]]
        symbols.append(1)
    symbols.append(0)
    order = np.array(suffix_array(symbols))
    window = np.full(len(symbols), -1)
    window[starts] = np.arange(len(starts))
    sorted_windows = window[order]
    sorted_windows = sorted_windows[sorted_windows >= 0]
    at = np.array(starts)[sorted_windows]
    text = np.array(symbols + [0] * slack)
    same = np.ones(max(0, len(at) - 1), bool)
    for k in range(slack):  # common prefix of neighbours, up to slack symbols
        pair = np.flatnonzero(same)
        if not len(pair):
            break
        same[pair] = text[at[pair] + k] == text[at[pair + 1] + k]
    owner = np.array(owners)[sorted_windows]
    repeats = np.array(several, bool)[owner]
    class_ = np.cumsum(np.append(0, ~same)) if len(at) else np.zeros(0, np.int64)
    full = np.array(distances)[sorted_windows] >= 0
    counts = np.bincount(class_[full], minlength=int(class_.max(initial=0)) + 1) if len(at) else np.zeros(1)
    shared = np.zeros(len(counts), bool)
    np.logical_or.at(shared, class_, repeats)
    hit = repeats | (full & (counts[class_] > 1)) | (full & shared[class_])
    return np.stack([owner[hit], np.array(distances)[sorted_windows][hit]], 1)


def sort_segments(batches: Iterator[pa.RecordBatch], slack: int) -> Iterator[pa.RecordBatch]:
    """Rows (core, low, sides, several, segment) ordered by core to ``REPEATED`` rows."""
    held: list[tuple] = []
    size = 0

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        found = repeated_windows([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows], slack)
        out: list[tuple] = []
        by_owner: dict[int, list[int]] = {}
        for owner, distance in found.tolist():
            by_owner.setdefault(owner, []).append(distance)
        for owner, hits in by_owner.items():
            _, low, sides, _, name = rows[owner]
            if hits[0] < 0:
                out.append((name, low, len(sides) - (slack - 1 - low)))
                continue
            hits.sort()
            begin = before = hits[0]
            for d in [*hits[1:], None]:
                if d is None or d != before + 1:
                    out.append((name, begin, before))
                    begin = d
                before = d
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.int64(), pa.int32(), pa.int32()))], REPEATED.names)

    for batch in batches:
        rows = list(zip(*(column.to_pylist() for column in batch.columns)))
        for row in rows:
            if size > ARRAY_SYMBOLS and row[0] != held[-1][0]:
                yield solve(held)
                held, size = [], 0
            held.append(row)
            size += len(row[2]) + 2
    if held:
        yield solve(held)


def divided(variants: DataFrame, slack: int) -> DataFrame:
    """``REPEATED`` rows of cores with very many different segments: windows of equal offset are grouped by their bytes.

    A core in very many contexts would make one suffix array grow with the corpus; the offset and the bytes beside the core
    divide it into groups that are only counted.
    """
    high = F.octet_length("sides") - (slack - 1 - F.col("low"))
    windows = variants.select("core", "segment", "several", "sides", high.alias("high"), F.explode(F.sequence("low", high)).alias("d"))
    windows = windows.withColumn("bytes", F.substring("sides", F.col("high") - F.col("d") + 1, F.lit(slack - 1)))
    groups = windows.groupBy("core", "d", "bytes").agg(F.count("*").alias("n"), F.max("several").alias("shared")).where("n > 1 or shared")
    hits = windows.join(stored(groups, "groups"), ["core", "d", "bytes"])
    return hits.select("segment", F.col("d").cast("int").alias("low"), F.col("d").cast("int").alias("high"))


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 400) -> tuple[DataFrame, DataFrame]:
    """``(rows, texts)``: rows of ``docs`` as ``doc_id``, ``n_bytes``, ``text_key``, ``sha256``; and for each distinct text that
    repeats anything, its ``text_key``, its ``text`` and the ``spans`` (ascending, maximal) of the bytes to remove.

    Texts are UTF-8 bytes, null is empty; strings never cross texts. A byte is removed if a string of ``length`` bytes
    that also starts elsewhere covers it, overlaps included. Equal texts are handled once; those of ``length`` bytes or more
    with copies are removed whole. Ids may be null or repeat: rows are told apart by id and text.
    """
    coarse, fine = length // 2, min(64, length // 4)
    content = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    source = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), content.alias("text"), F.unhex(F.substring(F.sha2(content, 256), 1, 32)).alias("text_key"))
    rows = stored(source.select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), "text_key", F.sha2("text", 256).alias("sha256")), "texts")
    long = source.where(F.octet_length("text") >= length)
    place = lambda at: F.xxhash64("text_key", at)

    # Windows that can repeat at all: those whose long-slack core occurs at two places.
    anchors = stored(ragged.expand(long, "text", ANCHOR, compute_anchors(length, coarse), ["text_key"]), "anchors")
    twice = anchors.groupBy("core").agg(F.min(place("at")).alias("p"), F.max(place("at")).alias("q")).where("p <> q").select("core")
    twice = stored(twice, "cores")
    near = anchors.join(twice, "core")
    starts = F.struct((F.col("at") - F.col("high")).alias("start"), (F.col("at") - F.col("low") + 1).alias("end"))
    open_ = near.groupBy("text_key").agg(F.collect_set(starts).alias("ranges"))
    ids = rows.where(F.col("n_bytes") >= length).groupBy("text_key", "doc_id").agg(F.count("*").alias("n"))
    first = ids.groupBy("text_key").agg(F.min("doc_id").alias("first_id"), F.sum("n").alias("copies"), F.max("n").alias("same_id"))
    chosen = first.join(open_, "text_key", "left").where("copies > 1 or ranges is not null")
    none = F.array().cast("array<struct<start:int,end:int>>")
    chosen = stored(chosen.select(F.col("text_key").alias("k"), "first_id", "copies", "same_id", F.coalesce("ranges", none).alias("ranges")), "open")
    taken = long.join(chosen, (F.col("text_key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("first_id"))).drop("k", "first_id", "doc_id", "same_id")
    taken = stored(taken, "candidates")
    if not chosen.where("same_id > 1").isEmpty():  # rows that repeat id and text: each text is still taken once
        taken = stored(taken.dropDuplicates(["text_key"]), "candidates")
    discard(anchors, twice, chosen)

    found = ragged.expand(taken, "text", SEGMENT, compute_segments(length, fine), ["text_key"], ["ranges"])
    named = found.withColumn("segment", F.xxhash64("core", "low", "sides"))
    counted = named.groupBy("core", "low", "sides", "segment").agg(F.min(place("at")).alias("p"), F.max(place("at")).alias("q"))
    variants = stored(counted.select("core", "low", "sides", (F.col("p") != F.col("q")).alias("several"), "segment"), "segments")
    crowded = stored(variants.groupBy("core").agg(F.count("*").alias("n")).where(F.col("n") > MOST_VARIANTS).select("core"), "crowded")
    sorted_ = variants.join(crowded, "core", "left_anti").repartition("core").sortWithinPartitions("core").select("core", "low", "sides", "several", "segment")
    repeated = sorted_.mapInArrow(lambda batches: sort_segments(batches, fine), REPEATED).union(divided(variants.join(crowded, "core", "left_semi"), fine))
    repeated = stored(repeated.select("segment", F.col("low").alias("l"), F.col("high").alias("h")), "repeated")
    discard(variants, crowded)

    span = F.struct((F.col("at") - F.col("h")).alias("start"), (F.col("at") - F.col("l") + length).alias("end"))
    spans = named.select("text_key", "at", "segment").join(repeated, "segment").groupBy("text_key").agg(F.collect_set(span).alias("spans"))
    spans = spans.select(F.col("text_key").alias("k"), merged("spans").alias("spans"))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.octet_length("text").alias("end")))
    joined = taken.join(spans, F.col("text_key") == F.col("k"), "left")
    texts = joined.select("text_key", "text", F.when(F.col("copies") > 1, whole).otherwise(F.col("spans")).alias("spans")).where("spans is not null")
    texts = stored(texts, "repeating")
    discard(taken, repeated)
    return rows, texts


def merged(name: str):
    """Maximal ranges that cover the same bytes as the ranges of a list column."""
    last = lambda acc: F.element_at(acc, -1)
    joined = lambda acc, r: F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last(acc).start.alias("start"), F.greatest(last(acc).end, r.end).alias("end"))))
    empty = F.array().cast("array<struct<start:int,end:int>>")
    return F.aggregate(F.array_sort(name), empty, lambda acc, r: F.when((F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1).end >= r.start), joined(acc, r)).otherwise(F.concat(acc, F.array(r))))


def cut(text: bytes, spans: Sequence[tuple[int, int]], whole_characters: bool = False) -> bytes:
    """``text`` without ``spans``; with ``whole_characters`` a character that is only partly in a span stays."""
    parts, at = [], 0
    for start, end in spans:
        if whole_characters:
            while start < end and 0x80 <= text[start] < 0xC0:
                start += 1
            while start < end < len(text) and 0x80 <= text[end] < 0xC0:
                end -= 1
        parts.append(text[at:start])
        at = end
    return b"".join([*parts, text[at:]])


def compute_kept(column: pa.Array, spans: pa.Array, whole_characters: bool = False) -> list[pa.Array]:
    ranges = [[(s["start"], s["end"]) for s in row or ()] for row in spans.to_pylist()]
    return [pa.array([cut(t, r, whole_characters) for t, r in zip(column.cast(pa.binary()).to_pylist(), ranges)], pa.binary())]
