"""Texts of an Arrow batch as flat numpy arrays: bytes, words, lines and their fingerprints.

A batch of texts is one byte array plus row offsets, so splitting into words and hashing them are a few array passes
per batch, not one Python step per word. Fingerprints have 64 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Texts handled at once, so that a worker's arrays stay bounded; a longer text is handled alone.
PIECE_BYTES = 4 << 20

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_BYTE_CODES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first ``n`` powers of the multiplier modulo 2**64."""
    global _powers
    if len(_powers) < n:
        factors = np.full(max(n, 2 * len(_powers), 4096), _MULTIPLIER, np.uint64)
        factors[0] = 1
        _powers = np.multiply.accumulate(factors)
    return _powers[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits (a bijection)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Texts:
    """``data[offsets[i]:offsets[i + 1]]`` are the UTF-8 bytes of text ``i``; a null text is empty."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def sums(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each text are flagged."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


def texts(column: pa.Array | pa.ChunkedArray) -> Texts:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return Texts(data, offsets - offsets[0])


@dataclass
class Ranges:
    """Byte ranges ``starts[j]:ends[j]`` in text order; ``first[i]:first[i + 1]`` are those of text ``i``."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def runs(batch: Texts, inside: np.ndarray) -> Ranges:
    """Maximal runs of bytes with ``inside[byte]`` that do not cross texts."""
    flags = inside[batch.data]
    if not flags.any():
        none = np.zeros(0, np.int64)
        return Ranges(none, none, np.zeros(len(batch) + 1, np.int64))
    borders = batch.offsets[(batch.offsets > 0) & (batch.offsets < len(flags))]
    begins = flags.copy()
    begins[1:] &= ~flags[:-1]
    begins[borders] = flags[borders]
    stops = flags.copy()
    stops[:-1] &= ~flags[1:]
    stops[borders - 1] = flags[borders - 1]
    starts = np.flatnonzero(begins)
    return Ranges(starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, batch.offsets))


def lines(batch: Texts) -> Ranges:
    """Non-empty lines, cut at line feeds."""
    inside = np.ones(256, bool)
    inside[10] = False
    return runs(batch, inside)


def fingerprints(data: np.ndarray, ranges: Ranges) -> np.ndarray:
    """A 64-bit fingerprint of the bytes of each (non-empty) range."""
    lengths = ranges.ends - ranges.starts
    if not len(lengths):
        return np.zeros(0, np.uint64)
    begins = np.cumsum(lengths) - lengths
    step = np.arange(lengths.sum()) - np.repeat(begins, lengths)
    terms = powers(int(lengths.max()))[step]
    terms *= _BYTE_CODES[data[step + np.repeat(ranges.starts, lengths)]]
    return mixed(np.add.reduceat(terms, begins) + lengths.astype(np.uint64))


def window_prints(words: np.ndarray, width: int) -> np.ndarray:
    """Fingerprint of every ``width`` consecutive words; entry ``j`` starts at word ``j``."""
    n = max(0, len(words) - width + 1)
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = h * _MULTIPLIER + words[k : k + n]
    return mixed(h)


def whole_windows(first: np.ndarray, width: int) -> np.ndarray:
    """Indices of the windows of ``width`` words that lie within one text."""
    n = max(0, int(first[-1]) - width + 1)
    good = np.ones(n, bool)
    bad = np.zeros(int(first[-1]) + 1, np.int64)
    for stop in (first[1:-1],):  # a window crosses a border if it starts in the last width-1 words before it
        np.add.at(bad, np.maximum(stop - width + 1, 0), 1)
        np.add.at(bad, stop, -1)
    good &= np.cumsum(bad)[:n] == 0
    return np.flatnonzero(good)


def flag_table(pattern_bytes: Sequence[int]) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(pattern_bytes)] = True
    return table


#: Bytes of words cut at ASCII white space (space, tab, line feed, vertical tab, form feed, carriage return).
SPACED_WORD = ~flag_table([0x20, *range(0x09, 0x0E)])
#: Bytes of words of ASCII digits, lower-case letters and everything beyond ASCII, once A-Z are lower-case.
PLAIN_WORD = flag_table([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of each piece have at most ``limit`` bytes, or are a single text."""
    ends = texts(batch.column(column)).offsets[1:]
    start = 0
    while start < len(ends):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def spare_name(taken: Sequence[str], name: str) -> str:
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name += "_"
    return name


def annotate(
    docs: DataFrame, column: str, result: T.StructType, compute: Callable[..., list[pa.Array]], carry: Sequence[str], into: str, also: Sequence[str] = (),
    limit: int = PIECE_BYTES,
) -> DataFrame:
    """Columns ``carry`` of ``docs`` and a struct ``into`` that ``compute`` gives for the texts in ``column`` (and the columns
    ``also``), ``limit`` bytes of texts at once. No shuffle."""
    schema = T.StructType([*(docs.schema[name] for name in carry), T.StructField(into, result, False)])
    names, fields = list(carry), [field.name for field in result]
    frame = docs.select(*[docs[f"`{name}`"] for name in dict.fromkeys([*names, column, *also])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, column, limit):
                made = pa.StructArray.from_arrays(compute(*(piece.column(name) for name in (column, *also))), fields)
                yield pa.RecordBatch.from_arrays([*(piece.column(name) for name in names), made], [*names, into])

    return frame.mapInArrow(run, schema)


def expand(
    docs: DataFrame, column: str, result: T.StructType, compute: Callable[..., tuple[np.ndarray, list[pa.Array]]], carry: Sequence[str], also: Sequence[str] = (),
) -> DataFrame:
    """Any number of rows per text: ``compute`` gives the text's index in the batch for each row, and the columns of ``result``."""
    schema = T.StructType([*(docs.schema[name] for name in carry), *result])
    frame = docs.select(*[docs[f"`{name}`"] for name in dict.fromkeys([*carry, column, *also])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, column):
                rows, made = compute(*(piece.column(name) for name in (column, *also)))
                taken = pa.array(rows)
                yield pa.RecordBatch.from_arrays([*(piece.column(name).take(taken) for name in carry), *made], schema.names)

    return frame.mapInArrow(run, schema)
