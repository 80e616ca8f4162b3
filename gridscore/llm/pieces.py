"""SentencePiece encoding and decoding by matching all pieces against a suffix array of a batch.

The distinct words of a batch (with the blanks before them) are concatenated and their suffixes sorted as deep as the longest
piece. A binary search finds the range of suffixes that start with each piece; the ranges are the edges of a lattice,
sorted by position. Relaxing an edge asks whether its piece may follow the piece that ends where it starts: in a merge vocabulary
exactly one segmentation of every prefix has only pairs of neighbours that merging would leave apart, and it is the one that
merging gives.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2 as model_format

from gridscore.llm import ragged

# The letter that stands for a blank in pieces; kinds of pieces.
BLANK = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6

#: Bytes of texts whose words are made distinct together, and of distinct words whose suffixes are sorted together: an edge takes about
#: 100 bytes, and several end at each byte.
TEXT_BYTES = 1 << 21
WORD_BYTES = 1 << 18

RESULT = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType(), False), False), T.StructField("n_byte_pieces", T.LongType(), False)])
_NEVER = np.int64(1 << 40)


@dataclass
class Vocabulary:
    """Pieces as bytes, a blank for each blank letter. ``time``: when merging makes the piece (-1: a character); ``left`` and
    ``right``: what it is made of (itself if a character). The id after the last stands for any unknown character."""

    surface: list[bytes]
    time: np.ndarray
    left: np.ndarray
    right: np.ndarray
    pair_codes: np.ndarray
    pair_times: np.ndarray
    byte_ids: np.ndarray
    sorted_ids: np.ndarray  # pieces that can be a result of merging, in order of their bytes
    prefix: bool

    def __post_init__(self) -> None:
        self.sizes = np.array([*map(len, self.surface), 0])
        self.sorted_pieces = [self.surface[i] for i in self.sorted_ids]


@lru_cache(maxsize=2)
def load_vocabulary(path: str) -> Vocabulary:
    model = model_format.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    normal = model.normalizer_spec
    if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or normal.precompiled_charsmap or normal.remove_extra_whitespaces or not normal.escape_whitespaces:
        raise ValueError(f"{path} is no merge vocabulary with byte pieces and unchanged texts")
    if any(p.type not in (NORMAL, UNKNOWN, CONTROL, BYTE) for p in model.pieces):
        raise ValueError(f"{path} has user-defined or unused pieces")
    n = len(model.pieces)
    words = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
    if any(BLANK in w.lstrip(BLANK) for w in words):
        raise ValueError(f"{path} has pieces with a blank after a letter")
    by_score = sorted((i for w, i in words.items() if len(w) > 1), key=lambda i: (-model.pieces[i].score, i))
    time = np.full(n + 1, -1, np.int64)
    time[by_score] = np.arange(len(by_score))
    left, right = np.arange(n + 1), np.arange(n + 1)
    pairs: dict[tuple[int, int], int] = {}
    for word, i in words.items():
        for k in range(1, len(word)):
            a, b = words.get(word[:k]), words.get(word[k:])
            if a is not None and b is not None:
                pairs[a, b] = i
    moment = time.tolist()
    usable = []
    for word, i in words.items():
        parts = [words.get(c, n) for c in word]
        last = None
        while len(parts) > 1:
            best = min(((moment[m], k) for k in range(len(parts) - 1) if (m := pairs.get((parts[k], parts[k + 1]))) is not None), default=None)
            if best is None:
                break
            k = best[1]
            last = (parts[k], parts[k + 1])
            parts[k : k + 2] = [pairs[last]]
        if parts == [i]:
            usable.append(i)
            if last:
                left[i], right[i] = last
    codes = np.array([(a << 32) | b for a, b in pairs], np.int64)
    order = np.argsort(codes)
    surface = [b""] * n
    byte_ids = np.zeros(256, np.int32)
    for i, p in enumerate(model.pieces):
        if p.type == NORMAL:
            surface[i] = p.piece.replace(BLANK, " ").encode()
        elif p.type == BYTE:
            value = int(p.piece[3:5], 16)
            surface[i], byte_ids[value] = bytes([value]), i
        elif p.type == UNKNOWN:
            surface[i] = model.trainer_spec.unk_surface.encode()
    return Vocabulary(
        surface, time, left, right, codes[order], time[np.array(list(pairs.values()))][order], byte_ids,
        np.array(sorted(usable, key=lambda i: surface[i])), normal.add_dummy_prefix,
    )


def stay_apart(vocabulary: Vocabulary, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether merging the text of piece ``a`` followed by that of ``b`` leaves just these two pieces.

    Both are taken apart again, the one made last first; they would not stay if the parts next to the border had a merge that
    comes before the merges that consumed them. Of equal merges the left one comes first.
    """
    apart = np.ones(len(a), bool)
    active = np.arange(len(a))
    limit = np.full(len(a), _NEVER)
    last = len(vocabulary.pair_codes) - 1
    while len(active):
        code = (a << 32) | b
        slot = np.minimum(np.searchsorted(vocabulary.pair_codes, code), last)
        joins = (vocabulary.pair_codes[slot] == code) & (vocabulary.pair_times[slot] < limit)
        apart[active[joins]] = False
        ta, tb = vocabulary.time[a], vocabulary.time[b]
        go = ~joins & ((ta >= 0) | (tb >= 0))
        active, a, b, ta, tb = active[go], a[go], b[go], ta[go], tb[go]
        split_left = ta > tb
        limit = np.where(split_left, ta, tb + 1)
        a, b = np.where(split_left, vocabulary.right[a], a), np.where(split_left, b, vocabulary.left[b])
    return apart


def big_endian_words(text: np.ndarray, rest: np.ndarray, depth: int) -> list[np.ndarray]:
    """``depth`` arrays: the 8 bytes from each position, from 8 further on, … as numbers that sort like the bytes. Bytes
    beyond the ``rest`` of a position's word are zero."""
    padded = np.concatenate([text, np.zeros(8 * depth + 8, np.uint8)])
    view = np.ndarray((len(text) + 8 * depth,), ">u8", padded, strides=(1,)).astype(np.uint64)
    keep = np.array([0, *((1 << 64) - (1 << 64 - 8 * n) for n in range(1, 9))], np.uint64)
    return [view[8 * k : 8 * k + len(text)] & keep[np.clip(rest - 8 * k, 0, 8)] for k in range(depth)]


def suffix_order(words: list[np.ndarray]) -> np.ndarray:
    """Positions in the order of their suffixes. Only where the first 8 bytes are equal and go on, the others are looked at."""
    order = np.argsort(words[0], kind="stable")
    first = words[0][order]
    starts = np.flatnonzero(np.append(True, first[1:] != first[:-1]))
    sizes = np.diff(np.append(starts, len(order)))
    longer = words[1][order] if len(words) > 1 else np.zeros(len(order), np.uint64)
    tied = np.flatnonzero(np.repeat((sizes > 1) & (np.maximum.reduceat(longer, starts) > 0), sizes))
    run = np.repeat(np.arange(len(starts)), sizes)[tied]
    among = order[tied]
    order[tied] = among[np.lexsort([*(w[among] for w in words[:0:-1]), run])]
    return order


def matches(text: np.ndarray, pieces: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Positions and numbers of all occurrences of ``pieces`` in ``text``, whose words are separated by a byte 255 that no
    piece contains."""
    depth = max(1, -(-max(map(len, pieces)) // 8))
    ends = np.flatnonzero(text == 255)
    stop = np.append(ends, len(text))[np.searchsorted(ends, np.arange(len(text)))]
    words = big_endian_words(text, stop - np.arange(len(text)), depth)
    order = suffix_order(words)
    words = [w[order] for w in words]
    lengths = np.array([len(p) for p in pieces])
    low = np.frombuffer(b"".join(p.ljust(8 * depth, b"\0") for p in pieces), np.uint8).reshape(len(pieces), 8 * depth)
    high = np.where(np.arange(8 * depth) < lengths[:, None], low, 255).astype(np.uint8)
    first, stop = (bounds(words, np.ascontiguousarray(x).view(">u8").astype(np.uint64), upper) for x, upper in ((low, False), (high, True)))
    counts = stop - first
    number = np.repeat(np.arange(len(pieces)), counts)
    place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first, counts)
    return order[place], number


def bounds(words: list[np.ndarray], targets: np.ndarray, upper: bool) -> np.ndarray:
    """For each target the first suffix not below it, or the first above it."""
    low = np.searchsorted(words[0], targets[:, 0], side="left")
    high = np.searchsorted(words[0], targets[:, 0], side="right")
    for depth in range(1, len(words)):  # narrow to the suffixes that equal the words so far
        column, target = words[depth], targets[:, depth]
        low, high = within(column, target, low, high, False), within(column, target, low, high, True)
    return high if upper else low


def within(column: np.ndarray, target: np.ndarray, low: np.ndarray, high: np.ndarray, right: bool) -> np.ndarray:
    """Binary search of every target in its own stretch of ``column``."""
    low, high = low.copy(), high.copy()
    while (open_ := np.flatnonzero(low < high)).size:
        mid = (low[open_] + high[open_]) // 2
        below = column[mid] <= target[open_] if right else column[mid] < target[open_]
        low[open_[below]] = mid[below] + 1
        high[open_[~below]] = mid[~below]
    return low


def segment(words: Sequence[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all words in order, unknown characters as their bytes; number of ids of each word."""
    unknown = len(vocabulary.surface)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    text = np.frombuffer(b"\xff".join(words) + b"\xff", np.uint8)  # a byte that is in no text
    base = np.cumsum(lengths + 1) - lengths - 1
    at, number = matches(text, vocabulary.sorted_pieces)
    size = vocabulary.sizes[vocabulary.sorted_ids][number]
    piece = vocabulary.sorted_ids[number]

    starts = np.flatnonzero(((text & 0xC0) != 0x80) & (text != 0xFF))
    width = np.select([text[starts] < 0x80, text[starts] < 0xE0, text[starts] < 0xF0], [1, 2, 3], 4)
    known = np.zeros(len(text), np.uint8)
    single = np.flatnonzero(vocabulary.time[piece] < 0)
    known[at[single]] = 1
    missing = known[starts] == 0
    at, piece, size = (np.concatenate(x) for x in ((at, starts[missing]), (piece, np.full(missing.sum(), unknown)), (size, width[missing])))

    word = np.repeat(np.arange(len(words)), lengths + 1)
    rank = at + size - base[word[at]]  # how far into its word an edge ends
    order = np.argsort(rank.astype(np.int16) if rank.max(initial=0) < 1 << 15 else rank, kind="stable")
    at, piece, size, rank = at[order], piece[order], size[order], rank[order]
    before = np.full(len(text) + 1, -1, np.int64)  # the piece that ends at a position
    wave = np.flatnonzero(np.append(True, rank[1:] != rank[:-1])) if len(rank) else np.zeros(0, np.int64)
    begins = np.zeros(len(text) + 1, bool)
    begins[base] = True
    for i, j in zip(wave.tolist(), np.append(wave[1:], len(rank)).tolist()):
        a, p, stop = at[i:j], piece[i:j], at[i:j] + size[i:j]
        # The position before a word is the separator's, so a word's first position never ends a piece.
        free = begins[a]
        before[stop[free]] = p[free]
        linked = np.flatnonzero(~free & (before[a] >= 0))
        if len(linked):
            good = linked[stay_apart(vocabulary, before[a[linked]], p[linked])]
            before[stop[good]] = p[good]

    sizes = vocabulary.sizes
    owner, position = np.arange(len(words)), base + lengths
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    keep = lengths > 0
    owner, position = owner[keep], position[keep]
    while len(owner):
        ids = before[position]
        if (ids < 0).any():
            raise AssertionError("a word has no segmentation")
        step = sizes[ids]
        odd = np.flatnonzero(ids == unknown)
        for k in odd:  # back to the start of the unknown character
            back = position[k] - 1
            while text[back] & 0xC0 == 0x80:
                back -= 1
            step[k] = position[k] - back
        found.append((owner, position - step, ids))
        position = position - step
        more = position > base[owner]
        owner, position = owner[more], position[more]
    if not found:
        return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
    owner, position, ids = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(position)
    owner, position, ids = owner[order], position[order], ids[order]
    wide = ids == unknown
    repeat = np.ones(len(ids), np.int64)
    repeat[wide] = np.append(position[1:], 0)[wide] - position[wide]
    if wide.any():
        lead = text[position[wide]]
        repeat[wide] = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0], [1, 2, 3], 4)
    flat = np.repeat(ids, repeat).astype(np.int32)
    step = np.arange(len(flat)) - np.repeat(np.cumsum(repeat) - repeat, repeat)
    raw = np.repeat(wide, repeat)
    flat[raw] = vocabulary.byte_ids[text[(np.repeat(position, repeat) + step)[raw]]]
    return flat, np.bincount(np.repeat(owner, repeat), minlength=len(words))


def encode(column: pa.Array, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in order and offsets of the texts in them. Null is empty; an empty text has no ids."""
    column = pc.replace_substring(pc.fill_null(column, ""), BLANK, " ")
    if vocabulary.prefix:
        column = pc.if_else(pc.equal(pc.binary_length(column), 0), column, pc.binary_join_element_wise(pa.scalar(""), column, " "))
    batch = ragged.texts(column)
    data, n = batch.data, len(batch.data)
    if not n:
        return np.zeros(0, np.int32), np.zeros(len(batch) + 1, np.int64)
    blank = data == 32
    cut = blank.copy()
    cut[1:] &= ~blank[:-1]
    cut[batch.offsets[batch.offsets < n]] = True
    starts = np.flatnonzero(cut)
    ranges = ragged.Ranges(starts, np.append(starts[1:], n), np.searchsorted(starts, batch.offsets))
    _, index, inverse = np.unique(ragged.fingerprints(data, ranges), return_index=True, return_inverse=True)
    begins, ends = starts[index], ranges.ends[index]
    group = np.cumsum(ends - begins) // WORD_BYTES
    firsts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    parts = []
    for i, j in zip(firsts.tolist(), np.append(firsts[1:], len(index)).tolist()):
        parts.append(segment([data[a:b].tobytes() for a, b in zip(begins[i:j].tolist(), ends[i:j].tolist())], vocabulary))
    ids, counts = (np.concatenate(x) for x in zip(*parts))
    begin = np.cumsum(counts) - counts
    sizes = counts[inverse]
    total = np.append(0, np.cumsum(sizes))
    place = np.arange(total[-1]) - np.repeat(total[:-1], sizes) + np.repeat(begin[inverse], sizes)
    return ids[place], total[ranges.first]


def encoded(docs: DataFrame, path: str, text: str = "text", carry: Sequence[str] = ("doc_id",), into: str = "encoded", decoded: bool = False) -> DataFrame:
    """``carry`` columns and struct ``into``: piece ``ids`` of each whole text and how many are byte pieces; with
    ``decoded`` also the text that the ids decode to, in the same pass.

    ``path``: a merge vocabulary with byte pieces, on every machine. Null and empty texts have no ids; repeated rows stay.
    Equal to the ``sentencepiece`` library without begin and end tokens.
    """

    def compute(column: pa.Array) -> list[pa.Array]:
        vocabulary = load_vocabulary(path)
        ids, offsets = encode(column, vocabulary)
        is_byte = np.zeros(len(vocabulary.surface), bool)
        is_byte[vocabulary.byte_ids] = True
        total = np.append(0, np.cumsum(is_byte[ids]))
        lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
        back = [pa.array(decode(lists, vocabulary), pa.string())] if decoded else []
        return [lists, pa.array(total[offsets[1:]] - total[offsets[:-1]]), *back]

    result = T.StructType([*RESULT, *([T.StructField("decoded", T.StringType(), False)] if decoded else [])])
    return ragged.annotate(docs, text, result, compute, carry, into, limit=TEXT_BYTES)


def decode(ids: pa.ListArray, vocabulary: Vocabulary) -> list[str]:
    """Texts of lists of ids: pieces joined, without the added first blank; bytes that are no UTF-8 become U+FFFD."""
    surface = pa.array(vocabulary.surface, pa.binary())
    sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
    offsets = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
    texts = pc.binary_join(pa.ListArray.from_arrays(offsets, surface.take(ids.flatten())), b"").to_pylist()
    if vocabulary.prefix:
        texts = [t[1:] if t[:1] == b" " else t for t in texts]
    return [t.decode("utf-8", "replace") for t in texts]


def with_decoded(frame: DataFrame, path: str, ids: str, into: str = "decoded") -> DataFrame:
    """Add column ``into``: the text of the list column ``ids``; a null list is an empty text."""
    out = T.StructType([*frame.schema, T.StructField(into, T.StringType(), False)])
    at = frame.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load_vocabulary(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = pa.array(decode(part.column(at), vocabulary), pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], [*part.schema.names, into])

    return frame.mapInArrow(run, out)
