"""A hidden Markov language model over words, trained by Baum-Welch counts that Spark adds up.

A state emits a word class, and the class its word: classes are given by word endings, so the tables that training sends
around have a fixed size, while word counts stay a distributed table of the size of the vocabulary. Texts are first
encoded as blocks: word numbers within the block and the block's own sorted word list. A list is cut into pieces by ranges of
fingerprints, a range is counted over all blocks at once, and its counts go back to the blocks as pieces. Lists, pieces and word
numbers travel as bytes, few rows at a time, so that no task holds more than a few blocks or a range.

Sequences are handled in stretches: the product of the step matrices of every stretch is formed for all stretches at once,
the scaled forward and backward vectors run over the stretches of a text, and from their values at the borders the
expected counts within all stretches follow at once. Likelihoods are those of the whole sequence.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridscore.llm import ragged
from gridscore.llm.components import discard, stored

#: Bytes of text of one block, unless a single text is longer.
BLOCK_BYTES = 1 << 20
#: Texts or blocks that Spark reads at once, and bytes of them that it hands to a worker at once.
TEXTS_TOGETHER, BLOCKS_TOGETHER, BYTES_TOGETHER = 1000, 8, 8 << 20
#: Words of all lists of blocks that lie in one range of fingerprints.
RANGE_WORDS = 1 << 20
#: Tokens whose states are worked out at once.
PART_TOKENS = 200_000
STRETCH = 64
ENDING = 3  # bytes of a word that give its class
DISCOUNT = 0.75
HELD_OUT = (7, 2)  # a text is held out if its id's checksum leaves this remainder

_bytes = lambda name: T.StructField(name, T.BinaryType())
BLOCKS = T.StructType([
    T.StructField("block", T.LongType(), False),
    T.StructField("doc_ids", T.ArrayType(T.LongType())),
    T.StructField("held_out", T.ArrayType(T.BooleanType(), False)),
    T.StructField("sizes", T.ArrayType(T.IntegerType(), False)),  # words of each text
    _bytes("tokens"),  # numbers in the block's word list, of as few bytes as the longest needs
    _bytes("words"),  # fingerprints, ascending, of 8 bytes
    _bytes("classes"),  # of the words, 4 bytes each, as the next
    _bytes("counts"),  # in training texts of the block
])
PIECES = T.StructType([T.StructField("block", T.LongType(), False), T.StructField("range", T.IntegerType(), False), _bytes("words"), _bytes("classes"), _bytes("counts")])
#: Training counts of the words of a piece (8 bytes each), or what a range adds to a class.
KNOWN = T.StructType([
    T.StructField("block", T.LongType()), T.StructField("range", T.IntegerType()), _bytes("known"),
    T.StructField("class", T.IntegerType()), T.StructField("class_tokens", T.LongType()), T.StructField("class_words", T.LongType()),
])
SCORES = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("held_out", T.BooleanType(), False),
    T.StructField("n_tokens", T.LongType(), False),
    T.StructField("n_known", T.LongType(), False),
    T.StructField("train_tokens", T.LongType(), False),
    T.StructField("base_score", T.DoubleType(), False),
    T.StructField("score", T.DoubleType(), False),
])


@dataclass(frozen=True)
class Settings:
    states: int = 8
    classes: int = 4096  # class 0 is the end of a text
    rounds: int = 4
    seed: int = 11


@dataclass
class Model:
    """``start`` (states), ``step`` (states x states), ``emit`` (states x classes), and how words share their class."""

    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray
    class_tokens: np.ndarray
    class_words: np.ndarray
    tokens: int
    words: int


def word_classes(batch: ragged.Texts, words: ragged.Ranges, classes: int) -> np.ndarray:
    code = np.zeros(len(words.starts), np.uint64)
    for k in range(1, ENDING + 1):
        at = words.ends - k
        inside = at >= words.starts
        code = code * np.uint64(257) + np.where(inside, batch.data[np.maximum(at, 0)].astype(np.uint64) + np.uint64(1), np.uint64(0))
    return (ragged.mixed(code) % np.uint64(classes - 1)).astype(np.int64) + 1


def encode_block(ids: pa.Array, held: pa.Array, column: pa.Array, classes: int) -> list[pa.Array]:
    batch = ragged.texts(column)
    batch = ragged.Texts(ragged.LOWER[batch.data], batch.offsets)
    words = ragged.runs(batch, ragged.SPACED_WORD)
    unique, index, tokens = np.unique(ragged.fingerprints(batch.data, words), return_index=True, return_inverse=True)
    sizes = np.diff(words.first)
    training = np.repeat(~held.to_numpy(zero_copy_only=False), sizes)
    counts = np.bincount(tokens[training], minlength=len(unique))
    kinds = word_classes(batch, words, classes)[index]
    one = lambda values, kind: pa.array([values], pa.list_(kind))
    raw = lambda values, kind: pa.array([values.astype(kind).tobytes()], pa.binary())
    return [
        pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([held.to_pylist()], pa.list_(pa.bool_())), one(sizes.astype(np.int32), pa.int32()),
        raw(tokens, np.min_scalar_type(len(unique))), raw(unique, np.uint64), raw(kinds, np.int32), raw(counts, np.int32),
    ]


def unpacked(raw: bytes, n: int) -> np.ndarray:
    """``n`` whole numbers that take all of ``raw``."""
    return np.frombuffer(raw, f"u{len(raw) // n}") if n else np.zeros(0, np.uint8)


@contextmanager
def few_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is run inside reads at most ``rows`` rows of a file at once and hands over about ``BYTES_TOGETHER`` bytes, or a single row."""
    bounds = {"spark.sql.parquet.columnarReaderBatchSize": rows, "spark.sql.execution.arrow.maxBytesPerBatch": BYTES_TOGETHER, "spark.sql.execution.arrow.maxRecordsPerBatch": TEXTS_TOGETHER}
    before = {name: spark.conf.get(name) for name in bounds}
    try:
        for name, most in bounds.items():
            spark.conf.set(name, str(most))
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def blocks(docs: DataFrame, doc_id: str, text: str, classes: int) -> DataFrame:
    """Texts as ``BLOCKS`` rows, each of bounded text size."""
    checksum = F.crc32(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).cast("binary"))
    source = docs.select(F.col(f"`{doc_id}`").cast("bigint"), (checksum % HELD_OUT[0] == HELD_OUT[1]), F.col(f"`{text}`"))
    source = source.toDF("doc_id", "held_out", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for piece in ragged.pieces(batch, "text", BLOCK_BYTES):
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *encode_block(*piece.columns, classes)], BLOCKS.names)
                number += 1

    return source.mapInArrow(run, BLOCKS)


@dataclass
class Stretches:
    """Tokens of a block's texts (each with its end) cut into stretches, longest first."""

    kinds: np.ndarray  # class of every token
    begin: np.ndarray
    size: np.ndarray
    text: np.ndarray
    order: np.ndarray  # number of the stretch within its text
    live: list[int]  # how many stretches have a token at each step


def stretches(sizes: np.ndarray, kinds: np.ndarray) -> Stretches:
    per_text = sizes + 1
    ends = np.cumsum(per_text)
    full = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)
    inside = np.ones(len(full), bool)
    inside[ends - 1] = False
    full[inside] = kinds
    count = -(-per_text // STRETCH)
    text = np.repeat(np.arange(len(sizes)), count)
    order = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    begin = (ends - per_text)[text] + order * STRETCH
    size = np.minimum(STRETCH, ends[text] - begin)
    by_size = np.argsort(-size, kind="stable")
    begin, size, text, order = begin[by_size], size[by_size], text[by_size], order[by_size]
    live = [int(np.searchsorted(-size, -t, side="left")) for t in range(int(size.max(initial=0)))]
    return Stretches(full, begin, size, text, order, live)


def products(s: Stretches, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Product of the step matrices of every stretch, scaled, and the logarithm of the scale."""
    states = len(model.start)
    emit = np.ascontiguousarray(model.emit.T)
    matrix = np.where((s.order == 0)[:, None, None], np.eye(states, dtype=model.step.dtype), model.step)
    scale = np.zeros(len(s.begin))
    room = np.empty((len(s.begin) * states, states), model.step.dtype)
    for t, live in enumerate(s.live):
        part = moved = matrix[:live]
        if t:
            moved = np.matmul(part.reshape(-1, states), model.step, out=room[: live * states]).reshape(-1, states, states)
        np.multiply(moved, emit[s.kinds[s.begin[:live] + t]][:, None, :], out=part)
        if t % 2 or t + 1 == len(s.live):
            top = part.reshape(live, -1).max(1)
            part /= top[:, None, None]
            scale[:live] += np.log(top)
    return matrix, scale


def forward(s: Stretches, model: Model, matrix: np.ndarray, scale: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """State vectors before each stretch, and the log likelihood of every text."""
    vector = np.tile(model.start, (texts, 1))
    likelihood = np.zeros(texts)
    before = np.empty((len(s.begin), len(model.start)), model.start.dtype)
    by_order = np.argsort(s.order, kind="stable")
    cuts = np.searchsorted(s.order[by_order], np.arange(1, int(s.order.max(initial=-1)) + 1))
    for at in np.split(by_order, cuts):
        who = s.text[at]
        before[at] = vector[who]
        moved = (vector[who][:, None, :] @ matrix[at])[:, 0, :]
        total = moved.sum(1)
        likelihood[who] += np.log(total) + scale[at]
        vector[who] = moved / total[:, None]
    return before, likelihood


def backward(s: Stretches, matrix: np.ndarray, texts: int) -> np.ndarray:
    """Vectors of what follows each stretch, scaled."""
    vector = np.ones((texts, matrix.shape[1]), matrix.dtype)
    after = np.empty((len(s.begin), matrix.shape[1]), matrix.dtype)
    by_order = np.argsort(-s.order, kind="stable")
    cuts = np.searchsorted(-s.order[by_order], -np.arange(int(s.order.max(initial=-1)) - 1, -1, -1))
    for at in np.split(by_order, cuts):
        who = s.text[at]
        after[at] = vector[who]
        moved = (matrix[at] @ vector[who][:, :, None])[:, :, 0]
        vector[who] = moved / moved.sum(1)[:, None]
    return after


def expected_counts(sizes: np.ndarray, kinds: np.ndarray, model: Model) -> np.ndarray:
    """Expected starts, steps and emissions of a block's texts, as one vector."""
    states, classes = model.emit.shape
    s = stretches(sizes, kinds)
    if not len(s.begin):
        return np.zeros(states + states * states + states * classes)
    matrix, scale = products(s, model)
    before, _ = forward(s, model, matrix, scale, len(sizes))
    behind = backward(s, matrix, len(sizes))
    emit = np.ascontiguousarray(model.emit.T)
    first = s.order == 0
    # A product with ones adds up the states faster than a sum along rows that short.
    ones = np.ones(states, model.step.dtype)
    alphas = np.empty((len(s.kinds), states), model.step.dtype)
    vector = before
    for t, live in enumerate(s.live):
        at = s.begin[:live] + t
        moved = vector[:live] @ model.step
        if t == 0:
            moved[first[:live]] = vector[:live][first[:live]]
        moved *= emit[s.kinds[at]]
        moved /= (moved @ ones)[:, None]
        vector = moved
        alphas[at] = vector
    posterior = np.empty_like(alphas)
    steps = np.zeros((states, states))
    vector = behind
    for t in range(len(s.live) - 1, -1, -1):
        live = s.live[t]
        at = s.begin[:live] + t
        weight = alphas[at] * vector[:live]
        weight /= (weight @ ones)[:, None]
        posterior[at] = weight
        came = alphas[at - 1] if t else before[:live]
        ahead = emit[s.kinds[at]] * vector[:live]
        moved = ahead @ model.step.T
        share = came / ((came * moved) @ ones)[:, None]
        steps += share.T @ ahead if t else share[~first[:live]].T @ ahead[~first[:live]]
        moved /= (moved @ ones)[:, None]
        vector[:live] = moved
    steps *= model.step
    starts = posterior[s.begin[first]].sum(0)
    emissions = np.stack([np.bincount(s.kinds, weights=posterior[:, k], minlength=classes) for k in range(states)])
    return np.concatenate([starts, steps.ravel(), emissions.ravel()])


def log_likelihoods(sizes: np.ndarray, kinds: np.ndarray, model: Model) -> np.ndarray:
    s = stretches(sizes, kinds)
    if not len(sizes):
        return np.zeros(0)
    matrix, scale = products(s, model)
    return forward(s, model, matrix, scale, len(sizes))[1]


def initial(class_tokens: np.ndarray, class_words: np.ndarray, tokens: int, words: int, settings: Settings) -> Model:
    n, rng = settings.states, np.random.default_rng(settings.seed)
    prior = (class_tokens + 1) / (class_tokens.sum() + len(class_tokens))
    emit = prior * rng.lognormal(0, 0.7, (n, len(prior)))
    step = np.full((n, n), 0.1 / n) + 0.9 * np.eye(n)
    return Model(np.full(n, 1 / n), step, emit / emit.sum(1)[:, None], class_tokens, class_words, tokens, words)


def updated(model: Model, counts: np.ndarray) -> Model:
    """The model of expected ``counts``, smoothed so that nothing has probability 0."""
    n, classes = model.emit.shape
    starts, steps, emissions = counts[:n], counts[n : n + n * n].reshape(n, n), counts[n + n * n :].reshape(n, classes)
    prior = (model.class_tokens + 1) / (model.class_tokens.sum() + classes)
    emit = emissions + 50 * prior
    step = steps + 0.1
    start = starts + 0.1
    return Model(start / start.sum(), step / step.sum(1)[:, None], emit / emit.sum(1)[:, None], model.class_tokens, model.class_words, model.tokens, model.words)


def parts(sizes: np.ndarray) -> Iterator[tuple[slice, slice]]:
    """Consecutive texts (and their words) of about ``PART_TOKENS`` words."""
    ends = np.append(0, np.cumsum(sizes))
    start = 0
    while start < len(sizes):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + PART_TOKENS, side="right")) - 1)
        yield slice(start, stop), slice(int(ends[start]), int(ends[stop]))
        start = stop


def block_rows(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Sizes and held-out flags of the texts of each block, its word numbers and the classes of its words."""
    for sizes, held, tokens, kinds in zip(*(batch.column(name) for name in ("sizes", "held_out", "tokens", "classes"))):
        sizes, held = sizes.values.to_numpy(), held.values.to_numpy(zero_copy_only=False)
        yield sizes.astype(np.int64), held.astype(bool), unpacked(tokens.as_buffer(), int(sizes.sum())), np.frombuffer(kinds.as_buffer(), np.int32)


def round_counts(encoded: DataFrame, model: Model) -> np.ndarray:
    """Baum-Welch counts of all training texts. Tasks send one vector each; Spark adds the entries."""
    # Single precision is enough for counts; scores are computed in double precision.
    single = replace(model, start=model.start.astype(np.float32), step=model.step.astype(np.float32), emit=model.emit.astype(np.float32))
    shared = encoded.sparkSession.sparkContext.broadcast(single)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(model_size(shared.value))
        for batch in batches:
            for sizes, held, tokens, kinds in block_rows(batch):
                chosen = np.repeat(~held, sizes)
                sizes, words = sizes[~held], kinds[tokens[chosen]].astype(np.int64)
                for texts, of_texts in parts(sizes):
                    total += expected_counts(sizes[texts], words[of_texts], shared.value)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["entry", "count"])

    rows = encoded.select("sizes", "held_out", "tokens", "classes").mapInArrow(run, "entry bigint, count double")
    counts = np.zeros(model_size(model))
    for entry, count in rows.groupBy("entry").agg(F.sum("count").alias("count")).collect():
        counts[entry] = count
    shared.unpersist()
    return counts


def model_size(model: Model) -> int:
    n, classes = model.emit.shape
    return n + n * n + n * classes


def pieces(encoded: DataFrame, ranges: int) -> DataFrame:
    """The word lists of all blocks as ``PIECES``, cut at the same ``ranges`` of fingerprints. A block has no piece where it has no word."""
    borders = np.array([(k << 64) // ranges for k in range(1, ranges)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, *columns in zip(*(batch.column(name) for name in ("block", "words", "classes", "counts"))):
                words, *rest = (column.as_buffer() for column in columns)
                cuts = np.concatenate([[0], np.searchsorted(np.frombuffer(words, np.uint64), borders), [words.size // 8]])
                full = np.flatnonzero(np.diff(cuts))
                ends = cuts[np.append(full, len(cuts) - 1)].astype(np.int32)  # an empty range begins where the next one does
                slices = [pa.Array.from_buffers(pa.binary(), len(full), [None, pa.py_buffer(ends * width), raw]) for width, raw in zip((8, 4, 4), (words, *rest))]
                yield pa.RecordBatch.from_arrays([pa.array([block.as_py()] * len(full), pa.int64()), pa.array(full.astype(np.int32)), *slices], PIECES.names)

    return encoded.select("block", "words", "classes", "counts").mapInArrow(run, PIECES)


def counted(classes: int):
    """``KNOWN`` of all pieces of one range."""

    def run(table: pa.Table) -> pa.Table:
        flat = lambda name: ragged.texts(table.column(name))
        words, kinds, counts = flat("words"), flat("classes").data.view(np.int32), flat("counts").data.view(np.int32)
        unique, first, at = np.unique(words.data.view(np.uint64), return_index=True, return_inverse=True)
        known = np.zeros(len(unique), np.int64)
        np.add.at(known, at, counts)
        trained = known > 0
        kinds, per_word = kinds[first][trained], known[trained]
        tokens = np.zeros(classes, np.int64)
        np.add.at(tokens, kinds, per_word)
        has = np.flatnonzero(tokens)
        found = pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(words.offsets.astype(np.int32)), pa.py_buffer(known[at])])
        none = lambda n, kind: pa.nulls(n, kind)
        columns = [
            (table.column("block").combine_chunks(), none(len(has), pa.int64())), (table.column("range").combine_chunks(), none(len(has), pa.int32())), (found, none(len(has), pa.binary())),
            (none(len(words), pa.int32()), pa.array(has, pa.int32())), (none(len(words), pa.int64()), pa.array(tokens[has])),
            (none(len(words), pa.int64()), pa.array(np.bincount(kinds, minlength=classes)[has], pa.int64())),
        ]
        return pa.table([pa.chunked_array(column) for column in columns], KNOWN.names)

    return run


def block_scores(sizes: np.ndarray, tokens: np.ndarray, kinds: np.ndarray, known: np.ndarray, ends: int, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Known tokens, base score and model score of each text. ``known``: training count of each word of the block."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    base = np.log10((known + 1) / (model.tokens + model.words + 1))
    in_class = np.maximum(model.class_tokens[kinds], 1e-300)
    unseen = np.where(model.class_tokens[kinds] > 0, DISCOUNT * model.class_words[kinds] / in_class, 1.0)
    given_class = np.log10(np.where(known > 0, (known - DISCOUNT) / in_class, unseen))
    add = lambda values: np.bincount(owner, weights=values[tokens], minlength=len(sizes))
    n_known = add((known > 0).astype(float)).astype(np.int64) + (ends > 0)
    base_score = add(base) + np.log10((ends + 1) / (model.tokens + model.words + 1))
    states = [log_likelihoods(sizes[texts], kinds[tokens[words]], model) for texts, words in parts(sizes)]
    score = add(given_class) + np.concatenate([*states, np.zeros(0)]) / np.log(10)
    return n_known, base_score, score


def scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """``SCORES`` of every row of ``docs``, by a model of the rows that are not held out.

    Tokens are words cut at ASCII white space with A-Z lower-cased, and one end per text; null, empty and blank texts are
    an end alone. Unknown words are one event, as in the base score. Texts with a null id belong to training and keep
    the null. Without training texts every word is unknown. Repeated rows count and are scored each.
    """
    spark = docs.sparkSession
    with few_rows(spark, TEXTS_TOGETHER):
        encoded = stored(blocks(docs, doc_id, text, settings.classes), "blocks")
    trained = F.aggregate("held_out", F.lit(0).cast("bigint"), lambda n, held: n + F.when(held, 0).otherwise(1))
    ends, listed = encoded.agg(F.sum(trained), F.sum(F.octet_length("words")) / 8).first()
    ends, ranges = ends or 0, max(spark.sparkContext.defaultParallelism, int(listed or 0) // RANGE_WORDS + 1)
    with few_rows(spark, BLOCKS_TOGETHER):
        known = stored(pieces(encoded, ranges).groupBy("range").applyInArrow(counted(settings.classes), KNOWN), "known")
    class_tokens, class_words = np.zeros(settings.classes), np.zeros(settings.classes)
    for kind, tokens, words in known.where("class is not null").groupBy("class").agg(F.sum("class_tokens"), F.sum("class_words")).collect():
        class_tokens[kind] += tokens
        class_words[kind] += words
    class_tokens[0], class_words[0] = ends, 1
    model = initial(class_tokens, class_words, int(class_tokens.sum()), int(class_words[1:].sum()) + (ends > 0), settings)
    with few_rows(spark, BLOCKS_TOGETHER):
        for _ in range(settings.rounds):
            model = updated(model, round_counts(encoded, model))
    shared = spark.sparkContext.broadcast(model)

    found = known.where("block is not null").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("range", "known"))).alias("known"))
    full = encoded.select("block", "doc_ids", "held_out", "sizes", "tokens", "classes").join(found, "block", "left").drop("block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for i, (sizes, held, tokens, kinds) in enumerate(block_rows(batch)):
                back = batch.column("known")[i].values
                known = ragged.texts(back.field("known")).data.view(np.int64) if back is not None else np.zeros(0, np.int64)
                n_known, base, score = block_scores(sizes, tokens, kinds, known, ends, model)
                columns = [sizes + 1, n_known, np.full(len(sizes), model.tokens, np.int64), base, score]
                yield pa.RecordBatch.from_arrays([batch.column("doc_ids")[i].values, batch.column("held_out")[i].values, *map(pa.array, columns)], SCORES.names)

    with few_rows(spark, BLOCKS_TOGETHER):
        result = stored(full.mapInArrow(run, SCORES), "scores")
    discard(encoded, known)
    return result
