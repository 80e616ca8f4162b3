"""Phrase collocations from count streams in prefix and suffix order.

The layout is that of external language-model estimation: counts of phrases of all lengths are kept as one sorted stream. In
prefix order (compared word by word) every phrase follows its own prefixes, in suffix order (words reversed) its own suffixes,
so one pass with a stack of as many entries as a phrase has words reads the counts of all first parts, of all last parts and of
the one-word extensions in lockstep; nothing is looked up by hash. A stream is cut into ranges anywhere, also between a phrase and
its extensions: the few phrases that reach over a cut are known before the pass.

Counting needs three scans. The first counts words, and pairs in buckets, of which there are more for larger sources. The second
counts by a second hash the pairs whose buckets reach the least count, and in buckets the longer phrases of such pairs. The third
counts only phrases that lie, like both of their parts with one word less, in buckets that reach the least count. The buckets
leave out what cannot count; how many there are changes the cost, not the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gridscore.llm import ragged
from gridscore.llm.components import discard, stored
from gridscore.session import source_bytes

#: Texts whose words are numbered together in a task.
BLOCK_BYTES = 1 << 20
#: Texts that Spark hands to a worker at once.
TEXTS_TOGETHER = 1000
#: Buckets of one set, at least: one bit each in what is sent around.
BUCKETS = 1 << 22
#: Bytes of source files for a bucket, so that buckets do not fill up with rare phrases as the source grows, and buckets at most, because
#: every worker holds their bits.
BUCKET_BYTES, MOST_BUCKETS = 128, 1 << 27
#: Buckets whose counts are added up together.
CHUNK = 1 << 16
#: Occurrences of phrases that a task gathers before it counts their buckets.
OCCURRENCES = 1 << 21

#: Counts of phrases that a task gathers before it adds up those of one phrase, and sums that it sends on before the end.
GATHERED = 1 << 17
HELD = 1 << 18
#: Bytes of source files for a task of the second scan, which sends each of its phrases once.
TASK_BYTES = 128 << 20

#: Bytes that end a piece, and bytes of words.
_ENDS = ragged.flag_table([*b".,;:!?", *range(0x0A, 0x0E)])
_WORD = ~(_ENDS | ragged.flag_table([0x20, 0x09]))

_text = lambda name: T.StructField(name, T.StringType(), True)
_long = lambda name: T.StructField(name, T.LongType(), True)
CHUNKS = T.StructType([T.StructField("chunk", T.IntegerType()), T.StructField("places", T.BinaryType()), T.StructField("counts", T.BinaryType())])
SURVEY = T.StructType([_text("lang"), _text("word"), _long("n"), *CHUNKS])
PHRASE = T.StructType([_text("lang"), _text("phrase"), _long("n")])


@dataclass
class Words:
    """Words of a block in text order: number in the block's dictionary, language, and whether the next one is in the same piece."""

    ids: np.ndarray
    dictionary: pa.Array
    lang: np.ndarray
    langs: pa.Array
    joined: np.ndarray
    prints: np.ndarray  # a fingerprint of each word of the dictionary


def read_words(column: pa.Array, lang: pa.Array) -> Words:
    batch = ragged.texts(column)
    batch = ragged.Texts(ragged.LOWER[batch.data], batch.offsets)
    found = ragged.runs(batch, _WORD)
    lengths = found.ends - found.starts
    flat = np.ascontiguousarray(batch.data[_WORD[batch.data]])
    offsets = np.append(0, np.cumsum(lengths)).astype(np.int64)
    strings = pa.Array.from_buffers(pa.large_string(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
    coded = strings.dictionary_encode()
    texts = ragged.texts(coded.dictionary)
    prints = ragged.fingerprints(texts.data, ragged.Ranges(texts.offsets[:-1], texts.offsets[1:], texts.offsets[:0]))
    langs = pc.fill_null(lang, "und").dictionary_encode()
    rows = found.rows()
    piece = np.searchsorted(np.flatnonzero(_ENDS[batch.data]), found.starts)
    joined = (piece[1:] == piece[:-1]) & (rows[1:] == rows[:-1])
    return Words(coded.indices.to_numpy(), coded.dictionary, langs.indices.to_numpy()[rows], langs.dictionary, joined, prints)


class Windows:
    """The buckets of the phrase of ``length`` words that begins at a word; ``longer`` goes on to the next length."""

    def __init__(self, words: Words, buckets: int) -> None:
        own = ragged.texts(words.langs)
        names = [int.from_bytes(own.data[a:b].tobytes()[:8], "little") ^ int(b - a) for a, b in zip(own.offsets[:-1], own.offsets[1:])]
        self.words, self.buckets, self.length = words, buckets, 1
        self.at = np.arange(len(words.ids))
        self.salt = ragged.mixed(np.array(names, np.uint64))
        self.prints = words.prints[words.ids]

    def longer(self, flags: np.ndarray) -> None:
        """Keep the phrases whose last word has a next one that belongs to them, if the phrases at both words are flagged."""
        last = self.at + self.length - 1
        keep = last < len(flags) - 1
        keep[keep] = self.words.joined[last[keep]] & flags[self.at[keep]] & flags[self.at[keep] + 1]
        self.at, last = self.at[keep], last[keep]
        self.prints = self.prints[keep] * ragged._MULTIPLIER + self.words.prints[self.words.ids[last + 1]]
        self.length += 1

    def bucket(self, which: int) -> np.ndarray:
        """Buckets of set ``which``."""
        mixed = ragged.mixed(self.prints ^ self.salt[self.words.lang[self.at]] ^ np.uint64(which))
        return (mixed % np.uint64(self.buckets)).astype(np.int64)

    def narrow(self, bits: np.ndarray, which: int) -> None:
        """Keep the phrases whose buckets of set ``which`` are flagged."""
        bucket = self.bucket(which)
        keep = (bits[(bucket >> 3) + which * bit_bytes(self.buckets)] >> (7 - (bucket & 7)).astype(np.uint8)) & 1 > 0
        self.at, self.prints = self.at[keep], self.prints[keep]


def bucket_sets(length: int) -> tuple[int, ...]:
    """Numbers of the sets of buckets of phrases of ``length`` words: two hashes of pairs, one of each longer length."""
    return (0, 1) if length == 2 else (length - 1,)


def bit_bytes(buckets: int) -> int:
    return -(-buckets // 8)


def enough_buckets(source: DataFrame) -> int:
    """The power of two from ``BUCKETS`` on that has one for every ``BUCKET_BYTES`` of files."""
    return min(max(BUCKETS, 1 << (source_bytes(source) // BUCKET_BYTES).bit_length()), MOST_BUCKETS)


def blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[Words]:
    for batch in batches:
        for piece in ragged.pieces(batch, "text", block_bytes):
            words = read_words(piece.column("text"), piece.column("lang"))
            if len(words.ids):
                yield words


def tallied(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One place of each distinct code, the codes renumbered, and how often each occurs."""
    _, first, inverse, counts = np.unique(codes, return_index=True, return_inverse=True, return_counts=True)
    return first, inverse, counts


class Gathered:
    """Buckets of one set, counted when there are ``OCCURRENCES`` of them."""

    def __init__(self, which: int, buckets: int, least: int) -> None:
        self.kind, self.least, self.parts, self.n = np.min_scalar_type(least), least, [], 0
        self.first = which * -(-buckets // CHUNK)

    def add(self, buckets: np.ndarray) -> Iterator[tuple[pa.Array, ...]]:
        self.parts.append(buckets.astype(np.uint32))
        self.n += len(buckets)
        if self.n >= OCCURRENCES:
            yield self.counted()

    def rest(self) -> Iterator[tuple[pa.Array, ...]]:
        if self.n:
            yield self.counted()

    def counted(self) -> tuple[pa.Array, ...]:
        """Columns of ``CHUNKS``: places within the chunk (2 bytes each) and counts, cut off at ``least``."""
        all_ = np.concatenate(self.parts)
        self.parts, self.n = [], 0
        all_.sort()
        starts = np.flatnonzero(np.append(True, all_[1:] != all_[:-1]))
        counts = np.minimum(np.diff(starts, append=len(all_)), self.least).astype(self.kind)
        places = all_[starts]
        chunks = places // np.uint32(CHUNK)
        rows = np.flatnonzero(np.append(True, chunks[1:] != chunks[:-1]))
        ends = np.append(rows, len(places))
        column = lambda values: pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((ends * values.itemsize).astype(np.int32)), pa.py_buffer(values)])
        return pa.array(chunks[rows].astype(np.int32) + np.int32(self.first)), column((places % np.uint32(CHUNK)).astype(np.uint16)), column(counts)


def survey(least: int, longest: int, buckets: int, block_bytes: int):
    """Counts of the words of each task, a word several times if the task has very many, and of its pairs by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = Gathered(0, buckets, least)
        made: list[tuple[pa.Array, ...]] = []

        def of_blocks() -> Iterator[pa.RecordBatch]:
            for words in blocks(batches, block_bytes):
                if longest > 1:
                    windows = Windows(words, buckets)
                    windows.longer(np.ones(len(words.ids), bool))
                    made.extend(pairs.add(windows.bucket(0)))
                size = len(words.dictionary)
                counts = np.bincount(words.lang.astype(np.int64) * size + words.ids)
                found = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([words.langs.take(pa.array(found // size)).cast(pa.string()), words.dictionary.take(pa.array(found % size)).cast(pa.string()), pa.array(counts[found])], PHRASE.names)

        def chunks() -> Iterator[pa.RecordBatch]:
            while made:
                columns = made.pop()
                yield pa.RecordBatch.from_arrays([*(pa.nulls(len(columns[0]), t) for t in (pa.string(), pa.string(), pa.int64())), *columns], SURVEY.names)

        for batch in summed(of_blocks(), GATHERED, HELD, made):
            if batch is not None:
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.nulls(batch.num_rows, t) for t in (pa.int32(), pa.binary(), pa.binary()))], SURVEY.names)
            yield from chunks()
        made.extend(pairs.rest())
        yield from chunks()

    return run


def survey_longer(flags, least: int, longest: int, buckets: int, block_bytes: int):
    """Counts by bucket of the pairs whose first buckets are flagged (``flags``: broadcast bits), by their second hash, and of the longer
    phrases whose pairs all are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = [Gathered(which, buckets, least) for which in range(longest)]
        for words in blocks(batches, block_bytes):
            windows, likely = Windows(words, buckets), np.ones(len(words.ids), bool)
            for length in range(2, longest + 1):
                windows.longer(likely)
                if length == 2:
                    windows.narrow(flags.value, 0)
                if not len(windows.at):
                    break
                which = bucket_sets(length)[-1]
                for columns in sets[which].add(windows.bucket(which)):
                    yield pa.RecordBatch.from_arrays([*columns], CHUNKS.names)
                likely = np.zeros(len(words.ids), bool)
                likely[windows.at] = True
        for gathered in sets:
            for columns in gathered.rest():
                yield pa.RecordBatch.from_arrays([*columns], CHUNKS.names)

    return run


def added(least: int):
    """The rows of one chunk as one bit for each bucket that reaches ``least``."""
    kind = np.min_scalar_type(least)

    def add(table: pa.Table) -> pa.Table:
        places, counts = (ragged.texts(table.column(name)).data for name in ("places", "counts"))
        total = np.zeros(CHUNK, np.uint64)
        np.add.at(total, places.view(np.uint16), counts.view(kind).astype(np.uint64))
        return pa.table([table.column("chunk")[:1], pa.array([np.packbits(total >= least).tobytes()], pa.binary())], ["chunk", "bits"])

    return add


def likely_phrases(chunks: DataFrame, least: int, buckets: int, bits: np.ndarray) -> None:
    """Set in ``bits`` the flags of the buckets that reach ``least``; as many bits as there are buckets come to the driver."""
    per_set, size = -(-buckets // CHUNK), bit_bytes(buckets)
    flagged = stored(chunks.groupBy("chunk").applyInArrow(added(least), "chunk int, bits binary"), "flags")
    for row in flagged.toLocalIterator():
        which, chunk = divmod(row.chunk, per_set)
        start = chunk * CHUNK // 8
        n = min(CHUNK // 8, size - start)
        bits[which * size + start : which * size + start + n] = np.frombuffer(row.bits, np.uint8, n)
    discard(flagged)


def count_phrases(flags, longest: int, buckets: int, block_bytes: int):
    """Counts of a task's phrases of two and more words whose buckets are flagged (``flags``: broadcast bits)."""

    def of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = flags.value
        for words in blocks(batches, block_bytes):
            windows, size = Windows(words, buckets), len(words.dictionary)
            likely = np.ones(len(words.ids), bool)
            names = words.lang.astype(np.int64) * size + words.ids
            for length in range(2, longest + 1):
                windows.longer(likely)
                for which in bucket_sets(length):
                    windows.narrow(bits, which)
                at = windows.at
                if not len(at):
                    break
                likely = np.zeros(len(words.ids), bool)
                likely[at] = True
                # A phrase is named by its beginning, which was named before, and its last word.
                first, named, counts = tallied(names[at] * size + words.ids[at + length - 1])
                names[at] = named
                spelled = [words.dictionary.take(pa.array(words.ids[at[first] + k])) for k in range(length)]
                yield pa.RecordBatch.from_arrays([
                    words.langs.take(pa.array(words.lang[at[first]])).cast(pa.string()), pc.binary_join_element_wise(*spelled, pa.scalar(" ", pa.large_string())).cast(pa.string()),
                    pa.array(counts.astype(np.int64)),
                ], PHRASE.names)

    return lambda batches: summed(of_blocks(batches), GATHERED, HELD)


def summed(batches: Iterator[pa.RecordBatch], gathered: int, held: int, waiting: list | None = None) -> Iterator[pa.RecordBatch | None]:
    """Counts of phrases, those of one phrase added up; more than ``held`` sums are sent on, so a phrase may come again.

    None comes in between if the caller has put something into ``waiting``, to be taken out.
    """

    def added_up(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        sums = pa.Table.from_batches(parts).group_by(["lang", "phrase"], use_threads=False).aggregate([("n", "sum")])
        return sums.select(["lang", "phrase", "n_sum"]).rename_columns(PHRASE.names).combine_chunks().to_batches()[0]

    parts, fresh = [], 0
    for batch in batches:
        if waiting:
            yield None
        parts.append(batch)
        fresh += batch.num_rows
        if fresh >= gathered:
            parts, fresh = [added_up(parts)], 0
            if parts[0].num_rows > held:
                yield parts.pop()
    if fresh:
        parts = [added_up(parts)]
    yield from parts


def large_tasks(rows: DataFrame, source: DataFrame) -> DataFrame:
    """``rows`` in fewer tasks: one for every slot, or for ``TASK_BYTES`` of the files of ``source`` if these are more."""
    return rows.coalesce(max(rows.sparkSession.sparkContext.defaultParallelism, -(-source_bytes(source) // TASK_BYTES)))


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Scans that are run inside hand over few texts at once: neither Spark nor a worker holds more of a task's texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, TEXTS_TOGETHER if int(before) <= 0 else min(int(before), TEXTS_TOGETHER))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def phrase_counts(docs: DataFrame, least: int, longest: int, text: str, lang: str, buckets: int, block_bytes: int) -> tuple[DataFrame, DataFrame]:
    """``lang``, ``words`` (array), ``n`` of all phrases of up to ``longest`` words that occur ``least`` times, and ``lang``,
    ``total`` (words of the language)."""
    rows = docs.select(F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"))
    spark, bits = rows.sparkSession, np.zeros(longest * bit_bytes(buckets), np.uint8)
    with small_batches(spark):
        surveyed = stored(rows.mapInArrow(survey(least, longest, buckets, block_bytes), SURVEY), "survey")
    words = stored(surveyed.where("word is not null").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    likely_phrases(surveyed.where("chunk is not null").select(*CHUNKS.names), least, buckets, bits)
    discard(surveyed)
    first = spark.sparkContext.broadcast(bits[: bit_bytes(buckets)].copy())
    with small_batches(spark):
        likely_phrases(rows.mapInArrow(survey_longer(first, least, longest, buckets, block_bytes), CHUNKS), least, buckets, bits)
    first.unpersist()
    flags = spark.sparkContext.broadcast(bits)
    phrases = large_tasks(rows, docs).mapInArrow(count_phrases(flags, longest, buckets, block_bytes), PHRASE).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    some = words.select("lang", F.array("word").alias("words"), "n").union(phrases.select("lang", F.split("phrase", " ", -1).alias("words"), "n"))
    with small_batches(spark):
        counts = stored(some.where(F.col("n") >= least), "counts")
    totals = stored(words.groupBy("lang").agg(F.sum("n").alias("total")), "totals")
    discard(words)
    return counts, totals


@dataclass
class Open:
    """A phrase of the stack; ``row`` is None if it came before the range."""

    seq: list[str]
    n: int
    row: tuple | None
    parts: list[int]
    extension: int


def lockstep(rows: DataFrame, parts: str, extension: str) -> DataFrame:
    """Rows (lang, seq, n, ...) with ``parts`` (counts of the sequence's own first 1, 2, ... words) and ``extension`` (the
    largest count of a sequence that has one more word at its end). Every prefix of a row must be a row.

    The rows are dealt out as sorted ranges, which may begin anywhere. Prefixes of a range's first row are read from the
    table before: fewer than the row has words, for each range.
    """
    spark = rows.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    payload = [c for c in rows.columns if c not in ("lang", "seq", "n")]
    dealt = stored(rows.repartitionByRange(ranges, "lang", "seq").withColumn("range", F.spark_partition_id()), "ranges")
    firsts = {r["range"]: (r.first.lang, list(r.first.seq)) for r in dealt.groupBy("range").agg(F.min(F.struct("lang", "seq")).alias("first")).collect()}
    reaching = {(lang, tuple(seq[:k])) for lang, seq in firsts.values() for k in range(1, len(seq))}
    wanted = spark.createDataFrame([(lang, list(seq)) for lang, seq in sorted(reaching)], "lang string, seq array<string>")
    own = F.struct("seq", "n", F.lit(0).cast("bigint").alias("longer"))
    longer = F.struct(F.slice("seq", 1, F.size("seq") - 1).alias("seq"), F.lit(0).cast("bigint").alias("n"), F.col("n").alias("longer"))
    known = dealt.select("lang", F.explode(F.array(own, longer)).alias("e")).select("lang", "e.*").join(wanted, ["lang", "seq"])
    over = {(r.lang, tuple(r.seq)): (r.n, r.longer) for r in known.groupBy("lang", "seq").agg(F.max("n").alias("n"), F.max("longer").alias("longer")).collect()}
    schema = T.StructType([*(rows.schema[c] for c in ("lang", "seq", "n", *payload)), T.StructField(parts, T.ArrayType(T.LongType())), _long(extension)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[Open] = []
        done: list[tuple] = []
        here = lang = None
        arrow = None

        def close(depth: int) -> None:
            while len(stack) > depth:
                last = stack.pop()
                if last.row is not None:
                    longest = max(last.extension, over.get((lang, tuple(last.seq)), (0, 0))[1])
                    done.append((lang, last.seq, last.n, *last.row, last.parts, longest))

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*done)) if done else [()] * len(schema.names)
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow)], schema.names)
            done.clear()
            return made

        for batch in batches:
            if arrow is None:
                kinds = {f.name: f.type for f in batch.schema}
                arrow = [*(kinds[c] for c in ("lang", "seq", "n", *payload)), pa.list_(pa.int64()), pa.int64()]
            for at, language, seq, n, *row in zip(*(batch.column(c).to_pylist() for c in ("range", "lang", "seq", "n", *payload))):
                if at != here or language != lang:
                    close(0)
                    if at != here and firsts[at][0] == language:
                        before = [firsts[at][1][:k] for k in range(1, len(firsts[at][1]))]
                        counts = [over[language, tuple(b)][0] for b in before]
                        stack.extend(Open(b, c, None, counts[:k], 0) for k, (b, c) in enumerate(zip(before, counts)))
                    here, lang = at, language
                depth = min(len(stack), len(seq) - 1)
                while depth and stack[depth - 1].seq != seq[:depth]:
                    depth -= 1
                close(depth)
                if depth != len(seq) - 1:
                    raise ValueError(f"no count of the beginning of {seq}")
                if stack:
                    stack[-1].extension = max(stack[-1].extension, n)
                stack.append(Open(seq, n, tuple(row), [o.n for o in stack], 0))
            yield flushed()
        close(0)
        if done:
            yield flushed()

    return dealt.repartition("range").sortWithinPartitions("range", "lang", "seq").mapInArrow(run, schema)


SCORED = T.StructType([_text("lang"), _text("phrase"), *(_long(name) for name in ("a", "l", "r", "n", "score"))])


def weakest_cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cut of the lowest score, the first of several; in Python's integers, because products pass 64 bits."""
    for batch in batches:
        cuts = []
        for a, firsts, lasts, total in zip(*(batch.column(c).to_pylist() for c in ("n", "firsts", "lasts", "total"))):
            scaled = 1000 * a * total
            score, _, left, right = min((scaled // (left * right), k, left, right) for k, (left, right) in enumerate(zip(firsts, reversed(lasts))))
            cuts.append((a, left, right, total, score))
        columns = [pa.array(c, pa.int64()) for c in (zip(*cuts) if cuts else [()] * 5)]
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("phrase"), *columns], SCORED.names)


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 100, longest: int = 5, share: int = 100, best: int = 2000, buckets: int | None = None,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The ``best`` phrases of each language: ``lang``, ``rank``, ``phrase``, ``a`` (its count), ``l`` and ``r`` (counts of the two
    parts of its weakest cut), ``n`` (words of the language) and ``score``, floor(1000 a n / (l r)).

    Words are lower-cased (A-Z) and do not cross ``.,;:!?`` or line ends. Phrases of 2 to ``longest`` words that occur ``least``
    times count, unless a phrase with more words that holds them reaches ``share`` percent of their count. Such a longer phrase
    need only be looked for among those with one more word: any phrase between the two is at least as frequent as the longer.
    A null language is ``und``; null, empty and blank texts have no words; repeated rows count again. Ties go by count, then by
    the bytes of the phrase. No documents give no rows. Texts and counts are whole; arithmetic is exact.
    """
    counts, totals = phrase_counts(docs, least, longest, text, lang, buckets or enough_buckets(docs), block_bytes)
    by_prefix = stored(lockstep(counts.select("lang", F.col("words").alias("seq"), "n"), "firsts", "right"), "by_prefix")
    turned = by_prefix.select("lang", F.reverse("seq").alias("seq"), "n", "firsts", "right")
    both = stored(lockstep(turned, "lasts", "left").where("size(seq) > 1"), "by_suffix")
    alone = both.where(100 * F.greatest("left", "right") < share * F.col("n")).join(totals, "lang")
    rows = alone.select("lang", F.array_join(F.reverse("seq"), " ").alias("phrase"), "n", "firsts", "lasts", "total").mapInArrow(weakest_cuts, SCORED)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = rows.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= best)
    result = stored(ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
    discard(counts, totals, by_prefix, both)
    return result
