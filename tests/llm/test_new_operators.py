"""Merge replay, centroid clustering and collocations against the library and plain Python."""

import hashlib
import random
import tracemalloc
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import re
import tiktoken
from pyspark.sql import functions as F

from gridscore.llm import clustering, collocations, merge_replay, queries

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = [chr(x) for x in [*range(0, 300), 0x1C, 0x85, 0xA0, 0x2028, 0x3000, 0x200B, 0x4E2D, 0x1F642, 0x661, 0xBD, 0x2160, 0x301, 0x180E, 0xFEFF]]


@pytest.fixture(scope="module")
def tokens():
    return merge_replay.load_ranks(RANKS)


@pytest.fixture(scope="module")
def library(tokens):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})


def odd_texts(tokens, seed=2):
    rnd = random.Random(seed)
    texts = [None, "", " ", "\n" * 50, "a" * 3000, "ab" * 1000, " " * 999, "<|endoftext|>", "aaab" * 300, "é" * 500]
    texts += ["".join(rnd.choices([*ODD, "the", "ing", " a", "'s", "'LL", "\n\n"], k=rnd.randint(0, 60))) for _ in range(800)]
    texts += ["".join(tokens[rnd.randrange(len(tokens))].decode("utf8", "ignore") for _ in range(20)) for _ in range(500)]
    return texts + texts[:20]


def test_replay_equals_library(spark, tokens, library):
    texts = odd_texts(tokens)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    rows = {r.doc_id: r.encoded for r in merge_replay.encoded(docs, RANKS, public_tokenizers.PATTERN, decoded=True).collect()}
    for i, text in enumerate(texts):
        assert rows[i].ids == library.encode_ordinary(text or ""), text
        assert bytes(rows[i].decoded) == (text or "").encode()


def test_a_pair_of_lower_rank_after_a_merge():
    # "ab" has a higher rank than "abc" and "aba": after one merge a lower pair comes up before the second "ab" merges.
    letters = [bytes([b]) for b in range(256)]
    vocabulary = [*letters, b"abc", b"aba", b"cab", b"bab", b"ab", b"abab"]
    own = tiktoken.Encoding("own", pat_str=".+", mergeable_ranks={t: i for i, t in enumerate(vocabulary)}, special_tokens={})
    coder = merge_replay.Coder(vocabulary, ".+")
    rnd = random.Random(4)
    words = ["abab", "ababc", "abababcab", *("".join(rnd.choices("abc", k=rnd.randint(1, 30))) for _ in range(2000))]
    ids, counts = coder.encode(words)
    for word, got in zip(words, np.split(ids, np.cumsum(counts)[:-1])):
        assert got.tolist() == own.encode_ordinary(word), word


def test_forgetting_words_changes_nothing(monkeypatch, tokens, library):
    monkeypatch.setattr(merge_replay, "REMEMBERED_BYTES", 50)
    coder = merge_replay.Coder(tokens, public_tokenizers.PATTERN)
    for text in odd_texts(tokens, seed=8)[1:200]:
        ids, _ = coder.encode([text])
        assert ids.tolist() == library.encode_ordinary(text)


def test_decoding_alone(spark):
    rows = spark.createDataFrame([(1, [64, 65]), (2, []), (3, None)], "doc_id bigint, ids array<int>")
    assert {r.doc_id: bytes(r.decoded) for r in merge_replay.decoded(rows, RANKS).collect()} == {1: b"ab", 2: b"", 3: b""}
    with pytest.raises(Exception, match="no token"):
        merge_replay.decoded(spark.createDataFrame([(1, [99_999])], "doc_id bigint, ids array<int>"), RANKS).collect()


def test_registered_replay(spark, library):
    got = {r.doc_id: r for r in queries.QUERIES["op11_merge_replay"](spark, "/root/testdata/sf0.001").collect()}
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(got) == len(texts)
    for row in texts:
        ids = library.encode_ordinary(row.text or "")
        assert got[row.doc_id].n_tokens == len(ids)
        assert got[row.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[row.doc_id].decoded_sha256 == hashlib.sha256((row.text or "").encode()).hexdigest()


def plain_clusters(rows, dimensions, k, rounds):
    """Rows (key, ints) -> assignments, distances and centroids."""
    named = sorted((hashlib.sha256(f"1:{key}".encode()).hexdigest(), v) for key, v in rows if key is not None)
    centroids = [list(v) for _, v in named[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centroids))
    for _ in range(rounds):
        members = defaultdict(list)
        for _, v in rows:
            members[near(v)[1]].append(v)
        for i, vs in members.items():
            centroids[i] = [sum(column) // len(vs) for column in zip(*vs)]
    return [(key, *reversed(near(v))) for key, v in rows], centroids


@pytest.mark.parametrize("leading", [1, 3, 6])
def test_clusters_equal_plain_python(spark, leading):
    rnd = random.Random(leading)
    centres = [[rnd.uniform(-3, 3) for _ in range(6)] for _ in range(5)]
    rows = [(i, [x + rnd.gauss(0, 0.3) for x in centres[i % 5]]) for i in range(400)]
    rows += [(i, rows[0][1]) for i in range(400, 500)] + [rows[3], rows[3], (None, rows[5][1]), (7, rows[9][1])]
    bad = [(900, None), (901, [1.0] * 5), (902, [1.0] * 5 + [None]), (903, [1.0] * 5 + [float("nan")]), (904, [float("inf")] + [0.0] * 5), (905, [])]
    settings = clustering.Settings(dimensions=6, clusters=7, leading=leading)
    found, about = clustering.clusters(spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<float>").repartition(5), settings=settings)
    whole = [(key, [int(np.floor(64 * np.float64(np.float32(x)))) for x in v]) for key, v in rows]
    expected, centroids = plain_clusters(whole, 6, 7, 3)
    assert Counter((r.vec_id, r.cluster, r.distance) for r in found.collect()) == Counter(expected)
    inertia = Counter()
    for _, cluster, distance in expected:
        inertia[cluster] += distance
    for r in about.collect():
        assert list(r.centroid) == centroids[r.cluster] and r.inertia == inertia[r.cluster]


def test_bounds_leave_out_far_centroids():
    rnd = np.random.default_rng(3)
    centroids = rnd.integers(-200, 200, (16, 8))
    v = centroids[rnd.integers(0, 16, 500)] + rnd.integers(-9, 9, (500, 8))
    axes = np.linalg.qr(rnd.normal(size=(8, 8)))[0]
    turned = v @ axes
    cluster, distance, measured = clustering.nearest(v, turned[:, :4], np.linalg.norm(turned[:, 4:], axis=1), centroids, axes)
    every = ((v[:, None] - centroids) ** 2).sum(2)
    assert (cluster == every.argmin(1)).all() and (distance == every.min(1)).all()
    assert measured < 2 * len(v)


def test_few_or_no_vectors(spark):
    settings = clustering.Settings(dimensions=2)
    few, about = clustering.clusters(spark.createDataFrame([(1, [0.5, 1.0]), (2, [0.5, 1.0])], "vec_id bigint, embedding array<double>"), settings=settings)
    assert sorted((r.vec_id, r.cluster, r.distance) for r in few.collect()) == [(1, 0, 0), (2, 0, 0)]
    assert sorted((r.cluster, r.inertia) for r in about.collect()) == [(0, 0), (1, 0)]
    none, about = clustering.clusters(spark.createDataFrame([(1, [0.5])], "vec_id bigint, embedding array<double>"), settings=settings)
    assert none.count() == about.count() == 0
    with pytest.raises(Exception, match="too large"):
        clustering.clusters(spark.createDataFrame([(1, [0.5, 1e30])], "vec_id bigint, embedding array<double>"), settings=settings)


def plain_collocations(rows, least, longest, share, best):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if c < "\x80" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    result = []
    for lang, f in counts.items():
        kept = []
        frequent = {p: a for p, a in f.items() if a >= least}
        hidden = {p[i : i + k] for p, a in frequent.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= share * f[p[i : i + k]]}
        for p, a in frequent.items():
            if len(p) > 1 and p not in hidden:
                score, _, l, r = min((1000 * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(kept)[:best], 1):
            result.append((lang, rank, phrase.decode(), -a, l, r, totals[lang], -score))
    return sorted(result)


def phrase_rows(seed, n):
    rnd = random.Random(seed)
    words = ["the", "The", "of", "a", "a", "a", "é", "É", "x\x01y", "x", "new", "york", "times", "🙂", "b"]
    rows = [(None, None), ("en", ""), (None, "a a a a a a a"), ("en", " \t\n..a"), ("en", "new york times " * 40), ("zz", "alone")]
    for _ in range(n):
        text = "".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "?x ", "\x0b"]) for _ in range(rnd.randint(0, 60)))
        rows.append((rnd.choice(["en", "en", "en", "de", None, "und"]), text))
    return rows + rows[5:15]


@pytest.mark.parametrize("share, buckets, block", [(100, 1 << 12, 300), (60, 16, 1 << 20), (100, collocations.BUCKETS, 1 << 20)])
def test_collocations_equal_plain_python(spark, share, buckets, block):
    rows = phrase_rows(share + buckets, 300)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    found = collocations.collocations(docs, least=6, best=40, share=share, buckets=buckets, block_bytes=block)
    assert sorted(tuple(r) for r in found.collect()) == plain_collocations(rows, 6, 5, share, 40)


@pytest.mark.parametrize("ranges", [1, 7, 60])
def test_streams_may_be_cut_anywhere(spark, ranges):
    rows = phrase_rows(ranges, 200)
    docs = spark.createDataFrame(rows, "lang string, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    try:
        found = collocations.collocations(docs, least=3, best=10_000, buckets=1 << 12)
        assert sorted(tuple(r) for r in found.collect()) == plain_collocations(rows, 3, 5, 100, 10_000)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_no_text_has_no_collocations(spark):
    empty = spark.createDataFrame([], "lang string, text string, rank int, words int")
    assert collocations.collocations(empty, buckets=1 << 12).count() == 0
    assert collocations.collocations(spark.createDataFrame([(None, None), ("en", " . ")], "lang string, text string"), buckets=1 << 12).count() == 0


def test_odd_columns(spark):
    vectors = spark.createDataFrame([(1, [0.5, 1.0], 5, "x"), (2, [0.0, 1.0], 6, "y")], "vec_id bigint, embedding array<double>, cluster int, v string")
    assert clustering.clusters(vectors, settings=clustering.Settings(dimensions=2))[0].count() == 2
    docs = spark.createDataFrame([(1, "a b", "z", 2)], "doc_id bigint, text string, encoded string, ids int")
    assert merge_replay.encoded(docs, RANKS, public_tokenizers.PATTERN).select(F.size("encoded.ids")).first()[0] == 2


def test_scans_for_phrases_hold_few_texts_at_once(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    rows = spark.range(0, 2500, 1, 1)
    with collocations.small_batches(spark):
        sizes = rows.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in batches), "n bigint").collect()
    assert sum(r.n for r in sizes) == 2500 and max(r.n for r in sizes) <= 1000
    assert spark.conf.get(name) == before


def test_a_worker_surveys_texts_in_small_blocks():
    texts = [" ".join(f"w{(i * 7919 + k * k) % 5003}" for k in range(400)) for i in range(3000)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(["en"] * len(texts))], ["text", "lang"])
    tracemalloc.start()
    words = sum(len(w.ids) for w in collocations.blocks(iter([batch]), collocations.BLOCK_BYTES))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert words == 1_200_000
    assert peak < 4 * batch.nbytes


def test_a_task_sends_each_of_its_phrases_once():
    texts, langs = pa.array(["a b c a b. "] * 300), pa.array(["en"] * 300)
    batch = pa.RecordBatch.from_arrays([texts, langs], ["text", "lang"])
    every = SimpleNamespace(value=np.full(1 << 13, 255, np.uint8))
    made = [r for b in collocations.count_phrases(every, 5, 1 << 12, 100)(iter([batch, batch])) for r in b.to_pylist()]
    counts = {"a b": 1200, "b c": 600, "c a": 600, "a b c": 600, "b c a": 600, "c a b": 600, "a b c a": 600, "b c a b": 600, "a b c a b": 600}
    assert len(made) == len(counts) and {r["phrase"]: r["n"] for r in made} == counts
    assert [*collocations.count_phrases(every, 5, 1 << 12, 100)(iter([]))] == []


def test_sums_that_are_sent_early_lose_no_count():
    rnd = random.Random(5)
    rows = [("en" if rnd.random() < 0.5 else None, f"p{rnd.randrange(60)}", rnd.randrange(9)) for _ in range(900)]
    kinds = [pa.string(), pa.string(), pa.int64()]
    batches = [pa.RecordBatch.from_arrays([*map(pa.array, zip(*rows[i : i + 7]), kinds)], collocations.PHRASE.names) for i in range(0, 900, 7)]
    expected = {}
    for lang, phrase, n in rows:
        expected[lang, phrase] = expected.get((lang, phrase), 0) + n
    for gathered, held in ((1, 0), (20, 30), (10_000, 10_000)):
        made = [*collocations.summed(iter(batches), gathered, held)]
        assert len(made) > 1 or gathered > 900
        found = {}
        for r in (r for b in made for r in b.to_pylist()):
            found[r["lang"], r["phrase"]] = found.get((r["lang"], r["phrase"]), 0) + r["n"]
        assert found == expected


def test_a_larger_source_has_more_buckets(spark, monkeypatch, tmp_path):
    # Pairs that occur once or twice would fill the least number of buckets, and then every one of them would be counted.
    rnd = random.Random(6)
    rows = [("en", " ".join(f"w{rnd.randrange(3000)}" for _ in range(300)) + ". new york") for _ in range(300)]
    spark.createDataFrame(rows, "lang string, text string").repartition(4).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    monkeypatch.setattr(collocations, "BUCKETS", 1 << 10)
    monkeypatch.setattr(collocations, "BUCKET_BYTES", 8)
    buckets = collocations.enough_buckets(docs)
    assert buckets >= 1 << 16
    flagged = {}
    for n in (1 << 10, buckets):
        bits = np.zeros(5 * n // 8, np.uint8)
        chunks = docs.mapInArrow(collocations.survey(20, 5, n, 1 << 20), collocations.SURVEY).where("chunk is not null").select(*collocations.CHUNKS.names)
        collocations.likely_phrases(chunks, 20, n, bits)
        flagged[n] = np.unpackbits(bits[: n // 8]).mean()
    assert flagged[1 << 10] == 1 and 0 < flagged[buckets] < 0.01
    found = collocations.collocations(docs, least=20)
    assert sorted(tuple(r) for r in found.collect()) == plain_collocations(rows, 20, 5, 100, 2000)


@pytest.mark.parametrize("buckets", [16, 100_003, 1 << 18])
def test_buckets_that_are_sent_early_lose_no_count(monkeypatch, buckets):
    monkeypatch.setattr(collocations, "OCCURRENCES", 1000)
    rng = np.random.default_rng(buckets)
    parts = [rng.zipf(1.2, 700) % buckets for _ in range(20)]
    gathered = collocations.Gathered(2, buckets, 30)
    made = [columns for part in parts for columns in gathered.add(part)] + [*gathered.rest()]
    table = pa.concat_tables([pa.table([*columns], collocations.CHUNKS.names) for columns in made])
    expected = np.bincount(np.concatenate(parts), minlength=buckets) >= 30
    per_set = -(-buckets // collocations.CHUNK)
    got = np.zeros(per_set * collocations.CHUNK, bool)
    for chunk in set(table.column("chunk").to_pylist()):
        row = collocations.added(30)(table.filter(pa.array([c == chunk for c in table.column("chunk").to_pylist()]))).to_pylist()[0]
        at = (row["chunk"] - 2 * per_set) * collocations.CHUNK
        got[at : at + collocations.CHUNK] = np.unpackbits(np.frombuffer(row["bits"], np.uint8))
    assert len(made) > 5 and (got[:buckets] == expected).all() and not got[buckets:].any()
