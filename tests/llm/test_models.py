"""The language model against a plain recursion and held-out texts, language identification against known labels."""

import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridscore.llm import hmm, language_id, queries, ragged

SF_DIR = "/root/testdata/sf0.01"


def plain_forward_backward(model, sequence):
    alphas, scales = [], []
    for t, symbol in enumerate(sequence):
        a = (model.start if t == 0 else alphas[-1] @ model.step) * model.emit[:, symbol]
        scales.append(a.sum())
        alphas.append(a / a.sum())
    betas = [np.ones(len(model.start))]
    for t in range(len(sequence) - 1, 0, -1):
        betas.insert(0, model.step @ (model.emit[:, sequence[t]] * betas[0]) / scales[t])
    gamma = np.array(alphas) * np.array(betas)
    gamma /= gamma.sum(1)[:, None]
    steps, emit = np.zeros_like(model.step), np.zeros_like(model.emit)
    for t in range(len(sequence) - 1):
        xi = alphas[t][:, None] * model.step * (model.emit[:, sequence[t + 1]] * betas[t + 1])[None]
        steps += xi / xi.sum()
    for t, symbol in enumerate(sequence):
        emit[:, symbol] += gamma[t]
    return sum(map(math.log, scales)), np.concatenate([gamma[0], steps.ravel(), emit.ravel()])


def test_stretches_equal_the_plain_recursion():
    rng = np.random.default_rng(4)
    states, classes = 3, 7
    model = hmm.Model(rng.dirichlet(np.ones(states)), rng.dirichlet(np.ones(states), states), rng.dirichlet(np.ones(classes), states), np.ones(classes), np.ones(classes), 7, 7)
    sizes = np.array([0, 5, 300, 64, 63, 0, 127, 128, 1])
    kinds = rng.integers(1, classes, sizes.sum())
    ends = np.cumsum(sizes)
    plain = [plain_forward_backward(model, [*kinds[e - n : e], 0]) for n, e in zip(sizes, ends)]
    assert np.allclose(hmm.log_likelihoods(sizes, kinds, model), [p[0] for p in plain])
    assert np.allclose(hmm.expected_counts(sizes, kinds, model), sum(p[1] for p in plain))


@pytest.fixture(scope="module")
def scored(spark):
    return {r.doc_id: r for r in queries.QUERIES["op7_hidden_markov_scores"](spark, SF_DIR).collect()}


def tokens(text):
    lower = "".join(c.lower() if c < "\x80" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), None]


def test_base_scores_equal_plain_python(spark, scored):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 7 == 2 for r in docs}
    counts = Counter(t for r in docs if not held[r.doc_id] for t in tokens(r.text))
    total, distinct = sum(counts.values()), len(counts)
    for r in docs:
        own = tokens(r.text)
        s = scored[r.doc_id]
        assert (s.held_out, s.n_tokens, s.n_known, s.train_tokens) == (held[r.doc_id], len(own), sum(counts[t] > 0 for t in own), total)
        assert math.isclose(s.base_score, sum(math.log10((counts[t] + 1) / (total + distinct + 1)) for t in own), rel_tol=1e-9)


def test_held_out_texts_are_likelier_than_by_the_base(scored):
    held = [s for s in scored.values() if s.held_out]
    assert sum(s.score for s in held) > 0.9 * sum(s.base_score for s in held)
    assert all(s.score < 0 for s in scored.values())


def test_rounds_raise_the_likelihood(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    totals = []
    for rounds in (0, 1, 3):
        rows = hmm.scores(docs, settings=hmm.Settings(states=4, rounds=rounds))
        totals.append(rows.where("not held_out").agg(F.sum("score")).first()[0])
    assert totals[0] < totals[1] < totals[2]


def test_class_probabilities_sum_to_one():
    model = hmm.Model(np.ones(1), np.ones((1, 1)), np.ones((1, 2)) / 2, np.array([1.0, 6.0]), np.array([1.0, 3.0]), 7, 4)
    sizes, words = np.array([1, 1, 1, 1]), np.arange(4)
    score = hmm.block_scores(sizes, words, np.ones(4, int), np.array([3, 2, 1, 0]), 1, model)[2]
    assert np.isclose((10**score).sum(), 0.5 * 0.5)  # the class, then the end


def test_a_worker_encodes_texts_in_small_blocks():
    texts = pa.array([" ".join(f"w{(i * 7919 + k * k) % 50_021}" for k in range(400)) for i in range(4000)])
    batch = pa.RecordBatch.from_arrays([pa.array(range(4000)), pa.array([False] * 4000), texts], ["doc_id", "held_out", "text"])
    tracemalloc.start()
    made = [hmm.encode_block(*piece.columns, 4096) for piece in ragged.pieces(batch, "text", hmm.BLOCK_BYTES)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(len(m[0][0]) for m in made) == 4000 and sum(sum(m[2][0].as_py()) for m in made) == 1_600_000
    assert peak < 10 * batch.nbytes


def test_spark_hands_over_few_bytes_at_once(spark):
    rows = spark.range(0, 60, 1, 1).select(F.repeat(F.lit("x"), 1 << 20).alias("text"))
    sizes = lambda: [r.n for r in rows.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches), "n bigint").collect()]
    with hmm.few_rows(spark, hmm.BLOCKS_TOGETHER):
        few = sizes()
    assert sum(few) >= 60 << 20 and max(few) < hmm.BYTES_TOGETHER + (2 << 20) < max(sizes())


@pytest.mark.parametrize("ranges", [1, 7, 5000])
def test_ranges_count_the_words_of_all_blocks(spark, ranges):
    rng = np.random.default_rng(ranges)
    texts = [" ".join(f"w{w}" for w in rng.zipf(1.3, 50) % 900) for _ in range(200)] + ["", None, "  "]
    docs = spark.createDataFrame([(i if i else None, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(5)
    encoded = hmm.blocks(docs, "doc_id", "text", 64).cache()
    known = hmm.pieces(encoded, ranges).groupBy("range").applyInArrow(hmm.counted(64), hmm.KNOWN).collect()
    expected, classes, total = Counter(), {}, Counter()
    lists = {r.block: (np.frombuffer(r.words, np.uint64), np.frombuffer(r.classes, np.int32), np.frombuffer(r.counts, np.int32)) for r in encoded.collect()}
    for words, kinds, counts in lists.values():
        for word, kind, n in zip(words.tolist(), kinds.tolist(), counts.tolist()):
            expected[word] += n
            classes[word] = kind
    for word, n in expected.items():
        total[classes[word]] += n
    assert sum(r.class_tokens for r in known if r.block is None) == sum(total.values())
    assert sum(r.class_words for r in known if r.block is None) == sum(n > 0 for n in expected.values())
    assert {k: n for k in range(64) if (n := sum(r.class_tokens for r in known if r["class"] == k))} == {k: n for k, n in total.items() if n}
    for block, (words, _, _) in lists.items():
        back = b"".join(bytes(r.known) for r in sorted((r for r in known if r.block == block), key=lambda r: r.range))
        assert np.frombuffer(back, np.int64).tolist() == [expected[w] for w in words.tolist()]
    encoded.unpersist()


def test_language_of_held_out_texts(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    train, test = docs.where("doc_id % 5 <> 0"), docs.where("doc_id % 5 = 0 and length(text) > 100")
    pages = test.select(F.col("doc_id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.concat(F.lit("<p>"), "text").alias("html"))
    found = language_id.identify(pages, train).join(test.select(F.col("doc_id").alias("page_id"), F.col("lang").alias("truth")), "page_id").collect()
    assert sum(r.lang == r.truth for r in found) > 0.95 * len(found) > 100


def test_evidence_adds_up(spark):
    docs = spark.createDataFrame([("le la les des une est", "fr"), ("the of and with that", "en")] * 5, "text string, lang string")
    page = lambda lang, text: f"<html lang='{lang}'><script>the of and</script><!-- the -->{text}</html>"
    rows = [(i, "http://www.a.fr/x", page("fr", "le la les des une est")) for i in range(30)]
    rows += [(100 + i, "https://b.com:80/", page("en", "the of and with that")) for i in range(30)]
    rows += [(200, "http://a.fr/", "<p></p>"), (201, None, page("fr", "")), (202, None, None), (203, "not an address", ""), (None, "http://u@b.com/#x", "")]
    found = {r.page_id: r for r in language_id.identify(spark.createDataFrame(rows, "page_id bigint, url string, html string"), docs).collect()}
    assert len(found) == 65
    assert (found[0].lang, found[0].host, found[0].suffix, found[0].declared) == ("fr", "a.fr", "fr", "fr")
    assert found[100].lang == "en" and found[100].host == "b.com"
    assert found[200].lang == "fr" and found[200].text_lang is None  # by its host
    assert found[201].lang == "fr" and found[None].lang == "en"
    assert 0 < found[202].probability <= 1
    assert found[202].lang == "en"  # no evidence, equal shares: the first in order


def test_without_labels(spark):
    docs = spark.createDataFrame([], "text string, lang string")
    pages = spark.createDataFrame([(1, "http://a.b/", "<p>x")], "page_id bigint, url string, html string")
    assert [(r.page_id, r.lang) for r in language_id.identify(pages, docs).collect()] == [(1, None)]
