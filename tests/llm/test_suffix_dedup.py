"""Suffix arrays against sorting, removal against a direct search."""

import hashlib
import random
from collections import Counter

import pyarrow as pa
import pytest

from gridscore.llm import ragged, suffix_dedup
from gridscore.llm.suffix_sorting import suffix_array


def test_suffix_array_equals_sorting():
    rnd = random.Random(1)
    for _ in range(400):
        text = [rnd.randint(1, rnd.choice([1, 2, 3, 9])) for _ in range(rnd.randint(0, 70))] + [0]
        assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])
    assert suffix_array([]) == []


def direct(texts, length):
    blobs = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + length] for b in blobs for i in range(len(b) - length + 1))
    for b in blobs:
        flags = [0] * len(b)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                flags[i : i + length] = [1] * length
        spans = [i for i in range(len(b)) if flags[i] and (i == 0 or not flags[i - 1])]
        yield sum(flags), len(spans), bytes(x for x, f in zip(b, flags) if not f)


def odd_texts(length):
    rnd = random.Random(length)
    words = ["aa", "b", "é", "xyz", " ", "ö"]
    line = lambda n: "".join(rnd.choices(words, k=n))
    passages = [line(length) for _ in range(6)]
    texts = [None, "", "short", "a" * (3 * length), "ab" * (2 * length), passages[0], passages[0], passages[1][: length - 1]]
    for _ in range(60):
        p = rnd.choice(passages)
        start = rnd.randint(0, len(p) // 3)
        texts.append(line(rnd.randint(0, length)) + p[start : start + rnd.randint(length // 2, len(p))] + line(rnd.randint(0, length)))
    return texts + [texts[20], texts[21] + texts[21]]


@pytest.mark.parametrize(("length", "block", "variants"), [(40, 1 << 20, 2000), (40, 64, 2000), (24, 1 << 20, 3), (400, 1 << 20, 2000)])
def test_spans_equal_a_direct_search(spark, monkeypatch, length, block, variants):
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    monkeypatch.setattr(suffix_dedup, "MOST_VARIANTS", variants)
    monkeypatch.setattr(suffix_dedup, "ARRAY_SYMBOLS", 500)
    texts = odd_texts(length)
    docs = spark.createDataFrame([(None if i == 9 else i, t) for i, t in enumerate(texts)] + [(3, texts[3])], "doc_id bigint, text string")
    # Workers read the block size from their own copy of the module, so it is checked without Spark as well.
    s = suffix_dedup.segments(ragged.texts(pa.array(texts, pa.string())), length, length // 4)
    covered = {(r, a - d) for r, a, low, high in zip(s.row.tolist(), s.at.tolist(), s.low.tolist(), s.high.tolist()) for d in range(low, high + 1)}
    assert covered == {(i, j) for i, t in enumerate(texts) for j in range(len((t or "").encode()) - length + 1)}

    rows, found = suffix_dedup.repeated_spans(docs, length=length)
    spans = {bytes(r.text_key): [tuple(s) for s in r.spans] for r in found.collect()}
    got = sorted(
        (r.n_bytes, sum(b - a for a, b in spans.get(bytes(r.text_key), [])), len(spans.get(bytes(r.text_key), [])), bytes(r.text_key)) for r in rows.collect()
    )
    everything = [*texts, texts[3]]
    expected = []
    for text, (removed, n, kept) in zip(everything, direct(everything, length)):
        blob = (text or "").encode()
        key = hashlib.sha256(blob).digest()[:16]
        expected.append((len(blob), removed, n, key))
        assert suffix_dedup.cut(blob, spans.get(key, [])) == kept
    assert got == sorted(expected)


def test_cut_keeps_whole_characters():
    text = "aéö€z".encode()
    for start in range(len(text) + 1):
        for end in range(start, len(text) + 1):
            suffix_dedup.cut(text, [(start, end)], whole_characters=True).decode()
    assert suffix_dedup.cut(text, [(1, 3)], whole_characters=True).decode() == "aö€z"
