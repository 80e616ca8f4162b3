"""Operators against plain Python on small inputs."""

import hashlib
import base64
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridscore.llm import decontamination, quality, ragged, sharding, token_counts, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def odd_texts(n=300, seed=3):
    rnd = random.Random(seed)
    parts = ["a", "b", "ab", "Öl", "é", " ", "  ", "\n", "\t", "\x0b", "#", "|", "the", "\x85", " ", "zz", "\r\n", "🙂"]
    return [None, "", " ", "\n\n", "a" * 5000] + ["".join(rnd.choices(parts, k=rnd.randint(0, 120))) for _ in range(n)]


def test_measures_equal_plain_python():
    texts = odd_texts()
    got = list(zip(*(x.to_pylist() for x in quality.measure(pa.array(texts, pa.string())))))
    for text, measured in zip(texts, got):
        text = text or ""
        words = WORD.findall(text)
        lines = [line for line in text.split("\n") if WORD.search(line)]
        windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)}
        expected = (
            len(words), sum(map(len, words)), sum(text.count(c) for c in quality.SYMBOLS), len(lines), len(lines) - len(set(lines)), len(covered),
        )
        assert measured == expected, text


def test_ablation_counts_rows_by_bits(spark):
    ledger = spark.createDataFrame([(0,), (1,), (1,), (3,), (4,), (64,), (None,)], "failures bigint")
    rows = {(r.policy, r.rule): (r.n_failed, r.n_rejected, r.n_only_this) for r in quality.ablation(ledger).collect()}
    assert rows[1, "few_words"] == (3, 3, 2)
    assert rows[1, "repeated_windows"] == (1, 3, 0)
    assert rows[2, "symbols"] == (1, 4, 1)


@pytest.mark.parametrize("block_bytes", [60, 1 << 20])
def test_search_equals_plain_python(spark, block_bytes):
    rnd = random.Random(5)
    vocabulary = ["a", "b", "é", "cc", "ab", "x1", "Ö"]
    items = [(i, " ".join(rnd.choices(vocabulary, k=rnd.choice([1, 3, 9, 10, 14])))) for i in range(12)] + [(90, None), (None, "a b"), (91, "?!"), (92, "")]
    items += [items[0], (93, items[1][1])]
    texts = [None, "", "...", *(" ".join(rnd.choices(vocabulary, k=rnd.randint(0, 60))) for _ in range(40))]
    texts += [f"{texts[5]}. {items[4][1]}-{items[2][1].upper()}" for _ in range(2)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = decontamination.find_items(docs, spark.createDataFrame(items, "item_id bigint, text string"), block_bytes=block_bytes)
    got = {r.doc_id: (r.found.n_words, sorted(r.found.hits), r.found.items) for r in found.collect()}

    def words(text):
        lower = "".join(c.lower() if c < "\x80" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)

    for doc, text in enumerate(texts):
        own, hits, ids = words(text), set(), set()
        for item, item_text in items:
            if item_text is None:
                continue
            tokens = words(item_text)
            k = min(10, len(tokens))
            for i in range(len(tokens) - k + 1) if k else ():
                for j in range(len(own) - k + 1):
                    if own[j : j + k] == tokens[i : i + k]:
                        hits |= set(range(j, j + k))
                        ids |= {item} - {None}
        assert got[doc] == (len(own), sorted(hits), sorted(ids))
        assert next(r for r in found.collect() if r.doc_id == doc).found.n_hit == len(hits) if doc < 3 else True


def best_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid, used, n = (low + high) // 2, 0, 1
        for s in sizes:
            if used + s > mid:
                used, n = 0, n + 1
            used += s
        low, high = (low, mid) if n <= shards else (mid + 1, high)
    return low


@pytest.mark.parametrize(("n", "shards", "digits", "single"), [(500, 7, 1, 10), (3000, 16, 2, 50), (40, 16, 4, 200_000), (3, 5, 4, 200_000)])
def test_shards_are_the_best_contiguous_ones(spark, monkeypatch, n, shards, digits, single):
    monkeypatch.setattr(sharding, "FIRST_DIGITS", digits)
    monkeypatch.setattr(sharding, "SINGLE", single)
    monkeypatch.setattr(sharding, "REFINED", 5)
    rnd = random.Random(n)
    texts = ["x" * rnd.choice([1, 5, 50, 400]) + str(rnd.randint(0, n)) for _ in range(n)] + ["hot" * 20] * (n // 3) + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = sharding.assign(docs, shards, F.col("text"), F.octet_length(F.coalesce("text", F.lit(""))) + 1, ["doc_id"]).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    where, loads, slots, sizes = {}, {}, {}, {}
    for r in rows:
        key = hashlib.sha256((r.text or "").encode()).hexdigest()
        assert where.setdefault(key, r.shard) == r.shard
        loads[r.shard] = loads.get(r.shard, 0) + r.size
        sizes[key] = sizes.get(key, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    in_order = [where[k] for k in sorted(where)]
    assert in_order == sorted(in_order)
    assert max(loads.values()) == best_capacity([sizes[k] for k in sorted(sizes)], shards)


def test_token_counts_equal_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    counter = token_counts.Counter(token_counts.load_merges(path))
    texts = [t or "" for t in odd_texts()] + ["!!<|endoftext|> y<|endoftext|>", "aaaa" * 999, "it's  we'll  12345"]
    assert counter(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_archives_round_trip_in_chunks(spark):
    payloads = [b"", b"x" * 10, b"x" * 10, bytes(range(256)) * 1200, None, b"\r\n\r\nWARC/1.1\r\n", b"x" * 10]
    keys = [5, 4, 2, 1, 9, None, 2]
    pages = spark.createDataFrame(list(zip(keys, ["http://h/ a\r\nb"] * 6 + [None], payloads)), "id bigint, url string, html binary")
    rows = warc.with_revisits(pages, "id", "html")
    urn = lambda c: F.concat(F.lit("urn:"), F.coalesce(c.cast("string"), F.lit("none")))
    chunks = warc.chunk_rows(
        rows, urn(F.col("id")), F.col("url"), F.col("html"), F.when(F.col("first_key").isNotNull(), urn(F.col("first_key"))), F.col("payload_digest"),
        F.col("payload_bytes"), chunk_bytes=1000,
    )
    back = warc.read_chunks(warc.write_archives(chunks, warc.archive_folder(spark), archive_bytes=3000), chunk_bytes=700).collect()
    whole = {}
    for r in sorted(back, key=lambda r: (r.path, r.record_no, r.chunk_no)):
        record = whole.setdefault((r.path, r.record_no), [r.record_id, r.record_type, r.refers_to, b"", None])
        record[3] += r.data
        assert len(r.data) <= 700 and r.payload_bytes == len(record[3])
        assert r.payload_digest == base64.b32encode(hashlib.sha1(record[3]).digest()).decode()
        if r.is_last:
            record[4] = r.declared_digest
    got = sorted(tuple(map(str, v)) for v in whole.values())
    expected = []
    for key, data in zip(keys, payloads):
        data = data or b""
        first = min((k for k, p in zip(keys, payloads) if (p or b"") == data and k is not None), default=None)
        revisit = key != first
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        expected.append((f"urn:{'none' if key is None else key}", "revisit" if revisit else "response", f"urn:{first}" if revisit else "None", str(b"" if revisit else data), digest))
    assert got == sorted(expected)


def test_damaged_archives_fail():
    def rows(data):
        return list(warc.records(warc.Stream(pa.BufferReader(data)), 100))

    good = b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <a>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    assert [r[7:9] for r in rows(good * 2)] == [(0, b"hello")] * 2
    packed = zlib.compress(good, wbits=31)
    assert len(rows(packed + packed)) == 2
    for bad in (good[:-8], b"junk\r\n", good[:30], packed[:-30]):
        with pytest.raises(ValueError):
            rows(bad)


def test_whole_windows_stay_within_texts():
    first = np.array([0, 0, 3, 3, 8, 9])
    assert ragged.whole_windows(first, 3).tolist() == [0, 3, 4, 5]
    assert ragged.whole_windows(first, 20).tolist() == []
