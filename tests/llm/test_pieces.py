"""Encoding equals the library's and decoding brings texts back."""

import random
import tracemalloc

import public_tokenizers
import pyarrow as pa
import sentencepiece

from gridscore.llm import pieces, queries

PATH = public_tokenizers.path("piece_bpe_32k.model")


def encode(texts):
    ids, offsets = pieces.encode(pa.array(texts, pa.string()), pieces.load_vocabulary(PATH))
    return [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])]


def odd_texts():
    rnd = random.Random(9)
    letters = [chr(x) for x in (*range(0, 128), *range(0x80, 0x200), *range(0x2000, 0x2070), 0x2581, 0x3000, 0x4E00, 0x1F600, 0x300, 0xE000)]
    letters += [" "] * 40 + ["the", "tion", " an", "aaa", "rr"] * 10
    texts = ["", " ", "    ", "a" * 2000, " aaaa aaaaa  aaaaaaa", "x" + " " * 50 + "y"]
    return texts + ["".join(rnd.choices(letters, k=rnd.randint(0, 70))) for _ in range(1500)]


def test_ids_equal_the_library():
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = odd_texts()
    assert encode(texts) == library.encode(texts)
    assert encode([None, "a", None]) == [[], library.encode("a"), []]
    assert encode([]) == []


def test_distinct_words_in_several_parts(monkeypatch):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = odd_texts()[:300]
    for size in (1, 50, 3000):
        monkeypatch.setattr(pieces, "WORD_BYTES", size)
        assert encode(texts) == library.encode(texts)


def test_memory_does_not_follow_the_distinct_words_of_a_text():
    vocabulary = pieces.load_vocabulary(PATH)
    rnd = random.Random(3)
    text = pa.array([" ".join("".join(rnd.choices("etaoinshrdlu", k=7)) for _ in range(200_000))])
    tracemalloc.start()
    pieces.encode(text, vocabulary)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 180 << 20


def test_decoding_brings_texts_back():
    vocabulary = pieces.load_vocabulary(PATH)
    texts = odd_texts()
    ids = pa.array([None, *encode(texts)], pa.list_(pa.int32()))
    assert pieces.decode(ids, vocabulary) == ["", *(t.replace(pieces.BLANK, " ") for t in texts)]
    assert pieces.decode(ids.slice(5, 3), vocabulary) == [t.replace(pieces.BLANK, " ") for t in texts[4:7]]


def test_matches_finds_every_occurrence():
    import numpy as np

    text = b"abracadabra\xffabra"
    found = pieces.matches(np.frombuffer(text, np.uint8), [b"a", b"abra", b"zz", b"abracadabra"])
    expected = {(i, k) for k, p in enumerate([b"a", b"abra", b"zz", b"abracadabra"]) for i in range(len(text)) if text.startswith(p, i)}
    assert set(zip(*(x.tolist() for x in found))) == expected


def test_query_round_trips(spark):
    rows = queries.QUERIES["op9_suffix_array_pieces"](spark, "/root/testdata/sf0.001").collect()
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        assert r.round_trip and r.ids == library.encode(texts[r.doc_id]) and r.n_bytes == len(texts[r.doc_id].encode())
