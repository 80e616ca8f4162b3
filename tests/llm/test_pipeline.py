"""The pipeline's stages on a small table with planted cases."""

import random
from collections import Counter

import pytest
import sentencepiece

import corpus_pipeline
from gridscore.llm.components import stored


def prose(rnd, n):
    letters = "abcdefghijklmnopqrstuvwxyzé"
    return " ".join("".join(rnd.choices(letters, k=rnd.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    rnd = random.Random(8)
    folder = str(tmp_path_factory.mktemp("planted"))
    item, passage = prose(rnd, 30), prose(rnd, 60)
    clean = [prose(rnd, 150) for _ in range(20)]
    near = clean[0].split(" ")
    near[70] = "changed"
    rows = list(enumerate(clean))
    rows += [(30, " ".join(near)), (31, clean[1]), (32, prose(rnd, 150) + " " + item), (33, "too short"), (34, "ab " * 300), (35, None), (36, "")]
    rows += [(40 + i, f"{prose(rnd, 80)} {passage} {prose(rnd, 80)}") for i in range(3)] + [(5, clean[5])]
    docs = [(i, t, "en", "s", len(t) if t else None, "more") for i, t in rows]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    results, current = {}, spark.read.parquet(f"{folder}/documents.parquet")
    columns = current.columns
    for name, stage in corpus_pipeline.STAGES:
        current = stored(stage(spark, current, folder), name)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert current.columns == columns
        results[name] = {r.doc_id: r for r in current.collect()}
        assert current.count() - len(results[name]) == (name == "quality_rules")  # the repeated row of document 5 stays so far
    return folder, clean, passage, results, {i: t for i, t in rows}


def test_rules_reject_only_bad_documents(stages):
    _, _, _, results, texts = stages
    assert set(texts) - set(results["quality_rules"]) == {33, 34, 35, 36}


def test_one_of_each_group_stays(stages):
    results = stages[3]
    assert set(results["quality_rules"]) - set(results["minhash_near_dedup"]) == {30, 31}


def without_repeats(texts, length):
    """Texts without the characters whose bytes all lie in byte strings of ``length`` that start twice anywhere."""
    raw = {i: text.encode() for i, text in texts.items()}
    counts = Counter(data[at : at + length] for data in raw.values() for at in range(len(data) - length + 1))
    result = {}
    for i, text in texts.items():
        covered = set()
        for at in range(len(raw[i]) - length + 1):
            if counts[raw[i][at : at + length]] > 1:
                covered.update(range(at, at + length))
        kept, at = [], 0
        for char in text:
            size = len(char.encode())
            if not covered.issuperset(range(at, at + size)):
                kept.append(char)
            at += size
        result[i] = "".join(kept)
    return result


def test_passages_are_cut_and_clean_texts_stay(stages):
    _, clean, passage, results, _ = stages
    rows, before = results["suffix_array_dedup"], results["minhash_near_dedup"]
    expected = without_repeats({i: r.text for i, r in before.items()}, corpus_pipeline.REPEATED_BYTES)
    assert {i: r.text for i, r in rows.items()} == expected
    for i in range(3):
        assert passage[10:-10] not in rows[40 + i].text and rows[40 + i].n_chars == len(rows[40 + i].text)
    assert all(rows[i].text == clean[i] for i in range(3, 20))


def test_contaminated_documents_go(stages):
    results = stages[3]
    assert set(results["suffix_array_dedup"]) - set(results["benchmark_decontamination"]) == {32}


def test_last_stage_encodes(stages):
    results = stages[3]
    library = sentencepiece.SentencePieceProcessor(model_file=__import__("public_tokenizers").path("piece_bpe_32k.model"))
    before, after = results["benchmark_decontamination"], results["sentencepiece_encoding"]
    assert set(before) == set(after)
    assert all(after[i].ids == library.encode(before[i].text) for i in after)


def test_run_gives_the_same(spark, stages):
    assert {r.doc_id for r in corpus_pipeline.run(spark, stages[0]).collect()} == set(stages[3]["sentencepiece_encoding"])
