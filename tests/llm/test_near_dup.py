"""Near duplicates against all pairs, components against a plain search."""

import random

import numpy as np
import pyarrow as pa
import pytest

from gridscore.llm import near_dup
from gridscore.llm.components import components, stored


def plain_components(links, nodes):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("shape", ["chain", "star", "random", "loops", "none"])
def test_components(spark, shape):
    rnd = random.Random(2)
    links = {
        "chain": [(i, i + 1) for i in range(60)],
        "star": [(0, i) for i in range(1, 300)],
        "random": [(rnd.randint(0, 80), rnd.randint(0, 80)) for _ in range(60)],
        "loops": [(1, 1), (2, 3), (3, 2), (2, 3), (None, 4), (5, None)],
        "none": [],
    }[shape]
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    links = [(a, b) for a, b in links if a is not None and b is not None]
    assert found == plain_components(links, {n for link in links for n in link})


def near_texts(seed):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", " \n", "one two", "ONE  two", "one two three four five", "one two three four", "É é", "é É"]
    for size in (8, 40, 120, 300):
        base = rnd.choices(words, k=size)
        for _ in range(30):
            copy = list(base)
            for _ in range(rnd.randint(0, max(1, size // 40))):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            texts.append(" ".join(copy))
        texts += [" ".join(rnd.choices(words, k=size)) for _ in range(20)]
    return texts + texts[:60]


def shingles(text, width=5):
    lower = "".join(c.lower() if c < "\x80" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lower = lower.replace(c, " ")
    words = [w for w in lower.split(" ") if w]
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


@pytest.mark.parametrize(("percent", "small", "levels"), [(85, 24, 8), (80, 24, 8), (80, 4, 8), (85, 24, 4)])
def test_equals_all_pairs(spark, percent, small, levels):
    texts = near_texts(percent + small)
    ids = [None if i == 12 else 1000 - i for i in range(len(texts))]
    docs = spark.createDataFrame(list(zip(ids, texts)) + [(1000 - 20, texts[20])], "doc_id bigint, text string")
    rows = near_dup.near_duplicates(docs, settings=near_dup.Settings(percent=percent, small=small, levels=levels)).collect()
    sets = [shingles(t) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    root = plain_components(links, range(len(sets)))
    members = {}
    for i, r in root.items():
        members.setdefault(r, []).append(ids[i])
    lowest = {r: min((m for m in ms if m is not None), default=None) for r, ms in members.items()}
    expected = sorted((str(ids[i]), len(sets[i]), lowest[root[i]], ids[i] == lowest[root[i]]) for i in [*range(len(texts)), 20])
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id, r.kept) for r in rows) == expected


def family(n, planted, chains, seed=5):
    """``n`` texts of one template, too different to be linked, with close copies of the first ones: ``planted`` alone, ``chains`` of
    five in which each is close to the one before. Also the links."""
    rnd = random.Random(seed)
    base = [f"t{i}" for i in range(110)]

    def edited(words, k):
        words = list(words)
        for at in rnd.sample(range(len(words)), k):
            words[at] = f"x{rnd.random()}"
        return words

    texts, links = [edited(base, 3) for _ in range(n)], []
    for i in range(planted + chains):
        last = i
        for step in range(1 if i < planted else 4):
            copy = list(texts[last])
            copy[1], copy[20 + 18 * step] = (f"y{rnd.random()}" for _ in range(2))
            links.append((last, len(texts)))
            last = len(texts)
            texts.append(copy)
    return [" ".join(words) for words in texts], links


def test_pairs_in_a_large_family_are_found(spark):
    texts, links = family(700, 120, 10)
    number = {}
    sets = [{number.setdefault(s, len(number)) for s in shingles(t)} for t in texts]

    def close(i, j):
        shared = len(sets[i] & sets[j])
        return 100 * shared >= 85 * (len(sets[i]) + len(sets[j]) - shared)

    assert all(close(i, j) for i, j in links)
    links = [(i, j) for i in range(len(sets)) for j in range(i) if close(i, j)]
    root = plain_components(links, range(len(sets)))
    found = near_dup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), settings=near_dup.Settings(percent=85)).collect()
    lowest = {}
    for i, r in root.items():
        lowest[r] = min(lowest.get(r, i), i)
    wrong = [r.doc_id for r in found if r.component_id != lowest[root[r.doc_id]]]
    assert not wrong


@pytest.mark.parametrize("seed", range(6))
def test_shared_shingles_are_counted(monkeypatch, seed):
    monkeypatch.setattr(near_dup, "COLUMNS", 5)
    monkeypatch.setattr(near_dup, "FEW_SETS", [2, 3, 12][seed % 3])
    rnd = np.random.default_rng(seed)
    sets = [np.unique(np.concatenate([[7, 8], rnd.integers(0, 40, rnd.integers(0, 30))])).astype(np.int64) for _ in range([1, 2, 9, 30, 31, 60][seed])]
    found = near_dup.shared_shingles(np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets]), len(sets))
    expected = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    same = ~np.eye(len(sets), dtype=bool)
    assert (found[same] == expected[same]).all()


@pytest.mark.parametrize("block", [7, 50])
def test_nodes_that_do_not_divide_are_compared_in_blocks(spark, block):
    """Sets whose tokens do not tell them apart: the links that come back connect what all pairs would, and are no more than a forest of
    each pair of blocks."""
    rnd = random.Random(block)
    T = near_dup.T
    tokens = [1] * 56 + list(range(8))
    common = list(range(100))
    shingles = {str(i).encode(): sorted({*common, *(rnd.randrange(1000 + 40 * (i % 9), 1040 + 40 * (i % 9)) for _ in range(rnd.choice([12, 18])))}) for i in range(80)}
    rows = [(key, [t + (k if at >= 56 else 0) for at, t in enumerate(tokens)]) for k, key in enumerate(shingles)]
    sets = spark.createDataFrame(rows, T.StructType([T.StructField("key", T.BinaryType()), near_dup.SET["tokens"]]))
    crowd = sets.selectExpr("5L as node", "key", "0L as used")
    roots = spark.createDataFrame([(b"0", b"0"), (b"1", b"0")], "node binary, root binary")
    table = spark.createDataFrame(list(shingles.items()), "key binary, shingles array<bigint>")
    found = near_dup.crowd_links(crowd, roots, sets, lambda keys: stored(table.join(keys.distinct(), "key"), "s"), near_dup.Settings(percent=85, block=block)).collect()
    pairs = [(a, b) for a in shingles for b in shingles if a < b and 100 * len({*shingles[a]} & {*shingles[b]}) >= 85 * len({*shingles[a]} | {*shingles[b]})]
    links = [(bytes(r.a), bytes(r.b)) for r in found]
    assert pairs and set(links) <= set(pairs)
    assert plain_components([*links, (b"0", b"1")], shingles) == plain_components([*pairs, (b"0", b"1")], shingles)
    blocks = -(-80 // block)
    assert len(links) < 80 * blocks


def test_small_nodes_give_forests_of_their_likely_pairs():
    rnd = np.random.default_rng(4)
    nodes, likely, keys = [], [], {}
    for size, away in ((24, 5), (2, 0), (3, 5), (24, 24), (1, 0), (20, 14)):
        base, node = rnd.integers(0, 1000, near_dup.TOKENS), []
        for _ in range(size):
            tokens = base.copy()
            at = rnd.permutation(near_dup.TOKENS)[: rnd.integers(0, away + 1)]
            tokens[at] = rnd.integers(1000, 1 << 30, len(at))
            node.append({"key": b"%d" % rnd.integers(1 << 60), "n_shingles": 100, "tokens": tokens.tolist()})
        nodes.append(node)
        keys |= {m["key"]: m for m in node}
        likely.append([(x["key"], y["key"]) for i, x in enumerate(node) for y in node[:i] if sum(map(int.__eq__, x["tokens"], y["tokens"])) >= 41])
    kind = pa.list_(pa.struct([("key", pa.binary()), ("n_shingles", pa.int64()), ("tokens", pa.list_(pa.int32()))]))
    batch = pa.RecordBatch.from_arrays([pa.array(nodes, kind)], ["members"])
    rows = [r for out in near_dup.compare(iter([batch]), 41, 80) for r in out.to_pylist()]
    every = [link for node in likely for link in node]
    root = plain_components(every, keys)
    assert plain_components([(r["a"], r["b"]) for r in rows], keys) == root
    assert len(rows) == len(keys) - len(set(root.values())) < len(every) / 4  # a forest, not all pairs
    assert all(r["a"] < r["b"] and r["equal"] == sum(map(int.__eq__, keys[r["a"]]["tokens"], keys[r["b"]]["tokens"])) for r in rows)
    size = {r: sum(root[k] == r for k in keys) for r in set(root.values())}
    for r in rows:
        more = sum(root[a] == root[r["a"]] for a, _ in every) > size[root[r["a"]]] - 1
        assert (r["tree"] is not None) == more


def test_trees_that_confirming_leaves_apart_are_compared_on_full_sets(spark):
    """Of a tree's sets, ``a``-``b`` and ``b``-``c`` are no links but ``a``-``c`` is; another tree is in one group already."""
    sets = {b"a": [*range(100)], b"b": [*range(20, 120)], b"c": [*range(98), 200], b"d": [*range(500, 600)], b"e": [*range(500, 601)]}
    trees = spark.createDataFrame([(b"1", b"a"), (b"1", b"b"), (b"1", b"c"), (b"2", b"d"), (b"2", b"e")], "tree binary, key binary")
    roots = spark.createDataFrame([(b"d", b"d"), (b"e", b"d")], "node binary, root binary")
    shingles = spark.createDataFrame(list(sets.items()), "key binary, shingles array<bigint>")
    found = near_dup.tree_links(trees, roots, shingles, near_dup.Settings(percent=85)).collect()
    assert [(bytes(r.a), bytes(r.b)) for r in found] == [(b"a", b"c")]


def test_hubs_meet_parts_and_give_forests(spark):
    """A star: 240 sets alike to the one in the middle only, and so many hubs that sets times hubs would be thousands of rows."""
    rnd = np.random.default_rng(5)
    middle = rnd.integers(0, 1 << 30, near_dup.TOKENS)
    tokens = {b"middle": middle}
    for i in range(240):
        tokens[b"%03d" % i] = np.where(rnd.permutation(near_dup.TOKENS) < 16, rnd.integers(0, 1 << 30, near_dup.TOKENS), middle)
    sets = spark.createDataFrame([(k, 100, t.tolist()) for k, t in tokens.items()], "key binary, n_shingles bigint, tokens array<int>")
    crowd = sets.selectExpr("5L as node", f"{len(tokens)}L as n", "key")
    names = sorted(tokens)
    seen = [(k, b"middle", 64) for k in names[:20]] + [(a, b, 64) for a, b in zip(names[:160], names[1:])]
    candidates = spark.createDataFrame(seen, "a binary, b binary, equal int")
    roots = spark.createDataFrame([(b"000", b"000")], "node binary, root binary")
    found = [(bytes(r.a), bytes(r.b)) for r in near_dup.hub_pairs(crowd, candidates, roots, sets, near_dup.Settings(percent=80)).collect()]
    assert {k for pair in found if b"middle" in pair for k in pair} == set(tokens)
    assert len(found) <= 3 * len(tokens)
