"""Near duplicates by a chosen-path set similarity join.

Documents are sets of word shingles, embedded as a fixed number of minwise tokens. In each of several independent trees a node
picks one token position (now and then two) from its own path and branches its documents by their token there; a pair of
similarity s follows the same branch with probability s. Nodes that became small are compared exhaustively, larger ones branch
on. Of a small node's pairs that look similar enough only a spanning forest, the most alike first, is written and confirmed on
the full sets, so a group of many near copies costs a few confirmations per copy and never all of its pairs. If that leaves a
tree of the forest in several groups while the node has other likely pairs there, its members are compared on their full sets.

Documents of nodes that stay large for some levels first meet a few of the others only, which connects most of a large group.
Then every tree is gone through again from its first nodes: one that holds documents of more than one group branches until it
is compared exhaustively across these groups, when it became small enough for one task, or as it is, in pairs of blocks, when
branching would not make the comparisons much fewer. Only nodes of one group are left out. Such blocks hold the full sets: a task
compares all pairs exactly and returns a spanning forest of the links between groups, never the pairs.

Equal sets are one class from the start, so copies never meet pair by pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridscore.llm import ragged
from gridscore.llm.components import components, discard, stored

TOKENS = 64
#: Sets up to which the pairs of a shingle are counted one by one within a block, and shingles of one matrix.
FEW_SETS, COLUMNS = 12, 2048


@dataclass(frozen=True)
class Settings:
    percent: int = 80  # link if 100 * intersection >= percent * union
    shingle: int = 5
    trees: int = 12
    small: int = 24  # nodes compared exhaustively
    levels: int = 4  # after which larger nodes are first connected by leaders, parts and hubs
    leaders: int = 4  # random documents that all others of a node still large after these levels are compared with
    hubs: int = 16  # of a node still large after these levels, so many documents are compared with all others
    block: int = 1000  # nodes compared on full sets by one task after that; larger ones branch on or are cut into blocks

    @property
    def least_equal(self) -> int:
        """Equal tokens below which a pair is not worth confirming: 4.5 deviations under the expectation at the threshold."""
        p = self.percent / 100
        return int(TOKENS * p - 4.5 * (TOKENS * p * (1 - p)) ** 0.5)


SET = T.StructType([
    T.StructField("n_shingles", T.LongType(), False),
    T.StructField("key", T.BinaryType(), False),  # digest of the set; empty for an empty set
    T.StructField("tokens", T.ArrayType(T.IntegerType(), False), False),
])
SHINGLES = T.StructType([SET["key"], T.StructField("shingles", T.ArrayType(T.LongType(), False), False)])
#: ``tree`` names the members of a tree of the forest, if the node has more likely pairs among them than the tree.
PAIR = T.StructType([
    T.StructField("a", T.BinaryType(), False), T.StructField("b", T.BinaryType(), False), T.StructField("equal", T.IntegerType(), False),
    T.StructField("tree", T.BinaryType(), True),
])

_SEEDS = np.random.default_rng(7).integers(0, 1 << 63, (2, TOKENS), dtype=np.uint64)


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle fingerprints of each text."""
    batch = ragged.texts(column)
    batch = ragged.Texts(ragged.LOWER[batch.data], batch.offsets)
    words = ragged.runs(batch, ragged.SPACED_WORD)
    prints = ragged.fingerprints(batch.data, words)
    windows = ragged.window_prints(prints, width)
    sets = []
    for start, stop in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        n = stop - start
        if n >= width:
            sets.append(np.unique(windows[start : stop - width + 1]))
        else:
            # Short texts: the whole sequence, told apart from longer ones by its number of words.
            sets.append(ragged.window_prints(prints[start:stop], n) ^ np.uint64(n) if n else np.zeros(0, np.uint64))
    return sets


def digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest() if len(values) else b""


def minwise(sets: Sequence[np.ndarray]) -> np.ndarray:
    """``TOKENS`` 32-bit minwise tokens of each non-empty set."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    tokens = np.empty((len(sets), TOKENS), np.int32)
    for t in range(TOKENS):
        least = np.minimum.reduceat((flat ^ _SEEDS[0, t]) * (_SEEDS[1, t] | np.uint64(1)), starts)
        tokens[:, t] = (ragged.mixed(least) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return tokens


def compute_sets(width: int):
    def compute(column: pa.Array) -> list[pa.Array]:
        sets = shingle_sets(column, width)
        sizes = np.array([len(s) for s in sets], np.int64)
        full = [s for s in sets if len(s)]
        tokens = minwise(full).ravel() if full else np.zeros(0, np.int32)
        offsets = np.append(0, np.cumsum(np.where(sizes > 0, TOKENS, 0))).astype(np.int32)
        return [pa.array(sizes), pa.array([digest(s) for s in sets], pa.binary()), pa.ListArray.from_arrays(offsets, tokens)]

    return compute


def compute_shingles(width: int):
    def compute(column: pa.Array) -> list[pa.Array]:
        sets = shingle_sets(column, width)
        offsets = np.append(0, np.cumsum([len(s) for s in sets])).astype(np.int32)
        flat = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
        return [pa.array([digest(s) for s in sets], pa.binary()), pa.ListArray.from_arrays(offsets, flat)]

    return compute


def choices(nodes: DataFrame, percent: int) -> DataFrame:
    """``node``, ``position``, ``used`` of the children of nodes (node, used): one token position chosen by the path, and a second
    one as often as keeps one of ``percent`` similar pairs alive per level. ``used`` has a bit for each position of a path; no
    position is taken twice on it."""
    free = F.filter(F.sequence(F.lit(0), F.lit(TOKENS - 1)), lambda p: F.getbit("used", p) == 0)
    drawn = lambda left, salt: F.element_at(left, (F.pmod(F.xxhash64("node", F.lit(salt)), F.size(left)) + 1).cast("int"))
    first = nodes.select("node", "used", free.alias("free")).where("size(free) > 1").withColumn("p", drawn(F.col("free"), "first"))
    second = F.pmod(F.xxhash64("node", F.lit("second")), F.lit(percent)) < 100 - percent
    both = F.when(second, F.array("p", drawn(F.array_remove("free", F.col("p")), "other"))).otherwise(F.array("p"))
    return first.select("node", "used", F.explode(both).alias("position")).withColumn("used", F.expr("used | shiftleft(1L, position)"))


def branched(rows: DataFrame, nodes: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """Rows (parent, node, used, ...) of the children of ``nodes``, a few of the nodes of rows (node, key, ...)."""
    chosen = choices(nodes, settings.percent)
    child = F.xxhash64("node", "position", F.element_at("tokens", F.col("position") + 1))
    carry = [c for c in rows.columns if c not in ("parent", "node", "used")]
    joined = rows.drop("parent", "used").join(chosen, "node").join(sets.select("key", "tokens"), "key")
    return joined.select(F.col("node").alias("parent"), child.alias("node"), "used", *carry)


def spanning_forest(n: int, i: np.ndarray, j: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the edges ``i``-``j`` between ``n`` places a spanning forest takes, those that come first in ``order`` before others;
    and a place of its tree for each place."""
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    label, taken = np.arange(n), np.zeros(len(order), bool)
    live = np.arange(len(order))
    while True:
        live = live[label[i[live]] != label[j[live]]]
        if not len(live):
            return taken, label
        # Each tree takes its first edge to another one; two that take the same edge hang on the smaller of them.
        best = np.full(n, len(order))
        for ends in (i, j):
            np.minimum.at(best, label[ends[live]], rank[live])
        trees = np.flatnonzero(best < len(order))
        edge = order[best[trees]]
        taken[edge] = True
        parent = np.arange(n)
        parent[trees] = label[i[edge]] + label[j[edge]] - trees
        both = trees[(parent[parent[trees]] == trees) & (trees < parent[trees])]
        parent[both] = both
        while (parent[parent] != parent).any():
            parent = parent[parent]
        label = parent[label]


def compare(batches: Iterator[pa.RecordBatch], least: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Of the pairs of each small node whose sizes and tokens allow the similarity, a spanning forest of the most equal tokens."""
    for batch in batches:
        members = batch.column("members")
        flat, first = members.flatten(), np.diff(members.offsets.to_numpy())
        node = np.repeat(np.arange(len(first)), first)
        keys = flat.field("key")
        size = flat.field("n_shingles").to_numpy()
        width = np.frombuffer(flat.field("tokens").flatten().to_numpy(), np.int32).reshape(-1, TOKENS)
        found = []
        for step in range(1, int(first.max(initial=1))):
            i = np.flatnonzero(node[step:] == node[:-step])
            j = i + step
            fit = percent * np.maximum(size[i], size[j]) <= 100 * np.minimum(size[i], size[j])
            i, j = i[fit], j[fit]
            equal = (width[i] == width[j]).sum(1)
            fit = equal >= least
            found.append(np.stack([i[fit], j[fit], equal[fit]]))
        i, j, equal = np.concatenate(found, 1) if found else np.zeros((3, 0), np.int64)
        names = keys.to_pylist()
        place = np.empty(len(keys), np.int64)
        place[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
        i, j = np.where(place[i] <= place[j], i, j), np.where(place[i] <= place[j], j, i)
        # Ties go by the keys, so that trees of other positions take the same pairs.
        taken, label = spanning_forest(len(keys), i, j, np.lexsort((place[j], place[i], -equal)))
        some = {}
        for at in np.flatnonzero(np.bincount(label[i[~taken]], minlength=len(keys))).tolist():
            some[at] = []
        for at, own in enumerate(label.tolist()):
            if own in some:
                some[own].append(names[at])
        named = {at: hashlib.blake2b(b"".join(sorted(group)), digest_size=16).digest() for at, group in some.items()}
        i, j, equal = i[taken], j[taken], equal[taken]
        yield pa.RecordBatch.from_arrays([
            keys.take(pa.array(i)), keys.take(pa.array(j)), pa.array(equal.astype(np.int32)), pa.array([named.get(own) for own in label[i].tolist()], pa.binary()),
        ], PAIR.names)


def candidates(classes: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame, DataFrame | None, DataFrame | None]:
    """Distinct pairs ``a`` < ``b`` of class keys that forests of small nodes hold, with their number of equal tokens; the rows
    (tree, key) of trees that small first nodes have more likely pairs of; the rows (node, key, used, n) of nodes that are still
    large after the last of ``levels``; and those of large first nodes."""
    sets = classes.select("key", "n_shingles", "tokens")
    roots = F.explode(F.sequence(F.lit(1), F.lit(settings.trees)))
    rows = sets.select("key", "tokens", roots.alias("tree")).withColumn("position", F.pmod(F.col("tree") * 5, F.lit(TOKENS))).select(
        "key", F.xxhash64("tree", F.element_at("tokens", F.col("position") + 1)).alias("node"), F.expr("shiftleft(1L, position)").alias("used"),
    )
    pairs, used, crowd, large_first = [], [], None, None
    levels = min(settings.levels, TOKENS - 2)  # the root and each level take a position
    for level in range(1, levels + 1):
        rows = stored(rows, "nodes")
        counts = stored(rows.groupBy("node").agg(F.count("*").alias("n"), F.first("used").alias("used")).where("n > 1"), "counts")
        used += [rows, counts]
        pairs.append(exhausted(rows.join(counts.where(F.col("n") <= settings.small), "node"), sets, settings))
        large = counts.where(F.col("n") > settings.small)
        if large.isEmpty():
            break
        if level == 1:
            large_first = stored(rows.join(large.select("node", "n"), "node"), "large_first")
        if level < levels:
            rows = branched(rows, large, sets, settings).drop("parent")
            continue
        crowd = stored(rows.join(large.select("node", "n"), "node"), "crowd")
        # Each document meets the node's leaders and the others of a random small part; other trees draw other parts.
        part = F.pmod(F.xxhash64("key", "node"), F.ceil(2 * F.col("n") / settings.small))
        parted = crowd.select("node", part.alias("part"), "key")
        drawn = crowd.groupBy("node").agg(*[F.min(F.struct(F.xxhash64("key", F.lit(k)), "key")).key.alias(f"k{k}") for k in range(settings.leaders)])
        leaders = drawn.select("node", F.explode(F.array(*[f"k{k}" for k in range(settings.leaders)])).alias("key"))
        led = parted.select("node", "part").distinct().join(leaders, "node").select("node", "part", "key")
        pairs.append(exhausted(parted.union(led).distinct().select(F.xxhash64("node", "part").alias("node"), "key"), sets, settings))
    # All likely pairs of large first nodes are compared in the end, whatever their parts leave.
    found = pairs[0]
    for more in pairs[1:]:
        found = found.union(more.withColumn("tree", F.lit(None).cast("binary")))
    found = stored(found.where("a <> b"), "forests")
    result = stored(found.groupBy("a", "b").agg(F.max("equal").alias("equal")), "pairs")
    trees = stored(found.where("tree is not null").select("tree", F.explode(F.array("a", "b")).alias("key")).distinct(), "trees")
    discard(*used, found)
    return result, trees, crowd, large_first


def exhausted(rows: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """A forest of the pairs of each (small) node of rows (node, key) that are worth confirming."""
    members = rows.select("node", "key").join(sets, "key")
    grouped = members.groupBy("node").agg(F.collect_list(F.struct("key", "n_shingles", "tokens")).alias("members")).select("members")
    return grouped.mapInArrow(lambda batches: compare(batches, settings.least_equal, settings.percent), PAIR)


def hub_pairs(crowd: DataFrame, candidates: DataFrame, roots: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """In nodes that no token divides: documents that are still apart from the node's hubs, with what they are most alike among
    these and a small part of the others. Hubs are the documents with the most candidates whose estimate reaches the threshold.

    Of very many copies of one original each may be similar to the original alone, which is then such a hub. The hubs join every
    part of the node, and each part gives a forest: documents times hubs are compared, but never rows.
    """
    likely = candidates.where(100 * F.col("equal") >= settings.percent * TOKENS)
    ends = likely.select(F.col("a").alias("key")).union(likely.select(F.col("b").alias("key")))
    degrees = ends.groupBy("key").agg(F.count("*").alias("degree"))
    placed = crowd.select("node", "n", "key").join(roots.withColumnRenamed("node", "key"), "key", "left").join(degrees, "key", "left")
    placed = stored(placed.select("node", "n", "key", F.coalesce("root", "key").alias("root"), F.coalesce("degree", F.lit(0)).alias("degree")), "placed")
    slot = F.pmod(F.xxhash64("key"), F.lit(settings.hubs))
    best = placed.where("degree > 0").groupBy("node", slot.alias("slot")).agg(F.max(F.struct("degree", "key", "root")).alias("hub"))
    hubs = stored(best.select("node", F.col("hub.key").alias("key"), F.col("hub.root").alias("root")), "hubs")
    spread = hubs.groupBy("node").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    part = F.pmod(F.xxhash64("key", "node", F.lit("hubs")), F.ceil(2 * F.col("n") / settings.small))
    apart = stored(placed.join(spread, "node").where("root <> low or root <> high").select("node", part.alias("part"), "key"), "apart")
    led = apart.select("node", "part").distinct().join(hubs.select("node", "key"), "node").select("node", "part", "key")
    found = exhausted(apart.union(led).distinct().select(F.xxhash64("node", "part").alias("node"), "key"), sets, settings).select("a", "b").distinct()
    a, b = (roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")) for x in "ab")
    between = found.join(a, "a", "left").join(b, "b", "left").where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b"))
    result = stored(between.select("a", "b"), "hub_pairs")
    discard(placed, hubs, apart)
    return result


def shared_shingles(flat: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """How many shingles each two of ``n`` sets share; ``flat`` are the shingles of all sets, ``owner`` the sets they are of."""
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = np.full((n, n), np.count_nonzero(count == n), np.float32)
    # Shingles of a few sets are counted pair by pair, those of many by matrix products, those of all and of one set not at all.
    light = (count > 1) & (count <= FEW_SETS) & (count < n)
    here = light[column]
    order = np.argsort(column[here], kind="stable")
    of, col = owner[here][order], column[here][order]
    for step in range(1, min(FEW_SETS, n)):
        same = np.flatnonzero(col[step:] == col[:-step])
        for i, j in ((of[same], of[same + step]), (of[same + step], of[same])):
            np.add.at(shared, (i, j), np.float32(1))
    heavy = (count > FEW_SETS) & (count < n)
    number = np.cumsum(heavy) - 1
    here = heavy[column]
    order = np.argsort(number[column[here]], kind="stable")
    of, col = owner[here][order], number[column[here]][order]
    for start in range(0, int(heavy.sum()), COLUMNS):
        part = slice(*np.searchsorted(col, [start, start + COLUMNS]))
        matrix = np.zeros((n, min(COLUMNS, int(heavy.sum()) - start)), np.float32)
        matrix[of[part], col[part] - start] = 1
        shared += matrix @ matrix.T
    return shared


def block_links(percent: int):
    """The links of one block, or of two blocks with each other, that connect what was in different groups: a spanning forest, so
    never more than it has rows. All pairs are compared on their full sets."""

    def links(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        keys, sets = table.column("key").combine_chunks(), table.column("shingles").combine_chunks()
        block, sizes = table.column("block").to_numpy(), np.diff(sets.offsets.to_numpy())
        label = table.column("root").combine_chunks().dictionary_encode().indices.to_numpy().copy()
        n = len(keys)
        shared = shared_shingles(sets.flatten().to_numpy(), np.repeat(np.arange(n), sizes), n)
        fit = 100 * shared >= percent * (sizes[:, None] + sizes - shared)
        if block.min() != block.max():
            fit &= block[:, None] != block
        first, second = [], []
        for i in range(n):
            near = np.flatnonzero(fit[i])
            near = near[label[near] != label[i]]
            for j in near[np.unique(label[near], return_index=True)[1]]:
                first.append(i)
                second.append(j)
            label[np.isin(label, label[near])] = label[i]
        return pa.table([keys.take(pa.array(first, pa.int64())), keys.take(pa.array(second, pa.int64()))], ["a", "b"])

    return links


def blocked(rows: DataFrame, nodes: DataFrame, shingles: DataFrame, settings: Settings) -> DataFrame:
    """What ``block_links`` finds in the ``nodes`` (node, n) of rows (node, key, root); nodes of more than a block are dealt out as
    pairs of blocks."""
    blocks = F.ceil(F.col("n") / settings.block).cast("int")
    dealt = rows.join(nodes.select("node", blocks.alias("blocks")), "node").withColumn("block", F.pmod(F.xxhash64("key", "node"), F.col("blocks")).cast("int"))
    met = dealt.select("node", "key", "root", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    part = F.xxhash64("node", F.least("block", "other"), F.greatest("block", "other")).alias("part")
    return met.select(part, "key", "root", "block").join(shingles, "key").groupBy("part").applyInArrow(block_links(settings.percent), "a binary, b binary")


def crowd_links(large_first: DataFrame, roots: DataFrame, sets: DataFrame, shingles_of, settings: Settings) -> DataFrame:
    """Links between different groups that large first nodes bring together: these branch until they are in blocks.

    A node that branching hardly divides is compared as it is, which finds all of its links: its children would need more than
    four fifths of its comparisons. What stays quadratic in such a node is arithmetic within tasks, not rows.
    """
    rows = large_first.select("node", "key", "used").join(roots.withColumnRenamed("node", "key"), "key", "left")
    rows = stored(rows.select(F.lit(0).cast("bigint").alias("parent"), "node", "used", "key", F.coalesce("root", "key").alias("root")), "crowd_rows")
    mixed = lambda rows: stored(rows.groupBy("parent", "node").agg(
        F.first("used").alias("used"), F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"),
    ).where("low <> high").drop("low", "high"), "crowd_nodes")
    nodes, links = mixed(rows), []
    shingles = shingles_of(rows.join(nodes.select("node"), "node").select("key"))
    used = [rows, nodes, shingles]
    while True:
        whole = (F.col("n") <= settings.block) | (F.bit_count("used") >= TOKENS - 1)
        links.append(blocked(rows, nodes.where(whole), shingles, settings))
        large = nodes.where(~whole)
        if large.isEmpty():
            break
        children = stored(branched(rows, large, sets, settings), "crowd_rows")
        below = mixed(children)
        work = below.groupBy(F.col("parent").alias("node")).agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("work"))
        judged = stored(large.join(work, "node", "left").withColumn("divided", F.coalesce("work", F.lit(0.0)) <= 0.8 * F.col("n") * F.col("n")), "judged")
        links.append(blocked(rows, judged.where("not divided"), shingles, settings))
        going = judged.where("divided").select(F.col("node").alias("parent"))
        rows = children
        nodes = stored(below.join(going, "parent"), "crowd_nodes")
        used += [children, below, judged, nodes]
    found = links[0]
    for more in links[1:]:
        found = found.union(more)
    result = stored(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "crowd_links")
    discard(*used)
    return result


def confirmed(pairs: DataFrame, shingles: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    left = shingles.select(F.col("key").alias("a"), F.col("shingles").alias("x"))
    right = shingles.select(F.col("key").alias("b"), F.col("shingles").alias("y"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(100 * shared >= percent * (F.size("x") + F.size("y") - shared)).select("a", "b")


def tree_links(trees: DataFrame, roots: DataFrame, shingles: DataFrame, settings: Settings) -> DataFrame:
    """Links between different groups within the ``trees`` (tree, key) that are not in one group: all pairs on full sets."""
    rows = trees.join(roots.withColumnRenamed("node", "key"), "key", "left").select("tree", "key", F.coalesce("root", "key").alias("root"))
    rows = stored(rows, "tree_rows")
    mixed = rows.groupBy("tree").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("tree")
    met = rows.join(mixed, "tree").select("tree", "key", "root", F.lit(0).alias("block")).join(shingles, "key")
    found = met.groupBy("tree").applyInArrow(block_links(settings.percent), "a binary, b binary")
    result = stored(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "tree_links")
    discard(rows)
    return result


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``.

    Words are cut at ASCII white space, A-Z lower-cased; a text of fewer words than a shingle is one shingle. Null, empty
    and blank texts have no shingles and are alone. ``component_id`` is the smallest id that confirmed links and equal sets
    reach, ``kept`` whether it is the row's own. Rows without an id count as copies only: they take the component of
    their group, or null if no member has an id. Rows that repeat an id are kept or not together. Texts are read whole.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    known = stored(ragged.annotate(rows, "text", SET, compute_sets(settings.shingle), ["doc_id"], "set").select("doc_id", "set.*"), "sets")
    full = known.where("n_shingles > 0")
    first = full.groupBy("key").agg(F.min("doc_id").alias("first_id"))
    classes = stored(
        full.join(first.withColumnRenamed("key", "k"), (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("first_id"))).groupBy("key").agg(
            F.first("first_id").alias("first_id"), F.first("n_shingles").alias("n_shingles"), F.first("tokens").alias("tokens"),
        ), "classes",
    )
    pairs, trees, crowd, large_first = candidates(classes, settings)
    ends = lambda pairs: pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key")))

    def shingles_of(keys: DataFrame) -> DataFrame:
        wanted = keys.distinct().join(classes, "key").select("first_id", F.col("key").alias("wanted"))
        found = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("first_id")))
        read = ragged.annotate(found, "text", SHINGLES, compute_shingles(settings.shingle), ["wanted"], "s").where("s.key = wanted").select("s.*")
        return stored(read.dropDuplicates(["key"]), "shingles")

    shingles = shingles_of(ends(pairs).union(crowd.select("key")) if crowd is not None else ends(pairs))
    links = stored(confirmed(pairs, shingles, settings.percent), "links")
    roots = stored(components(links), "roots")
    fresh = tree_links(trees, roots, shingles, settings)
    used = [pairs, trees, shingles, links, roots, fresh]
    if crowd is not None:
        apart = hub_pairs(crowd, pairs, roots, classes.select("key", "n_shingles", "tokens"), settings)
        used += [crowd, apart, fresh := stored(fresh.union(confirmed(apart, shingles, settings.percent)), "links")]
    if not fresh.isEmpty():
        links = links.union(fresh)
        roots = stored(components(links), "roots")
        used.append(roots)
    if large_first is not None:
        fresh = crowd_links(large_first, roots, classes.select("key", "tokens"), shingles_of, settings)
        used += [large_first, fresh]
        if not fresh.isEmpty():
            roots = stored(components(links.union(fresh)), "roots")
            used.append(roots)
    member = classes.select("key", "first_id").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    lowest = member.groupBy("root").agg(F.min("first_id").alias("component_id"))
    placed = stored(member.join(lowest, "root").select("key", "component_id"), "members")
    discard(*used, classes)
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    result = known.select("doc_id", "n_shingles", "key").join(placed, "key", "left")
    return result.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
