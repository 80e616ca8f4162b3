"""Contiguous sharding with the smallest possible largest shard.

Atomic groups (rows that must stay together) are ordered by a digest; shards are contiguous stretches of that order. The
smallest feasible capacity is found by binary search, each capacity checked by filling shards greedily.

The search runs on a summary of the order: stretches of groups (by digest prefix) with their total size. Bounds on where
each cut can lie follow from the summary; only stretches that may hold a cut are refined, down to single groups, so the
result is exact while the driver sees a bounded number of totals. All row work is DataFrame code.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridscore.session import scratch_path

#: Leading hex digits of a digest that make the first summary: 16 ** 4 stretches at most.
FIRST_DIGITS = 4
#: Stretches refined at once, and groups up to which they are refined to single groups at once.
REFINED = 4096
SINGLE = 200_000
KEY_DIGITS = 64
#: Row lanes per shard for numbering rows.
LANES = 1024


@dataclass(frozen=True, order=True)
class Stretch:
    """Consecutive groups whose key starts with ``prefix``."""

    prefix: str
    groups: int
    size: int
    largest: int


def summary(groups: DataFrame, digits: int, prefixes: Sequence[str] | None = None) -> list[Stretch]:
    """Totals of the stretches of ``digits`` digits, of the whole order or of the stretches named."""
    if prefixes is not None:
        by_length: dict[int, list[str]] = {}
        for prefix in prefixes:
            by_length.setdefault(len(prefix), []).append(prefix)
        wanted = F.lit(False)
        for n, names in by_length.items():
            wanted = wanted | F.substring("key", 1, n).isin(names)
        groups = groups.where(wanted)
    totals = groups.groupBy(F.substring("key", 1, digits).alias("prefix")).agg(
        F.count("*").alias("groups"), F.sum("size").alias("size"), F.max("size").alias("largest"),
    )
    return [Stretch(*row) for row in totals.collect()]


@dataclass
class Order:
    stretches: list[Stretch]

    def __post_init__(self) -> None:
        self.stretches.sort()
        self.ends = [0]
        for s in self.stretches:
            self.ends.append(self.ends[-1] + s.size)
        self.total = self.ends[-1]

    def low(self, at: int) -> int:
        """A group border at or before ``at`` that is certainly one."""
        return self.ends[bisect_right(self.ends, at) - 1]

    def high(self, at: int) -> int:
        """No group border lies between this and ``at``."""
        if at >= self.total:
            return self.total
        i = bisect_right(self.ends, at) - 1
        return self.ends[i] if self.stretches[i].groups == 1 else at

    def fill(self, capacity: int, shards: int, certain: bool) -> list[int]:
        """Ends of greedily filled shards: lower bounds if ``certain``, else upper bounds."""
        ends = [0]
        for _ in range(shards):
            ends.append((self.low if certain else self.high)(ends[-1] + capacity))
        return ends[1:]

    def smallest(self, shards: int, least: int, certain: bool) -> int:
        """The smallest capacity, from ``least`` on, that fits all groups into ``shards``."""
        low, high = least, max(least, self.total)
        while low < high:
            mid = (low + high) // 2
            if self.fill(mid, shards, certain)[-1] >= self.total:
                high = mid
            else:
                low = mid + 1
        return low


def cuts(groups: DataFrame, shards: int) -> tuple[int, list[str]]:
    """The smallest capacity and the key prefixes at which shards 1, 2, … begin. ``groups``: ``key`` (hex), ``size``."""
    order = Order(summary(groups, FIRST_DIGITS))
    if not order.stretches:
        return 0, []
    largest = max(s.largest for s in order.stretches)
    while True:
        least = max(largest, -(-order.total // shards))
        low, high = order.smallest(shards, least, certain=False), order.smallest(shards, least, certain=True)
        first, last = order.fill(low, shards, certain=True), order.fill(high, shards, certain=False)
        open_ = {}
        for a, b in zip(first, last):
            for i in range(bisect_right(order.ends, a) - 1, min(bisect_right(order.ends, b), len(order.stretches))):
                if order.stretches[i].groups > 1:
                    open_[order.stretches[i].prefix] = order.stretches[i]
        if not open_:
            break
        chosen = sorted(open_.values(), key=lambda s: -s.size)[:REFINED]
        names = {s.prefix for s in chosen}
        few = sum(s.groups for s in chosen) <= SINGLE
        digits = KEY_DIGITS if few else min(len(s.prefix) for s in chosen) + 1
        if not few:
            names = {s.prefix for s in chosen if len(s.prefix) < digits}
        order = Order([s for s in order.stretches if s.prefix not in names] + summary(groups, digits, sorted(names)))
    begins, at = [], 0
    for _ in range(shards - 1):
        at = order.low(at + high)
        if at >= order.total:
            break
        begins.append(order.stretches[order.ends.index(at)].prefix)
    return high, begins


def assign(rows: DataFrame, shards: int, key: Column, size: Column, order_by: Sequence[str], drop: Sequence[str] = ()) -> DataFrame:
    """``rows`` with ``size``, ``shard`` and ``slot`` (0, 1, … within each shard).

    Rows of equal ``key`` (a text or binary column; null counts as empty) stay together. Sizes must not be negative; with
    fewer groups than shards, or one group larger than a fair share, later shards may stay empty. Columns in ``drop`` are left out. Slots follow a hash of
    the ``order_by`` columns, then these columns; repeated rows get slots of their own. Result columns replace columns of
    ``rows`` of the same names. The rows are written once to the shared scratch folder, so no later step depends on a
    lost executor or reads the texts again.
    """
    spark = rows.sparkSession
    path = scratch_path(spark, "shards")
    rows = rows.withColumns({"size": size.cast("bigint"), "_key": F.sha2(F.coalesce(key.cast("binary"), F.lit("").cast("binary")), 256)}).drop(*drop)
    rows.write.parquet(path)
    rows = spark.read.parquet(path)
    groups = rows.groupBy(F.col("_key").alias("key")).agg(F.sum("size").alias("size"))
    groups.write.parquet(f"{path}-groups")
    _, begins = cuts(spark.read.parquet(f"{path}-groups"), shards)
    shard = F.lit(0)
    for begin in begins:
        shard = shard + (F.col("_key") >= begin).cast("int")
    lane = F.pmod(F.xxhash64(*order_by, "_key"), F.lit(LANES)).cast("int")
    placed = rows.withColumns({"shard": shard, "_lane": lane})
    counts = placed.groupBy("shard", "_lane").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_lane").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_lane", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("bigint")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("shard", "_lane").orderBy(*order_by, "_key"))
    numbered = placed.join(offsets, ["shard", "_lane"]).withColumn("slot", F.col("_before") + within - 1)
    return numbered.drop("_lane", "_before", "_key")
