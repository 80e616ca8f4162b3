"""Ordered computations inside a group that survive a group holding most of the rows.

A plain window sorts one whole group in one task. Here a group is cut along its sequence
column into slots of bounded size; each slot is windowed alone and a small per-slot
summary carries the state across slot borders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLOT_WIDTH = 1 << 18


def row_numbers(
    df: DataFrame, keys: list[str], seq: str | list[str], out: str, width: int = SLOT_WIDTH, facts: DataFrame | None = None, on: list[str] | None = None
) -> DataFrame:
    """``row_number()`` per ``keys`` ordered by the unique integer column ``seq``, or by several columns that are unique
    together, of which the first (an integer) gives the slots.

    Slots span ``width`` values of ``seq``, so no task ever sorts more than ``width`` rows
    of a group. Slot counts are summed to offsets; the join back is on the very columns
    the rows are already partitioned by. ``facts`` about coarser groups (one row per value of
    the key columns ``on``) travel with the offsets, which saves moving the rows to them.
    """
    order = [seq] if isinstance(seq, str) else seq
    slotted = df.withColumn("_slot", F.floor(F.col(order[0]) / F.lit(width)))
    in_slot = Window.partitionBy(*keys, "_slot").orderBy(*order)
    local = slotted.withColumn("_local", F.row_number().over(in_slot))
    before = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        slotted.groupBy(*keys, "_slot")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    if facts is not None:
        offsets = offsets.join(facts, on)
    return (
        local.join(offsets, [*keys, "_slot"])
        .withColumn(out, (F.col("_local") + F.col("_offset")).cast("bigint"))
        .drop("_slot", "_local", "_offset")
    )


def previous_rows(
    df: DataFrame, keys: list[str], seq: str, value: str, depth: int, out: str, width: int = SLOT_WIDTH, dense: bool = True
) -> DataFrame:
    """Array of the ``depth`` values before each row of its group, oldest first.

    With ``dense`` the sequence column counts rows without gaps inside a group; otherwise
    row numbers are computed first. The last ``depth`` rows of a slot are copied to the
    next slot, where they serve as predecessors only.
    """
    position = seq
    if not dense:
        df = row_numbers(df, keys, seq, "_pos", width)
        position = "_pos"
    slot = F.floor(F.col(position) / F.lit(width))
    last_rows = F.pmod(F.col(position), F.lit(width)) >= width - depth
    copies = F.when(last_rows, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    spread = df.select("*", F.explode(copies).alias("_copy")).withColumn("_slot", slot + F.col("_copy"))
    window = Window.partitionBy(*keys, "_slot").orderBy(position).rowsBetween(-depth, -1)
    result = spread.withColumn(out, F.collect_list(value).over(window)).where("_copy = 0")
    return result.drop("_copy", "_slot", *(["_pos"] if not dense else []))


def trailing_count(
    df: DataFrame, keys: list[str], ts: str, counted: Column, seconds: int, out: str, slot_seconds: int = 600
) -> DataFrame:
    """For each row, the counted rows of its group in the last ``seconds`` (both ends inclusive).

    Counted rows are first added up per distinct time, then looked up in time slots; a time
    near the end of a slot is copied to the next one. No task holds more of a group than one
    slot plus its look-back.
    """
    if slot_seconds < seconds:
        raise ValueError("a time slot must be at least as long as the look-back")
    micros = F.unix_micros(F.col(ts))
    per_time = df.groupBy(*keys, micros.alias("_us")).agg(F.count_if(counted).alias("_n"))
    slot_us, back_us = slot_seconds * 1_000_000, seconds * 1_000_000
    near_end = F.pmod(F.col("_us"), F.lit(slot_us)) >= slot_us - back_us
    copies = F.when(near_end & (F.col("_n") > 0), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    spread = per_time.select("*", F.explode(copies).alias("_copy")).withColumn(
        "_slot", F.floor(F.col("_us") / F.lit(slot_us)) + F.col("_copy")
    )
    window = Window.partitionBy(*keys, "_slot").orderBy("_us").rangeBetween(-back_us, 0)
    counts = spread.withColumn(out, F.sum("_n").over(window)).where("_copy = 0").select(*keys, "_us", out)
    return df.withColumn("_us", micros).join(counts, [*keys, "_us"]).drop("_us")


def running_streak(df: DataFrame, keys: list[str], seq: str, hit: Column, out: str, width: int = SLOT_WIDTH) -> DataFrame:
    """Length of the unbroken run of ``hit`` rows that ends at each row of its group."""
    slotted = df.withColumn("_slot", F.floor(F.col(seq) / F.lit(width))).withColumn("_hit", F.coalesce(hit, F.lit(False)))
    in_slot = Window.partitionBy(*keys, "_slot").orderBy(seq)
    breaks = F.sum(F.when(F.col("_hit"), 0).otherwise(1)).over(in_slot.rowsBetween(Window.unboundedPreceding, 0))
    local = slotted.withColumn("_island", breaks)
    in_island = Window.partitionBy(*keys, "_slot", "_island").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    local = local.withColumn("_run", F.sum(F.col("_hit").cast("int")).over(in_island))

    # Per slot: where its last break lies, and how long the run after it is.
    last_break = F.max(F.when(~F.col("_hit"), F.col(seq)))
    summary = (
        slotted.groupBy(*keys, "_slot")
        .agg(last_break.alias("_last"), F.count(F.lit(1)).alias("_rows"))
    )
    tails = (
        slotted.join(summary, [*keys, "_slot"])
        .groupBy(*keys, "_slot", "_last")
        .agg(F.count_if(F.col("_last").isNull() | (F.col(seq) > F.col("_last"))).alias("_tail"))
    )
    over_slots = Window.partitionBy(*keys).orderBy("_slot")
    carried = tails.withColumn("_era", F.count("_last").over(over_slots.rowsBetween(Window.unboundedPreceding, 0)))
    in_era = Window.partitionBy(*keys, "_era").orderBy("_slot").rowsBetween(Window.unboundedPreceding, 0)
    carried = (
        carried.withColumn("_carry_out", F.sum("_tail").over(in_era))
        .withColumn("_carry", F.coalesce(F.lag("_carry_out").over(over_slots), F.lit(0)))
        .select(*keys, "_slot", "_carry")
    )
    value = F.when(F.col("_island") == 0, F.col("_run") + F.col("_carry")).otherwise(F.col("_run"))
    return (
        local.join(carried, [*keys, "_slot"])
        .withColumn(out, value.cast("bigint"))
        .drop("_slot", "_hit", "_island", "_run", "_carry")
    )


def latest_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row per key in ``order``: a map-side combinable maximum, no window."""
    rest = [name for name in df.columns if name not in keys and name not in order]
    best = F.max(F.struct(*order, *rest)).alias("_best") if not rest else F.max_by(F.struct(*order, *rest), F.struct(*order)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_best.{name}").alias(name) for name in [*order, *rest]]).select(df.columns)


def first_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row per key in ``order``."""
    rest = [name for name in df.columns if name not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_best.{name}").alias(name) for name in rest]).select(df.columns)


def round_robin(df: DataFrame, bucket: list[str], lane: str, lane_order: str, seq: str, width: int = SLOT_WIDTH) -> DataFrame:
    """Positions of rows when the lanes of a bucket are served in turn.

    The position follows from the row's number in its lane and the lane sizes alone, so no
    sort over a whole bucket is needed, and its rows never meet in one task. Lanes
    (participants) are a bounded dimension.
    """
    sizes = df.groupBy(*bucket, lane, lane_order).agg(F.count(F.lit(1)).alias("_n"))
    lanes = sizes.groupBy(*bucket).agg(F.collect_list(F.struct(F.col(lane_order).alias("ord"), F.col("_n").alias("n"))).alias("_lanes"))
    numbered = row_numbers(df, [*bucket, lane], seq, "round", width, facts=lanes, on=bucket)
    turn = F.col("round")
    whole_rounds = F.aggregate("_lanes", F.lit(0).cast("bigint"), lambda acc, x: acc + F.least(x["n"], turn - 1))
    this_round = F.size(F.filter("_lanes", lambda x: (x["ord"] < F.col(lane_order)) & (x["n"] >= turn)))
    return numbered.withColumn("position", whole_rounds + this_round + 1).drop("_lanes")
