"""Ordered computations cut into small slots against plain loops, with one hot group."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from gridscore.operators import analysis, windows


@pytest.fixture(scope="module")
def rows(spark):
    """A third of all rows has one key; sequence numbers have gaps."""
    rng = random.Random(5)
    data, seq = [], 0
    for _ in range(600):
        seq += rng.choice([1, 1, 2, 7])
        key = "hot" if rng.random() < 0.4 else f"k{rng.randrange(6)}"
        start = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
        data.append((key, seq, start + datetime.timedelta(seconds=seq * 3 - seq % 5), rng.random() < 0.6, rng.choice("abc")))
    return data, spark.createDataFrame(data, "key string, seq bigint, ts timestamp, hit boolean, lane string")


def groups(data):
    result = {}
    for r in sorted(data, key=lambda r: r[1]):
        result.setdefault(r[0], []).append(r)
    return result


@pytest.mark.parametrize("width", [7, 64, 1 << 18])
def test_row_numbers_and_streaks(rows, width):
    data, df = rows
    numbers = {r.seq: r.n for r in windows.row_numbers(df, ["key"], "seq", "n", width).collect()}
    streaks = {r.seq: r.s for r in windows.running_streak(df, ["key"], "seq", F.col("hit"), "s", width).collect()}
    for members in groups(data).values():
        run = 0
        for position, r in enumerate(members, start=1):
            run = run + 1 if r[3] else 0
            assert numbers[r[1]] == position and streaks[r[1]] == run


@pytest.mark.parametrize("width", [5, 1 << 18])
def test_previous_rows(rows, width):
    data, df = rows
    found = {r.seq: r.before for r in windows.previous_rows(df, ["key"], "seq", "seq", 3, "before", width, dense=False).collect()}
    assert len(found) == len(data)
    for members in groups(data).values():
        seqs = [r[1] for r in members]
        for i, seq in enumerate(seqs):
            assert found[seq] == seqs[max(0, i - 3):i]


@pytest.mark.parametrize("slot", [60, 600])
def test_trailing_count_includes_both_ends(rows, slot):
    data, df = rows
    found = {r.seq: r.n for r in windows.trailing_count(df, ["key"], "ts", F.col("hit"), 60, "n", slot).collect()}
    for members in groups(data).values():
        for r in members:
            assert found[r[1]] == sum(o[3] and datetime.timedelta(0) <= r[2] - o[2] <= datetime.timedelta(seconds=60) for o in members)


def test_trailing_count_refuses_short_slots(rows):
    with pytest.raises(ValueError):
        windows.trailing_count(rows[1], ["key"], "ts", F.col("hit"), 60, "n", 30)


def test_round_robin(rows):
    data, df = rows
    lanes = df.withColumn("ord", F.ascii("lane") - 97)
    found = {r.seq: r.position for r in windows.round_robin(lanes, ["key"], "lane", "ord", "seq", 11).collect()}
    for members in groups(data).values():
        queues = {lane: [r[1] for r in members if r[4] == lane] for lane in "abc"}
        order = []
        while any(queues.values()):
            order += [queues[lane].pop(0) for lane in "abc" if queues[lane]]
        assert [found[seq] for seq in order] == list(range(1, len(order) + 1))


def test_latest_and_first_rows(spark):
    df = spark.createDataFrame([("a", 1, 1, "x"), ("a", 2, 1, "y"), ("a", 2, 2, None), ("b", 1, 1, "z")], "k string, t int, seq int, v string")
    assert {(r.k, r.seq, r.v) for r in windows.latest_rows(df, ["k"], ["t", "seq"]).collect()} == {("a", 2, None), ("b", 1, "z")}
    assert {(r.k, r.v) for r in windows.first_rows(df, ["k"], ["t", "seq"]).collect()} == {("a", "x"), ("b", "z")}


@pytest.mark.parametrize("count", [1, 2, 640])
def test_quantiles_by_rank(spark, count):
    rng = random.Random(count)
    values = [round(rng.random() ** 3, 3) for _ in range(count)]
    df = spark.createDataFrame([("all", v) for v in values] + [("all", None)], "g string, v double")
    found = analysis.rank_quantiles(df, "v", (0.1, 0.9, 0.95), ["g"]).first()
    weighed = df.groupBy("g", "v").agg(F.count(F.lit(1)).alias("w"))
    assert analysis.rank_quantiles(weighed, "v", (0.1, 0.9, 0.95), ["g"], weight="w").first() == found
    ordered = sorted(values)
    rank = lambda p: ordered[-int(-((count - 1) * p) // 1)]
    assert (found.p10, found.p90, found.p95) == (rank(0.1), rank(0.9), rank(0.95))
    assert found.median == pytest.approx((ordered[(count - 1) // 2] + ordered[count // 2]) / 2)


def test_buckets_are_left_closed(spark):
    label = analysis.bucketed(F.col("v"), (0.0, 0.05, 0.15), ("low", "mid", "high"), "none")
    df = spark.createDataFrame([(0.0,), (0.0499,), (0.05,), (0.15,), (9.0,), (None,)], "v double")
    assert [r[0] for r in df.select(label).collect()] == ["low", "low", "mid", "high", "high", "none"]


def test_one_to_one_refuses_repeated_keys(spark):
    left = spark.createDataFrame([("a", 1), ("a", 2)], "k string, x int")
    right = spark.createDataFrame([("a", 5)], "k string, y int")
    assert analysis.one_to_one(left.where("x = 1"), right, ["k"]).collect() == [("a", 1, 5)]
    with pytest.raises(Exception, match="occurs more than once"):
        analysis.one_to_one(left, right, ["k"]).collect()


def test_pairs_need_both_sides_ok(spark):
    schema = "source_id string, target_language string, status string, total_penalty bigint, kind string"
    a = spark.createDataFrame([("1", "en", "ok", 5, "use"), ("2", "en", "ok", 1, "use"), ("3", "en", "judge_failed", None, "ignore"), ("4", "en", "ok", 2, "ignore")], schema)
    b = spark.createDataFrame([("1", "en", "ok", 1, "use"), ("2", "en", "ok", 1, "use"), ("3", "en", "ok", 0, "ignore"), ("4", "en", "judge_failed", None, "ignore")], schema)
    found = {(r.dimension, r.value): (r.n, r.a_wins, r.b_wins, r.ties) for r in analysis.paired_breakdown(analysis.pairs(a, b), ["kind"]).collect()}
    assert found == {("overall", None): (2, 0, 1, 1), ("kind", "use"): (2, 0, 1, 1)}
