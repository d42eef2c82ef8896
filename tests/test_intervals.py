import random

import pytest

from chalkline.operators.intervals import gaps_between, merge_intervals, periods_and_gaps

LONG = "k bigint, lo bigint, hi bigint"


def merged(rows, gap=1):
    out = {}
    for k in {r[0] for r in rows}:
        own = sorted((a, b) for kk, a, b in rows if kk == k and a is not None and b is not None and b > a)
        for a, b in own:
            last = out.setdefault(k, [])
            if last and a <= last[-1][1] + gap:
                last[-1][1] = max(last[-1][1], b)
            else:
                last.append([a, b])
    return {(k, a, b) for k, v in out.items() for a, b in v}


@pytest.mark.parametrize("seed", range(4))
def test_periods_are_those_of_a_plain_sweep(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for _ in range(400):
        a = rnd.randrange(0, 3000)
        rows.append((rnd.choice([1, 1, 1, 2, None]), a, a + rnd.choice([0, -3, 1, 5, 40, 100, 101, 350, 900])))
    rows += rows[:50] + [(1, None, 4), (1, 4, None)]
    df = spark.createDataFrame(rows, LONG)
    got = {tuple(r) for r in merge_intervals(df, ["k"], "lo", "hi", 1, shard=100).collect()}
    assert got == merged(rows)


def test_a_bridge_covers_what_lies_inside_its_shards(spark):
    rows = [(1, 50, 950), (1, 310, 320), (1, 940, 1000), (1, 1002, 1003)]
    got = sorted(tuple(r) for r in merge_intervals(spark.createDataFrame(rows, LONG), ["k"], "lo", "hi", 1, shard=100).collect())
    assert got == [(1, 50, 1000), (1, 1002, 1003)]


def test_very_long_intervals_are_not_cut_into_many_rows(spark):
    rows = [(1, 0, 9_000_000_000_000_000), (1, 5, 6)]
    got = [tuple(r) for r in merge_intervals(spark.createDataFrame(rows, LONG), ["k"], "lo", "hi").collect()]
    assert got == [(1, 0, 9_000_000_000_000_000)]


def test_gaps_and_clashing_names(spark):
    rows = [(1, 0.0, 1.0, 7), (1, 1.0005, 2.0, 7), (1, 5.0, 6.0, 7), (1, 4000.0, 4001.0, 7), (1, float("nan"), 3.0, 7), (1, 3.0, float("inf"), 7), (1, 9.0, 9.0, 7)]
    df = spark.createDataFrame(rows, "k bigint, `shard` double, `lo` double, hi int")
    got = sorted(tuple(r) for r in periods_and_gaps(df, ["k"], "shard", "lo").collect())
    assert got == [(1, "gap", 2000, 5000), (1, "period", 0, 2000), (1, "period", 5000, 6000), (1, "period", 4000000, 4001000)]


def test_empty(spark):
    df = spark.createDataFrame([], LONG)
    assert merge_intervals(df, ["k"], "lo", "hi").count() == 0
    assert gaps_between(spark.createDataFrame([], "k bigint, start_ms bigint, end_ms bigint"), ["k"]).count() == 0
