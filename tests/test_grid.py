import math
import random

from chalkline.operators.grid import complete_grid

SCHEMA = "job bigint, t double, a double, m double, slot string"


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return {(r.job, r.field_name, r.slot): r for r in complete_grid(df, ["job"], "t", ["a", "m"]).collect()}


def test_every_second_once_observed_exact_gaps_marked(spark):
    rows = [(1, 0.2, 1.0, 2.0, "x"), (1, 0.7, 3.0, None, "x"), (1, 1.5, None, 4.0, "x"), (1, 60.0, math.nan, -1.0, "x"), (1, 9000.0, 1.0, 1.0, "x"), (None, 5.0, 2.0, 2.0, "x")]
    got = run(spark, rows + rows[:1])
    assert len(got) == 2 * (61 + 1 + 1)
    assert got[1, "a", 0].value == (1.0 + 3.0 + 1.0) / 3 and got[1, "a", 0].status == "observed"
    assert got[1, "m", 1].value == 4.0
    assert got[1, "a", 1].status == "filled" and got[1, "a", 1].value > 0
    assert got[1, "a", 30].status == "unsupported" and got[1, "a", 30].value is None
    assert got[1, "m", 60].status == "unsupported"
    assert got[None, "a", 5].status == "observed"


def test_filling_beats_the_mean(spark):
    rnd = random.Random(5)
    truth, rows = {}, []
    for s in range(4000):
        busy = 1.0 if (s // 20) % 3 == 0 else 0.1
        a, m = busy * rnd.uniform(0.8, 1.2), busy * rnd.uniform(0.9, 1.1)
        truth[s] = a
        rows.append((1, s + 0.4, None if s % 7 == 3 else a, m, "x"))
    got = run(spark, rows)
    hidden = [s for s in truth if s % 7 == 3]
    mean = sum(truth.values()) / len(truth)
    error = sum(abs(got[1, "a", s].value - truth[s]) for s in hidden)
    plain = sum(abs(mean - truth[s]) for s in hidden)
    assert all(got[1, "a", s].status == "filled" for s in hidden)
    assert error < 0.5 * plain


def test_shard_edges_make_no_difference(spark):
    rows = [(1, float(s), 1.0 + s % 2, 2.0, "x") for s in range(3590, 3612) if s not in (3599, 3600)]
    got = run(spark, rows)
    assert sorted({k[2] for k in got}) == list(range(3590, 3612))
    assert got[1, "a", 3599].status == got[1, "a", 3600].status == "filled"


def test_empty(spark):
    assert run(spark, []) == {}
