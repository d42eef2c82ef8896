import math
import random

from chalkline.operators.spikes import Fences, Reading, flag_readings, quartiles, sketch

FIELDS = [Reading("a"), Reading("b", zero_is_normal=True)]
SCHEMA = "id bigint, job bigint, layer string, t double, a double, b double"


def series(n=1500, seed=1, level=1.0, start=0.0, first_id=0):
    rnd = random.Random(seed)
    return [[first_id + i, 1, "coarse", start + i * 0.5, level * rnd.uniform(0.9, 1.3), rnd.choice([0.0, 0.0, rnd.uniform(5, 9)])] for i in range(n)]


def flags(spark, rows):
    df = spark.createDataFrame([tuple(r) for r in rows], SCHEMA)
    return {(r.row_id, r.field_name): r.reason for r in flag_readings(df, ["job", "layer"], "t", "id", FIELDS).collect()}


def test_spikes_dropouts_and_impossible_values(spark):
    rows = series()
    rows[10][4], rows[20][4], rows[30][4], rows[40][4], rows[50][4], rows[60][4] = 40.0, 0.05, -1.0, math.nan, math.inf, None
    rows[70][5], rows[80][5] = 900.0, -0.5
    assert flags(spark, rows) == {
        (10, "a"): "spike", (20, "a"): "dropout", (30, "a"): "impossible", (40, "a"): "impossible", (50, "a"): "impossible", (70, "b"): "spike", (80, "b"): "impossible",
    }


def test_stuck_over_hours_nulls_and_spikes_and_copies(spark):
    rows = series(n=16_000)
    # 3600 s lies at row 7200: the stretch runs over the hour's edge, with a null and a spike inside.
    for i in range(7194, 7206):
        rows[i][4] = 1.111
    rows[7198][4], rows[7201][4] = None, 50.0
    rows.append([99_999, *rows[7196][1:]])
    for i in range(100, 106):
        rows[i][4] = 0.999  # six readings: too few
    for i in range(300, 330):
        rows[i][5] = 0.0  # at rest
    got = flags(spark, rows)
    stuck = {i for (i, f), why in got.items() if why == "stuck"}
    assert stuck == set(range(7194, 7206)) - {7198, 7201} | {99_999}
    assert got[7201, "a"] == "spike"


def test_a_stretch_may_span_whole_hours(spark):
    rows = [[i, 1, "x", i * 1200.0, 5.0 if 20 <= i < 40 else 4.0 + (i % 7) / 10, 0.0] for i in range(200)]
    assert {i for i, _ in flags(spark, rows)} == set(range(20, 40))


def test_levels_are_per_source_and_null_sources_count(spark):
    low, high = series(seed=1), series(seed=2, level=100.0, first_id=10_000)
    for r in high:
        r[1] = None
    low[5][4] = 100.0
    assert set(flags(spark, low + high)) == {(5, "a")}


def test_null_times_and_empty(spark):
    rows = series(200)
    rows += [[900 + i, 1, "coarse", None, 1.0, 0.0] for i in range(20)]
    rows[-1][4] = -3.0
    assert set(flags(spark, rows)) == {(919, "a")}
    assert flags(spark, []) == {}


def test_sketches_merge_exactly(spark):
    rnd = random.Random(3)
    values = sorted(rnd.lognormvariate(0, 2) for _ in range(5000))
    df = spark.createDataFrame([(1, v) for v in values], "k int, v double").repartition(7)
    acc = Fences().accuracy
    row = quartiles(sketch(df, ["k"], "v", acc), ["k"], acc).first()
    assert abs(math.exp(row.q1) / values[1249] - 1) <= 0.03 and abs(math.exp(row.q3) / values[3749] - 1) <= 0.03


def test_spikes_in_a_still_stretch_below_the_level_of_activity(spark):
    rnd = random.Random(5)
    # A fifth of the readings is activity at ten times the still level, in stretches of 40.
    rows = [[i, 1, "x", i * 0.5, rnd.uniform(0.9, 1.2) * (10 if 100 <= i % 200 < 140 else 1), 0.0] for i in range(8000)]
    rows[50][4] = 8.0  # one reading at the level of activity
    rows[250][4], rows[251][4] = 9.0, 8.5  # two
    rows[7199][4] = 9.5  # the last of its hour; its neighbour lies in the next
    rows[330][4] = 0.1  # falls out of activity, and below everything
    assert flags(spark, rows) == {(50, "a"): "spike", (250, "a"): "spike", (251, "a"): "spike", (7199, "a"): "spike", (330, "a"): "dropout"}


def test_neighbours_too_far_off_say_nothing_and_one_side_suffices(spark):
    rows = series(800)
    rows[799][4] = 7.0  # the last one: only the readings before it are there
    rows += [[9000, 1, "coarse", 5000.0, 7.0, 0.0]]  # alone: within the fences of the levels
    assert set(flags(spark, rows)) == {(799, "a")}


def test_a_stretch_that_wavers_in_the_last_digits_is_stuck(spark):
    rows = series(2000)
    for i in range(500, 520):
        rows[i][4] = 1.1 * (1 + (i % 3 - 1) * 0.0005)
    rows.append([7777, 1, "coarse", rows[510][3], rows[510][4], None])  # sent twice
    rows.append([7778, 1, "coarse", rows[511][3], 30.0, None])  # another reading of the same time
    got = flags(spark, rows)
    assert {i for (i, f), why in got.items() if why == "stuck"} == set(range(500, 520)) - {511} | {7777}
    assert got[7778, "a"] == "spike"


def test_extra_columns_and_a_constant_source(spark):
    rows = [(i, 1, i * 1.0, 5.0, "x", 1.0) for i in range(30)] + [(100 + i, 2, i * 1.0, 0.0, "x", 1.0) for i in range(30)]
    df = spark.createDataFrame(rows, "id bigint, job bigint, t double, a double, hour string, src double")
    got = flag_readings(df, ["job"], "t", "id", [Reading("a")]).collect()
    assert {(r.row_id, r.reason) for r in got} == {(i, "stuck") for i in [*range(30), *range(100, 130)]}
    assert flag_readings(df, ["job"], "t", "id", [Reading("a", zero_is_normal=True)]).count() == 30
