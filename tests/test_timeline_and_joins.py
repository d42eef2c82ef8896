import math
import random

import pytest
from pyspark.sql import functions as F

from chalkline.operators import joins, rules, scenes
from chalkline.operators.sequence import sittings, with_next
from chalkline.operators.timeline import COLUMNS, layer_merge, timeline
from helpers import SCHEMA, row


def features(spark, rows):
    """Raw rows: (row_id, job, layer, t, view, motion)."""
    base = spark.createDataFrame(rows, "row_id bigint, job_id bigint, layer string, t double, view_type string, motion_raw double")
    kinds = {f.split()[0]: f.split()[1] for f in SCHEMA.split(", ")}
    return base.select(*[F.col(c) if c in base.columns else F.lit(None).cast(kinds[c]).alias(c) for c in COLUMNS])


def test_dense_rows_win_and_defaults_fill(spark):
    rows = [(1, 1, "coarse", 1.0, "MainTable", 0.1), (2, 1, "dense", 1.00001, None, 0.2), (3, 1, "dense", 1.0, "x", None), (4, 1, "coarse", 2.0, "", math.nan), (5, 1, "coarse", None, "", 1.0), (6, None, "dense", 1.0, "replay", math.inf)]
    assert layer_merge(features(spark, rows)).count() == 3
    got = {(r.job_id, r.t): r for r in timeline(features(spark, rows)).collect()}
    assert set(got) == {(1, 1.0), (1, 2.0), (None, 1.0)}
    assert got[1, 1.0].layer == "dense" and got[1, 1.0].motion_raw == 0.0 and got[1, 1.0].view_type == "other" and got[1, 1.0].table_observable
    assert got[None, 1.0].view_type == "replay" and got[None, 1.0].motion_raw == 0.0 and got[None, 1.0].sitting == 1000
    assert timeline(features(spark, rows[:0])).count() == 0


def test_sittings_end_with_a_pause(spark):
    df = spark.createDataFrame([(1, x) for x in (0, 3_599_999, 3_600_000, 7_199_999, 10_799_999, 10_800_000, 99_000_000)] + [(2, 5)], "k int, ms bigint")
    got = {(r.k, r.sitting, r.sitting_end) for r in sittings(df, ["k"], "ms", 3_600_000).collect()}
    assert got == {(1, 0, 7_199_999), (1, 10_799_999, 10_800_000), (1, 99_000_000, 99_000_000), (2, 5, 5)}


def test_the_next_row_may_lie_in_a_later_shard(spark):
    df = spark.createDataFrame([(None, 1, 0), (None, 5, 0), (None, 300, 3), (1, 7, 0)], "k int, x int, shard int")
    got = {(r.k, r.x): r.n for r in with_next(df, ["k"], "x", "shard", "n").collect()}
    assert got == {(None, 1): 5, (None, 5): 300, (None, 300): None, (1, 7): None}


@pytest.mark.parametrize("closed", [True, False])
def test_points_in_spans(spark, closed):
    rnd = random.Random(1)
    points = [(rnd.choice([1, 2]), rnd.choice([0.0, 600.0, 1200.0, rnd.uniform(0, 2000)])) for _ in range(200)]
    spans = [(rnd.choice([1, 2]), a, a + rnd.choice([-5.0, 0.0, 10.0, 600.0, 1500.0])) for a in (rnd.choice([0.0, 600.0, rnd.uniform(0, 1500)]) for _ in range(60))]
    p, s = spark.createDataFrame(points, "k int, t double"), spark.createDataFrame(spans, "k int, lo double, hi double")
    got = sorted(tuple(r) for r in joins.within(p, s, ["k"], "t", "lo", "hi", closed=closed).collect())
    want = sorted((k, t, a, b) for k, t in points for j, a, b in spans if j == k and a <= b and a <= t and (t <= b if closed else t < b))
    assert got == want


def test_last_before_and_nearest(spark):
    points = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 3.5), (2, 1.0)], "k int, t double")
    marks = spark.createDataFrame([(1, 2.0, "a"), (1, 2.0, "b"), (1, 3.0, "c"), (1, None, "z")], "k int, at double, v string")
    got = {(r.k, r.t): r.v for r in joins.last_before(points, marks, ["k"], "t", "at", ["v"]).collect()}
    assert got == {(1, 1.0): None, (1, 2.0): "b", (1, 3.5): "c", (2, 1.0): None}
    near = {(r.k, r.t): r.nearest_at for r in joins.nearest(points, marks.select("k", "at"), ["k"], "t", "at", 0.5).collect()}
    assert near == {(1, 1.0): None, (1, 2.0): 2.0, (1, 3.5): 3.0, (2, 1.0): None}


def test_repaired_replays(spark):
    rows = [row(i, view_type="replay", green_ratio=0.34 if i < 10 else 0.1) for i in range(20)]
    got = rules.repaired_views(spark.createDataFrame(rows, SCHEMA)).groupBy("repaired_view").count().collect()
    assert {r.repaired_view: r["count"] for r in got} == {"main_table": 10, "replay": 10}
    live = [row(i, view_type="replay" if i < 10 else "main_table", green_ratio=0.34) for i in range(20)]
    assert rules.repaired_views(spark.createDataFrame(live, SCHEMA)).where("repaired_view <> view_type").count() == 0


def test_scenes_and_samples(spark):
    cuts = {0: 0.0, 20: 1.0, 22: 1.0, 40: 1.0}
    df = spark.createDataFrame([row(i / 10, scene_cut_score=cuts.get(i, 0.0), view_type="replay" if i >= 40 else "main_table") for i in range(60)], SCHEMA)
    got = sorted((r.start, r.end, r.view_type, r.n) for r in scenes.segment(df.withColumn("cut", F.col("scene_cut_score") >= 0.42), "cut").collect())
    assert got == [(0.0, 2.2, "main_table", 22), (2.2, 4.0, "main_table", 18), (4.0, 5.9, "replay", 20)]
    assert sorted(r.t for r in rules.sampled(df, 2.0, 1.0, 3.0).collect()) == [1.0, 1.5, 2.0, 2.5, 3.0]


def test_fades_need_confirmation(spark):
    two = [0.0, 0.2, 0.25, 0.1, 0.3]
    df = spark.createDataFrame([row(i) for i in range(5)], SCHEMA).withColumn("two", F.element_at(F.array(*[F.lit(x) for x in two]), F.col("t").cast("int") + 1)).withColumn("one", F.lit(0.1))
    assert sorted(r.t for r in rules.confirmed_cuts(df, "one", "two").where("cut").collect()) == [1.0]


def test_stable_speed_ignores_jitter(spark):
    still = [row(i / 10, cue_ball_x=100 + (i % 2) * 0.3, cue_ball_y=50.0, ball_diameter_px=10) for i in range(10)]
    assert rules.stable_speed(spark.createDataFrame(still, SCHEMA)).where("stable_speed > 0").count() == 0
    moving = [row(i / 10, cue_ball_x=100.0 + 5 * i, cue_ball_y=50.0, ball_diameter_px=10) for i in range(10)]
    last = rules.stable_speed(spark.createDataFrame(moving, SCHEMA)).orderBy(F.desc("t")).first()
    assert abs(last.stable_speed - 5.0) < 1e-6
