import random

from pyspark.sql import functions as F
from helpers import SCHEMA, tracked

from chalkline.operators import stateful, windows as w
from chalkline.operators.pieces import by_pieces, numbered


def timeline(spark, n=400, seed=4):
    rnd = random.Random(seed)
    t, rows = 3590.0, []  # over the edge of an hour
    for i in range(n):
        t = round(t + rnd.choice([0.03, 0.1, 0.1, 0.4, 3.0 if i % 90 == 0 else 0.1]), 3)
        moving = (i // 25) % 3 == 0
        rows.append(tracked(t, moving, motion_raw=rnd.uniform(0, 1), cue_ball_normalized_speed=rnd.uniform(0, 3) if moving else 0, cue_ball_x=rnd.uniform(0, 99), cue_ball_y=rnd.uniform(0, 99), scene_cut_score=0.9 if rnd.random() < 0.02 else 0.0))
    return spark.createDataFrame(rows, SCHEMA)


def test_rows_are_numbered_through_a_recording(spark):
    got = numbered(timeline(spark)).orderBy("t").select("_row").collect()
    assert [r[0] for r in got] == list(range(400))


def test_pieces_give_what_the_whole_gives(spark):
    rows = timeline(spark)
    steps = {
        "local": (lambda x: x.withColumn("onset", w.motion_onset()).withColumn("norm", w.local_normal("onset")).select("job_id", "sitting", "t", "norm", *(["_halo"] if "_halo" in x.columns else [])), 0.0, w.ONSET_ROWS),
        "moments": (lambda x: w.transition_metrics(x).select("job_id", "sitting", "t", "pre_n", "post_n", "stationary_ratio", "displacement", "acceleration", *(["_halo"] if "_halo" in x.columns else [])), w.MOMENT_S, 1),
    }
    for step, reach_s, reach_rows in steps.values():
        whole = sorted(tuple(r) for r in step(rows).collect())
        assert sorted(tuple(r) for r in by_pieces(rows, step, reach_s, reach_rows, 30).collect()) == whole and len(whole) == 400


def test_stops_and_smoothing_do_not_depend_on_pieces(spark, monkeypatch):
    rows = timeline(spark)
    marks = rows.where("pmod(int(t * 10), 37) = 0").select("job_id", "sitting", "t")
    stops = lambda: sorted(str(r) for r in stateful.find_stops(rows, marks).collect())
    smooth = lambda: [(r.t, r.session, round(r.smooth, 12)) for r in stateful.smoothed(rows).orderBy("t").collect()]
    one = stops(), smooth()
    monkeypatch.setattr(stateful, "STOP_PIECE", 120)
    monkeypatch.setattr("chalkline.operators.pieces.SIZE", 80)
    assert (stops(), smooth()) == one and len(one[0]) > 3


def test_empty(spark):
    rows = timeline(spark).limit(0)
    assert by_pieces(rows, lambda x: x.withColumn("q", F.lit(1)), 1.0).count() == 0
    assert stateful.find_stops(rows, rows.select("job_id", "sitting", "t")).count() == 0
