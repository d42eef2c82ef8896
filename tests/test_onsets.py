from chalkline.operators import folds, windows as w
from chalkline.plans.timeline_queries import detect
from helpers import SCHEMA, row


def tl(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def launch(speeds, contact=None, n=26, step=4.0):
    """A cue ball at rest that moves with the given speeds (by time) and drifts right while it does."""
    rows, x = [], 100.0
    for i in range(n):
        t = i / 10
        speed = speeds(t)
        x += step if speed > 0 else 0
        rows.append(row(t, ball_diameter_px=10, ball_count=8, cue_ball_track_confidence=0.95, cue_ball_detected=True, cue_ball_x=x, cue_ball_y=50.0, cue_ball_normalized_speed=speed, max_ball_normalized_speed=speed, motion_raw=0.7 if speed else 0.02, cue_contact_score=contact if contact and t == 1.0 else 0.0))
    return rows


def test_a_launch_is_found(spark):
    found = detect(tl(spark, launch(lambda t: 1.5 if t >= 1.0 else 0.0))).collect()
    assert [r.t for r in found] == [1.0] and found[0].kind == "transition" and found[0].confidence > 0.7


def test_a_hole_in_the_track_needs_contact(spark):
    speeds = {1.0: 1.4, 1.1: 0.0, 1.2: 6.0, 1.3: 5.0}
    rows = lambda c: launch(lambda t: speeds.get(t, 0.0), c)
    assert [r.t for r in detect(tl(spark, rows(0.88))).collect()] == [1.0]
    assert 1.0 not in [r.t for r in detect(tl(spark, rows(None))).collect()]


def test_a_hidden_cue_ball(spark):
    rows = []
    for i in range(31):
        t = i / 10
        hit = t >= 1.0
        rows.append(row(t, ball_diameter_px=10, ball_count=8, cue_ball_track_confidence=0.0 if hit else 0.95, cue_ball_detected=not hit, cue_ball_x=None if hit else 100.0, cue_ball_y=None if hit else 50.0, max_ball_normalized_speed=3.0 if hit else 0.0, ball_residual_motion=0.6 if hit else 0.0, motion_raw=0.7 if hit else 0.02))
    got = w.onset_metrics(tl(spark, rows)).where(w.onset_confirmed()).collect()
    assert 1.0 in [r.t for r in got]
    respot = [row(i / 10, ball_diameter_px=10, ball_count=8, cue_ball_track_confidence=0.95, cue_ball_detected=True, cue_ball_x=100.0, cue_ball_y=50.0, max_ball_normalized_speed=3.0 if i >= 10 else 0.0, ball_residual_motion=0.6 if i >= 10 else 0.0, motion_raw=0.7 if i >= 10 else 0.02) for i in range(31)]
    assert w.onset_metrics(tl(spark, respot)).where(w.onset_confirmed()).count() == 0


def test_sparse_proposals(spark):
    rows = [row(i / 2, motion_raw=0.75 if 4 <= i <= 12 else 0.05, motion_score=0.75 if 4 <= i <= 12 else 0.05, ball_residual_motion=0.75 if 4 <= i <= 12 else 0.05) for i in range(20)]
    found = folds.suppress(w.sparse_windows(tl(spark, rows)).where("proposed"), "score", 1.2).collect()
    assert [r.t for r in found] == [2.0]


def test_audio_peaks(spark):
    spikes = {10: 0.35, 11: 0.70, 30: 0.55, 31: 0.45, 42: 0.80}
    rows = tl(spark, [row(i / 10, audio_onset=spikes.get(i, 0.0)) for i in range(50)])
    _, peak = w.crossings_and_peaks("audio_onset", 0.30)
    got = folds.strongest(rows.withColumn("p", peak).where("p"), "audio_onset", 1.0).collect()
    assert sorted((r.t, r.audio_onset) for r in got) == [(1.1, 0.70), (3.0, 0.55), (4.2, 0.80)]
    one = folds.strongest(rows.withColumn("p", peak).where("p"), "audio_onset", 1.0, most=1).collect()
    assert [r.t for r in one] == [4.2]


def test_merging_candidates_joins_their_evidence(spark):
    rows = [(1, 1.0, 0.5, {"a": 1.0, "b": 1.0}, 1), (1, 1.5, 0.9, {"b": 2.0}, 2), (1, 2.6, 0.9, {"c": 3.0}, 3), (1, 9.0, 0.1, {}, 4)]
    df = spark.createDataFrame(rows, "job_id bigint, t double, s double, e map<string,double>, id int")
    got = {r.id: (r.t, dict(r.e)) for r in folds.merge_near(df, 1.2, "t", "s", "e", ["id"]).collect()}
    assert got == {2: (1.5, {"a": 1.0, "b": 2.0, "c": 3.0}), 4: (9.0, {})}


def test_spaced_events(spark):
    df = spark.createDataFrame([(1, x) for x in (0.0, 0.1, 0.2, 0.35, 0.4, 5.0, 5.0)], "job_id bigint, t double")
    assert sorted(r.t for r in folds.spaced(df, 0.2, "t", ["job_id"]).collect()) == [0.0, 0.2, 0.4, 5.0]
