import pytest

from chalkline.operators import stateful
from chalkline.operators.stateful import Clip, find_stops, label_phases, mark_replays, resolve_overlaps, smoothed
from helpers import SCHEMA, row, tracked


def tl(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def grid(n, start=0):
    return [round(i / 10, 3) for i in range(start, n)]


def stop_of(spark, rows, strike=1.0):
    marks = spark.createDataFrame([(1, 0, strike)], "job_id bigint, sitting bigint, t double")
    return find_stops(tl(spark, rows), marks).first()


def base(spark, end=3.0, moving=(1.0, 1.4), change=None):
    rows = []
    for t in grid(int(end * 10) + 1):
        more = change(t) if change else {}
        now = more.pop("moving", moving[0] <= t <= moving[1])
        rows.append(tracked(t, now, **more))
    return stop_of(spark, rows)


def test_plain_stop(spark):
    r = base(spark)
    assert (r.last_motion, r.stop, r.confirm, r.confirmed, r.stop_reason) == (1.4, 1.5, 2.0, True, "confirmed_stationary")
    assert r.start_confidence == 0.92 and r.stop_confidence == 0.95 and not r.stop_review


@pytest.mark.parametrize(
    ("change", "last", "stop", "confirm"),
    [
        (lambda t: {"scene_cut_score": 1.0} if t == 1.8 else {}, None, 1.9, 2.4),
        (lambda t: {"occluded_ball_count": 1, "motion_raw": 0.5} if 1.5 <= t <= 1.8 else {}, 1.8, 1.9, 2.4),
        (lambda t: {"moving": True} if t == 1.8 else {}, 1.4, 1.5, 2.0),
        (lambda t: {"moving": True} if t in (1.8, 1.9) else {}, 1.9, 2.0, 2.5),
    ],
)
def test_disturbed_stops(spark, change, last, stop, confirm):
    r = base(spark, end=3.5, change=change)
    assert (r.stop, r.confirm) == (stop, confirm)
    assert last is None or r.last_motion == last


def test_stale_occlusion(spark):
    r = base(spark, end=4.0, change=lambda t: {"occluded_ball_count": 2} if t >= 1.5 else {})
    assert (r.stop, r.confirm, r.stop_review, r.stop_reason) == (1.5, 2.0, True, "confirmed_stale_occlusion_override")


def test_motion_without_end_and_without_motion(spark):
    r = base(spark, end=20.0, moving=(1.0, 99.0))
    assert (r.stop, r.confirmed, r.stop_review, r.stop_reason) == (11.0, False, True, "max_duration_review_cap")
    r = base(spark, end=3.0, moving=(9.0, 9.0))
    assert r.stop_reason == "no_sustained_ball_motion"
    r = base(spark, end=3.0, moving=(1.0, 99.0))
    assert r.stop_reason == "motion_not_confirmed"


def test_no_rows_near_the_onset(spark):
    r = stop_of(spark, [tracked(t, False) for t in (0.0, 50.0)], strike=20.0)
    assert r.stop_reason == "no_motion_observations" and r.stop == 30.0


def phases(spark, more=None, end=17):
    rows = []
    for t in grid(end):
        score = 0.9 if t == 0.5 else 0.0
        moving = 0.6 <= t <= 0.9
        extra = more(t) if more else {}
        rows.append(tracked(t, False, strike_score=score, cue_ball_detected=True, **(dict(moving_ball_count=1, max_ball_normalized_speed=0.65) if moving else {"ball_residual_motion": 0.0}), **extra))
    return {r.t: r.state for r in label_phases(tl(spark, rows)).collect()}


def test_phases_in_order(spark):
    got = phases(spark)
    seen = list(dict.fromkeys(got[t] for t in sorted(got)))
    assert seen[:7] == ["WAITING", "CUEING", "STRIKE_CANDIDATE", "STRIKE_CONFIRMED", "BALLS_MOVING", "BALLS_SETTLING", "ALL_BALLS_STOPPED"]


@pytest.mark.parametrize("bad", [{"observation_valid": False}, {"table_observable": False}, {"scene_cut_score": 1.0}, {"occluded_ball_count": 1}])
def test_a_bad_row_breaks_stillness(spark, bad):
    got = phases(spark, lambda t: bad if t == 1.2 else {}, end=22)
    stopped = [t for t in sorted(got) if got[t] == "ALL_BALLS_STOPPED"]
    assert stopped and stopped[0] >= 1.8


def test_smoothing_starts_over_at_cuts(spark):
    rows = [row(t, motion_raw=x, scene_cut_score=cut) for t, x, cut in [(0, 1.0, 0), (1, 0.0, 0), (2, 1.0, 0.5), (3, 0.0, 0)]]
    got = {r.t: (r.session, round(r.smooth, 6)) for r in smoothed(tl(spark, rows)).collect()}
    assert got == {0.0: (0, 1.0), 1.0: (0, 0.4), 2.0: (1, 1.0), 3.0: (1, 0.4)}


def clip(strike, confidence=0.9, audio=0.0, stop=None, confirmed=False, quiet=1.0):
    return Clip(strike, max(0, strike - 2), strike + 4, min(stop or strike + 1, strike + 4), stop or strike + 1, confirmed, confidence, audio, quiet, False, strike + 4)


def test_overlaps_keep_the_better_supported():
    kept = resolve_overlaps([clip(1.266667, audio=0.02), clip(4.766671, audio=0.58)], strict=True)
    assert [c.strike for c in kept] == [4.766671] and kept[0].notes == {"replaced": 1.266667}
    kept = resolve_overlaps([clip(575.567246), clip(580.167251, 0.78), clip(583.700587)], strict=True)
    assert [c.strike for c in kept] == [575.567246, 583.700587]
    kept = resolve_overlaps([clip(1.0, stop=10.0, confirmed=False), clip(19.5)], strict=False)
    assert len(kept) == 2
    kept = resolve_overlaps([clip(1.0, stop=10.0, confirmed=True), clip(5.0)], strict=False)
    assert [c.strike for c in kept] == [1.0] and kept[0].notes == {"rejected": 5.0} and kept[0].review


def test_strict_clips_are_capped(spark):
    from pyspark.sql import functions as F

    from chalkline.operators.shots import clip_bounds

    def cut(end, moving, mode="strict"):
        rows = tl(spark, [tracked(t, moving[0] <= t <= moving[1]) for t in grid(int(end * 10) + 1)])
        marks = spark.createDataFrame([(1, 0, 1.0, 0.9)], "job_id bigint, sitting bigint, t double, confidence double")
        ends = rows.groupBy("job_id", "sitting").agg(F.max("t").alias("duration"))
        clips = clip_bounds(find_stops(rows, marks).join(marks, ["job_id", "sitting", "t"]), rows, ends, mode)
        clips = clips.select("job_id", "sitting", "strike", "start", "end", "stop", "uncapped", "confirmed", "confidence", F.lit(0.0).alias("audio"), F.lit(0.0).alias("quiet"), "review", "minimum")
        return stateful.resolve_shots(clips, mode == "strict").first()

    r = cut(20.0, (1.0, 99.0))
    assert (r.clip_start, r.clip_end, r.review) == (0.0, 5.0, True)
    r = cut(3.0, (1.0, 1.4))
    assert (r.clip_start, r.clip_end) == (0.0, 3.0)
    r = cut(20.0, (1.0, 1.4), "action_only")
    assert (r.clip_start, r.clip_end) == (0.0, 2.5)


def test_replays_follow_live_ones(spark):
    up, down = [float(i) for i in range(16)], [float(16 - i) for i in range(16)]
    rows = [(1, 0, 10.0, 0.9, up, False, False), (1, 0, 20.0, 0.9, up, False, True), (1, 0, 30.0, 0.9, up, False, False), (1, 0, 31.0, 0.9, down, False, True), (1, 0, 150.0, 0.9, up, False, True), (1, 0, 40.0, 0.2, [0.0] * 16, True, False)]
    df = spark.createDataFrame(rows, "job_id bigint, sitting bigint, t double, confidence double, signature array<double>, explicit boolean, transition boolean")
    got = {r.t: (r.replay, r.replay_of) for r in mark_replays(df).collect()}
    assert got == {10.0: (False, None), 20.0: (True, 10.0), 30.0: (False, None), 31.0: (False, None), 40.0: (True, None), 150.0: (False, None)}


def test_empty(spark):
    assert label_phases(tl(spark, [])).count() == 0
    assert smoothed(tl(spark, [])).count() == 0
    marks = spark.createDataFrame([(1, 0, 1.0)], "job_id bigint, sitting bigint, t double")
    assert find_stops(tl(spark, [row(1)]), marks.limit(0)).count() == 0
    assert stateful.PHASES[stateful.STOPPED] == "ALL_BALLS_STOPPED"
