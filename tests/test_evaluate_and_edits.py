import random

import pytest
from pyspark.sql import functions as F

from chalkline.operators import edits, evaluate, folds, rules, shots


def test_matching_and_metrics(spark):
    p = spark.createDataFrame([("v", x) for x in (1.0, 5.0, 9.0)] + [("w", 1.0)], "video string, p double")
    g = spark.createDataFrame([("v", x) for x in (1.1, 5.2, 12.0)] + [("x", 3.0)], "video string, g double")
    matched = evaluate.match_events(p, g, ["video"], 0.5).collect()
    assert sorted((r.p, r.g) for r in matched) == [(1.0, 1.1), (5.0, 5.2)]
    m = {r.video: r for r in evaluate.metrics_by_key(p, g, ["video"], 0.5).collect()}
    assert (m["v"].matched, round(m["v"].precision, 4), round(m["v"].recall, 4)) == (2, 0.6667, 0.6667)
    assert (m["w"].precision, m["w"].recall, m["x"].missed_rate, m["w"].f1) == (0.0, 0.0, 1.0, 0.0)
    report = evaluate.macro(evaluate.metrics_by_key(p, g, ["video"], 0.5)).first()
    assert (report.videos, report.matched, report.predicted) == (3, 2, 4)


def test_each_event_is_used_once(spark):
    p = spark.createDataFrame([("v", 1.0), ("v", 1.2)], "video string, p double")
    g = spark.createDataFrame([("v", 1.1), ("v", 1.15)], "video string, g double")
    assert sorted((r.p, r.g) for r in evaluate.match_events(p, g, ["video"], 0.5).collect()) == [(1.0, 1.1), (1.2, 1.15)]


SHOT = "job_id bigint, shot_id int, clip_start double, clip_end double, cue_strike double, ball_motion_end double, shot_confidence double, included boolean, possible_replay boolean, user_modified boolean, manual_review_required boolean"


def table(spark):
    return spark.createDataFrame([(1, 1, 0.0, 10.0, 2.0, 8.0, 0.5, True, False, False, True)], SHOT)


def test_edits(spark):
    one = table(spark)
    two = edits.add(edits.update(one, F.col("shot_id") == 1, included=F.lit(False)), spark.createDataFrame([(1, 9, 20.0, 25.0, 21.0, 24.0, 0.9, True, True, True, False)], SHOT), ["job_id"])
    rows = {r.shot_id: r for r in two.collect()}
    assert set(rows) == {1, 2} and not rows[1].included and rows[1].user_modified and not rows[1].manual_review_required
    three = edits.split(two, ["job_id"], F.lit(5.0), F.col("shot_id") == 1)
    rows = {r.shot_id: (r.clip_start, r.clip_end, r.cue_strike, r.ball_motion_end) for r in three.collect()}
    assert rows == {1: (0.0, 5.0, 2.0, 5.0), 2: (5.0, 10.0, 5.0, 8.0), 3: (20.0, 25.0, 21.0, 24.0)}
    back = edits.merge_first(three, ["job_id"], 2).orderBy("shot_id").collect()
    assert [(r.shot_id, r.clip_start, r.clip_end, r.cue_strike) for r in back] == [(1, 0.0, 10.0, 2.0), (2, 20.0, 25.0, 21.0)]
    gone = edits.delete(three, spark.createDataFrame([(1, 2)], "job_id bigint, shot_id int"), ["job_id"])
    assert sorted(r.shot_id for r in gone.collect()) == [1, 2]
    assert edits.split(two, ["job_id"], F.lit(0.01), F.lit(True)).count() == 2


def test_decisions_carry_over(spark):
    schema = "job_id bigint, shot_id int, cue_strike double, included boolean, user_modified boolean, linked_live_shot_id int"
    new = spark.createDataFrame([(1, 1, 2.1, True, False, None), (1, 2, 30.0, True, False, None), (1, 3, 50.0, True, False, None), (1, 4, 50.6, True, False, None), (1, 5, None, True, False, None), (2, 1, 2.0, True, False, None)], schema)
    # The first in turn takes the nearest old one, though the next would fit better; what is too far off takes none.
    old = spark.createDataFrame([(1, 7, 2.0, False, True, 3), (1, 8, 27.0, False, True, None), (1, 9, 50.5, False, False, None), (1, 10, 51.9, True, True, 1), (1, 11, None, False, True, 2)], schema)
    got = {(r.job_id, r.shot_id): (r.included, r.user_modified, r.linked_live_shot_id) for r in edits.carry_over(new, old, ["job_id"]).collect()}
    assert got == {(1, 1): (False, True, 3), (1, 2): (True, False, None), (1, 3): (False, False, None), (1, 4): (True, True, 1), (1, 5): (True, False, None), (2, 1): (True, False, None)}
    assert edits.carry_over(new.limit(0), old, ["job_id"]).count() == 0 and edits.carry_over(new, old.limit(0), ["job_id"]).count() == 6


def test_an_id_that_is_no_shot(spark):
    with pytest.raises(Exception, match="no shot 77"):
        edits.delete(table(spark), spark.createDataFrame([(1, 77)], "job_id bigint, shot_id int"), ["job_id"]).collect()


def test_ranges(spark):
    df = spark.createDataFrame([(1, 1, 4.0, 7.0), (1, 2, -0.0005, 2.0), (1, 3, 2.001, 4.0)], "job_id bigint, shot_id int, a double, b double").withColumn("s", F.lit(10.0))
    assert [tuple(r) for r in edits.keep_ranges(df, ["job_id"], "a", "b").collect()] == [(1, 0, 7000)]
    assert edits.range_violations(df, ["job_id"], "shot_id", "a", "b", "s").count() == 0
    bad = spark.createDataFrame(
        [(1, 1, 0.0, 2.0), (1, 2, 1.0, 3.0), (1, 3, 5.0, 5.02), (1, 4, -1.0, -0.5), (1, 5, 8.0, 11.0), (1, 6, None, 3.0)], "job_id bigint, shot_id int, a double, b double"
    ).withColumn("s", F.lit(10.0))
    assert {r.shot_id: r.violation for r in edits.range_violations(bad, ["job_id"], "shot_id", "a", "b", "s").collect()} == {2: "overlap", 3: "too short", 4: "outside", 5: "outside", 6: "missing"}
    many = spark.range(203).selectExpr("1 as job_id", "id as shot_id", "double(id) as a", "id + 0.5D as b")
    assert [r.violation for r in edits.range_violations(many, ["job_id"], "shot_id", "a", "b").collect()] == ["too many"] * 3


def test_folds_do_not_depend_on_pieces(spark):
    rnd = random.Random(9)
    rows = [(k, round(rnd.uniform(0, 9000), 2), rnd.choice([0.1, 0.5, 0.9])) for k in (1, 2) for _ in range(1500)] + [(3, 3599.5, 0.1), (3, 3600.2, 0.2), (3, 3601.1, 0.3)]
    df = spark.createDataFrame(rows, "k int, t double, s double").dropDuplicates(["k", "t"])
    kept = {}
    for k, t, s in sorted({(k, t): (k, t, s) for k, t, s in ((r.k, r.t, r.s) for r in df.collect())}.values()):
        mine = kept.setdefault(k, [])
        if not mine or t - mine[-1][0] >= 1.2:
            mine.append((t, s))
        elif s > mine[-1][1]:
            mine[-1] = (t, s)
    got = folds.suppress(df, "s", 1.2, keys=["k"]).collect()
    assert sorted((r.k, r.t, r.s) for r in got) == sorted((k, t, s) for k, x in kept.items() for t, s in x)
    firsts = {}
    for k, t in sorted({(r.k, r.t) for r in df.collect()}):
        mine = firsts.setdefault(k, [])
        if not mine or t - mine[-1] >= 0.7:
            mine.append(t)
    assert sorted((r.k, r.t) for r in folds.spaced(df, 0.7, "t", ["k"]).collect()) == sorted((k, t) for k, x in firsts.items() for t in x)


def test_export_rules(spark):
    rows = [(1, 1, True, False, None, ["main_table"]), (1, 2, False, True, None, []), (1, 3, True, False, 1, []), (1, 4, True, False, None, ["replay"]), (1, 5, False, False, None, [])]
    df = spark.createDataFrame(rows, "job_id bigint, shot_id int, included boolean, possible_replay boolean, linked_live_shot_id int, camera_views array<string>").withColumns({"shot_confidence": F.lit(0.9), "importance": F.lit(0.5)})
    ids = lambda **k: sorted(r.shot_id for r in rules.export_filter(df, **k).collect())
    assert ids() == [1] and ids(include_replays=True) == [1, 2, 3, 4] and ids(only_included=False) == [1, 5] and ids(least_confidence=0.95) == []


def test_boundaries(spark):
    good = (1, 1, 2.125, 5.25, 0.125, 6.125)
    df = spark.createDataFrame([good, (1, 2, 2.125, 5.25, 0.5, 6.125), (1, 3, 2.125, 5.25, 0.125, 5.75)], "job_id bigint, shot_id int, cue_strike double, ball_motion_end double, clip_start double, clip_end double")
    got = {(r.shot_id, r.violation) for r in rules.boundary_violations(df).collect()}
    assert got == {(2, "start"), (3, "end")}
    more = df.where("shot_id = 1").withColumns({"cue_strike_timestamp": F.lit(2.5), "stop_confirmation_timestamp": F.lit(5.0), "last_ball_motion_timestamp": F.lit(5.5), "physical_stop_timestamp": F.lit(5.25)})
    ends = spark.createDataFrame([(1, 6.0)], "job_id bigint, source_s double")
    assert {r.violation for r in rules.boundary_violations(more, durations=ends).collect()} == {"cue_strike_alias", "start", "end", "confirmation", "last_motion", "source"}
    assert rules.require_valid(df.where("shot_id = 1")).count() == 1
    try:
        rules.require_valid(df).collect()
    except Exception as e:
        assert "violates" in str(e)
    else:
        raise AssertionError


def test_names_of_modes_and_cosine(spark):
    df = spark.createDataFrame([("Strict",), ("shots-only",), (" Full Shot Sequence",), ("ActionOnly",), ("highlights",), (None,)], "m string")
    assert [r[0] for r in df.select(rules.mode_name(F.col("m"))).collect()] == ["strict", "strict", "full_sequence", "action_only", "natural", None]
    with pytest.raises(Exception, match="no such mode: natural_flow"):
        spark.createDataFrame([("natural_flow",)], "m string").select(rules.mode_name(F.col("m"))).collect()
    v = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in v.select(shots.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0]


def test_proposals_and_replay_doubts(spark):
    rows = [(1, {"dense_transition_confirmed": 1.0}, False), (2, {"occlusion_inferred": 1.0, "ball_onset_run": 1.0}, True), (3, {"occlusion_inferred": 1.0, "ball_onset_run": 2.0}, False), (4, {"audio_seed": 1.0}, True), (5, {"audio_seed": 1.0}, None), (6, {}, True)]
    df = spark.createDataFrame(rows, "id int, e map<string,double>, s boolean")
    assert [r.id for r in df.where(rules.retained(F.col("e"), F.col("s"))).collect()] == [1, 3, 4]
    rows = [(1, True, "replay", {}), (2, True, "main_table", {}), (3, True, None, {"replay_signature_confirmed": 0.6}), (4, False, "replay", {}), (5, None, None, {})]
    df = spark.createDataFrame(rows, "id int, r boolean, v string, e map<string,double>")
    for retain, want in ((False, {1: (False, True), 2: (True, True), 3: (False, True), 4: (True, False), 5: (True, False)}), (True, {i: (True, False) for i in range(1, 6)})):
        first, doubt = rules.included_at_first(F.col("r"), F.col("v"), F.col("e"), retain)
        assert {x.id: (x.i, x.d) for x in df.select("id", first.alias("i"), doubt.alias("d")).collect()} == want
