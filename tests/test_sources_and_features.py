import io
import itertools
import json
import random
import wave

import numpy as np
from pyspark.sql import functions as F

from chalkline.functions import pixels, scalars
from chalkline.operators.tracking import Tracker, assign, robust_diameter, track_objects, track_statistics
from chalkline.sources import documents, sinks


def test_assignment_is_the_cheapest():
    rnd = np.random.default_rng(1)
    for n, m in [(1, 1), (2, 3), (3, 2), (4, 4), (3, 5)]:
        cost = rnd.random((n, m))
        pairs = assign(cost)
        best = min(sum(cost[i, j] for i, j in zip(range(n), p)) for p in itertools.permutations(range(m), n)) if n <= m else min(sum(cost[i, j] for i, j in zip(p, range(m))) for p in itertools.permutations(range(n), m))
        assert len(pairs) == min(n, m) and abs(sum(cost[i, j] for i, j in pairs) - best) < 1e-9


def test_tracks_cross_without_mixing_and_end_after_a_second():
    tracker = Tracker()
    for k in range(3):
        tracker.update(k * 0.1, [("cue", 4.0 * k, 0.0, 10.0, 0.9, 0.9), ("ball", 20.0 - 4 * k, 0.0, 10.0, 0.9, 0.1)])
    assert {k.label: round(k.x) for k in tracker.tracks} == {"cue": 8, "ball": 12}
    assert len(tracker.update(0.3, [])) == 2 and all(k.hidden and k.speed() == 0 for k in tracker.tracks)
    assert tracker.update(1.4, []) == []


def test_tracking_by_recording(spark):
    rows = [(j, i / 10, "cue", 10.0 + 10 * i, 10.0, 12.0, 0.9, 0.9) for j in (1, 2) for i in range(5)] + [(1, 0.5, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "job_id bigint, t double, label string, x double, y double, diameter double, confidence double, colour double")
    tracks = track_objects(df, ["job_id"])
    stats = {(r.job_id, r.t): r for r in track_statistics(tracks, ["job_id"]).collect()}
    assert stats[1, 0.4].moving == 1 and round(stats[1, 0.4].max_speed) == 100
    assert stats[1, 0.5].hidden == 1 and stats[1, 0.5].max_speed == 0
    assert {r.diameter for r in robust_diameter(df.where("x is not null"), ["job_id"]).collect()} == {12.0}


def test_highlights_and_still_hidden_tracks_do_not_count(spark):
    rows = [(1, i / 10, "ball", 10.0 + 10 * i, 10.0, 12.0, 0.9, 0.1, 0.3, 0.9) for i in range(3)]  # not round
    rows += [(1, i / 10, "ball", 10.0 + 10 * i, 300.0, 12.0, 0.9, 0.1, 0.9, 0.9) for i in range(3)]
    rows += [(1, i / 10, "ball", 500.0, 300.0, 12.0, 0.9, 0.1, 0.9, 0.9) for i in range(2)]  # still, then hidden
    rows += [(1, i / 10, "cue", x, 600.0, 12.0, sure, colour, 0.9, 0.9) for i in range(3) for x, sure, colour in ((100.0, 0.9, 0.7), (400.0, 0.8, 0.95))]
    df = spark.createDataFrame(rows, "job_id bigint, t double, label string, x double, y double, diameter double, confidence double, colour double, shape double, surround double")
    tracks = track_objects(df, ["job_id"]).cache()
    last = {r.t: r for r in track_statistics(tracks, ["job_id"]).collect()}[0.2]
    assert (last.balls, last.moving, last.hidden, round(last.mean_speed)) == (5, 1, 0, 50)
    assert tracks.where(f"track = {last.cue_track}").first().x == 400.0


def test_truth_documents(spark):
    docs = {
        "a": {"labels": [], "shots": [{"cue_strike": 1.0, "ball_motion_end": 2.0}, {"cue_strike": 5.0}]},
        "b": [{"timestamp": 3.0, "event_type": "cue_strike", "end": 4.0}, {"timestamp": 9.0, "event_type": "ball_stop"}],
        "c": {"events": [{"timestamp": 7.0, "event_type": "cue_strike"}]},
    }
    rows = [(k, json.dumps(v)) for k, v in docs.items()] + [("d", "not json"), ("e", None)]
    got = sorted(tuple(r) for r in documents.truth_events(spark.createDataFrame(rows, "video string, body string"), "video", "body").collect())
    assert got == [("a", 1.0, 2.0), ("a", 5.0, 8.0), ("b", 3.0, 4.0), ("c", 7.0, 10.0)]


def test_data_set_of_folders(spark, tmp_path):
    for name, files in {"v1": ("predictions.json", "ground_truth.json"), "v2": ("analysis.json", "ground_truth.json"), "v3": ("predictions.json",)}.items():
        (tmp_path / name).mkdir()
        for f in files:
            (tmp_path / name / f).write_text(json.dumps({"shots": [{"cue_strike": 1.5}]}))
    p, g = documents.dataset(spark, str(tmp_path))
    assert sorted(r.folder for r in p.collect()) == sorted(r.folder for r in g.collect()) == ["v1", "v2"]


def test_media_metadata(spark):
    video = {"codec_type": "video", "codec_name": "h264", "width": 1920, "height": 1080, "avg_frame_rate": "30000/1001", "r_frame_rate": "30/1", "nb_frames": "300", "display_aspect_ratio": "0:1", "tags": {"rotate": "90"}}
    rows = [("a", json.dumps({"streams": [video, {"codec_type": "audio", "codec_name": "aac", "sample_rate": "48000", "channels": 2}], "format": {"size": "12"}})), ("b", json.dumps({"streams": [{**video, "avg_frame_rate": "0/0", "r_frame_rate": "0/0", "nb_frames": "N/A"}]})), ("c", "{}")]
    got = {r.id: r for r in documents.media_metadata(spark.createDataFrame(rows, "id string, body string"), "id", "body").collect()}
    a = got["a"]
    assert (round(a.duration, 3), a.rotation, a.aspect, a.has_audio, a.audio_rate, a.variable, a.problem) == (10.01, 90, "1920:1080", True, 48000, False, None)
    assert got["b"].problem == "no duration" and got["b"].variable and got["c"].problem == "no picture"


def test_scalars(spark):
    df = spark.createDataFrame([(50.0, "30/1"), (3661.5, "0/0"), (-1.0, "N/A"), (59.9996, "25")], "t double, r string")
    rows = df.select(scalars.time_text(F.col("t")), scalars.fraction(F.col("r")), scalars.frame_at(F.col("t"), F.lit(10.0)), scalars.to_source(F.col("t"), F.lit(100.0), F.lit(50.0))).collect()
    assert [r[0] for r in rows] == ["00:50.000", "01:01:01.500", "00:00.000", "01:00.000"]
    assert [r[1] for r in rows] == [30.0, 0.0, 0.0, 25.0]
    assert rows[0][2] == 500 and [r[3] for r in rows][:3] == [25.0, 50.0, 0.0]
    size = spark.range(1).select(scalars.fit_even(F.lit(1920), F.lit(1080), 960, 540).alias("s"), scalars.file_name(F.lit("Shot 1: é!")).alias("f")).first()
    assert tuple(size.s) == (960, 540) and size.f == "Shot_1__é_"


def test_exports(spark, tmp_path):
    shots = spark.createDataFrame([(1, 1, 10.0, 12.5, 11.0, 12.0, 0.9, 0.5, True), (1, 2, 20.0, 21.0, 20.5, 20.9, 0.8, 0.4, True)], "job_id bigint, shot_id int, clip_start double, clip_end double, cue_strike double, ball_motion_end double, shot_confidence double, importance double, included boolean")
    lines = [r.line for r in sinks.decision_list(shots, "Cut", F.lit("a.mp4")).orderBy("line_no").collect()]
    assert lines == [
        "TITLE: Cut", "FCM: NON-DROP FRAME", "", "001  AX       V     C        00:10:000 00:12:500 00:00:000 00:02:500", "* FROM CLIP NAME: shot_0001", "* SOURCE FILE: a.mp4",
        "002  AX       V     C        00:20:000 00:21:000 00:02:500 00:03:500", "* FROM CLIP NAME: shot_0002", "* SOURCE FILE: a.mp4",
    ]
    assert [(r.start_ms, r.end_ms) for r in sinks.chapters(shots).orderBy("shot_id").collect()] == [(0, 2500), (2500, 3500)]
    meta = [r.line for r in sinks.chapter_metadata(shots).orderBy("line_no").collect()]
    assert meta[:5] == [";FFMETADATA1", "[CHAPTER]", "TIMEBASE=1/1000", "START=0", "END=2500"] and len(meta) == 11
    tsv = [r.line for r in sinks.chapter_list(shots).orderBy("line_no").collect()]
    assert tsv[0].startswith("# edited_time\tsource_start") and tsv[1].split("\t")[:4] == ["0.000", "10.000", "12.500", "1"] and len(tsv) == 3
    sinks.write_rows(sinks.shot_rows(shots), str(tmp_path / "csv"))
    assert "review_required" in sinks.shot_rows(shots).columns
    label = json.loads(sinks.training_labels(shots).orderBy("shot_id").first().label)
    assert label["reaction_end"] == 12.5 and set(label) == {"shot_id", "preparation_start", "cue_strike", "ball_motion_start", "ball_motion_end", "reaction_end", "possible_replay", "user_modified", "confidence"}
    jobs = spark.createDataFrame([(1, "a.mp4", "2"), (9, "b.mp4", "2")], "job_id bigint, source_path string, version string")
    papers = {r.job_id: json.loads(r.document) for r in sinks.label_documents(shots, jobs).collect()}
    assert [x["shot_id"] for x in papers[1]["labels"]] == [1, 2] and papers[1]["source_path"] == "a.mp4" and papers[9]["labels"] == []
    doc = json.loads(sinks.analysis_documents(shots.select("job_id", "shot_id"), spark.createDataFrame([(1, 0.5)], "job_id bigint, start double")).first().document)
    assert len(doc["shots"]) == 2 and doc["scenes"] == [{"start": 0.5}]


def test_pictures_and_sound(spark):
    green = np.zeros((20, 30, 3), np.uint8)
    green[:] = (20, 160, 60)
    half = green.copy()
    half[:, :15] = 0
    got = {r.t: r for r in pixels.picture_features(spark.createDataFrame([(1, 0.0, 30, 20, bytearray(green.tobytes())), (1, 1.0, 30, 20, bytearray(half.tobytes()))], "job_id bigint, t double, width int, height int, rgb binary")).collect()}
    assert got[0.0].green == 1.0 and got[1.0].green == 0.5 and got[0.0].edges == 0.0 < got[1.0].edges
    assert pixels.histogram_distance(np.array(got[0.0].histogram), np.array(got[0.0].histogram)) < 1e-9 < pixels.histogram_distance(np.array(got[0.0].histogram), np.array(got[1.0].histogram))
    rng = np.random.default_rng(0)
    picture = rng.random((32, 48)) * 255
    moved = np.roll(picture, (3, -5), (0, 1))
    assert pixels.camera_shift(picture, moved) == (3, -5)
    assert pixels.residual_motion(picture, moved)["mean"] < 1e-9
    rate = 16_000
    samples = np.zeros(rate)
    samples[8000:8400] = np.sin(np.arange(400) * 2 * np.pi * 4000 / rate) * 20_000
    buffer = io.BytesIO()
    with wave.open(buffer, "wb") as f:
        f.setnchannels(1), f.setsampwidth(2), f.setframerate(rate), f.writeframes(samples.astype(np.int16).tobytes())
    sound = pixels.sound_features(spark.createDataFrame([(1, bytearray(buffer.getvalue()))], "job_id bigint, content binary")).collect()
    loudest = max(sound, key=lambda r: r.onset)
    assert abs(loudest.t - 0.5) < 0.15 and max(r.highband for r in sound) > 0.99
    random.seed(0)


def test_round_objects_on_cloth():
    picture = np.zeros((60, 80, 3), np.uint8)
    picture[:] = (20, 160, 60)
    yy, xx = np.mgrid[:60, :80]
    for cx, cy in ((20, 30), (60, 20)):
        picture[(xx - cx) ** 2 + (yy - cy) ** 2 <= 25] = (240, 240, 235)
    picture[50:52, 5:70] = (240, 240, 240)
    found = pixels.round_objects(picture)
    assert sorted((round(o["x"]), round(o["y"])) for o in found) == [(20, 30), (60, 20)]
    assert all(o["surround"] > 0.5 and 9 <= o["diameter"] <= 12 for o in found)


def test_jobs_configuration_and_synthetic_rows(spark):
    from chalkline.sources import jobs

    conf = jobs.with_values({"strike": {"spacing_s": 2.0}, "modes": {"natural": {"pre_s": 5.0}}})
    assert conf.strike.spacing_s == 2.0 and conf.modes["natural"].pre_s == 5.0 and conf.modes["strict"].pre_s == 2.0
    rows = jobs.synthetic_features(spark, 2, 60)
    assert rows.count() == 1200 and rows.where("motion_raw > 0").count() > 0
    made = jobs.new_jobs(spark.createDataFrame([("/a.mp4",)], "source_path string").withColumn("at", F.timestamp_seconds(F.lit(0))), "at").first()
    assert made.job.startswith("19700101-000000-") and len(made.job) == 24
    table = spark.createDataFrame([("a", "queued", 0.0), ("b", "queued", 0.0)], "job string, status string, progress double")
    updates = spark.createDataFrame([("a", "running", 0.5, 1), ("a", "done", 1.0, 2)], "job string, status string, progress double, updated_at int")
    assert [(r.job, r.status) for r in jobs.latest_progress(table, updates).collect()] == [("b", "queued"), ("a", "done")]
    shots = spark.createDataFrame([(1, 2, 0.0, 2.0), (1, 1, 3.0, 4.5)], "job_id bigint, shot_id int, clip_start double, clip_end double")
    assert json.loads(jobs.export_metadata(shots, "strict").first().metadata) == {"mode": "strict", "shots": 2, "shot_ids": [1, 2], "duration": 3.5, "accurate": True}


def test_histogram_tells_32_steps_of_a_channel_apart():
    near = [pixels.colour_histogram(np.full((4, 4, 3), [60.0, 100.0, v])) for v in (100, 110)]
    assert len(near[0]) == 32**3 and pixels.histogram_distance(*near) > 0.4
