"""Queries over events, shots and scenes: joins in time, folds, stops, clips, replays, evaluation, edits and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chalkline.config import DEFAULT
from chalkline.functions import predicates as p
from chalkline.functions import scalars
from chalkline.operators import edits, evaluate, folds, joins, shots as sh, stateful, windows as w
from chalkline.operators.intervals import merge_intervals
from chalkline.operators.pieces import by_pieces
from chalkline.operators.sequence import sittings, to_ms
from chalkline.operators.timeline import KEYS, finite, micro
from chalkline.plans import base_sql as b
from chalkline.plans.timeline_queries import _TRANS, detect, tl
from chalkline.session import cut
from chalkline.sources import sinks
from chalkline.sources.tables import load


def us(*names: str) -> list[Column]:
    return [micro(n).alias(n) for n in names]


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Strike candidates without copies: of a candidate_id the first to arrive, then the smallest values."""
    rows = load(spark, folder, "strike_candidates", "candidate_id", "job_id", "timestamp", "confidence", "evidence", "camera_view", "possible_replay", "ingested_at")
    good = rows.select(
        "candidate_id", "job_id", finite(F.col("timestamp")).alias("t"), F.coalesce(finite(F.col("confidence")), F.lit(0.0)).alias("confidence"),
        F.coalesce("evidence", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))).alias("evidence"), "ingested_at",
    ).where("t is not null and candidate_id is not null")
    best = F.min_by(F.struct("job_id", "t", "confidence", "evidence"), F.struct("ingested_at", "t", "confidence"))
    return good.groupBy("candidate_id").agg(best.alias("x")).select("candidate_id", "x.*")


_TIMES = ("cue_strike_timestamp", "clip_start_timestamp", "clip_end_timestamp", "physical_stop_timestamp", "stop_confirmation_timestamp", "last_ball_motion_timestamp")


def clean_shots(spark: SparkSession, folder: str, *more: str) -> DataFrame:
    """Shots without copies: of a (job_id, shot_id) the last to arrive, then the largest values; `more` numbers come along."""
    names = (*more, "cue_strike", "ball_motion_end", "clip_start", "clip_end", "shot_confidence", "importance")
    rows = load(spark, folder, "shots", "job_id", "shot_id", *names, "included", "possible_replay", "manual_review_required", "camera_views", "linked_live_shot_id", "ingested_at")
    good = rows.select(
        "job_id", "shot_id", *[finite(F.col(n)).alias(n) for n in names], F.coalesce("included", F.lit(True)).alias("included"),
        *[F.coalesce(x, F.lit(False)).alias(x) for x in ("possible_replay", "manual_review_required")], F.coalesce("camera_views", F.array().cast("array<string>")).alias("camera_views"), "linked_live_shot_id", "ingested_at",
    ).where("job_id is not null and shot_id is not null")
    pick = F.struct("ingested_at", F.coalesce("shot_confidence", F.lit(-1.0)), F.coalesce("importance", F.lit(-1.0)), "included", "possible_replay", "manual_review_required")
    columns = [n for n in good.columns if n not in ("job_id", "shot_id", "ingested_at")]
    return good.groupBy("job_id", "shot_id").agg(F.max_by(F.struct(*columns), pick).alias("x")).select("job_id", "shot_id", "x.*")


def clips(spark, folder):
    """Shots with a clip of positive length."""
    return clean_shots(spark, folder).where("clip_start is not null and clip_end > clip_start")


def recordings(rows: DataFrame) -> DataFrame:
    """First and last time of each recording."""
    return rows.groupBy(*KEYS).agg(F.min("t").alias("first_t"), F.max("t").alias("duration"))


def in_recordings(events: DataFrame, rows: DataFrame, t: str) -> DataFrame:
    """Events with the recording they fall into; others are left out."""
    spans = recordings(rows).select("job_id", "sitting", "first_t", "duration")
    return joins.within(events, spans, ["job_id"], t, "first_t", "duration").drop("first_t", "duration")


# --- joins in time


def frame_scenes(spark, folder):
    """Each sample with the scene it lies in: of several the one that began last, then the first view by name; null without
    one. A job's last scene has no end."""
    scenes = load(spark, folder, "scenes", "job_id", "start", "end", "view_type").where("start is not null and `end` > start")
    rows = tl(spark, folder, "motion_raw").select("job_id", "t")
    ends = rows.groupBy("job_id").agg((F.max("t") + 1.0).alias("beyond")).join(scenes.groupBy("job_id").agg(F.max("start").alias("last")), "job_id")
    spans = scenes.join(ends, "job_id", "left").select(
        "job_id", F.col("start").alias("lo"), F.when(F.col("start") == F.col("last"), F.greatest("end", "beyond")).otherwise(F.col("end")).alias("hi"), F.coalesce("view_type", F.lit("other")).alias("scene_view")
    )
    found = joins.within(rows, spans, ["job_id"], "t", "lo", "hi", "left", closed=False)
    last = F.max_by("scene_view", F.struct("lo", "hi", "scene_view"))
    return found.groupBy("job_id", "t").agg(F.max("lo").alias("lo"), last.alias("scene_view")).select("job_id", micro("t").alias("t_us"), micro("lo").alias("scene_us"), "scene_view")


def near_cuts(spark, folder):
    """Samples less than 0.08 s from the beginning of a scene."""
    starts = load(spark, folder, "scenes", "job_id", "start").where("start is not null").select("job_id", F.round("start", 3).alias("cut"))
    rows = tl(spark, folder, "motion_raw").select("job_id", "t")
    near = joins.nearest(rows, starts, ["job_id"], "t", "cut", 0.08)
    return near.where(F.abs(F.col("t") - F.col("nearest_at")) < 0.08).select("job_id", micro("t").alias("t_us"), micro("nearest_at").alias("cut_us"))


def audio_near(spark, folder):
    """Loudest onset within 0.12 s of each sample, and the onset of the last sample of the coarse layer before it."""
    rows = by_pieces(tl(spark, folder, "audio_onset"), lambda x: x.withColumn("peak", w.seconds_frame("max(audio_onset)", 0.12, 0.12)), 0.12)
    coarse = rows.where("layer = 'coarse'").select(*KEYS, F.col("t").alias("at"), F.col("audio_onset").alias("before"))
    asof = joins.last_before(rows.select(*KEYS, "t", "peak"), coarse, KEYS, "t", "at", ["before"])
    return asof.select("job_id", micro("t").alias("t_us"), *us("peak", "before"))


def audio_seeds(spark, folder):
    """Audio peaks with no candidate within 1.5 s, none within 1.5 s of an earlier seed."""
    rows = tl(spark, folder, "audio_onset", "audio_highband").withColumn("score", p.clip(F.greatest("audio_onset", "audio_highband")))
    _, peak = w.crossings_and_peaks("score", 0.30)
    peaks = folds.strongest(by_pieces(rows, lambda x: x.withColumn("peak", peak).where("peak"), 0.0), "score", 1.2).select(*KEYS, "t")
    marks = candidates(spark, folder).select("job_id", F.col("t").alias("at"))
    free = joins.nearest(peaks, marks, ["job_id"], "t", "at", 1.5).where("nearest_at is null")
    return folds.spaced(free, 1.5, "t").select("job_id", micro("t").alias("t_us"))


def scene_starts(spark, folder):
    """Beginnings of scenes, none within 0.2 s of the one before that was kept."""
    scenes = load(spark, folder, "scenes", "job_id", "start").where("start is not null")
    return folds.spaced(scenes, 0.2, "start", ["job_id"]).select("job_id", micro("start").alias("start_us"))


def scene_middles(spark, folder):
    """The sample nearest to the middle of each scene, the earlier of two."""
    scenes = load(spark, folder, "scenes", "job_id", "start", "end").where("start is not null and `end` > start").distinct()
    spans = scenes.select("job_id", F.col("start").alias("lo"), F.col("end").alias("hi"))
    found = joins.within(tl(spark, folder, "view_type").select("job_id", "t", "view_type"), spans, ["job_id"], "t", "lo", "hi", closed=False)
    middle = F.abs(F.col("t") - (F.col("lo") + F.col("hi")) / 2)
    return found.groupBy("job_id", "lo", "hi").agg(F.min_by(F.struct("t", "view_type"), F.struct(middle, "t")).alias("x")).select(
        "job_id", micro("lo").alias("start_us"), micro("hi").alias("end_us"), micro("x.t").alias("t_us"), "x.view_type"
    )


# --- candidates, stops, clips


def merged_candidates(spark, folder):
    """Candidates with those nearer than 1.2 s merged into one."""
    merged = folds.merge_near(candidates(spark, folder), 1.2, "t", "confidence", "evidence", ["candidate_id"])
    return merged.select("job_id", micro("t").alias("t_us"), micro("confidence").alias("confidence"), "candidate_id")


def next_candidates(spark, folder):
    """Each candidate with the next one of its recording, the recording's end if it is the last."""
    rows = tl(spark, folder, "motion_raw")
    found = in_recordings(candidates(spark, folder), rows, "t").join(recordings(rows), KEYS)
    after = F.lead("t").over(w.Window.partitionBy(*KEYS).orderBy("t", "candidate_id"))
    return found.select("candidate_id", micro("t").alias("t_us"), micro(F.coalesce(after, F.col("duration"))).alias("next_us"))


def phase_labels(spark, folder):
    """The phase of the shot at each sample."""
    return stateful.label_phases(tl(spark, folder)).select("job_id", micro("t").alias("t_us"), "state")


def smoothed_motion(spark, folder):
    """The raw motion smoothed within the stretches between cuts."""
    return stateful.smoothed(tl(spark, folder, "motion_raw", "scene_cut_score")).select("job_id", micro("t").alias("t_us"), "session", micro("smooth").alias("smooth"))


def stops(spark, folder):
    """The timeline, the candidates in it and the stops after them: each used several times, so each is written once."""
    rows = cut(tl(spark, folder), "timeline")
    marks = folds.merge_near(candidates(spark, folder), 1.2, "t", "confidence", "evidence", ["candidate_id"])
    marks = cut(in_recordings(marks, rows, "t"), "marks")
    return rows, marks, cut(stateful.find_stops(rows, marks), "stops")


def motion_stops(spark, folder):
    """Where motion ends after each candidate."""
    found = stops(spark, folder)[2]
    return found.select("job_id", micro("t").alias("t_us"), *us("stop", "confirm", "stop_confidence"), "confirmed", "stop_review", "stop_reason")


def clips_of(mode: str):
    def query(spark, folder):
        rows, marks, found = stops(spark, folder)
        clip = sh.clip_bounds(found.join(marks.select(*KEYS, "t", "confidence"), [*KEYS, "t"]), rows, recordings(rows), mode)
        return clip.select("job_id", *us("strike", "start", "end", "stop"), "confirmed", "review")

    query.__name__ = f"clips_{mode}"
    query.__doc__ = f"Clips around the candidates in the mode {mode}, before overlaps are resolved."
    return query


def shots_of(mode: str):
    def query(spark, folder):
        rows, marks, found = stops(spark, folder)
        facts = marks.select(*KEYS, "t", "confidence", F.coalesce(F.col("evidence")["audio_onset"], F.lit(0.0)).alias("audio"), F.coalesce(F.col("evidence")["pre_ball_quiet_ratio"], F.lit(0.0)).alias("quiet"))
        clip = sh.clip_bounds(found.join(facts, [*KEYS, "t"]), rows, recordings(rows), mode)
        clip = clip.select(*KEYS, "strike", "start", "end", "stop", "uncapped", "confirmed", "confidence", "audio", "quiet", "review", "minimum")
        done = stateful.resolve_shots(clip, mode == "strict")
        return done.select("job_id", "shot_id", *us("strike", "clip_start", "clip_end", "stop"), "review", *us("replaced", "rejected"))

    query.__name__ = f"shots_{mode}"
    query.__doc__ = f"Shots cut in the mode {mode}, overlaps resolved."
    return query


def detected_stops(spark, folder):
    """Stops after the onsets that the timeline itself shows."""
    rows = cut(tl(spark, folder), "timeline")
    found = stateful.find_stops(rows, cut(detect(rows).select(*KEYS, "t"), "onsets"))
    return found.select("job_id", micro("t").alias("t_us"), micro("stop").alias("stop"), "confirmed", "stop_reason")


def refine_windows(spark, folder):
    """Stretches of the recording to look at again around each candidate, merged where less than 0.25 s apart."""
    rows, marks, found = stops(spark, folder)
    ends = recordings(rows)
    c = F.col
    after = F.lead("t").over(w.Window.partitionBy(*KEYS).orderBy("t"))
    hard = F.least("duration", c("t") + DEFAULT.stop.max_s + 0.8)
    begin = F.greatest(F.lit(0.0), c("t") - DEFAULT.refine_backward_s)
    planned = found.join(ends, KEYS).withColumns({"hard": hard, "begin": begin, "after": after})
    open_end = F.when(c("stop_reason") == "max_duration_review_cap", c("hard")).when(c("after") < c("hard"), F.least("hard", c("after") + 1.0)).otherwise(c("hard"))
    end = F.when(c("confirmed"), F.least("hard", F.greatest(c("begin") + 1.0, c("stop") + 0.8 + DEFAULT.refine_tail_s))).otherwise(open_end)
    ms = planned.select(*KEYS, to_ms("begin").alias("lo"), to_ms(end).alias("hi"))
    return merge_intervals(ms, KEYS, "lo", "hi", 250).select("job_id", "start_ms", "end_ms")


def refined_candidates(spark, folder):
    """Candidates moved to the first sample within 0.5 s that shows the transition; others lose a quarter of their confidence."""
    first = F.lag("t").over(w.ordered()).isNull()
    rows = by_pieces(tl(spark, folder), lambda x: w.transition_metrics(x).withColumns({"first": first, "fits": w.transition_confirmed() | w.sparse_dense_confirmed()}), w.MOMENT_S)
    fits = rows.where("fits and not first").select("job_id", F.col("t").alias("_t"))
    marks = candidates(spark, folder).select("candidate_id", "job_id", F.col("t").alias("at"), "confidence", F.greatest(F.lit(0.0), F.col("t") - 0.5).alias("lo"), (F.col("t") + 0.5).alias("hi"))
    moved = joins.within(fits, marks, ["job_id"], "_t", "lo", "hi").groupBy("candidate_id").agg(F.min("_t").alias("to"))
    out = marks.join(moved, "candidate_id", "left")
    sure = F.when(F.col("to").isNotNull(), F.greatest("confidence", F.lit(0.75))).otherwise(F.col("confidence") * 0.75)
    return out.select("candidate_id", micro(F.coalesce("to", "at")).alias("t_us"), micro(sure).alias("confidence"), F.col("to").isNotNull().alias("confirmed"))


def replay_links(spark, folder):
    """Candidates that repeat an earlier one."""
    rows = cut(tl(spark, folder, "motion_score", "view_type", "scene_cut_score"), "timeline")
    marks = in_recordings(candidates(spark, folder).select("job_id", "t", "confidence"), rows, "t").groupBy(*KEYS, "t").agg(F.max("confidence").alias("confidence"))
    signed = sh.signatures(marks, rows)
    wide = marks.select(*KEYS, "t", (F.col("t") - 1.0).alias("lo"), (F.col("t") + 1.0).alias("hi")).withColumnRenamed("t", "at")
    seen = joins.within(rows.select(*KEYS, "t", "view_type", "scene_cut_score"), wide, KEYS, "t", "lo", "hi").groupBy(*KEYS, "at").agg(
        F.bool_or(F.col("view_type").isin(*p.REPLAYS)).alias("explicit"),
        F.bool_or((F.col("scene_cut_score") >= 0.5) & F.col("t").between(F.col("at") - 0.8, F.col("at") + 0.8)).alias("transition"),
    ).withColumnRenamed("at", "t")
    full = signed.join(seen, [*KEYS, "t"], "left").withColumns({x: F.coalesce(x, F.lit(False)) for x in ("explicit", "transition")})
    return stateful.mark_replays(full).select("job_id", micro("t").alias("t_us"), "replay", micro("replay_of").alias("replay_of"))


def label_similarity(spark, folder):
    """Cosine of each embedding with the mean of its label."""
    rows = load(spark, folder, "embeddings", "vec_id", "embedding", "label")
    means = rows.select("label", F.posexplode("embedding")).groupBy("label", "pos").agg(F.avg("col").alias("m")).groupBy("label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("mean")
    )
    return rows.join(means, "label").select("vec_id", "label", F.rint(sh.cosine(F.col("embedding"), F.col("mean")) * 10_000).cast("bigint").alias("cosine_e4"))


# --- shots of the table


def shot_views(spark, folder):
    """The views shown during each clip."""
    rows = tl(spark, folder, "view_type")
    found = sh.views_between(in_recordings(clips(spark, folder), rows, "clip_start"), rows, "clip_start", "clip_end")
    return found.select("job_id", "shot_id", F.array_join("views", ",").alias("views"))


def shot_preparations(spark, folder):
    """Where the preparation of each shot begins."""
    rows = tl(spark, folder, "motion_score")
    found = sh.preparation_start(in_recordings(clips(spark, folder).where("cue_strike is not null"), rows, "cue_strike"), rows, 6.0, "cue_strike")
    return found.select("job_id", "shot_id", micro("prep").alias("prep"))


def shot_importance(spark, folder):
    """The importance of each clip."""
    rows = tl(spark, folder, "motion_score", "motion_area_ratio", "audio_rms")
    found = in_recordings(clips(spark, folder).where("cue_strike is not null and ball_motion_end is not null").drop("importance"), rows, "clip_start")
    return sh.importance(found, rows, stop="ball_motion_end", begin="cue_strike", replay=F.col("possible_replay")).select("job_id", "shot_id", micro("importance").alias("importance"))


def shot_offsets(spark, folder):
    """Where each included clip lies when a job's clips are joined."""
    return sh.running_offsets(clips(spark, folder).where("included"), ["job_id"], "clip_start", "clip_end", "shot_id").select("job_id", "shot_id", *us("rec_in", "rec_out"))


def shot_events(spark, folder):
    """Two events for each shot."""
    return sh.timeline_events(clips(spark, folder), ["job_id"], "cue_strike", "ball_motion_end", "clip_end").select("job_id", "shot_id", "event_type", *us("t", "until"))


def job_durations(spark, folder):
    """Length of each job's included clips, of all its clips, and how many there are."""
    length = F.col("clip_end") - F.col("clip_start")
    return clips(spark, folder).groupBy("job_id").agg(
        F.count(F.lit(1)).alias("n"), micro(F.sum(F.when(F.col("included"), length).otherwise(0.0))).alias("edited"), micro(F.sum(length)).alias("total")
    )


def matched_events(spark, folder):
    """Candidates matched one to one with the shots' strikes, 0.75 s apart at most."""
    predicted = candidates(spark, folder).select("job_id", F.col("t").alias("p")).distinct()
    truth = clean_shots(spark, folder).select("job_id", F.col("cue_strike").alias("g")).where("g is not null").distinct()
    return evaluate.match_events(predicted, truth, ["job_id"], 0.75).select("job_id", *us("p", "g", "d"))


def _evaluated(spark, folder):
    predicted = candidates(spark, folder).select("job_id", F.col("t").alias("p")).distinct()
    truth = clean_shots(spark, folder).select("job_id", F.col("cue_strike").alias("g")).where("g is not null").distinct()
    return evaluate.metrics_by_key(predicted, truth, ["job_id"], 0.75)


_RATIOS = ("precision", "recall", "f1", "missed_rate", "false_rate", "mean_error", "median_error")


def event_metrics(spark, folder):
    """Metrics of the candidates against the shots, by job."""
    return _evaluated(spark, folder).select("job_id", "predicted", "true", "matched", *us(*_RATIOS))


def event_report(spark, folder):
    """The same over all jobs."""
    return evaluate.macro(_evaluated(spark, folder)).select("videos", "predicted", "true", "matched", *us(*_RATIOS))


def _ranges(spark, folder):
    """The clips as ranges to keep, with the length of their source: the time of its last sample."""
    ends = tl(spark, folder, "motion_raw").groupBy("job_id").agg(F.max("t").alias("source_s"))
    return clean_shots(spark, folder).select("job_id", "shot_id", "clip_start", "clip_end").join(ends, "job_id", "left")


def keep_ranges(spark, folder):
    """The ranges of each job without a fault, joined where they touch."""
    ranges = _ranges(spark, folder)
    wrong = edits.range_violations(ranges, ["job_id"], "shot_id", "clip_start", "clip_end", "source_s").select("job_id", "shot_id")
    return edits.keep_ranges(ranges.join(wrong, ["job_id", "shot_id"], "left_anti"), ["job_id"], "clip_start", "clip_end")


def range_violations(spark, folder):
    """Ranges that forbid keeping a job's ranges as they are."""
    return edits.range_violations(_ranges(spark, folder), ["job_id"], "shot_id", "clip_start", "clip_end", "source_s")


def split_shots(spark, folder):
    """Every shot of 1 s or more split at its middle, renumbered."""
    rows = clips(spark, folder)
    return edits.split(rows, ["job_id"], (F.col("clip_start") + F.col("clip_end")) / 2, F.col("clip_end") - F.col("clip_start") >= 1.0).select("job_id", "shot_id", *us("clip_start", "clip_end", "cue_strike", "ball_motion_end"))


def merged_shots(spark, folder):
    """Each job's first two shots by clip merged into one, renumbered."""
    return edits.merge_first(clips(spark, folder), ["job_id"], 2).select("job_id", "shot_id", *us("clip_start", "clip_end", "cue_strike"), "included")


def deleted_shots(spark, folder):
    """Shots that are replays deleted, the others renumbered."""
    rows = clips(spark, folder)
    return edits.delete(rows, rows.where("possible_replay").select("job_id", "shot_id"), ["job_id"]).select("job_id", "shot_id", *us("clip_start", "clip_end"))


def shot_rows(spark, folder):
    """The rows of the shot list."""
    return sinks.shot_rows(clips(spark, folder))


def decision_list(spark, folder):
    """The lines of each job's edit decision list."""
    return sinks.decision_list(clips(spark, folder).where("included"))


def chapters(spark, folder):
    """Chapters of the joined clips, in ms."""
    return sinks.chapters(clips(spark, folder).where("included")).drop("rank")


def chapter_list(spark, folder):
    """The lines of each job's chapter list."""
    return sinks.chapter_list(clips(spark, folder).where("included"))


def carried_decisions(spark, folder):
    """Candidates as shots to be cut anew, with what was decided about the shots of the table they go back to."""
    marks = folds.merge_near(candidates(spark, folder), 1.2, "t", "confidence", "evidence", ["candidate_id"])
    new = marks.select("job_id", F.col("candidate_id").alias("shot_id"), F.col("t").alias("cue_strike"), F.lit(True).alias("included"), F.lit(None).cast("int").alias("linked_live_shot_id"))
    return edits.carry_over(new, clean_shots(spark, folder), ["job_id"]).select("job_id", "shot_id", "included", "linked_live_shot_id")


def scalar_functions(spark, folder):
    """The scalar functions, over the clips."""
    c = F.col
    rows = clips(spark, folder).withColumn("size", scalars.fit_even(c("shot_id") * 13 + 640, c("shot_id") * 7 + 480, 960, 540))
    return rows.select(
        "job_id", "shot_id", scalars.time_text(F.floor(c("clip_start") * 1000) / 1000).alias("at"), scalars.fraction(F.concat(c("shot_id").cast("string"), F.lit("/"), (c("shot_id") % 3).cast("string"))).alias("rate"),
        "size.width", "size.height", scalars.frame_at(c("clip_start"), F.lit(25.0)).alias("frame"),
        micro(scalars.to_source(c("clip_start"), F.lit(100.0), F.lit(50.0))).alias("source_us"), scalars.file_name(F.concat(F.lit("Shot "), c("shot_id").cast("string"), F.lit(": final!"))).alias("file"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        frame_scenes, near_cuts, audio_near, audio_seeds, scene_starts, scene_middles, merged_candidates, next_candidates, phase_labels, smoothed_motion, motion_stops,
        *[clips_of(m) for m in DEFAULT.modes], *[shots_of(m) for m in DEFAULT.modes], detected_stops, refine_windows, refined_candidates, replay_links, label_similarity, shot_views, shot_preparations, shot_importance,
        shot_offsets, shot_events, job_durations, matched_events, event_metrics, event_report, keep_ranges, range_violations, split_shots, merged_shots, deleted_shots,
        shot_rows, decision_list, chapters, chapter_list, carried_decisions, scalar_functions,
    )
}

_M = b.micro
_CAND = """k_c as (select candidate_id, arg_min({'job_id': job_id, 't': "timestamp", 'confidence': coalesce(case when isfinite(confidence) then confidence end, 0)},
   (ingested_at, "timestamp", coalesce(case when isfinite(confidence) then confidence end, 0))) x from strike_candidates where isfinite("timestamp") and candidate_id is not null group by 1),
cand as (select candidate_id, x.job_id job_id, x.t t, x.confidence confidence from k_c)"""
_FIN = "case when isfinite({0}) then {0} end"
_NAMES = ("cue_strike", "ball_motion_end", "clip_start", "clip_end", "shot_confidence", "importance")
_SHOTS = (
    "k_r as (select job_id, shot_id, " + ", ".join(_FIN.format(n) + " " + n for n in _NAMES)
    + ", coalesce(included, true) included, coalesce(possible_replay, false) possible_replay, coalesce(manual_review_required, false) manual_review_required, linked_live_shot_id, ingested_at from shots where job_id is not null and shot_id is not null),"
    " k_s as (select *, row_number() over (partition by job_id, shot_id order by ingested_at desc, coalesce(shot_confidence, -1) desc, coalesce(importance, -1) desc, included desc, possible_replay desc, manual_review_required desc) n from k_r),"
    " cs as (select * from k_s where n = 1), clip as (select * from cs where clip_start is not null and clip_end > clip_start)"
)
_SPANS = "rec as (select job_id, sitting, min(t) first_t, max(t) duration from tl group by all)"
_MATCH = f"""p_all as (select distinct job_id, t p from cand), g_all as (select distinct job_id, cue_strike g from cs where cue_strike is not null),
m_p as (select p.job_id, p, g, abs(p - g) d from p_all p join g_all g on p.job_id = g.job_id and p between g - 0.75 and g + 0.75 and abs(p - g) <= 0.75),
m_n as (select *, row_number() over (partition by job_id order by d, p, g) i from m_p),
m_k as (select job_id, 0::bigint i, []::double[] ps, []::double[] gs from (select distinct job_id from m_n)
  union all select n.job_id, n.i, case when list_contains(k.ps, n.p) or list_contains(k.gs, n.g) then k.ps else list_append(k.ps, n.p) end,
    case when list_contains(k.ps, n.p) or list_contains(k.gs, n.g) then k.gs else list_append(k.gs, n.g) end from m_k k join m_n n on n.job_id = k.job_id and n.i = k.i + 1),
m_l as (select job_id, arg_max(ps, i) ps, arg_max(gs, i) gs from m_k group by 1),
m_x as (select job_id, unnest(ps) p, unnest(gs) g from m_l), m as (select job_id, p, g, abs(p - g) d from m_x)"""
_METRICS = """e_p as (select job_id, count(*) predicted from p_all group by 1), e_g as (select job_id, count(*) "true" from g_all group by 1),
e_m as (select job_id, count(*) matched, avg(d) mean_error, median(d) median_error from m group by 1),
e as (select job_id, coalesce(predicted, 0) predicted, coalesce("true", 0) "true", coalesce(matched, 0) matched, coalesce(mean_error, 0) mean_error, coalesce(median_error, 0) median_error
  from e_p full join e_g using (job_id) left join e_m using (job_id)),
e2 as (select *, case when predicted > 0 then matched / predicted else 0 end "precision", case when "true" > 0 then matched / "true" else 0 end recall,
  case when "true" > 0 then ("true" - matched) / "true" else 0 end missed_rate, case when predicted > 0 then (predicted - matched) / predicted else 0 end false_rate from e),
e3 as (select *, case when "precision" + recall > 0 then 2 * "precision" * recall / ("precision" + recall) else 0 end f1 from e2)"""


def _spaced(source: str, t: str, gap: float, keys: str) -> str:
    same = " and ".join(f"n.{k} = k.{k}" for k in keys.split(", "))
    return f"""g_n as (select *, row_number() over (partition by {keys} order by {t}) i from (select distinct {keys}, {t} from {source})),
g_k as (select {keys}, i, {t} at_, true kept from g_n where i = 1
  union all select {', '.join('n.' + k for k in keys.split(', '))}, n.i, case when n.{t} - k.at_ >= {gap} then n.{t} else k.at_ end, n.{t} - k.at_ >= {gap} from g_k k join g_n n on {same} and n.i = k.i + 1)"""


_FOUR = "lpad(shot_id::varchar, greatest(4, length(shot_id::varchar))::int, '0')"
_MERGED_ID = """c_n as (select *, row_number() over (partition by job_id order by t, candidate_id) i from cand),
c_k as (select job_id, i, t kt, confidence ks, candidate_id kc, 0 step from c_n where i = 1
  union all select n.job_id, n.i, case when n.t - k.kt >= 1.2 or n.confidence > k.ks then n.t else k.kt end, case when n.t - k.kt >= 1.2 or n.confidence > k.ks then n.confidence else k.ks end,
    case when n.t - k.kt >= 1.2 or n.confidence > k.ks then n.candidate_id else k.kc end, case when n.t - k.kt >= 1.2 then 1 else 0 end from c_k k join c_n n on n.job_id = k.job_id and n.i = k.i + 1),
c_g as (select *, sum(step) over (partition by job_id order by i) g from c_k), mi as (select job_id, max_by(kt, i) t, max_by(kc, i) id from c_g group by job_id, g)"""
_TL = b.TIMELINE.replace("with ", "with recursive ", 1)
_RANGES = b.TIMELINE + f""", {_SHOTS}, z as (select job_id, max(t) source_s from tl group by all),
rg as (select cs.*, source_s, max(case when clip_start is not null then clip_end end) over (o rows between unbounded preceding and 1 preceding) reach, row_number() over o nth from cs left join z using (job_id) window o as (partition by job_id order by clip_start nulls first, clip_end nulls first, shot_id)),
rv as (select *, case when clip_start is null or clip_end is null then 'missing' when clip_start < -1e-3 or clip_end > greatest(0, source_s) + 1e-3 then 'outside'
  when least(clip_end, source_s) - greatest(0, clip_start) < 0.05 then 'too short' when reach is not null and greatest(0, clip_start) < least(reach, source_s) - 1e-3 then 'overlap' when nth > 200 then 'too many' end violation from rg)"""
_RATIO_SQL = ", ".join(_M(f'"{r}"', f'"{r}"') for r in _RATIOS)
SQL = {
    "frame_scenes": b.TIMELINE + f""", z as (select job_id, max(t) + 1.0 beyond from tl group by all),
s as (select job_id, start lo, case when start = max(start) over (partition by job_id) then greatest("end", beyond) else "end" end hi, coalesce(view_type, 'other') v from scenes left join z using (job_id) where start is not null and "end" > start)
select tl.job_id, {_M('t', 't_us')}, {_M('max(lo)', 'scene_us')}, arg_max(v, (lo, hi, v)) scene_view from tl left join s on s.job_id = tl.job_id and t >= lo and t < hi group by tl.job_id, t""",
    "near_cuts": b.TIMELINE + f""", s as (select distinct job_id, round(start, 3) cut from scenes where start is not null)
select tl.job_id, {_M('t', 't_us')}, {_M('arg_min(cut, (abs(cut - t), cut))', 'cut_us')} from tl join s on s.job_id = tl.job_id and t >= cut - 0.08 and t <= cut + 0.08 group by tl.job_id, t having min(abs(cut - t)) < 0.08""",
    "audio_near": b.TIMELINE + f""", a as (select *, max(audio_onset) over (partition by job_id, sitting order by t range between 0.12 preceding and 0.12 following) peak,
 last_value(case when layer = 'coarse' then audio_onset end ignore nulls) over (partition by job_id, sitting order by t rows unbounded preceding) before from tl)
select job_id, {_M('t', 't_us')}, {_M('peak', 'peak')}, {_M('before', 'before')} from a""",
    "scene_starts": "with recursive " + _spaced("(select job_id, start from scenes where start is not null)", "start", 0.2, "job_id") + f" select job_id, {_M('at_', 'start_us')} from g_k where kept",
    "scene_middles": b.TIMELINE + f""", s as (select distinct job_id, start lo, "end" hi from scenes where start is not null and "end" > start),
j as (select s.job_id, lo, hi, t, tl.view_type v from tl join s on s.job_id = tl.job_id and t >= lo and t < hi)
select job_id, {_M('lo', 'start_us')}, {_M('hi', 'end_us')}, {_M('arg_min(t, (abs(t - (lo + hi) / 2), t))', 't_us')}, arg_min(v, (abs(t - (lo + hi) / 2), t)) view_type from j group by job_id, lo, hi""",
    "merged_candidates": "with recursive " + _CAND + """, c_n as (select *, row_number() over (partition by job_id order by t, candidate_id) i from cand),
c_k as (select job_id, i, t kt, confidence ks, candidate_id kc, 0 step from c_n where i = 1
  union all select n.job_id, n.i, case when n.t - k.kt >= 1.2 or n.confidence > k.ks then n.t else k.kt end, case when n.t - k.kt >= 1.2 or n.confidence > k.ks then n.confidence else k.ks end,
    case when n.t - k.kt >= 1.2 or n.confidence > k.ks then n.candidate_id else k.kc end, case when n.t - k.kt >= 1.2 then 1 else 0 end from c_k k join c_n n on n.job_id = k.job_id and n.i = k.i + 1),
c_g as (select *, sum(step) over (partition by job_id order by i) g from c_k)"""
    + f" select job_id, {_M('max_by(kt, i)', 't_us')}, {_M('max_by(ks, i)', 'confidence')}, max_by(kc, i) candidate_id from c_g group by job_id, g",
    "next_candidates": b.TIMELINE + f", {_CAND}, {_SPANS} select candidate_id, {_M('t', 't_us')}, {_M('coalesce(lead(t) over (partition by c.job_id, sitting order by t, candidate_id), duration)', 'next_us')}"
    " from cand c join rec on rec.job_id = c.job_id and t between first_t and duration",
    "smoothed_motion": _TL + f""", a as (select *, (scene_cut_score >= 0.42)::int cut, row_number() over (partition by job_id, sitting order by t) i from tl),
k as (select job_id, sitting, i, t, cut session, motion_raw smooth from a where i = 1
 union all select a.job_id, a.sitting, a.i, a.t, k.session + a.cut, case when a.cut = 1 then a.motion_raw else 0.6 * a.motion_raw + 0.4 * k.smooth end from k join a on a.job_id = k.job_id and a.sitting = k.sitting and a.i = k.i + 1)
select job_id, {_M('t', 't_us')}, session, {_M('smooth', 'smooth')} from k""",
    "refined_candidates": b.TIMELINE + f""", {_TRANS}, {_CAND}, f as (select job_id, t ft from d where (confirmed or sparse_confirmed) and last_t is not null),
m as (select candidate_id, any_value(t) at_, any_value(confidence) confidence, min(ft) mt from cand c left join f on f.job_id = c.job_id and ft between greatest(0, t - 0.5) and t + 0.5 group by 1)
select candidate_id, {_M('coalesce(mt, at_)', 't_us')}, {_M('case when mt is not null then greatest(confidence, 0.75) else confidence * 0.75 end', 'confidence')}, mt is not null confirmed from m""",
    "label_similarity": """with e as (select label, generate_subscripts(embedding, 1) i, unnest(embedding)::double x, vec_id from embeddings),
m as (select label, i, avg(x) m from e group by all)
select vec_id, e.label, round_even(sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))) * 10000, 0)::bigint cosine_e4 from e join m using (label, i) group by vec_id, e.label""",
    "shot_views": b.TIMELINE + f""", {_SHOTS}, {_SPANS}, s as (select clip.* from clip join rec on rec.job_id = clip.job_id and clip_start between first_t and duration),
r as (select s.job_id, shot_id, sitting from clip s join rec on rec.job_id = s.job_id and clip_start between first_t and duration)
select s.job_id, s.shot_id, coalesce(string_agg(distinct tl.view_type, ',' order by tl.view_type), '') "views" from s join r on r.job_id = s.job_id and r.shot_id = s.shot_id
left join tl on tl.job_id = s.job_id and tl.sitting = r.sitting and t between clip_start and clip_end group by s.job_id, s.shot_id""",
    "shot_preparations": b.TIMELINE + f""", {_SHOTS}, {_SPANS}, s as (select clip.*, sitting from clip join rec on rec.job_id = clip.job_id and cue_strike between first_t and duration)
select s.job_id, shot_id, {_M('coalesce(max(t), any_value(greatest(0, cue_strike - 6.0)))', 'prep')} from s left join tl on tl.job_id = s.job_id and tl.sitting = s.sitting and tl.motion_score > 0.4
 and t >= greatest(0, cue_strike - 6.0) and t < cue_strike group by s.job_id, shot_id""",
    "shot_importance": b.TIMELINE + f""", {_SHOTS}, {_SPANS}, s as (select clip.*, sitting from clip join rec on rec.job_id = clip.job_id and clip_start between first_t and duration where cue_strike is not null and ball_motion_end is not null),
i as (select s.job_id, shot_id, avg(motion_score) e, avg(motion_area_ratio) a, avg(audio_rms) r from s join tl on tl.job_id = s.job_id and tl.sitting = s.sitting and t between clip_start and clip_end group by all),
l as (select s.job_id, shot_id, avg(audio_rms) loud from s join tl on tl.job_id = s.job_id and tl.sitting = s.sitting and t between ball_motion_end and ball_motion_end + 3.0 group by all)
select s.job_id, s.shot_id, {_M(f"coalesce(case when e is not null then {b.clip('0.2 * e + 0.15 * least(1.0, a / 0.02) + 0.10 * least(1.0, (ball_motion_end - cue_strike) / 15.0) + 0.25 * possible_replay::int + 0.10 * r + 0.2 * coalesce(loud, 0)')} end, 0.3)", 'importance')}
from s left join i using (job_id, shot_id) left join l using (job_id, shot_id)""",
    "shot_offsets": f"with {_SHOTS}, o as (select *, sum(clip_end - clip_start) over (partition by job_id order by shot_id rows unbounded preceding) ro from clip where included)"
    f" select job_id, shot_id, {_M('ro - (clip_end - clip_start)', 'rec_in')}, {_M('ro', 'rec_out')} from o",
    "shot_events": f"with {_SHOTS} select job_id, shot_id, 'cue_strike' event_type, {_M('cue_strike', 't')}, {_M('ball_motion_end', 'until')} from clip where cue_strike is not null"
    f" union all select job_id, shot_id, 'ball_stop', {_M('ball_motion_end')}, {_M('clip_end')} from clip where ball_motion_end is not null",
    "job_durations": f"with {_SHOTS} select job_id, count(*) n, {_M('sum(case when included then clip_end - clip_start else 0 end)', 'edited')}, {_M('sum(clip_end - clip_start)', 'total')} from clip group by 1",
    "matched_events": f"with recursive {_CAND}, {_SHOTS}, {_MATCH} select job_id, {_M('p', 'p')}, {_M('g', 'g')}, {_M('d', 'd')} from m",
    "event_metrics": f'with recursive {_CAND}, {_SHOTS}, {_MATCH}, {_METRICS} select job_id, predicted, "true", matched, {_RATIO_SQL} from e3',
    "event_report": f'with recursive {_CAND}, {_SHOTS}, {_MATCH}, {_METRICS} select count(*) videos, sum(predicted)::bigint predicted, sum("true")::bigint "true", sum(matched)::bigint matched, '
    + ", ".join(_M(f'avg("{r}")', f'"{r}"') for r in _RATIOS) + " from e3",
    "keep_ranges": f"""{_RANGES}, v as (select distinct job_id, greatest(0, round(clip_start * 1000)::bigint) lo, round(clip_end * 1000)::bigint hi from rv where violation is null),
h as (select *, case when lo > max(hi) over w + 1 or max(hi) over w is null then 1 else 0 end h from v window w as (partition by job_id order by lo, hi rows between unbounded preceding and 1 preceding)),
i as (select *, sum(h) over (partition by job_id order by lo, hi rows unbounded preceding) i from h)
select job_id, min(lo) start_ms, max(hi) end_ms from i group by job_id, i""",
    "range_violations": f"{_RANGES} select job_id, shot_id, violation from rv where violation is not null",
    "split_shots": f"""with {_SHOTS}, s as (select *, (clip_start + clip_end) / 2 cut, clip_end - clip_start >= 1.0 yes from clip),
u as (select job_id, shot_id, 0 part, clip_start a, case when yes then cut else clip_end end e, cue_strike st, case when yes then least(ball_motion_end, cut) else ball_motion_end end me from s
 union all select job_id, shot_id, 1, cut, clip_end, greatest(cut, least(cue_strike, clip_end)), ball_motion_end from s where yes)
select job_id, row_number() over (partition by job_id order by a, shot_id, part)::int shot_id, {_M('a', 'clip_start')}, {_M('e', 'clip_end')}, {_M('st', 'cue_strike')}, {_M('me', 'ball_motion_end')} from u""",
    "merged_shots": f"""with {_SHOTS}, r as (select *, row_number() over (partition by job_id order by clip_start, shot_id) k from clip),
u as (select job_id, min(k) k, min(clip_start) a, max(clip_end) e, arg_min(coalesce(cue_strike, -1e300), k) st, bool_or(included) inc from r group by job_id, greatest(k, 2))
select job_id, row_number() over (partition by job_id order by a, k)::int shot_id, {_M('a', 'clip_start')}, {_M('e', 'clip_end')}, {_M("case when st > -1e299 then st end", 'cue_strike')}, inc included from u""",
    "deleted_shots": f"with {_SHOTS} select job_id, row_number() over (partition by job_id order by clip_start, shot_id)::int shot_id, {_M('clip_start', 'clip_start')}, {_M('clip_end', 'clip_end')} from clip where not possible_replay",
    "shot_rows": f"with {_SHOTS} select job_id, shot_id, round(clip_start, 3) clip_start, round(cue_strike, 3) cue_strike, round(clip_end, 3) clip_end, round(clip_end - clip_start, 3) duration, round(shot_confidence, 3) confidence,"
    " round(importance, 3) importance, possible_replay, manual_review_required review_required, included from clip",
    "chapters": f"""with {_SHOTS}, o as (select *, sum(clip_end - clip_start) over (partition by job_id order by shot_id rows unbounded preceding) ro from clip where included)
select job_id, shot_id, round_even((ro - (clip_end - clip_start)) * 1000, 0)::bigint start_ms, round_even(ro * 1000, 0)::bigint end_ms, 'Shot ' || {_FOUR} || coalesce(' @ ' || printf('%.3f', cue_strike) || 's', '') title from o""",
    "chapter_list": f"""with {_SHOTS}, o as (select *, row_number() over (partition by job_id order by shot_id) i, sum(clip_end - clip_start) over (partition by job_id order by shot_id rows unbounded preceding) ro from clip where included)
select job_id, i + 1 line_no, printf('%.3f', ro - (clip_end - clip_start)) || chr(9) || printf('%.3f', clip_start) || chr(9) || printf('%.3f', clip_end) || chr(9) || shot_id || chr(9) || coalesce(printf('%.3f', cue_strike), '') line from o
union all select distinct job_id, 1, '# edited_time' || chr(9) || 'source_start' || chr(9) || 'source_end' || chr(9) || 'shot_id' || chr(9) || 'cue_strike' from o""",
    "carried_decisions": "with recursive " + _CAND + f", {_SHOTS}, " + _MERGED_ID + """,
nw as (select job_id, id, t, row_number() over (partition by job_id order by t, id) i from mi), od as (select job_id, shot_id, cue_strike, included, linked_live_shot_id from cs where cue_strike is not null),
kd as (select job_id, 0::bigint i, []::int[] used, null::bigint id, null::int took from (select distinct job_id from nw)
 union all select k.job_id, n.i, case when o is null then k.used else list_append(k.used, o) end, n.id, o from kd k join nw n on n.job_id = k.job_id and n.i = k.i + 1
  left join lateral (select arg_min(od.shot_id, (abs(od.cue_strike - n.t), od.cue_strike, od.shot_id)) o from od where od.job_id = n.job_id and abs(od.cue_strike - n.t) <= 1.5 and not list_contains(k.used, od.shot_id)) on true)
select kd.job_id, kd.id shot_id, coalesce(od.included, true) included, od.linked_live_shot_id from kd left join od on od.job_id = kd.job_id and od.shot_id = kd.took where i > 0""",
}
