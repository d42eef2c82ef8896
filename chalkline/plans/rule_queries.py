"""Queries over row rules, sampling and the finer points of the timeline."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from chalkline.functions import predicates as p
from chalkline.operators import joins, rules, scenes, shots as sh, windows as w
from chalkline.operators.pieces import by_pieces
from chalkline.operators.timeline import KEYS, micro
from chalkline.plans import base_sql as b
from chalkline.plans.shot_queries import _CAND, _SHOTS, _SPANS, _TIMES, _spaced, candidates, clean_shots, clips, in_recordings, refined_candidates, us
from chalkline.plans.shot_queries import SQL as _SHOT_SQL
from chalkline.plans.timeline_queries import _SCORE, _TRANS, _USABLE, _W, _suppress, tl
from chalkline.sources.tables import load

c = F.col


def exported_shots(spark, folder):
    """Shots for export: live and included ones with a confidence of 0.5 or more."""
    return rules.export_filter(clips(spark, folder), least_confidence=0.5).select("job_id", "shot_id")


def exported_with_replays(spark, folder):
    """The same with replays, included or not."""
    return rules.export_filter(clips(spark, folder), include_replays=True).select("job_id", "shot_id")


def boundary_violations(spark, folder):
    """Shots that break the strict boundaries; a source is as long as its last sample is late."""
    ends = tl(spark, folder, "motion_raw").groupBy("job_id").agg(F.max("t").alias("source_s"))
    return rules.boundary_violations(clean_shots(spark, folder, *_TIMES), durations=ends)


def retained_candidates(spark, folder):
    """Candidates that the timeline confirms, or that were heard (half the loudest or more) and that it supports."""
    confirmed = refined_candidates(spark, folder).select("candidate_id", "confirmed")
    heard = candidates(spark, folder).select("candidate_id", F.coalesce(c("evidence")["audio"], F.lit(0.0)).alias("heard"))
    rows = confirmed.join(heard, "candidate_id").join(audio_support(spark, folder).select("candidate_id", "supported"), "candidate_id", "left")
    said = F.create_map(F.lit("dense_transition_confirmed"), c("confirmed").cast("double"), F.lit("audio_seed"), (c("heard") >= 0.5).cast("double"))
    return rows.where(rules.retained(said, c("supported"))).select("candidate_id", "confirmed")


def first_inclusion(spark, folder):
    """Whether each candidate's shot would be included at first, and whether its replay doubt calls for review."""
    rows = load(spark, folder, "strike_candidates", "candidate_id", "possible_replay", "camera_view", "evidence").where("candidate_id is not null")
    included, doubt = rules.included_at_first(c("possible_replay"), c("camera_view"), c("evidence"))
    return rows.groupBy("candidate_id").agg(F.bool_and(included).alias("included"), F.bool_or(doubt).alias("review"))


def repaired_views(spark, folder):
    """Views after the repair of wrong replay labels."""
    return rules.repaired_views(tl(spark, folder, "view_type", "green_ratio")).select("job_id", micro("t").alias("t_us"), "repaired_view")


def confirmed_cuts(spark, folder):
    """Cuts and confirmed fades; the cut score is the distance to the row before, that two rows back their sum."""
    two = F.least(F.lit(1.0), c("scene_cut_score") + F.coalesce(F.lag("scene_cut_score").over(w.ordered()), F.lit(0.0)))
    rows = by_pieces(tl(spark, folder, "scene_cut_score"), lambda x: rules.confirmed_cuts(x.withColumn("two", two), "scene_cut_score", "two").where("cut"), 0.0, 2)
    return rows.select("job_id", micro("t").alias("t_us"))


def scene_segments(spark, folder):
    """Scenes between the cuts of the timeline, with the view in their middle."""
    rows = tl(spark, folder, "scene_cut_score", "view_type").withColumn("cut", c("scene_cut_score") >= 0.42)
    return scenes.segment(rows, "cut").select("job_id", *us("start", "end"), "view_type", "n")


def stable_speeds(spark, folder):
    """Speed of the cue ball from its place over the last 0.24 s."""
    return by_pieces(tl(spark, folder, "cue_ball_x", "cue_ball_y", "ball_diameter_px"), rules.stable_speed, 0.24).select("job_id", micro("t").alias("t_us"), F.rint(c("stable_speed") * 1000).cast("bigint").alias("stable_speed_e3"))


def sampled_rows(spark, folder):
    """One row each half second of every recording."""
    return rules.sampled(tl(spark, folder, "motion_raw"), 2.0).select("job_id", micro("t").alias("t_us"))


def joined_seek(spark, folder):
    """Where the middle of each included clip lies in the source, sought by its time on the joined clips."""
    offsets = sh.running_offsets(clips(spark, folder).where("included"), ["job_id"], "clip_start", "clip_end", "shot_id")
    times = offsets.select("job_id", ((c("rec_in") + c("rec_out")) / 2).alias("at"))
    return rules.seek(offsets, times).select("job_id", "shot_id", *us("source_t"))


def audio_support(spark, folder):
    """What the picture says around each candidate: median before, peak and active samples after."""
    rows = tl(spark, folder).withColumn("a", p.audio_support_activity())
    marks = in_recordings(candidates(spark, folder).select("candidate_id", "job_id", c("t").alias("at")), rows, "at")
    spans = marks.select("candidate_id", *KEYS, "at", (c("at") - 0.35).alias("lo"), (c("at") + 1.8).alias("hi"))
    near = joins.within(rows.select(*KEYS, "t", "a"), spans, KEYS, "t", "lo", "hi").groupBy("candidate_id").agg(
        w.median_of(F.collect_list(F.when(c("t") < c("at"), c("a")))).alias("before"), F.max(F.when(c("t") >= c("at"), c("a"))).alias("peak"),
        F.count_if((c("t") >= c("at")) & (c("a") >= 0.18)).alias("active"),
    )
    supported = (F.coalesce(c("before"), F.lit(0.0)) <= 0.55) & (c("peak") >= 0.20) & (c("active") >= 2)
    return near.select("candidate_id", *us("before", "peak"), "active", F.coalesce(supported, F.lit(False)).alias("supported"))


def shot_lengths(spark, folder):
    """Seconds from strike to end of motion over all shots: median, mean, and how many reach 9.9 s."""
    rows = clean_shots(spark, folder).withColumn("s", c("ball_motion_end") - c("cue_strike")).where("s is not null")
    return rows.agg(F.count(F.lit(1)).alias("n"), micro(F.expr("percentile(s, 0.5)")).alias("median"), micro(F.avg("s")).alias("mean"), F.count_if(c("s") >= 9.9).alias("capped"))


def rows_per_view(spark, folder):
    """Per recording and view: samples, those valid for onsets, and total motion (in ten-thousandths)."""
    return tl(spark, folder).groupBy(*KEYS, "view_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(p.valid_strike()).alias("valid"), F.sum(F.rint(c("motion_raw") * 10_000).cast("bigint")).alias("motion"))


QUERIES = {
    f.__name__: f
    for f in (
        exported_shots, exported_with_replays, boundary_violations, retained_candidates, first_inclusion, repaired_views, confirmed_cuts, scene_segments, stable_speeds, sampled_rows, joined_seek, audio_support, shot_lengths,
        rows_per_view,
    )
}

_M = b.micro
_REPLAY_SHOT = "(possible_replay or linked_live_shot_id is not null or list_has_any(coalesce(camera_views, []), ['replay', 'slow_motion_replay']))"
_SHOTS_ALL = _SHOTS.replace("ingested_at from shots", "ingested_at, camera_views from shots")
SQL = {
    "exported_shots": f"with {_SHOTS_ALL} select job_id, shot_id from clip where not {_REPLAY_SHOT} and included and coalesce(shot_confidence, 0) >= 0.5",
    "exported_with_replays": f"with {_SHOTS_ALL} select job_id, shot_id from clip where {_REPLAY_SHOT} or included",
    "boundary_violations": b.TIMELINE + ", " + _SHOTS.replace("ingested_at from shots", "ingested_at, " + ", ".join(f"case when isfinite({x}) then {x} end {x}" for x in _TIMES) + " from shots")
    + """, z as (select job_id, max(t) source_s from tl group by all),
w as (select cs.*, coalesce(cue_strike_timestamp, cue_strike) s, coalesce(clip_start_timestamp, clip_start) a, coalesce(clip_end_timestamp, clip_end) e, coalesce(physical_stop_timestamp, ball_motion_end) p, case when source_s > 0 then source_s end src from cs left join z using (job_id)),
u as (select job_id, shot_id, unnest([case when abs(cue_strike - cue_strike_timestamp) > 1e-6 then 'cue_strike_alias' end, case when abs(clip_start - clip_start_timestamp) > 1e-6 then 'clip_start_alias' end,
 case when abs(clip_end - clip_end_timestamp) > 1e-6 then 'clip_end_alias' end, case when s is not null and abs(a - greatest(0, s - 2)) > 1e-6 then 'start' end,
 case when p is not null and s is not null and abs(e - least(src, greatest(p, s + 4))) > 1e-6 then 'end' end, case when stop_confirmation_timestamp + 1e-6 < p then 'confirmation' end, case when last_ball_motion_timestamp > p + 1e-6 then 'last_motion' end,
 case when a < -1e-6 or e <= a + 1e-6 then 'interval' end, case when not s between a - 1e-6 and e + 1e-6 then 'strike' end, case when e > src + 1 / 30.0 then 'source' end]) violation from w) select * from u where violation is not null""",
    "repaired_views": b.TIMELINE + f""", f as (select *, avg(({b.REPLAY})::int) over (partition by job_id, sitting) >= 0.9 and avg((green_ratio >= 0.18)::int) over (partition by job_id, sitting) >= 0.2 wrong from tl)
select job_id, {_M('t', 't_us')}, case when wrong and green_ratio >= 0.18 then 'main_table' else view_type end repaired_view from f""",
    "confirmed_cuts": b.TIMELINE + f""", a as (select *, least(1.0, scene_cut_score + coalesce(lag(scene_cut_score) over ({_W}), 0)) two from tl), n as (select *, lead(two) over ({_W}) nx from a)
select job_id, {_M('t', 't_us')} from n where scene_cut_score >= 0.42 or (two >= 0.18 and coalesce(nx >= 1.2 * 0.18, false))""",
    "stable_speeds": b.TIMELINE + f""", pt as (select * from tl where cue_ball_x is not null and cue_ball_y is not null),
j as (select x.job_id, x.t, y.t yt, y.cue_ball_x px, y.cue_ball_y py from tl x join pt y on x.job_id = y.job_id and x.sitting = y.sitting and y.t >= x.t - 0.24 and y.t <= x.t),
l as (select *, lag(px) over (partition by job_id, t order by yt) lx, lag(py) over (partition by job_id, t order by yt) ly from j),
s as (select job_id, t, count(*) n, regr_slope(px, yt) sx, regr_slope(py, yt) sy, sqrt((arg_max(px, yt) - arg_min(px, yt)) ** 2 + (arg_max(py, yt) - arg_min(py, yt)) ** 2) way,
  sum(sqrt((px - lx) ** 2 + (py - ly) ** 2)) path from l group by all)
select tl.job_id, {_M('tl.t', 't_us')}, round_even(coalesce(case when n >= 2 and way >= 0.08 * greatest(ball_diameter_px, 1.0) and way >= 0.35 * path
  then sqrt(coalesce(sx, 0) ** 2 + coalesce(sy, 0) ** 2) / greatest(ball_diameter_px, 1.0) end, 0) * 1000, 0)::bigint stable_speed_e3 from tl left join s using (job_id, t)""",
    "sampled_rows": b.TIMELINE + f""", o as (select *, floor((t - min(t) over (partition by job_id, sitting)) * 2.0 + 1e-6) slot from tl)
select job_id, {_M('min(t)', 't_us')} from o group by job_id, sitting, slot""",
    "joined_seek": f"""with {_SHOTS}, o as (select *, sum(clip_end - clip_start) over (partition by job_id order by shot_id rows unbounded preceding) ro from clip where included),
r as (select *, ro - (clip_end - clip_start) ri from o), q as (select job_id, (ri + ro) / 2 at_ from r)
select r.job_id, shot_id, {_M('clip_start + at_ - ri', 'source_t')} from q join r on r.job_id = q.job_id and at_ >= ri and at_ < ro""",
    "audio_support": b.TIMELINE + f""", {_CAND}, {_SPANS}, m as (select c.*, sitting from cand c join rec on rec.job_id = c.job_id and c.t between first_t and duration),
a as (select m.candidate_id, m.t at_, tl.t, {b.AUDIO_SUPPORT} a from m join tl on tl.job_id = m.job_id and tl.sitting = m.sitting and tl.t >= m.t - 0.35 and tl.t <= m.t + 1.8),
g as (select candidate_id, median(case when t < at_ then a end) before, max(case when t >= at_ then a end) peak, count(*) filter (t >= at_ and a >= 0.18) active from a group by 1)
select candidate_id, {_M('before', 'before')}, {_M('peak', 'peak')}, active, coalesce(coalesce(before, 0) <= 0.55 and peak >= 0.20 and active >= 2, false) supported from g""",
    "shot_lengths": f"with {_SHOTS}, s as (select ball_motion_end - cue_strike s from cs where ball_motion_end is not null and cue_strike is not null)"
    f" select count(*) n, {_M('median(s)', '\"median\"')}, {_M('avg(s)', '\"mean\"')}, count(*) filter (s >= 9.9) capped from s",
    "rows_per_view": b.TIMELINE + f"select job_id, sitting, view_type, count(*) n, count(*) filter ({b.VALID_STRIKE}) \"valid\", sum(round_even(motion_raw * 10000, 0)::bigint)::bigint motion from tl group by all",
}

SQL["retained_candidates"] = f"""with {_CAND.replace("'confidence': coalesce", "'heard': coalesce(evidence['audio'], 0), 'confidence': coalesce").replace("x.confidence confidence from", "x.confidence confidence, x.heard heard from")}
select r.candidate_id, r.confirmed from ({_SHOT_SQL['refined_candidates']}) r join cand using (candidate_id) left join ({SQL['audio_support']}) s using (candidate_id) where r.confirmed or (heard >= 0.5 and coalesce(s.supported, false))"""
SQL["first_inclusion"] = """select candidate_id, bool_and(not (coalesce(possible_replay, false) and (coalesce(camera_view in ('replay', 'slow_motion_replay'), false) or coalesce(evidence['replay_signature_confirmed'], 0) >= 0.5))) included,
 bool_or(coalesce(possible_replay, false)) review from strike_candidates where candidate_id is not null group by 1"""

# Checks of queries defined in the other modules.
_PEAKS = f"""a_s as (select *, {b.clip('greatest(audio_onset, audio_highband)')} score from tl), a_l as (select *, lag(score) over ({_W}) p, lead(score) over ({_W}) n from a_s),
a_p as (select job_id, sitting, t, score, row_number() over (partition by job_id, sitting order by score desc, t) i from a_l where score >= 0.30 and score >= p and score > n),
a_k as (select job_id, sitting, 0::bigint i, []::double[] ts from (select distinct job_id, sitting from a_p)
  union all select x.job_id, x.sitting, x.i, case when len(list_filter(k.ts, lambda z: abs(z - x.t) < 1.2)) > 0 then k.ts else list_append(k.ts, x.t) end
  from a_k k join a_p x on x.job_id = k.job_id and x.sitting = k.sitting and x.i = k.i + 1),
a_f as (select job_id, sitting, unnest(arg_max(ts, i)) t from a_k group by 1, 2)"""
_REC = b.TIMELINE.replace("with ", "with recursive ", 1)
_STEP = """case when not usable then case when s in (0, 1, 6) then 0 else s end
 when s = 6 then 0
 when s = 0 then case when stationary and x.t - quiet >= 0.30 then 1 else 0 end
 when s = 1 then case when score >= 0.35 and coalesce(x.t - quiet >= 0.30, false) then 2 when not stationary and not from_rest then 0 else 1 end
 when s = 2 then case when from_rest then case when coalesce(x.t - mv >= 0.12, false) then 3 else 2 end when coalesce(x.t - cand > 0.75, false) then case when stationary then 1 else 0 end else 2 end
 when s = 3 then case when moving or from_rest then 4 when coalesce(x.t - cand > 0.75, false) then 0 else 3 end
 when s = 4 then case when moving then 4 else 5 end
 else case when moving then 4 when coalesce(x.t - still >= 0.50, false) then 6 else 5 end end"""
_PHASES = f"""p_i as (select job_id, sitting, t, {b.VALID_STATE} and occluded_ball_count = 0 usable,
 (case when {b.OBSERVED} then moving_ball_count > 0 or greatest(cue_ball_normalized_speed, max_ball_normalized_speed, ball_residual_motion) >= 0.18 else motion_score >= 0.35 and not (camera_motion_magnitude > 6 and residual_motion_mean < 1) end) from_rest,
 (case when {b.OBSERVED} then moving_ball_count > 0 or greatest(cue_ball_normalized_speed, max_ball_normalized_speed, ball_residual_motion) >= 0.08 else motion_score >= 0.20 and not (camera_motion_magnitude > 6 and residual_motion_mean < 1) end) moving,
 (case when {b.OBSERVED} then (cue_ball_track_confidence >= 0.45 or cue_ball_detected) and cue_ball_normalized_speed <= 0.65 and moving_ball_count = 0 else motion_score <= 0.28 end) stationary,
 strike_score score, row_number() over ({_W}) i from tl),
p_k as (select job_id, sitting, 0::bigint i, null::double t, 0 s, null::double quiet, null::double cand, null::double mv, null::double still from (select distinct job_id, sitting from p_i)
 union all select x.job_id, x.sitting, x.i, x.t, {_STEP},
  case when not usable then case when s in (0, 1, 6) then null else quiet end when s = 6 then case when stationary then x.t end
   when s = 0 then case when not stationary then null when quiet is null then x.t else quiet end
   when s = 1 and not (score >= 0.35 and coalesce(x.t - quiet >= 0.30, false)) and not stationary and not from_rest then null else quiet end,
  case when not usable then case when s in (0, 1, 6) then null else cand end when s = 6 then null when s = 1 and score >= 0.35 and coalesce(x.t - quiet >= 0.30, false) then x.t
   when s = 2 and not from_rest and coalesce(x.t - cand > 0.75, false) then null else cand end,
  case when not usable then case when s in (0, 1, 6) then null else mv end when s = 6 then null when s = 1 and score >= 0.35 and coalesce(x.t - quiet >= 0.30, false) then case when from_rest then x.t end
   when s = 2 then case when not from_rest then null when mv is null then x.t else mv end else mv end,
  case when not usable then case when s = 5 then null else still end when s = 6 then null when s = 4 and not moving then x.t when s = 5 then case when moving then null when still is null then x.t else still end else still end
 from p_k k join p_i x on x.job_id = k.job_id and x.sitting = k.sitting and x.i = k.i + 1)"""
_HIDDEN = f"""{_USABLE},
pre as (select x.job_id, x.t, count(y.t) n, avg((y.motion_raw <= 0.28)::int) quiet, median(y.motion_raw) raw_median, avg((y.max_ball_normalized_speed <= 5.0)::int) ball_quiet, median(y.max_ball_normalized_speed) ball_median,
   count(*) filter (r) reliable_n, avg(case when r then (y.speed <= 0.65)::int end) reliable_still, max_by(y.cue_ball_x, y.t) filter (r) ax, max_by(y.cue_ball_y, y.t) filter (r) ay, max_by(y.ball_diameter_px, y.t) filter (r) ad
   from u x left join (select *, cue_ball_detected and cue_ball_track_confidence >= 0.45 and cue_ball_x is not null and cue_ball_y is not null r from u where valid) y
   on x.job_id = y.job_id and x.sitting = y.sitting and y.t >= x.t - 0.5 and y.t < x.t - 0.03 group by all),
q as (select x.job_id, x.t, y.t yt, y.motion_raw raw, y.max_ball_normalized_speed ball, y.ball_residual_motion residual, y.cue_ball_detected seen, y.cue_ball_track_confidence sure, y.cue_ball_x px, y.cue_ball_y py,
   sum((not (y.motion_raw >= 0.22 and (y.max_ball_normalized_speed >= 1.0 or y.ball_residual_motion >= 0.35)))::int) over (partition by x.job_id, x.t order by y.t) misses
   from u x join u y on x.job_id = y.job_id and x.sitting = y.sitting and y.valid and y.t >= x.t and y.t <= x.t + 0.3),
post as (select q.job_id, q.t, count(*) filter (misses = 0) onset_run, max(raw) onset_raw, max(ball) onset_speed, max(residual) onset_residual,
   coalesce(bool_or(yt > q.t + 1e-6 and (not seen or sure < 0.315)), false) missing,
   coalesce(bool_or(yt > q.t + 1e-6 and seen and px is not null and py is not null and ax is not null and sqrt((px - ax) ** 2 + (py - ay) ** 2) / greatest(ad, 1.0) >= 1.5), false) jumps
   from q left join pre using (job_id, t) group by q.job_id, q.t),
h as (select u.job_id, u.t, coalesce(quiet, 0) quiet, coalesce(raw_median, 1) raw_median, coalesce(ball_quiet, 0) ball_quiet, coalesce(ball_median, 1) ball_median, coalesce(onset_run, 0) onset_run,
   coalesce(onset_raw, 0) onset_raw, coalesce(onset_speed, 0) onset_speed, coalesce(onset_residual, 0) onset_residual, coalesce(reliable_n, 0) reliable_n, coalesce(reliable_still, 0) reliable_still,
   coalesce(missing, false) missing, coalesce(jumps, false) jumps from u left join pre using (job_id, t) left join post using (job_id, t))"""
_HIDDEN_ONLY = re.sub(r"\b(pre|q|post)\b", r"h_\1", _HIDDEN.removeprefix(_USABLE + ",\n"))
_DETECT = f"""{_TRANS}, {_SCORE}, {_HIDDEN_ONLY},
hc as (select *, quiet >= 0.8 and raw_median <= 0.28 and ball_quiet >= 0.5 and ball_median <= 5 and reliable_n >= 2 and reliable_still >= 0.7 and (missing or jumps) and onset_run >= 2 and onset_raw >= 0.22 and onset_speed >= 1.0 hidden from h),
sl as (select *, lag(strike_score) over ({_W}) lp, lead(strike_score) over ({_W}) ln from scored),
sq as (select x.job_id, x.t, coalesce(median(y.motion_raw) <= 0.28, true) calm from scored x left join scored y on x.job_id = y.job_id and x.sitting = y.sitting and y.valid and y.t >= x.t - 0.5 and y.t < x.t - 0.05 group by all),
kd as (select sl.*, hidden, hc.quiet hq, hc.onset_run, hc.onset_speed, case when by_tracks and confirmed and last_t is not null then 'transition' when by_tracks and hidden and last_t is not null then 'hidden'
   when not by_tracks and calm and lp is not null and ln is not null and strike_score >= 0.35 and (lp < 0.35 or (strike_score >= lp and strike_score > ln)) then 'score' end kind
   from sl join hc using (job_id, t) join sq using (job_id, t)),
fd as (select *, {b.clip("case kind when 'transition' then greatest(strike_score, case when geometry then 0.82 else 0.72 end + 0.10 * stationary_ratio + 0.10 * sustained_ratio + 0.08 * track + 0.06 * contact)"
   " when 'hidden' then greatest(strike_score, 0.52 + 0.10 * hq + 0.08 * least(1.0, onset_run / 3.0) + 0.08 * least(1.0, onset_speed / 4.0)) else strike_score end")} confidence from kd where kind is not null)"""
_HF = ("quiet", "raw_median", "ball_quiet", "ball_median", "onset_raw", "onset_speed", "onset_residual", "reliable_still")
_CLOCK = (
    "(select case when h > 0 then lpad(h::varchar, 2, '0') || ':' else '' end || lpad((m % 60)::varchar, 2, '0') || ':' || lpad((s % 60)::varchar, 2, '0') || '.' || lpad((ms % 1000)::varchar, 3, '0')"
    " from (select ms, ms // 1000 s, ms // 60000 m, ms // 3600000 h from (select round_even(greatest({0}, 0) * 1000, 0)::bigint ms)))"
)
_MERGED = """c_n as (select *, row_number() over (partition by job_id order by t, candidate_id) i from cand),
c_k as (select job_id, i, t kt, confidence ks, 0 step from c_n where i = 1
  union all select n.job_id, n.i, case when n.t - k.kt >= 1.2 or n.confidence > k.ks then n.t else k.kt end, case when n.t - k.kt >= 1.2 or n.confidence > k.ks then n.confidence else k.ks end,
    case when n.t - k.kt >= 1.2 then 1 else 0 end from c_k k join c_n n on n.job_id = k.job_id and n.i = k.i + 1),
c_g as (select *, sum(step) over (partition by job_id order by i) g from c_k), mc as (select job_id, max_by(kt, i) t, max_by(ks, i) confidence from c_g group by job_id, g)"""
_CALM = f"(motion_raw <= 0.18 and residual_motion_max <= 0.80 and {b.BALL} <= 10)"
#: Stops of the marks mk(job_id, t), as st(job_id, sitting, t, stop, confirm, confirmed, sure, review, reason): one recursive step a row.
_STOPS = f"""s_r as (select *, {b.VALID_STOP} ok, {b.TRACKED} trk, occluded_ball_count > 0 and occluded_ball_count <= 2 and moving_ball_count = 0 and {_CALM} calm, {b.STOP_ACTIVITY} act,
   case when moving_ball_count > 0 then true when {b.TRACKED} then {b.BALL} >= 0.80 or ball_residual_motion >= 0.20 end go,
   case when {_CALM} and (occluded_ball_count = 0 or occluded_ball_count >= 8) then false when occluded_ball_count > 0 then true when moving_ball_count > 0 then true
     when {b.TRACKED} then {b.BALL} >= 0.60 or ball_residual_motion >= 0.10 end stay from tl),
s_m as (select mk.job_id, sitting, t, duration, greatest(0, least(t, duration)) st, least(duration, greatest(0, least(t, duration)) + 10) cap from mk join rec on rec.job_id = mk.job_id and mk.t between first_t and duration),
s_b as (select m.job_id, m.t, list_sort(list(r.act)) a from s_m m join s_r r on r.job_id = m.job_id and r.sitting = m.sitting and r.ok and r.t >= m.t - 1.2 and r.t < m.t - 0.08 group by all),
s_l as (select m.*, coalesce(list_aggregate(a[1:(len(a) + 1) // 2], 'median'), 0.05) base from s_m m left join s_b using (job_id, t)),
s_x as (select m.job_id, m.sitting, m.t mt, m.st, r.t, ok, trk, calm, coalesce(go, act >= greatest(0.18, base * 2.4)) go, coalesce(stay, act >= greatest(0.10, base * 1.65)) stay,
   row_number() over (partition by m.job_id, m.t order by r.t) k from s_l m join s_r r on r.job_id = m.job_id and r.sitting = m.sitting and r.t >= m.st and r.t <= m.cap + 1e-6),
s_any as (select m.job_id, m.t, count(*) n from s_l m join s_r r on r.job_id = m.job_id and r.sitting = m.sitting and r.t >= m.st - 0.25 and r.t <= m.cap + 1e-6 group by all),
s_k as (select job_id, t mt, 0::bigint k, 0 run, false going, null::double last, null::double still, 0 res, null::double unk, 0.0::double unks, null::double timer, false stale, false seen, 0 vr, false done, null::double at_ from s_l
 union all select y.job_id, y.mt, y.k, case when not ok or going then run when go then run + 1 else 0 end, going or (ok and go and run >= 1),
   case when not ok then last when not going then case when go and run >= 1 then y.t else last end when mov and (still is null or res >= 1) then y.t else last end,
   case when not ok then null when not going then still when mov then case when still is not null and res >= 1 then null else still end when y.t < st + 0.45 then still else coalesce(still, case when stale2 then timer2 end, y.t) end,
   case when not ok then 0 when not going then res when mov then case when still is null then res else res + 1 end else 0 end,
   case when ok then null else coalesce(unk, y.t) end, case when ok and unk is not null then unks + y.t - unk else unks end, case when ok and going then timer2 else timer end, case when ok and going then stale2 else stale end,
   seen or (ok and trk), vr + ok::int,
   coalesce(ok and going and not mov and y.t >= st + 0.45 and y.t - coalesce(still, case when stale2 then timer2 end, y.t) + 1e-9 >= 0.5, false), y.t
 from (select z.*, stay and not (calm and y_held) mov, case when calm then coalesce(timer, z.t) end timer2, stale or (calm and y_held) stale2
   from (select s.*, p.run, p.going, p.last, p.still, p.res, p.unk, p.unks, p.timer, p.stale, p.seen, p.vr, s.t - coalesce(p.timer, s.t) + 1e-9 >= 0.5 y_held from s_k p join s_x s on s.job_id = p.job_id and s.mt = p.mt and s.k = p.k + 1 where not p.done) z) y),
s_e as (select *, row_number() over (partition by job_id, mt order by k desc) n from s_k),
stp as (select m.job_id, m.sitting, m.t, case when done then still else cap end stop, case when done then at_ else cap end confirm, coalesce(done, false) confirmed, last,
   case when a.n is null then 0.20 when done then (case when vr < 4 then least(0.55, sure0) else sure0 end) when cap < duration - 1e-6 then 0.20 when last is not null then 0.20 else 0.12 end sure,
   case when a.n is null then 'no_motion_observations' when done then case when stale then 'confirmed_stale_occlusion_override' when unks > 0 then 'confirmed_after_unknown_gap' else 'confirmed_stationary' end
     when cap < duration - 1e-6 then 'max_duration_review_cap' when last is not null then 'motion_not_confirmed' else 'no_sustained_ball_motion' end reason, unks
   from s_l m left join s_any a using (job_id, t)
   left join (select *, (case when stale then 0.68 when seen then 0.95 else 0.82 end) - (case when unks > 0 then least(0.25, 0.08 * unks) else 0 end) sure0 from s_e where n = 1) e on e.job_id = m.job_id and e.mt = m.t)"""
_STOP_OUT = f"{_M('stop', 'stop')}, {_M('confirm', 'confirm')}, {_M('sure', 'stop_confidence')}, confirmed, not confirmed or sure < 0.70 or unks >= 0.35 stop_review, reason stop_reason"
SQL |= {
    "motion_stops": _REC + f", {_CAND}, {_MERGED}, {_SPANS}, mk as (select * from mc), {_STOPS} select job_id, {_M('t', 't_us')}, {_STOP_OUT} from stp",
    "detected_stops": _REC + f", {_DETECT}" + _suppress("fd", "strike_score", 1.2) + f", {_SPANS}, mk as (select job_id, t from kept), {_STOPS}"
    f" select job_id, {_M('t', 't_us')}, {_M('stop', 'stop')}, confirmed, reason stop_reason from stp",
    "strike_detections": _REC + f", {_DETECT}" + _suppress("fd", "strike_score", 1.2)
    + f" select fd.job_id, {_M('fd.t', 't_us')}, {_M('strike_score', 'strike_score')}, {_M('confidence', 'confidence')}, kind from kept join fd using (job_id, sitting, t)",
    "audio_seeds": _REC + f", {_PEAKS}, {_CAND}, fr as (select * from a_f f where not exists (select 1 from cand c where c.job_id = f.job_id and c.t between f.t - 1.5 and f.t + 1.5 and abs(c.t - f.t) <= 1.5)), "
    + _spaced("fr", "t", 1.5, "job_id, sitting") + f" select job_id, {_M('at_', 't_us')} from g_k where kept",
    "decision_list": f"""with {_SHOTS}, o as (select *, row_number() over (partition by job_id order by shot_id) i, sum(clip_end - clip_start) over (partition by job_id order by shot_id rows unbounded preceding) ro from clip where included),
l as (select job_id, i, unnest([{{'k': 1, 'line': lpad(i::varchar, greatest(3, length(i::varchar))::int, '0') || '  AX       V     C        ' || replace({_CLOCK.format('clip_start')} || ' ' || {_CLOCK.format('clip_end')} || ' '
 || {_CLOCK.format('ro - (clip_end - clip_start)')} || ' ' || {_CLOCK.format('ro')}, '.', ':')}}, {{'k': 2, 'line': '* FROM CLIP NAME: shot_' || lpad(shot_id::varchar, greatest(4, length(shot_id::varchar))::int, '0')}}, {{'k': 3, 'line': '* SOURCE FILE: ' || job_id}}]) x from o)
select job_id, (i - 1) * 3 + x.k + 3 line_no, x.line line from l union all select job_id, k, line from (select distinct job_id from o) cross join (values (1, 'TITLE: Export'), (2, 'FCM: NON-DROP FRAME'), (3, '')) h(k, line)""",
    "scalar_functions": f"""with {_SHOTS}, w as (select *, shot_id * 13 + 640 w, shot_id * 7 + 480 h from clip), z as (select *, least(1.0, 960.0 / w, 540.0 / h) sc from w)
select job_id, shot_id, {_CLOCK.format('floor(clip_start * 1000) / 1000')} "at", case when shot_id % 3 = 0 then 0.0 else shot_id::double / (shot_id % 3) end rate,
 greatest(2, (round_even(w * sc / 2, 0) * 2)::int) width, greatest(2, (round_even(h * sc / 2, 0) * 2)::int) height, round_even(clip_start * 25.0, 0)::bigint frame,
 {_M('greatest(0, least(50.0, clip_start * 50.0 / 100.0))', 'source_us')}, 'Shot_' || shot_id || '__final_' file from z""",
    "audio_peaks": _REC + f", {_PEAKS} select f.job_id, {_M('f.t', 't_us')}, {_M('score', 'score')} from a_f f join a_p p on p.job_id = f.job_id and p.t = f.t",
    "phase_labels": _REC + f", {_PHASES} select job_id, {_M('t', 't_us')}, ['WAITING', 'CUEING', 'STRIKE_CANDIDATE', 'STRIKE_CONFIRMED', 'BALLS_MOVING', 'BALLS_SETTLING', 'ALL_BALLS_STOPPED'][s + 1] state from p_k where i > 0",
    "hidden_onsets": b.TIMELINE + f", {_HIDDEN} select job_id, {_M('t', 't_us')}, " + ", ".join(_M(x, x) for x in _HF)
    + """, onset_run, reliable_n, missing, jumps, quiet >= 0.8 and raw_median <= 0.28 and ball_quiet >= 0.5 and ball_median <= 5 and reliable_n >= 2 and reliable_still >= 0.7 and (missing or jumps)
   and onset_run >= 2 and onset_raw >= 0.22 and onset_speed >= 1.0 confirmed from h""",
}

_CLIP_ROWS = f", {_CAND}, {_MERGED}, {_SPANS}, mk as (select job_id, t from mc), {_STOPS}, cb as (select stp.*, mc.confidence, duration from stp join mc using (job_id, t) join rec using (job_id, sitting) where reason <> 'no_sustained_ball_motion'"
_CLIP_ROWS += "), cr as (select *, confidence < 0.7 or not confirmed or sure < 0.70 or unks >= 0.35 review0 from cb)"


def _clip_sql(start: str, after: float, prep: float = 0.0) -> str:
    """Clips of a mode that is not strict."""
    wide = "case when confidence < 0.5 then 1.0 else 0.0 end"
    rows = "cr"
    if prep:
        rows = f"(select cr.*, coalesce((select max(x.t) from tl x where x.job_id = cr.job_id and x.sitting = cr.sitting and x.motion_score > 0.4 and x.t >= greatest(0, cr.t - {prep}) and x.t < cr.t), greatest(0, cr.t - {prep})) prep from cr)"
    return (
        _REC + _CLIP_ROWS + f" select job_id, {_M('t', 'strike')}, {_M(f'greatest(0, {start} - {wide})', 'start')}, {_M(f'least(duration, stop + {after} + {wide})', chr(34) + 'end' + chr(34))},"
        f" {_M('stop', 'stop')}, confirmed, review0 review from {rows}"
    )


SQL |= {
    "clips_strict": _REC + _CLIP_ROWS + """, s1 as (select *, greatest(0, t - 2.0) st from cr), s2 as (select *, least(least(stop, t + 4.0), st + 12.0) sp from s1),
s3 as (select *, greatest(st, least(duration, greatest(sp, t + 4.0), st + 12.0)) en, confirmed and sp >= stop ok from s2) select job_id, """
    + f"{_M('t', 'strike')}, {_M('st', 'start')}, {_M('en', chr(34) + 'end' + chr(34))}, {_M('sp', 'stop')}, ok confirmed, review0 or not ok review from s3",
    "clips_action_only": _clip_sql("greatest(0, t - 1.5)", 1.0),
    "clips_natural": _clip_sql("prep", 4.0, 6.0),
    "clips_full_sequence": _clip_sql("prep", 5.0, 15.0),
    "refine_windows": _REC + f""", {_CAND}, {_MERGED}, {_SPANS}, mk as (select job_id, t from mc), {_STOPS},
w1 as (select stp.*, duration, least(duration, t + 10.0 + 0.8) hard, greatest(0, t - 2.0) begin_, lead(t) over (partition by stp.job_id, sitting order by t) after_ from stp join rec using (job_id, sitting)),
w2 as (select job_id, sitting, round(begin_ * 1000)::bigint lo, round(case when confirmed then least(hard, greatest(begin_ + 1.0, stop + 0.8 + 2.0)) when reason = 'max_duration_review_cap' then hard
   when after_ < hard then least(hard, after_ + 1.0) else hard end * 1000)::bigint hi from w1),
w3 as (select *, case when lo > max(hi) over w + 250 or max(hi) over w is null then 1 else 0 end h from w2 where hi > lo window w as (partition by job_id, sitting order by lo, hi rows between unbounded preceding and 1 preceding)),
w4 as (select *, sum(h) over (partition by job_id, sitting order by lo, hi rows unbounded preceding) i from w3)
select job_id, min(lo) start_ms, max(hi) end_ms from w4 group by job_id, sitting, i""",
}


def _shots_sql(mode: str) -> str:
    """Overlaps resolved with a stack: a recursive step pushes, pops or drops one shot."""
    strict = mode == "strict"
    if strict:
        bounds = """, s1 as (select *, greatest(0, t - 2.0) st from cr), s2 as (select *, least(least(stop, t + 4.0), st + 12.0) sp from s1), s3 as (select *, greatest(st, least(duration, greatest(sp, t + 4.0), st + 12.0)) en,
 confirmed and sp >= stop ok from s2), bd as (select job_id, sitting, t, st a, en e, sp, stop un, ok, confidence, review0 or not ok rv, en mi from s3)"""
    else:
        start, after, prep = {"action_only": ("greatest(0, t - 1.5)", 1.0, 0), "natural": ("prep", 4.0, 6.0), "full_sequence": ("prep", 5.0, 15.0)}[mode]
        look = f"(select max(x.t) from tl x where x.job_id = cr.job_id and x.sitting = cr.sitting and x.motion_score > 0.4 and x.t >= greatest(0, cr.t - {prep}) and x.t < cr.t)"
        rows = f"(select cr.*, coalesce({look}, greatest(0, cr.t - {prep})) prep from cr)" if prep else "cr"
        wide = "case when confidence < 0.5 then 1.0 else 0.0 end"
        bounds = f", bd as (select job_id, sitting, t, greatest(0, {start} - {wide}) a, least(duration, stop + {after} + {wide}) e, stop sp, stop un, confirmed ok, confidence, review0 rv, stop mi from {rows})"
    overlap = "c.a < p.e - 1e-6" if strict else "false"
    return (
        _REC.replace("with recursive ", "with recursive ", 1) + _CLIP_ROWS + bounds
        + f""", ev as (select job_id, t, coalesce(arg_max(evidence['audio_onset'], confidence), 0) au, coalesce(arg_max(evidence['pre_ball_quiet_ratio'], confidence), 0) qu from
   (select m.job_id, m.t, m.confidence, s.evidence from mc m join strike_candidates s on s.job_id = m.job_id and s."timestamp" = m.t) group by all),
sq as (select bd.*, coalesce(au, 0) au, coalesce(qu, 0) qu, row_number() over (partition by bd.job_id, sitting order by bd.t) i from bd left join ev on ev.job_id = bd.job_id and ev.t = bd.t),
sk as (select job_id, sitting, 0::bigint i, 0::bigint n, []::struct(t double, a double, e double, sp double, un double, ok boolean, cf double, au double, qu double, rv boolean, mi double, rp double, rj double)[] s, null::double rp
   from (select distinct job_id, sitting from sq)
 union all select job_id, sitting, case act when 'pop' then i else i + 1 end, n + 1,
   case act when 'push' then list_append(s, {{'t': c.t, 'a': c.a, 'e': c.e, 'sp': c.sp, 'un': c.un, 'ok': c.ok, 'cf': c.confidence, 'au': c.au, 'qu': c.qu, 'rv': c.rv, 'mi': c.mi, 'rp': rp, 'rj': null}})
     when 'pop' then s[:-2] else list_append(s[:-2], {{'t': p.t, 'a': p.a, 'e': p.e, 'sp': p.sp, 'un': p.un, 'ok': p.ok, 'cf': p.cf, 'au': p.au, 'qu': p.qu, 'rv': p.rv or c.confidence >= 0.7, 'mi': p.mi, 'rp': p.rp, 'rj': c.t}}) end,
   case act when 'pop' then p.t end
 from (select k.job_id, k.sitting, k.i, k.n, k.s, k.rp, c, s[-1] p, case when len(s) = 0 then 'push'
     when not (c.t - s[-1].t < 0.6 or (s[-1].ok and c.t <= s[-1].un + 1e-6) or {overlap.replace('p.e', 's[-1].e')}) then 'push'
     when case when abs(c.confidence - s[-1].cf) > 0.05 then c.confidence > s[-1].cf when (s[-1].au >= 0.15) <> (c.au >= 0.15) then c.au >= 0.15 else c.qu - s[-1].qu > 1e-6 end then 'pop' else 'drop' end act
   from sk k join sq c on c.job_id = k.job_id and c.sitting = k.sitting and c.i = k.i + 1)),
fs as (select job_id, sitting, arg_max(s, n) s from sk group by all), fu as (select job_id, generate_subscripts(s, 1)::int shot_id, unnest(s) x from fs)
select job_id, shot_id, {_M('x.t', 'strike')}, """
        + (f"{_M('greatest(0, x.t - 2.0)', 'clip_start')}, {_M('greatest(x.sp, x.mi)', 'clip_end')}" if strict else f"{_M('x.a', 'clip_start')}, {_M('x.e', 'clip_end')}")
        + f", {_M('x.sp', 'stop')}, x.rv review, {_M('x.rp', 'replaced')}, {_M('x.rj', 'rejected')} from fu"
    )


SQL |= {f"shots_{mode}": _shots_sql(mode) for mode in ("strict", "action_only", "natural", "full_sequence")}

SQL["replay_links"] = _REC + f""", {_CAND}, {_SPANS}, rm as (select cand.job_id, sitting, t, max(confidence) confidence from cand join rec on rec.job_id = cand.job_id and t between first_t and duration group by all),
rv as (select m.job_id, m.sitting, m.t, coalesce(bool_or({b.REPLAY.replace('view_type', 'x.view_type')}), false) explicit, coalesce(bool_or(x.scene_cut_score >= 0.5 and x.t between m.t - 0.8 and m.t + 0.8), false) transition
   from rm m left join tl x on x.job_id = m.job_id and x.sitting = m.sitting and x.t >= m.t - 1.0 and x.t <= m.t + 1.0 group by all),
rs as (select m.job_id, m.t, coalesce(list(x.motion_score order by x.t) filter (x.t is not null), [0.0]) s from rm m left join tl x on x.job_id = m.job_id and x.sitting = m.sitting and x.t >= m.t and x.t <= m.t + 3.0 group by all),
rg as (select job_id, t, list_transform(range(16), lambda k: s[floor(k * (len(s) - 1) / 15.0)::int + 1] + (s[least(floor(k * (len(s) - 1) / 15.0)::int + 1, len(s) - 1) + 1] - s[floor(k * (len(s) - 1) / 15.0)::int + 1])
   * (k * (len(s) - 1) / 15.0 - floor(k * (len(s) - 1) / 15.0))) sig from rs),
rq as (select rm.*, explicit, transition, sig, row_number() over (partition by rm.job_id, rm.sitting order by rm.t) i from rm join rv using (job_id, sitting, t) join rg using (job_id, t)),
rk as (select job_id, sitting, 0::bigint i, []::struct(t double, sig double[])[] live, null::double t, false replay, null::double replay_of from (select distinct job_id, sitting from rq)
 union all select job_id, sitting, i + 1, case when not hit and confidence >= 0.40 then list_append(live, {{'t': ct, 'sig': sig}}) else live end, ct, hit, f
 from (select k.job_id, k.sitting, k.i, k.live, c.t ct, c.sig, c.confidence, c.explicit or len(m) > 0 hit, m[-1].t f
   from (select k.*, c, list_filter(k.live, lambda y: (c.explicit or c.transition) and c.t - y.t between 2.0 and 90.0 and sqrt(list_dot_product(y.sig, y.sig)) > 1e-6 and sqrt(list_dot_product(c.sig, c.sig)) > 1e-6
     and list_cosine_similarity(y.sig, c.sig) >= 0.92) m from rk k join rq c on c.job_id = k.job_id and c.sitting = k.sitting and c.i = k.i + 1) k))
select job_id, {_M('t', 't_us')}, replay, {_M('replay_of', 'replay_of')} from rk where i > 0"""

SQL["scene_segments"] = _REC + ", ct as (select job_id, sitting, t from tl where scene_cut_score >= 0.42), " + _spaced("ct", "t", 0.2, "job_id, sitting") + f""", st as (select job_id, sitting, at_ t from g_k where kept union select job_id, sitting, min(t) from tl group by all),
en as (select job_id, sitting, min(t) first_, max(t) last_ from tl group by all),
nx as (select st.*, first_, last_, coalesce(lead(t) over (partition by st.job_id, st.sitting order by t), last_) n_ from st join en using (job_id, sitting)),
lo as (select * from nx where n_ - t >= 0.4 or t = first_),
sp as (select job_id, sitting, t a, coalesce(lead(t) over (partition by job_id, sitting order by t), last_) e, last_ from lo)
select sp.job_id, {_M('a', 'start')}, {_M('e', chr(34) + 'end' + chr(34))}, arg_min(view_type, (abs(t - (a + e) / 2), t)) view_type, count(*) n from sp
join tl on tl.job_id = sp.job_id and tl.sitting = sp.sitting and t >= a and (t < e or (e = last_ and t = e)) group by sp.job_id, sp.sitting, a, e"""
