"""Queries over the feature timeline: row predicates, scores, window metrics, onset detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chalkline.config import DEFAULT
from chalkline.functions import predicates as p
from chalkline.operators import folds, windows as w
from chalkline.operators.pieces import by_pieces
from chalkline.operators.timeline import COLUMNS, KEYS, micro, timeline
from chalkline.plans import base_sql as b
from chalkline.sources.tables import load

def at() -> tuple:
    return ("job_id", micro("t").alias("t_us"))


def tl(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The timeline of a folder, narrowed to `columns` where given."""
    wanted = columns or COLUMNS[4:]
    return timeline(load(spark, folder, "frame_features", "row_id", "job_id", "layer", "t", *wanted), columns=wanted)


def merged_timeline(spark, folder):
    """One row per sample, its recording and a few of its values."""
    return tl(spark, folder, "view_type", "motion_raw", "ball_count", "table_observable").select(*at(), "sitting", "layer", "view_type", micro("motion_raw").alias("motion_raw"), "ball_count", "table_observable")


def row_predicates(spark, folder):
    """The row predicates of the detectors."""
    s = DEFAULT.state
    return tl(spark, folder).select(
        *at(), p.valid_strike().alias("valid_strike"), p.valid_stop().alias("valid_stop"), p.valid_state().alias("valid_state"),
        p.observable_at_source().alias("observable"), p.track_evidence().alias("tracked"), p.ball_observation().alias("observed"),
        p.quiet_override().alias("quiet"), p.state_moving(s.start, s.legacy_start).alias("moving_start"),
        p.state_moving(s.stop, s.legacy_stop).alias("moving_on"), p.cue_stationary().alias("stationary"),
        p.stop_moving(False, F.lit(0.05)).alias("stop_start"), p.stop_moving(True, F.lit(0.05)).alias("stop_on"),
    )


def activity_scores(spark, folder):
    """Speeds in ball diameters and the activity scores of the detectors."""
    return tl(spark, folder).select(
        *at(), micro(p.cue_speed()).alias("cue_speed"), micro(p.ball_speed()).alias("ball_speed"), micro(p.legacy_activity()).alias("legacy"),
        micro(p.stop_activity()).alias("stop_activity"), micro(p.sparse_activity()).alias("sparse"), micro(p.audio_support_activity()).alias("audio_support"),
        p.confidence_band(F.col("cue_ball_track_confidence")).alias("band"),
    )


def view_classes(spark, folder):
    """The camera view that the picture's shares decide (the table has no skin share; highband and cut score stand in)."""
    green, edges, skin, graphic = F.col("green_ratio"), F.col("edge_density"), F.col("audio_highband"), F.col("scene_cut_score")
    return tl(spark, folder, "green_ratio", "edge_density", "audio_highband", "scene_cut_score").select(*at(), p.view_decision(green, edges, skin, graphic).alias("view"))


def recording_facts(spark, folder):
    """Per recording: rows, whether tracks are reliable, shares of replay and green rows, whether replay labels are repaired."""
    whole = tl(spark, folder, "view_type", "green_ratio", "cue_ball_track_confidence", "ball_diameter_px").transform(w.with_tracks)
    replay, green = F.avg(p.flag(F.col("view_type").isin(*p.REPLAYS))), F.avg(p.flag(F.col("green_ratio") >= 0.18))
    return whole.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n"), F.first("by_tracks").alias("by_tracks"), micro(replay).alias("replay_share"), micro(green).alias("green_share"),
        ((replay >= 0.9) & (green >= 0.2)).alias("repaired"),
    )


def local_normals(spark, folder):
    """Rise of the raw motion, and that rise against the 95th percentile of the 41 rows around."""
    rows = by_pieces(tl(spark, folder, "motion_raw"), lambda x: x.withColumn("onset", w.motion_onset()).withColumn("norm", w.local_normal("onset")), 0.0, w.ONSET_ROWS)
    return rows.select(*at(), micro("onset").alias("onset"), micro("norm").alias("onset_norm"))


def sparse_window_metrics(spark, folder):
    """What the thin timeline says about an onset at each row."""
    rows = by_pieces(tl(spark, folder), w.sparse_windows, w.SPARSE_S)
    return rows.select(*at(), "pre_n", micro("pre_median").alias("pre_median"), "post_n", "active", "ball_active", micro("peak").alias("peak"), "proposed", micro("score").alias("score"))


def sparse_candidates(spark, folder):
    """Onset proposals of the thin timeline, suppressed to one in 1.2 s."""
    rows = by_pieces(tl(spark, folder), lambda x: w.sparse_windows(x).where("proposed"), w.SPARSE_S)
    return folds.suppress(rows, "score", DEFAULT.strike.spacing_s).select(*at(), micro("score").alias("score"))


def quiet_before(spark, folder):
    """Whether the half second before each row was quiet."""
    rows = by_pieces(tl(spark, folder).withColumn("valid", p.valid_strike()), lambda x: x.withColumn("quiet", w.pre_quiet()), w.MOMENT_S)
    return rows.select(*at(), "quiet")


def audio_peaks(spark, folder):
    """Local maxima of the audio score of 0.30 or more, the strongest first, none within 1.2 s of a stronger one."""
    rows = tl(spark, folder, "audio_onset", "audio_highband").withColumn("score", p.clip(F.greatest("audio_onset", "audio_highband")))
    crosses, peak = w.crossings_and_peaks("score", 0.30)
    peaks = by_pieces(rows, lambda x: x.withColumn("peak", peak).where("peak"), 0.0)
    return folds.strongest(peaks, "score", 1.2).select(*at(), micro("score").alias("score"))


def score_crossings(spark, folder):
    """Rises over 0.35 and peaks of the stored strike score."""
    crosses, peak = w.crossings_and_peaks("strike_score", DEFAULT.strike.min_confidence)
    found = by_pieces(tl(spark, folder, "strike_score"), lambda x: x.withColumns({"crosses": crosses, "peak": peak}).where("crosses or peak"), 0.0)
    return found.select(*at(), "crosses", "peak")


FLOATS = ("stationary_ratio", "pre_quiet_ratio", "pre_raw_median", "pre_ball_quiet_ratio", "pre_ball_median", "sustained_ratio", "post_peak", "acceleration", "track", "contact", "approach", "displacement", "direction")


def transitions(spark, folder):
    """The moments before and after each row, as a stroke would show them."""
    rows = by_pieces(tl(spark, folder), w.transition_metrics, w.MOMENT_S)
    out = [micro(c).alias(c) if c in FLOATS else F.col(c) for c in w.TRANSITION]
    return rows.select(*at(), *out, w.transition_confirmed().alias("confirmed"), w.sparse_dense_confirmed().alias("sparse_confirmed"))


def hidden_onsets(spark, folder):
    """What speaks for a stroke with the cue ball hidden."""
    rows = by_pieces(tl(spark, folder), w.onset_metrics, w.MOMENT_S)
    floats = ("quiet", "raw_median", "ball_quiet", "ball_median", "onset_raw", "onset_speed", "onset_residual", "reliable_still")
    return rows.select(*at(), *[micro(c).alias(c) if c in floats else F.col(c) for c in w.ONSET], w.onset_confirmed().alias("confirmed"))


def strike_scores(spark, folder):
    """The strike score of each row, computed anew."""
    rows = by_pieces(w.with_tracks(tl(spark, folder)), lambda x: w.strike_score(w.transition_metrics(x)), w.MOMENT_S, w.ONSET_ROWS)
    return rows.select(*at(), "by_tracks", "confirmed", micro("strike_score").alias("strike_score"))


def strike_detections(spark, folder):
    """Onsets found in the timeline: confirmed transitions, else hidden onsets, or by score where tracks are not reliable."""
    return detect(tl(spark, folder)).select(*at(), micro("strike_score").alias("strike_score"), micro("confidence").alias("confidence"), "kind")


def detect(rows: DataFrame) -> DataFrame:
    """Onset candidates of a timeline: KEYS, `t`, `strike_score`, `confidence`, `kind`."""
    s = DEFAULT.strike
    crosses, peak = w.crossings_and_peaks("strike_score", s.min_confidence)
    first = F.lag("t").over(w.ordered()).isNull()

    def scores(piece: DataFrame) -> DataFrame:
        scored = w.onset_metrics(w.strike_score(w.transition_metrics(piece)))
        return scored.withColumns({"hidden": w.onset_confirmed(), "by_score": (crosses | peak) & w.pre_quiet(), "first": first})

    # Scores of the rows beside a row are compared, so what these see must be there, too.
    scored = by_pieces(w.with_tracks(rows), scores, w.MOMENT_S, 2 * w.ONSET_ROWS)
    kind = (
        F.when(F.col("by_tracks") & F.col("confirmed") & ~F.col("first"), "transition")
        .when(F.col("by_tracks") & F.col("hidden") & ~F.col("first"), "hidden")
        .when(~F.col("by_tracks") & F.col("by_score"), "score")
    )
    c = F.col
    floor = F.when(c("geometry"), 0.82).otherwise(0.72) + 0.10 * c("stationary_ratio") + 0.10 * c("sustained_ratio") + 0.08 * c("track") + 0.06 * c("contact")
    covered = 0.52 + 0.10 * c("quiet") + 0.08 * F.least(F.lit(1.0), c("onset_run") / 3.0) + 0.08 * F.least(F.lit(1.0), c("onset_speed") / 4.0)
    sure = F.when(c("kind") == "transition", F.greatest("strike_score", floor)).when(c("kind") == "hidden", F.greatest("strike_score", covered)).otherwise(c("strike_score"))
    found = scored.withColumn("kind", kind).where("kind is not null").withColumn("confidence", p.clip(sure))
    return folds.suppress(found, "strike_score", s.spacing_s, extra=("confidence", "kind"))


QUERIES = {
    f.__name__: f
    for f in (
        merged_timeline, row_predicates, activity_scores, view_classes, recording_facts, local_normals, sparse_window_metrics, sparse_candidates,
        quiet_before, audio_peaks, score_crossings, transitions, hidden_onsets, strike_scores, strike_detections,
    )
}

_M = b.micro
_T = f"job_id, {_M('t', 't_us')}"
_W = "partition by job_id, sitting order by t"


def _moving(threshold: float, legacy: float) -> str:
    return (
        f"(case when {b.OBSERVED} then moving_ball_count > 0 or greatest(cue_ball_normalized_speed, max_ball_normalized_speed, ball_residual_motion) >= {threshold}"
        f" else motion_score >= {legacy} and not (camera_motion_magnitude > 6 and residual_motion_mean < 1) end)"
    )


_QUIET = f"(motion_raw <= 0.18 and residual_motion_max <= 0.80 and {b.BALL} <= 10)"
_PRED = f"""select {_T}, {b.VALID_STRIKE} valid_strike, {b.VALID_STOP} valid_stop, {b.VALID_STATE} valid_state,
 table_confidence >= 0.25 and table_mask_area_ratio >= 0.03 and scene_cut_score < 0.42 observable, {b.TRACKED} tracked, {b.OBSERVED} observed, {_QUIET} quiet,
 {_moving(0.18, 0.35)} moving_start, {_moving(0.08, 0.20)} moving_on,
 case when {b.OBSERVED} then (cue_ball_track_confidence >= 0.45 or cue_ball_detected) and cue_ball_normalized_speed <= 0.65 and moving_ball_count = 0 else motion_score <= 0.28 end stationary,
 case when moving_ball_count > 0 then true when {b.TRACKED} then {b.BALL} >= 0.80 or ball_residual_motion >= 0.20 else {b.STOP_ACTIVITY} >= greatest(0.18, 0.05 * 2.4) end stop_start,
 case when {_QUIET} and (occluded_ball_count = 0 or occluded_ball_count >= 8) then false when occluded_ball_count > 0 then true when moving_ball_count > 0 then true
      when {b.TRACKED} then {b.BALL} >= 0.60 or ball_residual_motion >= 0.10 else {b.STOP_ACTIVITY} >= greatest(0.10, 0.05 * 1.65) end stop_on
from tl"""
_VIEW = f"""select {_T}, case when green_ratio > 0.55 and edge_density < 0.08 then 'ball_closeup' when green_ratio >= 0.18 then 'main_table'
 when green_ratio >= 0.06 and scene_cut_score >= 0.55 then 'replay' when green_ratio >= 0.06 and audio_highband > 0.12 then 'player_closeup'
 when green_ratio >= 0.06 then 'wide_arena' when edge_density >= 0.15 then 'scoreboard' when audio_highband >= 0.12 * 1.5 then 'player_closeup'
 when green_ratio < 0.02 and edge_density < 0.06 then 'audience' else 'other' end "view" from tl"""
_FACTS = f"""select job_id, sitting, count(*) n, count(*) filter (cue_ball_track_confidence >= 0.45 and ball_diameter_px > 0.5) >= least(3, greatest(1, count(*) // 20)) by_tracks,
 {_M(f"avg(case when {b.REPLAY} then 1.0 else 0 end)", "replay_share")}, {_M("avg(case when green_ratio >= 0.18 then 1.0 else 0 end)", "green_share")},
 avg(case when {b.REPLAY} then 1.0 else 0 end) >= 0.9 and avg(case when green_ratio >= 0.18 then 1.0 else 0 end) >= 0.2 repaired from tl group by job_id, sitting"""
_ONSET = f"o_on as (select *, greatest(0, coalesce(motion_raw - lag(motion_raw) over ({_W}), 0)) onset from tl)"
_NORM = f"""o_norm as (select *, quantile_cont(onset, 0.95) over ({_W} rows between 20 preceding and 20 following) q from o_on),
o_n as (select *, case when q > 1e-8 then least(1.0, onset / q) else 0 end onset_norm from o_norm)"""
_SPARSE = f"""a as (select *, {b.SPARSE} act, {b.VALID_STRIKE} valid, max_ball_normalized_speed >= 1.5 or moving_ball_count >= 1 or ball_residual_motion >= 0.35
   or cue_ball_normalized_speed >= 0.75 ball_on from tl),
l as (select *, lag(act) over ({_W}) last_act, lag(cue_ball_normalized_speed) over ({_W}) last_cue,
   count(*) over f post_n, count(*) filter (act >= 0.35) over f active, count(*) filter (ball_on) over f ball_active, max(act) over f peak
   from a window f as ({_W} range between current row and 1.0 following)),
m as (select x.job_id, x.t, median(y.act) pre_median, count(y.act) pre_n from a x left join a y on x.job_id = y.job_id and x.sitting = y.sitting and y.t >= x.t - 1.5 and y.t < x.t - 0.01 group by all),
z as (select l.*, pre_median, pre_n, coalesce(valid and pre_n >= 1 and post_n >= 2 and pre_median <= 0.28 and (act - coalesce(last_act, 0) >= 0.20
   or (cue_ball_normalized_speed >= 0.75 and coalesce(last_cue < 0.5, false)) or (pre_median <= 0.35 and act >= 0.35 and act - pre_median >= 0.15))
   and active >= 2 and ball_active >= 2, false) proposed,
   greatest(0, least(0.78, 0.40 + 0.20 * least(1.0, peak) + 0.15 * least(1.0, ball_active / 3.0) + 0.10 * table_confidence
   + 0.08 * {b.clip('greatest(audio_onset, audio_highband)')})) score from l join m using (job_id, t))"""


def _suppress(source: str, score: str, gap: float) -> str:
    """Suppression as a recursive query over numbered candidates; kept(job_id, sitting, i, t, score)."""
    return f""", c_n as (select *, row_number() over ({_W}) i from {source}),
c_k as (select job_id, sitting, i, t kt, {score} ks, 0 step, t prev_t, {score} prev_s from c_n where i = 1
  union all select n.job_id, n.sitting, n.i, case when n.t - k.kt >= {gap} or n.{score} > k.ks then n.t else k.kt end,
    case when n.t - k.kt >= {gap} or n.{score} > k.ks then n.{score} else k.ks end, case when n.t - k.kt >= {gap} then 1 else 0 end, k.kt, k.ks
  from c_k k join c_n n on n.job_id = k.job_id and n.sitting = k.sitting and n.i = k.i + 1),
c_g as (select *, sum(step) over (partition by job_id, sitting order by i) g from c_k),
kept as (select job_id, sitting, g, max_by(kt, i) t, max_by(ks, i) score from c_g group by all)"""


_REC = b.TIMELINE.replace("with ", "with recursive ", 1)
_USABLE = f"u as (select *, {b.CUE} speed, {b.VALID_STRIKE} valid, {b.VALID_STRIKE} and cue_ball_track_confidence >= 0.315 ok, lag(t) over ({_W}) last_t, lag({b.CUE}) over ({_W}) last_speed from tl)"
_TRANS = f"""{_USABLE},
pre as (select x.job_id, x.t, count(y.t) pre_n, avg((y.speed <= 0.65)::int) stationary_ratio, avg((y.motion_raw <= 0.28)::int) pre_quiet_ratio, median(y.motion_raw) pre_raw_median,
   avg((y.max_ball_normalized_speed <= 5.0)::int) pre_ball_quiet_ratio, median(y.max_ball_normalized_speed) pre_ball_median
   from u x left join u y on x.job_id = y.job_id and x.sitting = y.sitting and y.ok and y.t >= x.t - 0.5 and y.t < x.t - 0.03 group by all),
q as (select x.job_id, x.t, y.t yt, y.speed ys, y.cue_ball_track_confidence yc, y.cue_ball_x yx, y.cue_ball_y yy, y.cue_contact_score ct, y.cue_approach_speed ap, y.cue_tip_visible tip,
   sum((y.speed < 0.18)::int) over (partition by x.job_id, x.t order by y.t) misses
   from u x join u y on x.job_id = y.job_id and x.sitting = y.sitting and y.ok and y.t >= x.t and y.t <= x.t + 0.3),
pts as (select *, lag(yx) over (partition by job_id, t order by yt) lx, lag(yy) over (partition by job_id, t order by yt) ly from q where yx is not null and yy is not null),
pp as (select job_id, t, count(*) n_pts, sum(sqrt((yx - lx) ** 2 + (yy - ly) ** 2)) path, sqrt((max_by(yx, yt) - min_by(yx, yt)) ** 2 + (max_by(yy, yt) - min_by(yy, yt)) ** 2) far from pts group by all),
post as (select job_id, t, count(*) post_n, count(*) filter (ys >= 0.18 and misses = 0) sustained_run, count(*) filter (ys >= 0.18 and misses <= 1) bridged_run, count(*) filter (ys >= 0.18) hits,
   max(ys) post_peak, max(yc) track, max(ct) contact, max(ap) approach, count(*) filter (tip) tips from q group by all),
w as (select u.*, coalesce(pre_n, 0) pre_n, coalesce(post_n, 0) post_n, coalesce(stationary_ratio, 0) stationary_ratio, coalesce(pre_quiet_ratio, 0) pre_quiet_ratio, coalesce(pre_raw_median, 1) pre_raw_median,
   coalesce(pre_ball_quiet_ratio, 0) pre_ball_quiet_ratio, coalesce(pre_ball_median, 1) pre_ball_median, coalesce(sustained_run, 0) sustained_run, coalesce(bridged_run, 0) bridged_run,
   least(1.0, coalesce(hits, 0) / 2.0) sustained_ratio, coalesce(post_peak, 0) post_peak, greatest(0, cue_ball_acceleration, coalesce((speed - coalesce(last_speed, 0)) / greatest(1e-3, t - last_t), 0)) acceleration,
   speed >= 1.0 and coalesce(last_speed, 0) < 1.0 crosses, least(1.0, coalesce(track, cue_ball_track_confidence)) track, coalesce(contact, 0) contact, coalesce(approach, 0) approach, coalesce(tips, 0) tips,
   coalesce(contact, 0) >= 0.20 or coalesce(approach, 0) >= 0.15 geometry, (case when n_pts >= 2 then far else 0 end) / greatest(ball_diameter_px, 1.0) displacement,
   case when n_pts >= 2 and path > 1e-6 then {b.clip('far / path')} else 0 end direction
   from u left join pre using (job_id, t) left join post using (job_id, t) left join pp using (job_id, t)),
d as (select *, stationary_ratio >= 0.7 and pre_n >= 3 and (pre_quiet_ratio >= 0.8 or (geometry and contact >= 0.7 and pre_quiet_ratio >= 0.7)) and pre_raw_median <= 0.28
   and ((pre_ball_quiet_ratio >= 0.6 and pre_ball_median <= 5) or (geometry and contact >= 0.7)) and crosses
   and (sustained_run >= 2 or (geometry and contact >= 0.7 and bridged_run >= 2 and post_peak >= 2.0)) and displacement >= 0.25 and direction >= 0.45 and track >= 0.45 confirmed,
   pre_n >= 3 and pre_raw_median <= 0.28 and post_peak >= 3.0 and sustained_run >= 2 and displacement >= 0.75 and direction >= 0.35 and track >= 0.36 sparse_confirmed from w)"""
_SCORE = f"""s_on as (select *, greatest(0, coalesce(motion_raw - lag(motion_raw) over ({_W}), 0)) onset,
   count(*) filter (cue_ball_track_confidence >= 0.45 and ball_diameter_px > 0.5) over (partition by job_id, sitting) >= least(3, greatest(1, count(*) over (partition by job_id, sitting) // 20)) by_tracks from d),
s_q as (select *, quantile_cont(onset, 0.95) over ({_W} rows between 20 preceding and 20 following) q95 from s_on),
s_g as (select *, 0.40 * (case when q95 > 1e-8 then least(1.0, onset / q95) else 0 end) + 0.15 * {b.clip('table_confidence + 0.15')} generic from s_q),
s_t as (select *, 0.45 * generic + 0.34 * {b.clip('acceleration / 4.0')} + 0.22 * sustained_ratio + 0.10 * stationary_ratio + 0.08 * track + 0.06 * contact tracked from s_g),
scored as (select * replace ({b.clip(f"((case when by_tracks then case when confirmed then tracked else least(0.22 * tracked, 0.75 * 0.35) end else generic + 0.18 * {b.clip('motion_area_ratio / 0.02')} end)"
   f" + 0.12 * {b.clip('greatest(audio_onset, audio_highband)')}) * (case when valid then 1.0 else 0.10 end) * (case when {b.REPLAY} then 0.05 else 1.0 end)")} as strike_score) from s_t)"""

SQL = {
    "merged_timeline": b.TIMELINE + f"select {_T}, sitting, layer, view_type, {_M('motion_raw', 'motion_raw')}, ball_count, table_observable from tl",
    "row_predicates": b.TIMELINE + _PRED,
    "activity_scores": b.TIMELINE
    + f"select {_T}, {_M(b.CUE, 'cue_speed')}, {_M(b.BALL, 'ball_speed')}, {_M(b.LEGACY, 'legacy')}, {_M(b.STOP_ACTIVITY, 'stop_activity')}, {_M(b.SPARSE, 'sparse')},"
    f" {_M(b.AUDIO_SUPPORT, 'audio_support')}, case when cue_ball_track_confidence >= 0.7 then 'high' when cue_ball_track_confidence >= 0.5 then 'medium' else 'low' end band from tl",
    "view_classes": b.TIMELINE + _VIEW,
    "recording_facts": b.TIMELINE + _FACTS,
    "local_normals": b.TIMELINE + f", {_ONSET}, {_NORM} select {_T}, {_M('onset', 'onset')}, {_M('onset_norm', 'onset_norm')} from o_n",
    "sparse_window_metrics": b.TIMELINE
    + f", {_SPARSE} select {_T}, pre_n, {_M('pre_median', 'pre_median')}, post_n, active, ball_active, {_M('peak', 'peak')}, proposed, {_M('score', 'score')} from z",
    "sparse_candidates": _REC + f", {_SPARSE}, zz as (select * from z where proposed)" + _suppress("zz", "score", 1.2) + f" select {_T}, {_M('score', 'score')} from kept",
    "quiet_before": b.TIMELINE
    + f", a as (select *, {b.VALID_STRIKE} valid from tl) select x.job_id, {_M('x.t', 't_us')}, coalesce(median(y.motion_raw) <= 0.28, true) quiet from a x"
    " left join a y on x.job_id = y.job_id and x.sitting = y.sitting and y.valid and y.t >= x.t - 0.5 and y.t < x.t - 0.05 group by x.job_id, x.t",
    "score_crossings": b.TIMELINE
    + f", a as (select *, lag(strike_score) over ({_W}) p, lead(strike_score) over ({_W}) n, strike_score s from tl),"
    " e as (select *, s >= 0.35 and p < 0.35 crosses, s >= 0.35 and s >= p and s > n peak from a where p is not null and n is not null)"
    f" select {_T}, crosses, peak from e where crosses or peak",
    "transitions": b.TIMELINE
    + f", {_TRANS} select {_T}, pre_n, post_n, sustained_run, bridged_run, crosses, tips, geometry, " + ", ".join(_M(c, c) for c in FLOATS) + ", confirmed, sparse_confirmed from d",
    "strike_scores": b.TIMELINE + f", {_TRANS}, {_SCORE} select {_T}, by_tracks, confirmed, {_M('strike_score', 'strike_score')} from scored",
}
