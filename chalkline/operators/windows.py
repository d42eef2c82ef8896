"""Window computations over a timeline: each is a column or a set of columns over a recording in order of time.

All frames are bounded rows or seconds of one recording; they share one sort, so several of them cost one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from chalkline.config import DEFAULT, Strike
from chalkline.functions import predicates as p
from chalkline.operators.sequence import join_by
from chalkline.operators.timeline import KEYS

_OVER = f"over (partition by {', '.join(KEYS)} order by t"


def seconds_frame(aggregate: str, before: float, after: float) -> Column:
    """An SQL aggregate over the rows from `before` seconds earlier to `after` seconds later, both included.

    A negative bound lies on the other side: before=0.5, after=-0.03 ends 0.03 s before the row.
    """
    def bound(x: float, word: str, other: str) -> str:
        return f"{abs(x)!r}D {word if x >= 0 else other}" if x else "current row"

    return F.expr(f"{aggregate} {_OVER} range between {bound(before, 'preceding', 'following')} and {bound(after, 'following', 'preceding')})")


def rows_frame(aggregate: str, before: int, after: int) -> Column:
    return F.expr(f"{aggregate} {_OVER} rows between {before} preceding and {after} following)")


def ordered() -> WindowSpec:
    return Window.partitionBy(*KEYS).orderBy("t")


def motion_onset(column: str = "motion_raw") -> Column:
    """Rise of a series since the row before; 0 for a fall and for the first row."""
    return F.greatest(F.lit(0.0), F.coalesce(F.col(column) - F.lag(column).over(ordered()), F.lit(0.0)))


def local_normal(column: str, half: int = DEFAULT.strike.norm_rows) -> Column:
    """A series against the 95th percentile of the rows around (`half` on either side), at most 1."""
    scale = rows_frame(f"percentile({column}, 0.95)", half, half)
    return F.when(scale > 1e-8, F.least(F.lit(1.0), F.col(column) / scale)).otherwise(0.0)


#: How far around a row these look: rows for the local normal of an onset, seconds for the moments before and after.
ONSET_ROWS = DEFAULT.strike.norm_rows + 1
MOMENT_S = max(DEFAULT.strike.quiet_s, DEFAULT.strike.post_s, 0.20)
SPARSE_S = max(DEFAULT.strike.sparse_pre_s, DEFAULT.strike.sparse_post_s)


def with_tracks(tl: DataFrame) -> DataFrame:
    """Adds `by_tracks`: a recording has enough reliable cue-ball tracks, so onsets are found by the cue ball's motion.

    Recordings are counted with map-side combine; one row of each goes back to its rows.
    """
    good = (F.col("cue_ball_track_confidence") >= DEFAULT.strike.track_confidence) & (F.col("ball_diameter_px") > 0.5)
    counts = tl.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_n"), F.count_if(good).alias("_good"))
    need = F.least(F.lit(3), F.greatest(F.lit(1), F.floor(F.col("_n") / 20)))
    return join_by(tl, counts.select(*KEYS, (F.col("_good") >= need).alias("by_tracks")), KEYS)


def crossings_and_peaks(column: str, threshold: float) -> tuple[Column, Column]:
    """(rises over the threshold, local maximum at or over it) for rows that are neither first nor last."""
    before, after = F.lag(column).over(ordered()), F.lead(column).over(ordered())
    x = F.col(column)
    inner = before.isNotNull() & after.isNotNull()
    return inner & (x >= threshold) & (before < threshold), inner & (x >= threshold) & (x >= before) & (x > after)


def sparse_windows(tl: DataFrame, s: Strike = DEFAULT.strike) -> DataFrame:
    """Per row what a thinly sampled timeline says about an onset: `activity`, `pre_n`, `pre_median`, `post_n`, `active`,
    `ball_active`, `peak`, `proposed` and its `score`."""
    act = tl.withColumns(
        {
            "activity": p.sparse_activity(s),
            "ball_on": (F.col("max_ball_normalized_speed") >= 1.5) | (F.col("moving_ball_count") >= 1)
            | (F.col("ball_residual_motion") >= s.sparse_activity) | (F.col("cue_ball_normalized_speed") >= s.motion_start_speed * 0.75),
            "valid": p.valid_strike(),
        }
    )
    before = "collect_list(struct(t, activity))"
    act = act.withColumn("pre", seconds_frame(before, s.sparse_pre_s, -s.sparse_guard_s))
    act = act.withColumn("pre", F.transform(F.filter("pre", lambda x: x["t"] < F.col("t") - s.sparse_guard_s), lambda x: x["activity"]))
    found = act.withColumns(
        {
            "pre_n": F.size("pre"),
            "pre_median": median_of("pre"),
            "post_n": seconds_frame("count(*)", 0, s.sparse_post_s),
            "active": seconds_frame(f"count_if(activity >= {s.sparse_activity}D)", 0, s.sparse_post_s),
            "ball_active": seconds_frame("count_if(ball_on)", 0, s.sparse_post_s),
            "peak": seconds_frame("max(activity)", 0, s.sparse_post_s),
            "last_activity": F.coalesce(F.lag("activity").over(ordered()), F.lit(0.0)),
            "last_cue": F.lag("cue_ball_normalized_speed").over(ordered()),
        }
    )
    a, m = F.col("activity"), F.col("pre_median")
    cue_rising = (F.col("cue_ball_normalized_speed") >= s.motion_start_speed * 0.75) & F.coalesce(F.col("last_cue") < s.motion_start_speed * 0.5, F.lit(False))
    from_quiet = (m <= s.sparse_activity) & (a >= s.sparse_activity) & (a - m >= 0.15)
    enough = (F.col("pre_n") >= 1) & (F.col("post_n") >= s.sparse_min_active)
    fires = (
        F.col("valid") & enough & (m <= s.quiet_max_motion) & ((a - F.col("last_activity") >= 0.20) | cue_rising | from_quiet)
        & (F.col("active") >= s.sparse_min_active) & (F.col("ball_active") >= s.sparse_min_active)
    )
    audio = p.clip(F.greatest("audio_onset", "audio_highband"))
    score = p.clip(
        0.40 + 0.20 * F.least(F.lit(1.0), F.col("peak")) + 0.15 * F.least(F.lit(1.0), F.col("ball_active") / 3.0) + 0.10 * F.col("table_confidence") + 0.08 * audio,
        0.0, 0.78,
    )
    return found.withColumns({"proposed": F.coalesce(fires, F.lit(False)), "score": score}).drop("pre", "last_activity", "last_cue")


def median_of(values: str | Column) -> Column:
    """Median of an array, null if it is empty."""
    a = F.array_sort(values)
    n = F.size(a)
    low, high = F.get(a, F.floor((n - 1) / 2).cast("int")), F.get(a, F.floor(n / 2).cast("int"))
    return F.when(n > 0, (low + high) / 2)


def transition_metrics(tl: DataFrame, s: Strike = DEFAULT.strike) -> DataFrame:
    """What the moments before and after each row say about a stroke; adds the columns of `TRANSITION`.

    Before: usable rows from 0.50 s to 0.03 s earlier. After: usable rows up to 0.30 s later, the row's own included.
    Usable rows are valid and have a track confidence of at least 0.7 of the required one. Without rows before, the
    medians are 1 and the ratios 0.
    """
    rows = tl.withColumns(
        {
            "speed": p.cue_speed(), "valid": p.valid_strike(), "sure": F.col("cue_ball_track_confidence"),
            "last_t": F.lag("t").over(ordered()), "last_speed": F.lag(p.cue_speed()).over(ordered()),
        }
    )
    fields = "struct(t, speed, sure, motion_raw raw, max_ball_normalized_speed ball, cue_ball_x x, cue_ball_y y, cue_contact_score contact, cue_approach_speed approach, cue_tip_visible tip)"
    usable = f"collect_list(case when valid and sure >= {s.track_relaxed}D then {fields} end)"
    rows = rows.withColumns({"pre": seconds_frame(usable, s.quiet_s, -s.quiet_guard_s), "post": seconds_frame(usable, 0, s.post_s)})
    rows = rows.withColumn("pre", F.filter("pre", lambda x: x["t"] < F.col("t") - s.quiet_guard_s))
    n_pre, n_post = F.size("pre"), F.size("post")

    def ratio(name: str, most: float) -> Column:
        return F.when(n_pre > 0, F.size(F.filter("pre", lambda x: x[name] <= most)) / n_pre).otherwise(0.0)

    def top(name: str) -> Column:
        return F.coalesce(F.array_max(F.transform("post", lambda x: x[name])), F.lit(0.0))

    misses = F.transform(F.filter("post", lambda x: x["speed"] < s.sustained_speed), lambda x: x["t"])
    hits = F.filter("post", lambda x: x["speed"] >= s.sustained_speed)

    def hits_before(nth: int) -> Column:
        end = F.get(misses, F.lit(nth))
        return F.size(F.filter(hits, lambda x: end.isNull() | (x["t"] < end)))

    points = F.filter("post", lambda x: x["x"].isNotNull() & x["y"].isNotNull())
    rows = rows.withColumn("points", points)
    n_points = F.size("points")
    far = F.when(n_points >= 2, F.hypot(F.get("points", n_points - 1)["x"] - F.get("points", F.lit(0))["x"], F.get("points", n_points - 1)["y"] - F.get("points", F.lit(0))["y"])).otherwise(0.0)
    steps = F.zip_with(F.slice("points", 1, F.greatest(n_points - 1, F.lit(0))), F.slice("points", 2, F.greatest(n_points - 1, F.lit(0))), lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"]))
    path = F.aggregate(steps, F.lit(0.0), lambda acc, x: acc + x)
    gain = (F.col("speed") - F.coalesce("last_speed", F.lit(0.0))) / F.greatest(F.lit(1e-3), F.col("t") - F.col("last_t"))
    contact, approach = top("contact"), top("approach")
    return rows.withColumns(
        {
            "pre_n": n_pre, "post_n": n_post,
            "stationary_ratio": ratio("speed", s.stationary_speed),
            "pre_quiet_ratio": ratio("raw", s.quiet_max_motion),
            "pre_raw_median": F.coalesce(median_of(F.transform("pre", lambda x: x["raw"])), F.lit(1.0)),
            "pre_ball_quiet_ratio": ratio("ball", s.quiet_max_ball_speed),
            "pre_ball_median": F.coalesce(median_of(F.transform("pre", lambda x: x["ball"])), F.lit(1.0)),
            "sustained_run": hits_before(0),
            "bridged_run": hits_before(1),
            "sustained_ratio": F.when(n_post > 0, F.least(F.lit(1.0), F.size(hits) / 2.0)).otherwise(0.0),
            "post_peak": top("speed"),
            "acceleration": F.greatest(F.lit(0.0), F.col("cue_ball_acceleration"), F.coalesce(gain, F.lit(0.0))),
            "crosses": (F.col("speed") >= s.motion_start_speed) & (F.coalesce("last_speed", F.lit(0.0)) < s.motion_start_speed),
            "track": F.least(F.lit(1.0), F.coalesce(F.array_max(F.transform("post", lambda x: x["sure"])), F.col("sure"))),
            "contact": contact, "approach": approach,
            "tips": F.size(F.filter("post", lambda x: x["tip"])),
            "geometry": (contact >= 0.20) | (approach >= 0.15),
            "displacement": far / F.greatest(F.col("ball_diameter_px"), F.lit(1.0)),
            "direction": F.when((n_points >= 2) & (path > 1e-6), p.clip(far / path)).otherwise(0.0),
        }
    ).drop("pre", "post", "points", "last_t", "last_speed", "sure")


TRANSITION = (
    "pre_n", "post_n", "stationary_ratio", "pre_quiet_ratio", "pre_raw_median", "pre_ball_quiet_ratio", "pre_ball_median", "sustained_run",
    "bridged_run", "sustained_ratio", "post_peak", "acceleration", "crosses", "track", "contact", "approach", "tips", "geometry", "displacement", "direction",
)


def transition_confirmed(s: Strike = DEFAULT.strike) -> Column:
    """Whether the transition metrics of a row are those of a stroke."""
    c = F.col
    override = c("geometry") & (c("contact") >= s.contact_override)
    quiet = (c("pre_quiet_ratio") >= s.quiet_min_ratio) | (override & (c("pre_quiet_ratio") >= s.contact_quiet_min_ratio))
    balls = ((c("pre_ball_quiet_ratio") >= s.ball_quiet_min_ratio) & (c("pre_ball_median") <= s.quiet_max_ball_speed)) | override
    runs = (c("sustained_run") >= 2) | (override & (c("bridged_run") >= 2) & (c("post_peak") >= s.bridge_min_peak))
    return (
        (c("stationary_ratio") >= s.stationary_min_ratio) & (c("pre_n") >= 3) & quiet & (c("pre_raw_median") <= s.quiet_max_motion) & balls & c("crosses")
        & runs & (c("displacement") >= 0.25) & (c("direction") >= 0.45) & (c("track") >= s.track_confidence)
    )


def sparse_dense_confirmed(s: Strike = DEFAULT.strike) -> Column:
    """The relaxed rule for proposals of the thin timeline."""
    c = F.col
    return (
        (c("pre_n") >= 3) & (c("pre_raw_median") <= s.quiet_max_motion) & (c("post_peak") >= max(3.0, 2.5 * s.motion_start_speed)) & (c("sustained_run") >= 2)
        & (c("displacement") >= 0.75) & (c("direction") >= 0.35) & (c("track") >= 0.36)
    )


def onset_metrics(tl: DataFrame, s: Strike = DEFAULT.strike) -> DataFrame:
    """What speaks for a stroke during which the cue ball was hidden or mixed up; adds the columns of `ONSET`."""
    rows = tl.withColumns({"speed": p.cue_speed(), "valid": p.valid_strike()})
    fields = "struct(t, speed, cue_ball_track_confidence sure, cue_ball_detected seen, motion_raw raw, max_ball_normalized_speed ball, ball_residual_motion residual, cue_ball_x x, cue_ball_y y, ball_diameter_px d)"
    usable = f"collect_list(case when valid then {fields} end)"
    rows = rows.withColumns({"pre": seconds_frame(usable, s.quiet_s, -s.quiet_guard_s), "post": seconds_frame(usable, 0, max(s.post_s, 0.20))})
    rows = rows.withColumn("pre", F.filter("pre", lambda x: x["t"] < F.col("t") - s.quiet_guard_s))
    placed = lambda x: x["x"].isNotNull() & x["y"].isNotNull()
    rows = rows.withColumns(
        {
            "sure": F.filter("pre", lambda x: x["seen"] & (x["sure"] >= s.track_confidence) & placed(x)),
            "later": F.filter("post", lambda x: x["t"] > F.col("t") + 1e-6),
        }
    )
    n_pre, n_sure = F.size("pre"), F.size("sure")
    anchor = F.get("sure", n_sure - 1)
    off = lambda x: F.hypot(x["x"] - anchor["x"], x["y"] - anchor["y"]) / F.greatest(anchor["d"], F.lit(1.0))
    good = lambda x: (x["raw"] >= 0.22) & ((x["ball"] >= 1.0) | (x["residual"] >= 0.35))
    bad = F.transform(F.filter("post", lambda x: ~good(x)), lambda x: x["t"])
    first_bad = F.get(bad, F.lit(0))
    top = lambda name: F.coalesce(F.array_max(F.transform("post", lambda x: x[name])), F.lit(0.0))
    share = lambda a, test: F.when(F.size(a) > 0, F.size(F.filter(a, test)) / F.size(a)).otherwise(0.0)
    return rows.withColumns(
        {
            "quiet": share("pre", lambda x: x["raw"] <= s.quiet_max_motion),
            "raw_median": F.coalesce(median_of(F.transform("pre", lambda x: x["raw"])), F.lit(1.0)),
            "ball_quiet": share("pre", lambda x: x["ball"] <= s.quiet_max_ball_speed),
            "ball_median": F.coalesce(median_of(F.transform("pre", lambda x: x["ball"])), F.lit(1.0)),
            "onset_run": F.size(F.filter("post", lambda x: good(x) & (first_bad.isNull() | (x["t"] < first_bad)))),
            "onset_raw": top("raw"), "onset_speed": top("ball"), "onset_residual": top("residual"),
            "reliable_n": n_sure, "reliable_still": share("sure", lambda x: x["speed"] <= s.stationary_speed),
            "missing": F.exists("later", lambda x: ~x["seen"] | (x["sure"] < s.track_relaxed)),
            "jumps": (n_sure > 0) & F.exists("later", lambda x: x["seen"] & placed(x) & F.coalesce(off(x) >= s.identity_jump, F.lit(False))),
        }
    ).drop("pre", "post", "sure", "later")


ONSET = ("quiet", "raw_median", "ball_quiet", "ball_median", "onset_run", "onset_raw", "onset_speed", "onset_residual", "reliable_n", "reliable_still", "missing", "jumps")


def onset_confirmed(s: Strike = DEFAULT.strike) -> Column:
    c = F.col
    return (
        (c("quiet") >= s.quiet_min_ratio) & (c("raw_median") <= s.quiet_max_motion) & (c("ball_quiet") >= s.fallback_ball_quiet_min_ratio)
        & (c("ball_median") <= s.quiet_max_ball_speed) & (c("reliable_n") >= 2) & (c("reliable_still") >= s.stationary_min_ratio)
        & (c("missing") | c("jumps")) & (c("onset_run") >= 2) & (c("onset_raw") >= 0.22) & (c("onset_speed") >= 1.0)
    )


def strike_score(metrics: DataFrame, s: Strike = DEFAULT.strike) -> DataFrame:
    """Adds `strike_score` and `confirmed` to rows with transition metrics and `by_tracks`."""
    c = F.col
    rows = (metrics if "by_tracks" in metrics.columns else with_tracks(metrics)).withColumns({"onset": motion_onset(), "confirmed": transition_confirmed(s)})
    generic = s.residual_weight * local_normal("onset", s.norm_rows) + s.view_weight * p.clip(c("table_confidence") + 0.15)
    tracked = (
        0.45 * generic + 0.34 * p.clip(c("acceleration") / 4.0) + 0.22 * c("sustained_ratio") + 0.10 * c("stationary_ratio") + 0.08 * c("track") + 0.06 * c("contact")
    )
    tracked = F.when(c("confirmed"), tracked).otherwise(F.least(0.22 * tracked, F.lit(0.75 * s.min_confidence)))
    plain = generic + 0.18 * p.clip(c("motion_area_ratio") / 0.02)
    score = F.when(c("by_tracks"), tracked).otherwise(plain) + s.audio_weight * p.clip(F.greatest("audio_onset", "audio_highband"))
    score = score * F.when(c("valid"), 1.0).otherwise(0.10) * F.when(c("view_type").isin(*p.REPLAYS), 0.05).otherwise(1.0)
    return rows.withColumn("strike_score", p.clip(score)).drop("onset")


def pre_quiet(s: Strike = DEFAULT.strike) -> Column:
    """Whether the valid rows 0.50 s to 0.05 s earlier were quiet; without such rows they were."""
    before = seconds_frame("collect_list(case when valid then struct(t, motion_raw) end)", s.quiet_s, -0.05)
    values = F.transform(F.filter(before, lambda x: x["t"] < F.col("t") - 0.05), lambda x: x["motion_raw"])
    return F.coalesce(median_of(values) <= s.quiet_max_motion, F.lit(True))
