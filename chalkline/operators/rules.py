"""Row rules over shots and timelines: export filters, boundary checks, repaired labels, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chalkline.config import DEFAULT
from chalkline.functions import predicates as p
from chalkline.operators.timeline import KEYS

c = F.col

# The modes and the other names under which each may be given.
MODE_NAMES = {
    "strict": ("strict_mode", "shots_only", "shot_only", "pure"),
    "action_only": ("action", "actiononly"),
    "natural": ("highlights", "natural_highlights"),
    "full_sequence": ("full", "full_shot_sequence", "sequence"),
}


def mode_name(text: Column) -> Column:
    """The mode a name means: case, spaces and hyphens do not matter. Null stays null; a name of no mode is an error."""
    plain = F.regexp_replace(F.lower(F.trim(text)), "[ -]", "_")
    known = [F.lit(x) for mode, names in MODE_NAMES.items() for name in (mode, *names) for x in (name, mode)]
    found = F.element_at(F.create_map(*known), plain)
    return F.when(text.isNull(), F.lit(None)).otherwise(F.coalesce(found, F.raise_error(F.concat(F.lit("no such mode: "), text)).cast("string")))


def retained(evidence: Column, audio_support: Column) -> Column:
    """Whether a proposed onset stays: the close look confirmed it (a transition, or an onset hidden behind the player that
    lasts two samples), or it was heard first and the picture supports it. A proposal alone does not stay."""
    said = lambda key: F.coalesce(evidence[key], F.lit(0.0))
    hidden = (said("occlusion_inferred") >= 0.5) & (said("ball_onset_run") >= 2.0)
    confirmed = (said("dense_transition_confirmed") >= 0.5) | (said("sparse_dense_transition") >= 0.5) | hidden
    return confirmed | ((said("audio_seed") >= 0.5) & F.coalesce(audio_support, F.lit(False)))


def included_at_first(possible_replay: Column, view: Column, evidence: Column, retain_replays: bool = False) -> tuple[Column, Column]:
    """Whether a new shot is included and whether its replay doubt calls for review. Only a replay's view or a confirmed
    signature leaves it out; a mere guess leaves it in, for review."""
    doubt = F.coalesce(possible_replay, F.lit(False)) & F.lit(not retain_replays)
    certain = F.coalesce(view.isin(*p.REPLAYS), F.lit(False)) | (F.coalesce(evidence["replay_signature_confirmed"], F.lit(0.0)) >= 0.5)
    return ~(doubt & certain), doubt


def is_replay() -> Column:
    return c("possible_replay") | c("linked_live_shot_id").isNotNull() | F.arrays_overlap("camera_views", F.array(*[F.lit(v) for v in p.REPLAYS]))


def export_filter(shots: DataFrame, include_replays: bool = False, only_included: bool = True, least_confidence: float = 0.0, least_importance: float = 0.0) -> DataFrame:
    """Shots to export. Replays need `include_replays` and then do not need to be included; all need the least scores."""
    chosen = F.when(F.coalesce(is_replay(), F.lit(False)), F.lit(include_replays)).otherwise(c("included") | F.lit(not only_included))
    scores = (F.coalesce("shot_confidence", F.lit(0.0)) >= least_confidence) & (F.coalesce("importance", F.lit(0.0)) >= least_importance)
    return shots.where(chosen & scores)


#: Times of a shot that are kept under two names.
ALIASES = {"cue_strike": "cue_strike_timestamp", "clip_start": "clip_start_timestamp", "clip_end": "clip_end_timestamp"}


def boundary_violations(shots: DataFrame, tolerance: float = 1e-6, durations: DataFrame | None = None, fps: float = 30.0) -> DataFrame:
    """What is wrong with clips under the strict rules: job_id, shot_id, `violation` (one row each).

    Times under two names agree; the clip begins 2 s before the strike (not before 0) and ends at the stop or 4 s after
    the strike, whichever is later, or where the source does (`durations`: job_id, `source_s`); the stop is not before the
    last motion and not after its confirmation; the clip is not empty, holds the strike, and does not outlast the source by
    more than a frame. A check is left out where a time it needs is null or no column of `shots`.
    """
    before, after = DEFAULT.modes["strict"].pre_s, DEFAULT.strict_after_s
    rows = shots.withColumns({x: F.lit(None).cast("double") for x in (*ALIASES.values(), "physical_stop_timestamp", "stop_confirmation_timestamp", "last_ball_motion_timestamp") if x not in shots.columns})
    if durations is not None:
        rows = rows.join(durations.select("job_id", "source_s"), "job_id", "left")
    else:
        rows = rows.withColumn("source_s", F.lit(None).cast("double"))
    strike, start, end = (F.coalesce(alias, name) for name, alias in ALIASES.items())
    stop, source = F.coalesce("physical_stop_timestamp", "ball_motion_end"), F.when(c("source_s") > 0, c("source_s"))
    frame = max(tolerance, 1.0 / max(fps or 30.0, 1.0))
    ends_at = F.when(stop.isNotNull() & strike.isNotNull(), F.least(source, F.greatest(stop, strike + after)))
    checks = {f"{name}_alias": F.abs(c(name) - c(alias)) > tolerance for name, alias in ALIASES.items()} | {
        "start": F.abs(start - F.greatest(F.lit(0.0), strike - before)) > tolerance,
        "end": F.abs(end - ends_at) > tolerance,
        "confirmation": c("stop_confirmation_timestamp") + tolerance < stop,
        "last_motion": c("last_ball_motion_timestamp") > stop + tolerance,
        "interval": (start < -tolerance) | (end <= start + tolerance),
        "strike": ~strike.between(start - tolerance, end + tolerance),
        "source": end > source + frame,
    }
    # The start needs a strike: without one `greatest` would pass the null over.
    checks["start"] = checks["start"] & strike.isNotNull()
    found = F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks.items()]), lambda x: x.isNotNull())
    return rows.select("job_id", "shot_id", F.explode(found).alias("violation"))


def require_valid(shots: DataFrame) -> DataFrame:
    """The shots, or an error if any violates the strict rules (raised when the plan runs)."""
    bad = boundary_violations(shots).select("job_id", "shot_id").distinct().withColumn("_bad", F.lit(True))
    marked = shots.join(bad, ["job_id", "shot_id"], "left")
    fail = F.raise_error(F.concat(F.lit("a shot violates the strict boundaries: "), c("shot_id").cast("string")))
    return marked.where(F.when(c("_bad"), fail).otherwise(F.lit(True))).drop("_bad")


def repaired_views(tl: DataFrame) -> DataFrame:
    """Adds `repaired_view`: where nine tenths of a recording pass for replay though a fifth of it shows the cloth, rows with
    the cloth are the main table."""
    whole = Window.partitionBy(*KEYS)
    replay, green = p.flag(c("view_type").isin(*p.REPLAYS)), p.flag(c("green_ratio") >= 0.18)
    wrong = (F.avg(replay).over(whole) >= 0.9) & (F.avg(green).over(whole) >= 0.2)
    return tl.withColumn("repaired_view", F.when(wrong & (c("green_ratio") >= 0.18), "main_table").otherwise(c("view_type")))


def confirmed_cuts(rows: DataFrame, adjacent: str, two_back: str, hard: float = 0.42, fade: float = 0.18) -> DataFrame:
    """Adds `cut`: hard cuts, and fades that the next row confirms.

    A row whose distance to the row before is at least `hard` is a cut. One whose distance to the row two before is at least
    `fade` begins a fade, which is a cut if the next row's is at least 1.2 x `fade`; the last row cannot be confirmed.
    """
    order = Window.partitionBy(*KEYS).orderBy("t")
    following = F.lead(two_back).over(order)
    faded = (c(adjacent) < hard) & (c(two_back) >= fade) & F.coalesce(following >= 1.2 * fade, F.lit(False))
    return rows.withColumn("cut", (c(adjacent) >= hard) | faded)


def stable_speed(tl: DataFrame, seconds: float = 0.24, least: float = 0.08, coherence: float = 0.35) -> DataFrame:
    """Adds `stable_speed` of the cue ball in diameters a second: slope of its place over the last `seconds`, 0 if it went
    nowhere (less than `least` diameters) or back and forth (net way under `coherence` of the path)."""
    over = f"over (partition by {', '.join(KEYS)} order by t range between {seconds!r}D preceding and current row)"
    place = "case when cue_ball_x is not null and cue_ball_y is not null then {0} end"
    stats = {
        "_sx": F.expr(f"regr_slope({place.format('cue_ball_x')}, t) {over}"), "_sy": F.expr(f"regr_slope({place.format('cue_ball_y')}, t) {over}"),
        "_p": F.expr(f"collect_list({place.format('struct(t, cue_ball_x x, cue_ball_y y)')}) {over}"),
    }
    rows = tl.withColumns(stats)
    n = F.size("_p")
    way = F.when(n >= 2, F.hypot(F.get("_p", n - 1)["x"] - F.get("_p", F.lit(0))["x"], F.get("_p", n - 1)["y"] - F.get("_p", F.lit(0))["y"])).otherwise(0.0)
    steps = F.zip_with(F.slice("_p", 1, F.greatest(n - 1, F.lit(0))), F.slice("_p", 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"]))
    path = F.aggregate(steps, F.lit(0.0), lambda acc, x: acc + x)
    size = F.greatest(c("ball_diameter_px"), F.lit(1.0))
    moving = (n >= 2) & (way >= least * size) & (way >= coherence * path)
    return rows.withColumn("stable_speed", F.when(moving, F.hypot(F.coalesce("_sx", F.lit(0.0)), F.coalesce("_sy", F.lit(0.0))) / size).otherwise(0.0)).drop("_sx", "_sy", "_p")


def sampled(rows: DataFrame, fps: float, start: float | None = None, end: float | None = None) -> DataFrame:
    """The first row of each 1/fps of a recording from `start` (else its first row) to `end`."""
    kept = rows
    if start is not None:
        kept = kept.where(c("t") >= start - 1e-6)
    if end is not None:
        kept = kept.where(c("t") <= end + 1e-6)
    origin = F.lit(start) if start is not None else F.min("t").over(Window.partitionBy(*KEYS))
    kept = kept.withColumn("_slot", F.floor((c("t") - origin) * fps + 1e-6))
    order = Window.partitionBy(*KEYS, "_slot").orderBy("t")
    return kept.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_slot")


def mirrored(shots: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """Fields that have two names: where one is missing it takes the other's value."""
    return shots.withColumns({a: F.coalesce(a, b) for a, b in pairs.items()} | {b: F.coalesce(b, a) for a, b in pairs.items()})


def seek(offsets: DataFrame, times: DataFrame) -> DataFrame:
    """Source position of times on the joined clips: job_id, `at`, shot_id, `source_t`.

    offsets: job_id, shot_id, clip_start, rec_in, rec_out; times: job_id, `at`. Times past the end are left out.
    """
    joined = times.join(offsets, "job_id").where((c("at") >= c("rec_in")) & (c("at") < c("rec_out")))
    return joined.select("job_id", "at", "shot_id", (c("clip_start") + c("at") - c("rec_in")).alias("source_t"))
