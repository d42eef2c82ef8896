"""Row predicates and scores of a timeline (columns as `operators.timeline.timeline` gives them)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chalkline.config import DEFAULT, State, Stop, Strike

c = F.col

REPLAYS = ("replay", "slow_motion_replay")
#: Views that show the table; the onset and stop rules also take `other` for one.
TABLE_VIEWS = ("main_table", "ball_closeup", "wide_arena")


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def flag(x: Column) -> Column:
    return F.when(x, 1.0).otherwise(0.0)


def valid_strike() -> Column:
    """Observation usable for finding onsets."""
    seen = c("observation_valid") & c("table_observable") & (c("scene_cut_score") < 0.5)
    table = (c("table_confidence") >= 0.18) | c("view_type").isin(*TABLE_VIEWS, "other")
    return seen & ~c("view_type").isin(*REPLAYS) & table


def valid_stop() -> Column:
    """Observation usable for finding the end of motion; stricter on views and on a moving camera."""
    seen = c("observation_valid") & c("table_observable") & (c("scene_cut_score") < 0.5)
    table = (c("table_confidence") >= 0.25) | c("view_type").isin(*TABLE_VIEWS, "other")
    shaken = (c("camera_motion_magnitude") > 12) & (c("table_confidence") < 0.45)
    return seen & ~c("view_type").isin(*REPLAYS, "scoreboard", "advertisement") & table & ~shaken


def valid_state(s: State = DEFAULT.state) -> Column:
    """Observation usable for the phase labels."""
    seen = c("observation_valid") & c("table_observable") & (c("scene_cut_score") < s.hard_cut)
    table = (c("table_confidence") >= 0.30) | c("view_type").isin(*TABLE_VIEWS)
    return seen & ~c("view_type").isin(*REPLAYS, "scoreboard", "advertisement") & table


def observable_at_source() -> Column:
    """What the scan itself calls observable: enough table in the picture and no cut."""
    return (c("table_confidence") >= 0.25) & (c("table_mask_area_ratio") >= 0.03) & (c("scene_cut_score") < DEFAULT.state.hard_cut)


def normalised(speed: str, normal: str) -> Column:
    """A speed in ball diameters: as given if positive, else from pixels if the diameter is known, else 0."""
    by_size = F.when(c("ball_diameter_px") > 0.5, c(speed) / c("ball_diameter_px")).otherwise(0.0)
    return F.when(c(normal) > 0, c(normal)).otherwise(by_size)


def cue_speed() -> Column:
    return normalised("cue_ball_speed", "cue_ball_normalized_speed")


def ball_speed() -> Column:
    return normalised("max_ball_speed", "max_ball_normalized_speed")


def track_evidence() -> Column:
    return (c("ball_diameter_px") > 0.5) & ((c("ball_count") > 0) | (c("cue_ball_track_confidence") > 0))


def ball_observation() -> Column:
    """Whether any field of the tracks says something."""
    measured = ("ball_diameter_px", "cue_ball_track_confidence", "cue_ball_normalized_speed", "max_ball_normalized_speed")
    counted = ("ball_residual_motion", "moving_ball_count", "occluded_ball_count")
    return (F.greatest(*measured) > 0) | (F.greatest(*counted) > 0) | c("cue_ball_x").isNotNull() | c("cue_ball_y").isNotNull()


def legacy_activity() -> Column:
    mixed = 0.30 * c("residual_motion_mean") / 2.2 + 0.50 * c("residual_motion_max") / 6.0 + 0.20 * c("motion_area_ratio") / 0.08
    return F.when(c("motion_raw") > 0, clip(c("motion_raw"))).otherwise(clip(mixed))


def stop_activity(s: Stop = DEFAULT.stop) -> Column:
    tracked = F.greatest(
        clip(ball_speed() / (2.5 * s.start_speed)), clip(c("ball_residual_motion")), 0.8 * F.least(F.lit(1.0), c("moving_ball_count") / 2.0)
    )
    return F.when(track_evidence(), tracked).otherwise(legacy_activity())


def sparse_activity(s: Strike = DEFAULT.strike) -> Column:
    parts = (c("motion_raw"), c("ball_residual_motion"), c("motion_score"), c("cue_ball_normalized_speed") / s.motion_start_speed, c("moving_ball_count") / 2.0)
    return clip(F.greatest(*parts))


def audio_support_activity() -> Column:
    return F.greatest(c("motion_raw"), c("motion_score"), c("ball_residual_motion"), ball_speed() / 3.0, c("moving_ball_count") / 2.0)


def quiet_override() -> Column:
    return (c("motion_raw") <= 0.18) & (c("residual_motion_max") <= 0.80) & (ball_speed() <= 10.0)


def state_moving(threshold: float, legacy: float) -> Column:
    """Moving by the tracks if they say anything, else by the picture, unless the camera explains it."""
    tracks = (c("moving_ball_count") > 0) | (F.greatest("cue_ball_normalized_speed", "max_ball_normalized_speed", "ball_residual_motion") >= threshold)
    camera = (c("camera_motion_magnitude") > 6) & (c("residual_motion_mean") < 1)
    return F.when(ball_observation(), tracks).otherwise((c("motion_score") >= legacy) & ~camera)


def cue_stationary(s: State = DEFAULT.state) -> Column:
    tracked = ((c("cue_ball_track_confidence") >= s.track_confidence) | c("cue_ball_detected")) & (
        c("cue_ball_normalized_speed") <= s.stationary_speed
    ) & (c("moving_ball_count") == 0)
    return F.when(ball_observation(), tracked).otherwise(c("motion_score") <= s.quiet_motion)


def confidence_band(score: Column) -> Column:
    return F.when(score >= DEFAULT.high, "high").when(score >= DEFAULT.medium, "medium").otherwise("low")


def view_decision(green: Column, edges: Column, skin: Column, graphic: Column) -> Column:
    """Camera view from shares of green, edges and skin and a replay-graphic score; the first rule that holds counts."""
    return (
        F.when((green > 0.55) & (edges < 0.08), "ball_closeup")
        .when(green >= 0.18, "main_table")
        .when((green >= 0.06) & (graphic >= 0.55), "replay")
        .when((green >= 0.06) & (skin > 0.12), "player_closeup")
        .when(green >= 0.06, "wide_arena")
        .when(edges >= 0.15, "scoreboard")
        .when(skin >= 0.12 * 1.5, "player_closeup")
        .when((green < 0.02) & (edges < 0.06), "audience")
        .otherwise("other")
    )


def stop_moving(already: bool, baseline: Column, s: Stop = DEFAULT.stop) -> Column:
    """Whether a row shows motion, from rest or once in motion (hysteresis)."""
    speed, activity = ball_speed(), stop_activity(s)
    hidden = c("occluded_ball_count")
    if already:
        tracked = (speed >= s.stop_speed) | (c("ball_residual_motion") >= s.stop_residual)
        free = activity >= F.greatest(F.lit(s.stop_activity), baseline * s.stop_factor)
        at_last = F.when(c("moving_ball_count") > 0, True).when(track_evidence(), tracked).otherwise(free)
        return F.when(quiet_override() & ((hidden == 0) | (hidden >= 8)), False).when(hidden > 0, True).otherwise(at_last)
    tracked = (speed >= s.start_speed) | (c("ball_residual_motion") >= s.start_residual)
    free = activity >= F.greatest(F.lit(s.start_activity), baseline * s.start_factor)
    return F.when(c("moving_ball_count") > 0, True).when(track_evidence(), tracked).otherwise(free)
