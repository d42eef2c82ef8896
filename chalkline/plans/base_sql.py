"""The timeline in SQL: common tables that the checking queries start from."""

from chalkline.functions.views import VIEWS
from chalkline.operators.timeline import COUNTS, FLAGS, NUMBERS, POSITIONS

_NAMES = ", ".join(f"({i}, '{v}', '{v.replace('_', '')}')" for i, v in enumerate(VIEWS))

#: v_named(view_type, view): what each spelling means.
VIEW_NAMES = f"""
v_list(i, view, letters) as (values {_NAMES}),
v_raw as (select distinct view_type, regexp_replace(lower(regexp_replace(view_type, '^.*[.:]', '')), '[^a-z]', '', 'g') letters
          from frame_features where view_type is not null),
v_near as (select view_type, min_by(view, levenshtein(r.letters, l.letters) * 100 + i) view, min(levenshtein(r.letters, l.letters)) e
           from v_raw r, v_list l where r.letters <> '' group by view_type),
v_named as (select view_type, case when e <= 2 then view else 'other' end view from v_near)
"""

_FINITE = "case when isfinite({0}) then {0} end"
TIMELINE = (
    "with " + VIEW_NAMES + f""",
b_rows as (select *, row_number() over (partition by job_id, round_even(t * 10000, 0) order by (layer = 'dense') desc, row_id desc) n
           from frame_features where isfinite(t)),
b_one as (select * from b_rows where n = 1),
b_mark as (select *, case when round(t * 1000) - lag(round(t * 1000)) over (partition by job_id order by t) < 3600000 then null else round(t * 1000) end::bigint s from b_one),
tl as (select job_id, layer, t, last_value(s ignore nulls) over (partition by job_id order by t rows unbounded preceding) sitting,
       coalesce(view, 'other') view_type, """
    + ", ".join(f"coalesce({_FINITE.format(c)}, 0.0) {c}" for c in NUMBERS)
    + ", "
    + ", ".join(f"coalesce({c}, 0) {c}" for c in COUNTS)
    + ", "
    + ", ".join(f"coalesce({c}, {str(d).lower()}) {c}" for c, d in FLAGS.items())
    + ", "
    + ", ".join(f"{_FINITE.format(c)} {c}" for c in POSITIONS)
    + " from b_mark left join v_named using (view_type))\n"
)

SEEN = "observation_valid and table_observable"
TABLE4 = "view_type in ('main_table', 'ball_closeup', 'wide_arena', 'other')"
REPLAY = "view_type in ('replay', 'slow_motion_replay')"
VALID_STRIKE = f"({SEEN} and scene_cut_score < 0.5 and not {REPLAY} and (table_confidence >= 0.18 or {TABLE4}))"
VALID_STOP = (
    f"({SEEN} and scene_cut_score < 0.5 and view_type not in ('replay', 'slow_motion_replay', 'scoreboard', 'advertisement') and (table_confidence >= 0.25 or {TABLE4})"
    " and not (camera_motion_magnitude > 12 and table_confidence < 0.45))"
)
VALID_STATE = (
    f"({SEEN} and scene_cut_score < 0.42 and view_type not in ('replay', 'slow_motion_replay', 'scoreboard', 'advertisement')"
    " and (table_confidence >= 0.30 or view_type in ('main_table', 'ball_closeup', 'wide_arena')))"
)
CUE = "(case when cue_ball_normalized_speed > 0 then cue_ball_normalized_speed when ball_diameter_px > 0.5 then cue_ball_speed / ball_diameter_px else 0 end)"
BALL = "(case when max_ball_normalized_speed > 0 then max_ball_normalized_speed when ball_diameter_px > 0.5 then max_ball_speed / ball_diameter_px else 0 end)"
TRACKED = "(ball_diameter_px > 0.5 and (ball_count > 0 or cue_ball_track_confidence > 0))"
OBSERVED = (
    "(greatest(ball_diameter_px, cue_ball_track_confidence, cue_ball_normalized_speed, max_ball_normalized_speed, ball_residual_motion) > 0"
    " or moving_ball_count > 0 or occluded_ball_count > 0 or cue_ball_x is not null or cue_ball_y is not null)"
)


def clip(x: str, low: str = "0", high: str = "1") -> str:
    return f"greatest({low}, least({high}, {x}))"


LEGACY = f"(case when motion_raw > 0 then {clip('motion_raw')} else {clip('0.30 * residual_motion_mean / 2.2 + 0.50 * residual_motion_max / 6.0 + 0.20 * motion_area_ratio / 0.08')} end)"
STOP_ACTIVITY = f"(case when {TRACKED} then greatest({clip(f'{BALL} / (2.5 * 0.80)')}, {clip('ball_residual_motion')}, 0.8 * least(1.0, moving_ball_count / 2.0)) else {LEGACY} end)"
SPARSE = clip("greatest(motion_raw, ball_residual_motion, motion_score, cue_ball_normalized_speed / 1.0, moving_ball_count / 2.0)")
AUDIO_SUPPORT = f"greatest(motion_raw, motion_score, ball_residual_motion, {BALL} / 3.0, moving_ball_count / 2.0)"


def micro(x: str, name: str = "") -> str:
    return f"round_even(({x}) * 1000000, 0)::bigint {name}"
