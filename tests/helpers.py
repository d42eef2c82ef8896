from chalkline.operators.timeline import COUNTS, FLAGS, NUMBERS, POSITIONS

SCHEMA = ", ".join(
    ["job_id bigint", "layer string", "t double", "view_type string", *[f"{c} double" for c in NUMBERS], *[f"{c} int" for c in COUNTS], *[f"{c} boolean" for c in FLAGS], *[f"{c} double" for c in POSITIONS], "sitting bigint"]
)


def row(t, job=1, **values):
    out = {"job_id": job, "layer": "dense", "t": float(t), "view_type": "main_table", **{c: 0.0 for c in NUMBERS}, **{c: 0 for c in COUNTS}, **FLAGS, **{c: None for c in POSITIONS}, "sitting": 0}
    out["table_confidence"] = 0.8
    for k, v in values.items():
        assert k in out, k
        out[k] = float(v) if isinstance(out[k], float) and not isinstance(v, bool) else v
    return tuple(out.values())


def tracked(t, moving, **more):
    speed = dict(max_ball_normalized_speed=0.8, moving_ball_count=1, ball_residual_motion=0.4, motion_raw=0.7) if moving else dict(ball_residual_motion=0.02, motion_raw=0.02)
    return row(t, **{**dict(ball_diameter_px=12, ball_count=8, cue_ball_track_confidence=0.95), **speed, **more})
