"""The timeline: one row per sample of a recording, from layered, repeated and incomplete feature rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chalkline.functions.views import canonical_view
from chalkline.operators.sequence import join_by, shard_of, sittings, to_ms

#: A recording: windows and folds never cross it. A job's recordings are its stretches without an hour's pause, so
#: that a job of any size is spread over many groups.
KEYS = ["job_id", "sitting"]
NUMBERS = (
    "table_confidence", "table_mask_area_ratio", "residual_motion_mean", "residual_motion_max", "motion_area_ratio",
    "camera_motion_magnitude", "scene_cut_score", "green_ratio", "edge_density", "audio_onset", "audio_rms", "audio_highband",
    "max_ball_speed", "ball_diameter_px", "cue_ball_speed", "cue_ball_normalized_speed", "cue_ball_acceleration",
    "cue_ball_track_confidence", "cue_tip_distance_to_ball", "cue_approach_speed", "cue_forward_motion", "cue_contact_score",
    "max_ball_normalized_speed", "ball_residual_motion", "strike_score", "motion_score", "motion_raw",
)
COUNTS = ("ball_count", "moving_ball_count", "occluded_ball_count")
FLAGS = {"cue_ball_detected": False, "table_observable": True, "observation_valid": True, "cue_tip_visible": False}
POSITIONS = ("cue_ball_x", "cue_ball_y")
COLUMNS = ("row_id", "job_id", "layer", "t", "view_type", *NUMBERS, *COUNTS, *FLAGS, *POSITIONS)


def finite(c: Column) -> Column:
    """The number, or null if it is NaN or infinite."""
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(math.inf)), c)


def layer_merge(features: DataFrame) -> DataFrame:
    """One row per job and tenth of a millisecond: the dense layer's over the coarse one's, then the latest row's."""
    key = F.rint(F.col("t") * 10_000).cast("bigint")
    pick = F.struct((F.col("layer") == "dense").alias("_dense"), F.col("row_id").alias("_row"))
    columns = [c for c in features.columns if c != "job_id"]
    return (
        features.where(finite(F.col("t")).isNotNull())
        .groupBy("job_id", key.alias("_key"))
        .agg(F.max_by(F.struct(*columns), pick).alias("_r"))
        .select("job_id", "_r.*")
    )


def _clean(name: str) -> Column:
    """A feature with its default in place of null; positions stay null."""
    c = F.col(name)
    if name == "view_type":
        return F.coalesce(canonical_view(c), F.lit("other"))
    if name in NUMBERS:
        return F.coalesce(finite(c), F.lit(0.0))
    return finite(c) if name in POSITIONS else F.coalesce(c, F.lit(FLAGS.get(name, 0)))


def timeline(features: DataFrame, pause_s: int = 3600, columns: Sequence[str] = COLUMNS[4:]) -> DataFrame:
    """The merged layers with defaults in place of nulls and non-finite numbers, canonical views, and the `sitting`.

    `columns` are those wanted besides job_id, layer and t: only they are read and shuffled.

    A job is a group of its own even if null. Rows without a finite time are left out. `sitting` is the ms at which the
    recording begins; a pause of `pause_s` or more ends it.
    """
    merged = layer_merge(features.select("row_id", "job_id", "layer", "t", *columns))
    clean = merged.select("job_id", "layer", "t", to_ms("t").alias("ms"), *[_clean(c).alias(c) for c in columns])
    spans = sittings(clean, ["job_id"], "ms", pause_s * 1000, pause_s * 1000).select("job_id", "shard", "sitting")
    placed = clean.withColumn("shard", shard_of("ms", pause_s * 1000))
    return join_by(placed, spans, ["job_id", "shard"]).drop("shard", "ms")


def micro(c: Column | str) -> Column:
    """A number in whole millionths: the form in which results are compared."""
    return F.rint((F.col(c) if isinstance(c, str) else c) * 1_000_000).cast("bigint")

