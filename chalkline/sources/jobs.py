"""Jobs, configuration and synthetic timelines."""

from __future__ import annotations

import dataclasses
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chalkline.config import DEFAULT, Config


def with_values(values: dict[str, Any], base: Any = DEFAULT) -> Config:
    """A configuration with nested values replaced; unknown names are errors."""
    changes = {}
    for name, value in values.items():
        old = getattr(base, name)
        if dataclasses.is_dataclass(old):
            value = with_values(value, old)
        elif isinstance(old, dict):
            value = {**old, **{k: with_values(v, old[k]) if isinstance(v, dict) and k in old else v for k, v in value.items()}}
        changes[name] = value
    return dataclasses.replace(base, **changes)


def new_jobs(sources: DataFrame, at: str) -> DataFrame:
    """Rows of new jobs: an id from the time and a random part, the source, and their first status."""
    random = F.substring(F.regexp_replace(F.expr("uuid()"), "-", ""), 1, 8)
    return sources.select(
        F.concat_ws("-", F.date_format(at, "yyyyMMdd-HHmmss"), random).alias("job"), "source_path", F.col(at).alias("created_at"), F.lit("queued").alias("status"), F.lit(0.0).alias("progress"),
    )


def latest_progress(jobs: DataFrame, updates: DataFrame) -> DataFrame:
    """Jobs with their last update (job, status, progress, updated_at), newest job first."""
    last = Window.partitionBy("job").orderBy(F.desc("updated_at"))
    newest = updates.withColumn("_n", F.row_number().over(last)).where("_n = 1").select("job", F.col("status").alias("_s"), F.col("progress").alias("_p"), "updated_at")
    joined = jobs.join(newest, "job", "left")
    return joined.withColumns({"status": F.coalesce("_s", "status"), "progress": F.coalesce("_p", "progress")}).drop("_s", "_p").orderBy(F.desc("job"))


def export_metadata(shots: DataFrame, mode: str, accurate: bool = True) -> DataFrame:
    """One JSON record a job on an export: mode, shots, their ids and length."""
    record = F.struct(
        F.lit(mode).alias("mode"), F.count(F.lit(1)).alias("shots"), F.array_sort(F.collect_list("shot_id")).alias("shot_ids"),
        F.sum(F.greatest(F.lit(0.0), F.col("clip_end") - F.col("clip_start"))).alias("duration"), F.lit(accurate).alias("accurate"),
    )
    return shots.groupBy("job_id").agg(F.to_json(record).alias("metadata"))


def synthetic_features(spark: SparkSession, jobs: int, seconds: int, fps: int = 10, shot_every_s: float = 20.0) -> DataFrame:
    """Feature rows of made-up recordings: a shot every so often, motion that decays after it. For load tests."""
    n = seconds * fps
    t = (F.col("id") % n) / F.lit(float(fps))
    since = F.pmod(t, F.lit(shot_every_s)) - 5.0
    motion = F.when((since >= 0) & (since < 6), F.exp(-since / 2.0)).otherwise(0.0)
    return spark.range(jobs * n).select(
        F.col("id").alias("row_id"), F.floor(F.col("id") / n).alias("job_id"), F.lit("dense").alias("layer"), t.alias("t"), motion.alias("motion_raw"), motion.alias("motion_score"),
        (2 * motion).alias("residual_motion_mean"), (5 * motion).alias("residual_motion_max"), (motion * 3).alias("max_ball_normalized_speed"), (motion > 0.2).cast("int").alias("moving_ball_count"),
        F.lit(0.8).alias("table_confidence"), F.lit("main_table").alias("view_type"), F.lit(12.0).alias("ball_diameter_px"), F.lit(8).alias("ball_count"),
    )
