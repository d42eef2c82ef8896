"""Repeated consecutive events: each run becomes one event with its count and duration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chalkline.operators.sequence import join_by, shard_of, sittings, to_ms


def collapse_runs(
    df: DataFrame, entity: Sequence[str], t: str, event: Column, pause_s: int = 3600, least: int = 2
) -> DataFrame:
    """Longest runs of `least` or more equal events: entity, `event`, `start_ms`, `end_ms`, `n_readings`, `duration_ms`.

    Events are ordered by `t` (seconds). Rows of an entity at the same `t` are one reading; if their events differ, the
    commonest counts, of equally common ones the first by name. Rows with a null event are left out, but they count
    for the sittings: a pause of `pause_s` or more between an entity's rows ends a run. Rows with a null or infinite
    `t` are left out. A null entity is an entity of its own; other columns are ignored; no rows in, none out.

    A lag window over (entity, shard of the clock) flags changes and their running sum numbers the runs; the runs of a
    shard are aggregated, and only its first and last run meet those of the neighbouring shards.
    """
    keys = [f"_k{i}" for i in range(len(entity))]
    width = pause_s * 1000
    rows = df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(entity, keys)], to_ms(f"`{t}`").alias("ms"), event.alias("event"))
    rows = rows.where("ms is not null")
    # Copies disappear in the map-side combine; what is left of a reading is one row per event named at its time.
    counted = rows.where("event is not null").groupBy(*keys, "ms", "event").agg(F.count(F.lit(1)).alias("n"))
    readings = counted.groupBy(*keys, shard_of("ms", width).alias("shard"), "ms").agg(
        F.min_by("event", F.struct(-F.col("n"), F.col("event"))).alias("event")
    )
    order = Window.partitionBy(*keys, "shard").orderBy("ms")
    changed = F.when(F.lag("event").over(order) == F.col("event"), 0).otherwise(1)
    numbered = readings.withColumn("changed", changed).withColumn("run", F.sum("changed").over(order))
    local = numbered.groupBy(*keys, "shard", "run").agg(
        F.first("event").alias("event"), F.min("ms").alias("lo"), F.max("ms").alias("hi"), F.count(F.lit(1)).alias("n")
    )
    ends = local.groupBy(*keys, "shard").agg(F.max("run").alias("last_run"))
    placed = join_by(local, ends, [*keys, "shard"])
    inner = (F.col("run") > 1) & (F.col("run") < F.col("last_run"))
    done = placed.where(inner).select(*keys, "event", "lo", "hi", "n")
    spans = sittings(rows, keys, "ms", width, width).select(*keys, "shard", "sitting")
    along = Window.partitionBy(*keys).orderBy("shard", "run")
    before = lambda c: F.lag(c).over(along)
    goes_on = (before("event") == F.col("event")) & (before("shard") != F.col("shard")) & (before("sitting") == F.col("sitting"))
    stitched = (
        join_by(placed.where(~inner), spans, [*keys, "shard"])
        .withColumn("chain", F.when(goes_on, 0).otherwise(1))
        .withColumn("chain", F.sum("chain").over(along))
        .groupBy(*keys, "chain")
        .agg(F.first("event").alias("event"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))
        .select(*keys, "event", "lo", "hi", "n")
    )
    return (
        done.unionByName(stitched)
        .where(F.col("n") >= least)
        .select(
            *[F.col(k).alias(c) for c, k in zip(entity, keys)], "event", F.col("lo").alias("start_ms"), F.col("hi").alias("end_ms"),
            F.col("n").alias("n_readings"), (F.col("hi") - F.col("lo")).alias("duration_ms"),
        )
    )
