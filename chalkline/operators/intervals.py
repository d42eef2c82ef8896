"""Overlapping and gapped intervals: continuous periods of each key and the gaps between them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chalkline.operators.sequence import SHARD_MS, carry_forward, join_by, shard_of, to_ms, with_next


def _coalesce(df: DataFrame, within: Sequence[str], join_gap: int) -> DataFrame:
    """Merge `lo`..`hi` of the groups `within` where at most `join_gap` lies between them; max of `_edge` is kept."""
    order = Window.partitionBy(*within).orderBy("lo", "hi")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    heads = df.withColumn("_head", F.when(reach.isNull() | (F.col("lo") > reach + join_gap), 1).otherwise(0))
    return (
        heads.withColumn("_island", F.sum("_head").over(upto))
        .groupBy(*within, "_island")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .drop("_island")
    )


def merge_intervals(
    df: DataFrame, keys: Sequence[str], start: str, end: str, join_gap: int = 1, shard: int = SHARD_MS
) -> DataFrame:
    """Periods covered by a key's intervals, as keys, `start_ms`, `end_ms`.

    `start` and `end` are whole numbers (ms). Intervals join when they overlap, touch or lie at most `join_gap` apart.
    Rows with a null bound or an end not after the start are left out; repeated rows change nothing; other columns
    are ignored; keys may be null (null is a key of its own); an empty table gives no rows.

    Two levels: intervals are clipped into shards of the clock and merged within (key, shard); only pieces that reach
    a shard's edge, at most two for each shard, go on and are stitched by key. An interval over more than two shards
    gives its first and last piece and one bridge over the shards between, reduced to the longest bridge from each
    shard, so that no interval is cut into more than three rows however long it is.
    """
    good = df.select(*keys, F.col(start).alias("lo"), F.col(end).alias("hi")).where("lo is not null and hi > lo")
    # An end exactly on an edge belongs to the shard before it.
    spans = good.withColumns({"_a": shard_of("lo", shard), "_b": shard_of(F.col("hi") - 1, shard)})
    first = F.struct(
        F.col("_a").alias("shard"), F.col("lo").alias("lo"), F.least("hi", (F.col("_a") + 1) * shard).alias("hi"), F.lit(False).alias("bridge")
    )
    last = F.struct(F.col("_b").alias("shard"), (F.col("_b") * shard).alias("lo"), F.col("hi").alias("hi"), F.lit(False).alias("bridge"))
    bridge = F.struct(
        F.col("_a").alias("shard"), ((F.col("_a") + 1) * shard).alias("lo"), (F.col("_b") * shard).alias("hi"), F.lit(True).alias("bridge")
    )
    parts = (
        F.when(F.col("_a") == F.col("_b"), F.array(first))
        .when(F.col("_a") + 1 == F.col("_b"), F.array(first, last))
        .otherwise(F.array(first, last, bridge))
    )
    pieces = spans.select(*keys, F.explode(parts).alias("p")).select(*keys, "p.*")
    # Equal starts in a shard keep only the longest end, before the shuffle: hot keys and copies shrink here.
    pieces = pieces.groupBy(*keys, "shard", "bridge", "lo").agg(F.max("hi").alias("hi"))
    local = _coalesce(pieces, [*keys, "shard", "bridge"], join_gap)
    touches = (
        F.col("bridge")
        | (F.col("lo") <= F.col("shard") * shard + join_gap)
        | (F.col("hi") >= (F.col("shard") + 1) * shard - join_gap)
    )
    names = [*keys, "lo", "hi"]
    stitched = _coalesce(local.where(touches).select(*names), list(keys), join_gap)
    # What lies inside a shard is final unless a bridge runs over that shard.
    bridged = carry_forward(
        local.groupBy(*keys, "shard").agg(F.max(F.when(F.col("bridge"), F.col("hi"))).alias("_b")), keys, "shard", "_b", "_over"
    ).drop("_b")
    inside = join_by(local.where(~touches), bridged, [*keys, "shard"]).where("_over is null or _over < hi")
    return (
        inside.select(*names).unionByName(stitched)
        .withColumnsRenamed({"lo": "start_ms", "hi": "end_ms"})
    )


def gaps_between(periods: DataFrame, keys: Sequence[str], below: int | None = None, shard: int = SHARD_MS) -> DataFrame:
    """Spaces between consecutive periods of a key, those shorter than `below`, as keys, `start_ms`, `end_ms`."""
    following = with_next(
        periods.withColumn("shard", shard_of("start_ms", shard)), keys, "start_ms", "shard", "next_start"
    )
    gap = F.col("next_start") - F.col("end_ms")
    kept = following.where(F.col("next_start").isNotNull())
    if below is not None:
        kept = kept.where(gap < below)
    return kept.select(*keys, F.col("end_ms").alias("start_ms"), F.col("next_start").alias("end_ms"))


def periods_and_gaps(
    df: DataFrame, keys: Sequence[str], start: str, end: str, join_gap: int = 1, gap_below: int | None = 3_600_000, shard: int = SHARD_MS
) -> DataFrame:
    """Periods and gaps of a key, from bounds in seconds: keys, `kind` (period, gap), `start_ms`, `end_ms`."""
    # Column names may clash with the operator's own, so only keys and bounds come along.
    ms = df.select(*keys, to_ms(f"`{start}`").alias("lo"), to_ms(f"`{end}`").alias("hi"))
    periods = merge_intervals(ms, keys, "lo", "hi", join_gap, shard)
    gaps = gaps_between(periods, keys, gap_below, shard)
    columns = [*keys, "kind", "start_ms", "end_ms"]
    return (
        periods.withColumn("kind", F.lit("period")).select(*columns)
        .unionByName(gaps.withColumn("kind", F.lit("gap")).select(*columns))
    )
