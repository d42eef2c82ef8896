"""Order-sensitive steps over keys of any size.

A window over one key alone would put a key's rows, maybe a third of the table, into one task. Here a key is split
into shards of its order column; a window then holds one shard, and what crosses shards goes through a summary of one
row per key and shard.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Milliseconds in a shard of a clock: an hour of readings is at most some ten thousand rows.
SHARD_MS = 3_600_000


def to_ms(seconds: str | Column) -> Column:
    """Seconds as whole milliseconds; null, infinite and NaN seconds, and those past 64 bits, become null."""
    c = F.col(seconds) if isinstance(seconds, str) else seconds
    ok = c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(9.0e15))
    return F.when(ok, F.round(c * 1000).cast("bigint"))


def shard_of(ms: Column | str, width: int = SHARD_MS) -> Column:
    """Number of the shard a millisecond lies in."""
    c = F.col(ms) if isinstance(ms, str) else ms
    w = F.lit(width).cast("bigint")
    return F.call_function("div", c - F.pmod(c, w), w)


def join_by(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join in which null keys match null keys; the result has the left's columns and the right's other ones."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = [F.col(f"`{k}`").eqNullSafe(F.col(f"`_right_{k}`")) for k in keys]
    return left.join(renamed, same, how).drop(*[f"_right_{k}" for k in keys])


def carry_forward(summary: DataFrame, keys: Sequence[str], shard: str, value: str, out: str, how: str = "max") -> DataFrame:
    """Per key and shard, the `how` (max, last) of `value` over all earlier shards of the key."""
    before = Window.partitionBy(*keys).orderBy(shard).rowsBetween(Window.unboundedPreceding, -1)
    agg = F.max(value) if how == "max" else F.last(value, ignorenulls=True)
    return summary.withColumn(out, agg.over(before))


def with_next(df: DataFrame, keys: Sequence[str], order: str, shard: str, out: str) -> DataFrame:
    """Add the key's next value of `order`, looking into the next shard that has rows where a shard ends.

    `order` must grow with `shard`; the last row of a key gets null. One window over (key, shard), one over the summary.
    """
    inside = Window.partitionBy(*keys, shard).orderBy(order)
    along = Window.partitionBy(*keys).orderBy(shard)
    first = (
        df.groupBy(*keys, shard)
        .agg(F.min(order).alias("_first"))
        .withColumn("_next_first", F.lead("_first").over(along))
        .drop("_first")
    )
    return (
        join_by(df.withColumn("_next", F.lead(order).over(inside)), first, [*keys, shard])
        .withColumn(out, F.coalesce("_next", "_next_first"))
        .select(*df.columns, out)
    )


def sittings(readings: DataFrame, keys: Sequence[str], ms: str, pause_ms: int, shard_ms: int | None = None) -> DataFrame:
    """Stretches of a key's readings without a pause of `pause_ms` or more.

    Returns keys, `sitting` (start in ms), `shard`, `sitting_start`, `sitting_end` - one row for each shard of a
    sitting, with the first and last ms of the readings of that shard as `shard_start`, `shard_end`.

    Shards are no wider than the pause, so a pause can only lie between two shards with readings: the
    readings are reduced to one row per key and shard (with map-side combine) before anything is ordered.
    Readings with a null ms are left out.
    """
    width = min(shard_ms or SHARD_MS, pause_ms)
    shards = (
        readings.where(F.col(ms).isNotNull())
        .groupBy(*keys, shard_of(ms, width).alias("shard"))
        .agg(F.min(ms).alias("shard_start"), F.max(ms).alias("shard_end"))
    )
    along = Window.partitionBy(*keys).orderBy("shard")
    starts = F.lag("shard_end").over(along).isNull() | (
        F.col("shard_start") - F.lag("shard_end").over(along) >= pause_ms
    )
    marked = shards.withColumn("_s", F.when(starts, F.col("shard_start")))
    run = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = marked.withColumn("sitting", F.last("_s", ignorenulls=True).over(run)).drop("_s")
    whole = Window.partitionBy(*keys, "sitting")
    return numbered.withColumns(
        {"sitting_start": F.min("shard_start").over(whole), "sitting_end": F.max("shard_end").over(whole)}
    )
