"""Joins in time: points with intervals, with neighbours, with windows. Equal keys and a shard of the clock come first.

Every point has one shard, so a hot job's points spread; the intervals' side is copied to each shard it touches.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds in a shard of the clock.
WIDTH_S = 600.0


def _shard(seconds: Column) -> Column:
    return F.floor(seconds / F.lit(WIDTH_S)).cast("bigint")


def within(points: DataFrame, spans: DataFrame, keys: Sequence[str], t: str, low: str, high: str, how: str = "inner", closed: bool = True) -> DataFrame:
    """Points with the spans around them: low <= t < high, or <= high if `closed`.

    Rows without a finite time or bounds have no partner. A span has a row for each shard of the clock that it touches, whatever
    their number.
    """
    p = points.withColumn("_shard", _shard(F.col(t)))
    first, last = _shard(F.col(low)), _shard(F.col(high))
    finite = (F.abs(F.col(low)) < math.inf) & (F.abs(F.col(high)) < math.inf)
    s = spans.where((F.col(low) <= F.col(high)) & finite).withColumn("_shard", F.explode(F.sequence(first, last)))
    s = s.withColumnsRenamed({k: f"_s_{k}" for k in [*keys, "_shard"]})
    upper = F.col(t) <= F.col(high) if closed else F.col(t) < F.col(high)
    on = [F.col(k) == F.col(f"_s_{k}") for k in [*keys, "_shard"]] + [F.col(t) >= F.col(low), upper]
    return p.join(s, on, how).drop("_shard", *[f"_s_{k}" for k in [*keys, "_shard"]])


def last_before(points: DataFrame, marks: DataFrame, keys: Sequence[str], t: str, at: str, carry: Sequence[str]) -> DataFrame:
    """As-of join: each point with the `carry` columns of the key's last mark at or before it, null if none.

    Both sides are merged in one sort by key and time; of marks at the same time the one with the larger `carry` counts.
    """
    left = points.withColumns({"_t": F.col(t), "_mark": F.lit(None).cast("int"), **{f"_c_{c}": F.lit(None).cast(marks.schema[c].dataType) for c in carry}})
    blank = {c: F.lit(None).cast(points.schema[c].dataType).alias(c) for c in points.columns if c not in keys}
    right = marks.where(F.col(at).isNotNull()).select(
        *[F.col(c) if c in keys else blank[c] for c in points.columns],
        F.col(at).alias("_t"), F.lit(1).alias("_mark"), *[F.col(c).alias(f"_c_{c}") for c in carry],
    )
    order = Window.partitionBy(*keys).orderBy("_t", F.col("_mark").asc_nulls_last(), *[f"_c_{c}" for c in carry]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    packed = F.last(F.when(F.col("_mark") == 1, F.struct(*[F.col(f"_c_{c}").alias(c) for c in carry])), ignorenulls=True).over(order)
    merged = left.unionByName(right).withColumn("_found", packed).where("_mark is null")
    return merged.select(*points.columns, *[F.col(f"_found.{c}").alias(c if c not in points.columns else f"{c}_found") for c in carry])


def nearest(points: DataFrame, marks: DataFrame, keys: Sequence[str], t: str, at: str, reach: float) -> DataFrame:
    """Each point with the nearest mark at most `reach` seconds away (`nearest_at`), null if there is none; the earlier of
    two equally near ones."""
    spans = marks.select(*keys, F.col(at).alias("_at"), (F.col(at) - reach).alias("_lo"), (F.col(at) + reach).alias("_hi")).distinct()
    joined = within(points, spans, keys, t, "_lo", "_hi", "left")
    names = points.columns
    best = F.min(F.when(F.col("_at").isNotNull(), F.struct(F.abs(F.col("_at") - F.col(t)).alias("d"), F.col("_at").alias("at"))))
    return joined.groupBy(*names).agg(best.alias("_b")).select(*names, F.col("_b.at").alias("nearest_at"))
