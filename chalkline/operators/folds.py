"""Order-dependent selections, folded inside the JVM over pieces of a key's events.

An event so far from the one before it that nothing earlier can touch it begins a piece; pieces are independent, so a key
with any number of events is folded in many groups. A piece is as long as its events follow each other without such a pause.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chalkline.operators.sequence import carry_forward, join_by
from chalkline.operators.timeline import KEYS
from chalkline.session import cut

#: Seconds in a shard of the clock.
WIDTH_S = 3600.0


def _last(acc: Column) -> Column:
    return F.get(acc, F.size(acc) - 1)


def in_pieces(df: DataFrame, keys: Sequence[str], t: str, gap_s: float, strictly: bool = False) -> DataFrame:
    """Adds `_piece`, the time at which an event's piece begins: a pause of `gap_s` or more (`strictly`: more) comes before it.

    Events are ordered within (key, shard of the clock); from shard to shard goes one row with the last event and the
    last beginning. The events are used more than once, so they are written to the shared folder first.
    """
    by = [*keys, "_shard"]
    rows = cut(df, "events").withColumn("_shard", F.floor(F.col(t) / WIDTH_S))
    order = Window.partitionBy(*by).orderBy(t)
    ends = carry_forward(rows.groupBy(*by).agg(F.max(t).alias("_end")), keys, "_shard", "_end", "_before").drop("_end")
    placed = join_by(rows, ends, by).withColumn("_prior", F.coalesce(F.lag(t).over(order), F.col("_before")))
    pause = F.col(t) - F.col("_prior")
    begins = F.col("_prior").isNull() | ((pause > gap_s) if strictly else (pause >= gap_s))
    marked = placed.withColumn("_begin", F.when(begins, F.col(t))).drop("_before", "_prior")
    upto = order.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = carry_forward(marked.groupBy(*by).agg(F.max("_begin").alias("_last")), keys, "_shard", "_last", "_earlier").drop("_last")
    return join_by(marked.withColumn("_piece", F.max("_begin").over(upto)), last, by).withColumn("_piece", F.coalesce("_piece", "_earlier")).drop("_shard", "_begin", "_earlier")


def _sorted(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], columns: Sequence[str]) -> DataFrame:
    head = [o if isinstance(o, Column) else F.col(o) for o in order]
    item = F.struct(*[h.alias(f"_o{i}") for i, h in enumerate(head)], *columns)
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_a"))


def suppress(df: DataFrame, score: str, gap_s: float, t: str = "t", keys: Sequence[str] = KEYS, extra: Sequence[str] = ()) -> DataFrame:
    """Temporal non-maximum suppression, streaming form: in order of time an event is kept if it lies `gap_s` or more
    after the last one kept; a nearer one replaces that one if its score is strictly higher."""
    columns = [t, score, *extra]
    rows = _sorted(in_pieces(df, keys, t, gap_s), [*keys, "_piece"], [t], columns)

    def step(acc: Column, x: Column) -> Column:
        last = _last(acc)
        far = (F.size(acc) == 0) | (x[t] - last[t] >= gap_s)
        better = x[score] > last[score]
        return F.when(far, F.concat(acc, F.array(x))).when(better, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(x))).otherwise(acc)

    kept = F.aggregate("_a", F.slice("_a", 1, 0), step)
    return rows.select(*keys, F.explode(kept).alias("_x")).select(*keys, *[f"_x.{c}" for c in columns])


def strongest(df: DataFrame, score: str, gap_s: float, most: int = 0, t: str = "t", keys: Sequence[str] = KEYS) -> DataFrame:
    """Strongest-first suppression: events in order of falling score (then time) are kept unless one already kept lies
    nearer than `gap_s`; at most `most` of a recording if that is positive."""
    # A limit is one for the whole recording; without it far events do not touch each other.
    by = keys if most else [*keys, "_piece"]
    rows = _sorted(df if most else in_pieces(df, keys, t, gap_s), by, [-F.col(score), t], [t, score])

    def step(acc: Column, x: Column) -> Column:
        clash = F.exists(acc, lambda y: F.abs(y[t] - x[t]) < gap_s)
        full = (F.size(acc) >= most) if most else F.lit(False)
        return F.when(clash | full, acc).otherwise(F.concat(acc, F.array(x)))

    kept = F.aggregate("_a", F.slice("_a", 1, 0), step)
    return rows.select(*keys, F.explode(kept).alias("_x")).select(*keys, f"_x.{t}", f"_x.{score}")


def merge_near(df: DataFrame, gap_s: float, t: str, score: str, evidence: str, extra: Sequence[str] = (), keys: Sequence[str] = ("job_id",)) -> DataFrame:
    """Candidates nearer than `gap_s` to the last one kept fall together: the one with the strictly higher score
    stays, the earlier one on ties; the evidence of both is merged, the winner's values on top."""
    columns = [t, score, evidence, *extra]
    # Maps have no order, so a recording's events are sorted with their evidence as sorted entries.
    entries = df.withColumn(evidence, F.array_sort(F.map_entries(evidence)))
    rows = _sorted(in_pieces(entries, keys, t, gap_s), [*keys, "_piece"], [t, F.col(extra[0]) if extra else F.lit(0)], columns)

    def merged(low: Column, high: Column) -> Column:
        own = F.transform(high[evidence], lambda e: e["key"])
        more = F.filter(low[evidence], lambda e: ~F.array_contains(own, e["key"]))
        return high.withField(evidence, F.concat(more, high[evidence]))

    def step(acc: Column, x: Column) -> Column:
        last = _last(acc)
        head = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        far = (F.size(acc) == 0) | (x[t] - last[t] >= gap_s)
        return (
            F.when(far, F.concat(acc, F.array(x)))
            .when(x[score] > last[score], F.concat(head, F.array(merged(last, x))))
            .otherwise(F.concat(head, F.array(merged(x, last))))
        )

    kept = F.aggregate("_a", F.slice("_a", 1, 0), step)
    found = rows.select(*keys, F.explode(kept).alias("_x")).select(*keys, *[f"_x.{c}" for c in columns])
    return found.withColumn(evidence, F.map_from_entries(evidence))


def spaced(df: DataFrame, gap_s: float, t: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """First-come selection: an event is kept if it lies `gap_s` or more after the last one kept."""
    rows = in_pieces(df.select(*keys, t).distinct(), keys, t, gap_s).groupBy(*keys, "_piece").agg(F.array_sort(F.collect_set(t)).alias("_a"))
    kept = F.aggregate("_a", F.slice("_a", 1, 0), lambda acc, x: F.when((F.size(acc) == 0) | (x - _last(acc) >= gap_s), F.concat(acc, F.array(x))).otherwise(acc))
    return rows.select(*keys, F.explode(kept).alias(t))


def match_one_to_one(pairs: DataFrame, left: str, right: str, distance: str, keys: Sequence[str], reach_s: float) -> DataFrame:
    """Greedy matching of candidate pairs of times: by distance, then left, then right, a pair is taken if both are free.

    No pair is further apart than `reach_s`, so pairs that begin more than that after the others share no time with them.
    """
    placed = in_pieces(pairs.withColumn("_from", F.least(left, right)), keys, "_from", reach_s, strictly=True)
    rows = _sorted(placed, [*keys, "_piece"], [distance, left, right], [left, right, distance])

    def step(acc: Column, x: Column) -> Column:
        taken = F.exists(acc, lambda y: (y[left] == x[left]) | (y[right] == x[right]))
        return F.when(taken, acc).otherwise(F.concat(acc, F.array(x)))

    kept = F.aggregate("_a", F.slice("_a", 1, 0), step)
    return rows.select(*keys, F.explode(kept).alias("_x")).select(*keys, *[f"_x.{c}" for c in (left, right, distance)])


def settle_in_turn(marks: DataFrame, keys: Sequence[str], reach_s: float) -> DataFrame:
    """First come, first served: keys, `new_id`, `old_id`.

    marks: keys, `side` (0 new, 1 old), `at`, `id`. New marks in order of time, then id, each take the nearest old mark
    that is left and at most `reach_s` away; of equally near ones the first by time, then id.
    """
    grouped = in_pieces(marks, keys, "at", reach_s, strictly=True).groupBy(*keys, "_piece").agg(F.array_sort(F.collect_list(F.struct("side", "at", "id"))).alias("_a"))
    sides = grouped.withColumns({"_new": F.filter("_a", lambda x: x["side"] == 0), "_old": F.filter("_a", lambda x: x["side"] == 1)})

    def step(acc: Column, x: Column) -> Column:
        near = F.filter(acc["left"], lambda y: F.abs(y["at"] - x["at"]) <= reach_s)
        best = F.array_min(F.transform(near, lambda y: F.struct(F.abs(y["at"] - x["at"]).alias("d"), y["at"].alias("at"), y["id"].alias("id"))))
        taken = F.struct(
            F.filter(acc["left"], lambda y: y["id"] != best["id"]).alias("left"),
            F.concat(acc["pairs"], F.array(F.struct(x["id"].alias("new_id"), best["id"].alias("old_id")))).alias("pairs"),
        )
        return F.when(best.isNull(), acc).otherwise(taken)

    start = F.struct(F.col("_old").alias("left"), F.array().cast("array<struct<new_id:bigint,old_id:bigint>>").alias("pairs"))
    pairs = F.aggregate("_new", start, step, lambda acc: acc["pairs"])
    return sides.where("size(_new) > 0 and size(_old) > 0").select(*keys, F.inline(pairs))
