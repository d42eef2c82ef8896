"""Edits of shot tables: each gives a new version of the table, shots numbered by their clip's beginning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chalkline.operators.intervals import merge_intervals
from chalkline.operators.sequence import to_ms

c = F.col


def renumber(shots: DataFrame, keys: list[str], *ties: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("clip_start", "shot_id", *ties)
    return shots.withColumn("shot_id", F.row_number().over(order))


def update(shots: DataFrame, where: Column, **values: Column) -> DataFrame:
    """Set columns of the shots `where` holds; they count as changed by hand and need no review."""
    changed = {**values, "user_modified": F.lit(True), "manual_review_required": F.lit(False)}
    return shots.withColumns({k: F.when(where, v).otherwise(c(k)) for k, v in changed.items() if k in shots.columns})


def delete(shots: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    """Without the shots of `ids` (keys, shot_id); an id that is no shot is an error (raised when the plan runs)."""
    known = shots.select(*keys, c("shot_id"), F.lit(True).alias("_known"))
    wanted = ids.select(*keys, c("shot_id").cast(shots.schema["shot_id"].dataType).alias("shot_id")).distinct().join(known, [*keys, "shot_id"], "left")
    missing = F.raise_error(F.concat(F.lit("no shot "), c("shot_id").cast("string"))).cast("boolean")
    found = wanted.withColumn("_drop", F.coalesce("_known", missing)).drop("_known")
    # A full join, so that ids without a shot are met (and raise) whatever the plan.
    return renumber(shots.join(found, [*keys, "shot_id"], "full").where("_drop is null").drop("_drop"), keys)


def add(shots: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    return renumber(shots.unionByName(more, allowMissingColumns=True), keys)


def split(shots: DataFrame, keys: list[str], at: Column, where: Column, margin: float = 0.05) -> DataFrame:
    """Cut shots at a time strictly inside their clip; the part after it begins with its own strike."""
    inside = where & (at > c("clip_start") + margin) & (at < c("clip_end") - margin)
    rest = [c(x) for x in shots.columns if x not in ("clip_start", "clip_end", "cue_strike", "ball_motion_end")]

    def piece(part: int, start: Column, end: Column, strike: Column, stop: Column) -> Column:
        return F.struct(F.lit(part).alias("_part"), start.alias("clip_start"), end.alias("clip_end"), strike.alias("cue_strike"), stop.alias("ball_motion_end"))

    whole = piece(0, c("clip_start"), c("clip_end"), c("cue_strike"), c("ball_motion_end"))
    left = piece(0, c("clip_start"), at, c("cue_strike"), F.least("ball_motion_end", at))
    right = piece(1, at, c("clip_end"), F.greatest(at, F.least("cue_strike", "clip_end")), c("ball_motion_end"))
    parts = F.when(inside, F.array(left, right)).otherwise(F.array(whole))
    return renumber(shots.select(*rest, F.inline(parts)), keys, "_part").drop("_part")


def merge(shots: DataFrame, keys: list[str], group: Column) -> DataFrame:
    """Shots of an equal `group` become one: the whole stretch, the first one's strike, any inclusion or replay."""
    first = F.struct("clip_start", "shot_id")
    rows = shots.withColumn("_g", group).groupBy(*keys, "_g").agg(
        F.min("shot_id").alias("shot_id"), F.min("clip_start").alias("clip_start"), F.max("clip_end").alias("clip_end"), F.min_by("cue_strike", first).alias("cue_strike"),
        F.max("ball_motion_end").alias("ball_motion_end"), F.max("shot_confidence").alias("shot_confidence"), F.bool_or("included").alias("included"), F.bool_or("possible_replay").alias("possible_replay"),
        *[F.min_by(x, first).alias(x) for x in ("preparation_start", "ball_motion_start") if x in shots.columns],
    )
    return renumber(rows.drop("_g"), keys)


def merge_first(shots: DataFrame, keys: list[str], n: int) -> DataFrame:
    """A key's first `n` shots merged into one."""
    order = Window.partitionBy(*keys).orderBy("clip_start", "shot_id")
    ranked = shots.withColumn("_k", F.row_number().over(order))
    return merge(ranked.withColumn("shot_id", c("_k")), keys, F.greatest(c("_k"), F.lit(n)))


#: What an editor decided about a shot, kept when shots are cut anew.
DECISIONS = ("included", "user_modified", "linked_live_shot_id")


def carry_over(new: DataFrame, old: DataFrame, keys: list[str], reach_s: float = 1.5) -> DataFrame:
    """New shots with the decisions (those of DECISIONS that both tables have) of the old shot each goes back to.

    The new shots of a key take turns by strike, then number: each takes the nearest old shot that is left (of two equally near the
    first by strike, then number), if it is at most `reach_s` away, else none. Shots without a strike take none.

    Only shots that follow each other within reach compete for the same old one, so a key's shots are split where
    neither side has a strike for twice the reach; each piece is settled by itself.
    """
    from chalkline.operators.folds import settle_in_turn

    kept = [x for x in DECISIONS if x in new.columns and x in old.columns]
    mark = lambda df, side: df.where("cue_strike is not null").select(*keys, F.lit(side).alias("side"), c("cue_strike").alias("at"), c("shot_id").cast("long").alias("id"))
    pairs = settle_in_turn(mark(new, 0).unionByName(mark(old, 1)), keys, reach_s)
    flags = pairs.join(old.select(*keys, c("shot_id").cast("long").alias("old_id"), *[c(x).alias(f"_old_{x}") for x in kept]), [*keys, "old_id"])
    flags = flags.select(*keys, c("new_id").alias("_id"), F.lit(True).alias("_met"), *[f"_old_{x}" for x in kept])
    joined = new.withColumn("_id", c("shot_id").cast("long")).join(flags, [*keys, "_id"], "left")
    return joined.withColumns({x: F.when(c("_met"), c(f"_old_{x}")).otherwise(c(x)) for x in kept}).select(*new.columns)


def keep_ranges(ranges: DataFrame, keys: list[str], low: str, high: str, tolerance_ms: int = 1) -> DataFrame:
    """Ranges to keep, those that touch (lie at most `tolerance_ms` apart) joined: keys, `start_ms`, `end_ms`.

    The ranges of a key are kept as a whole or not at all: `range_violations` tells what must not come in. Starts
    a little before 0 become 0.
    """
    ms = ranges.select(*keys, F.greatest(F.lit(0), to_ms(low)).alias("lo"), to_ms(high).alias("hi"))
    return merge_intervals(ms, keys, "lo", "hi", tolerance_ms)


def range_violations(ranges: DataFrame, keys: list[str], row: str, low: str, high: str, source: str | None = None, least_s: float = 0.05, most: int = 200) -> DataFrame:
    """Ranges that forbid keeping their key's ranges: outside the source, too short, overlapping an earlier one, too many.

    `source` is a column with the source's seconds; without it the end is not checked. Columns: keys, row, `violation`. Of a key with more
    than `most` ranges those after the first `most` are named; null bounds are `missing`.
    """
    ordered = Window.partitionBy(*keys).orderBy(low, high, row)
    until = F.greatest(F.lit(0.0), c(source)) if source else F.lit(None).cast("double")
    rows = ranges.withColumns({"_reach": F.max(F.when(c(low).isNotNull(), c(high))).over(ordered.rowsBetween(Window.unboundedPreceding, -1)), "_n": F.row_number().over(ordered)})
    start, end = F.greatest(F.lit(0.0), c(low)), F.least(c(high), until)
    what = (
        F.when(c(low).isNull() | c(high).isNull(), "missing").when((c(low) < -1e-3) | (c(high) > until + 1e-3), "outside").when(end - start < least_s, "too short")
        .when(c("_reach").isNotNull() & (start < F.least(c("_reach"), until) - 1e-3), "overlap").when(c("_n") > most, "too many")
    )
    return rows.select(*keys, row, what.alias("violation")).where("violation is not null")
