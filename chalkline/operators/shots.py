"""Shots: clips around onsets, their views, importance and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chalkline.config import DEFAULT, Config
from chalkline.functions import predicates as p
from chalkline.operators.joins import within
from chalkline.operators.timeline import KEYS

c = F.col


def preparation_start(shots: DataFrame, tl: DataFrame, most_s: float, strike: str = "strike") -> DataFrame:
    """Adds `prep`: the last row of clear motion in the `most_s` seconds before the onset, else their beginning."""
    spans = shots.select(*KEYS, c(strike).alias("_x"), F.greatest(F.lit(0.0), c(strike) - most_s).alias("_lo"))
    busy = tl.where("motion_score > 0.4").select(*KEYS, c("t").alias("_t"))
    last = within(busy, spans, KEYS, "_t", "_lo", "_x", closed=False).groupBy(*KEYS, "_x").agg(F.max("_t").alias("_prep"))
    joined = shots.join(last.withColumnRenamed("_x", strike), [*KEYS, strike], "left")
    return joined.withColumn("prep", F.coalesce("_prep", F.greatest(F.lit(0.0), c(strike) - most_s))).drop("_prep")


def views_between(shots: DataFrame, tl: DataFrame, low: str, high: str) -> DataFrame:
    """Adds `views`: the different views of the rows from `low` to `high`, sorted; empty without rows."""
    spans = shots.select(*KEYS, c(low).alias("_lo"), c(high).alias("_hi")).distinct()
    rows = tl.select(*KEYS, c("t").alias("_t"), "view_type")
    seen = within(rows, spans, KEYS, "_t", "_lo", "_hi").groupBy(*KEYS, "_lo", "_hi").agg(F.array_sort(F.collect_set("view_type")).alias("views"))
    out = shots.join(seen.withColumnsRenamed({"_lo": low, "_hi": high}), [*KEYS, low, high], "left")
    return out.withColumn("views", F.coalesce("views", F.array().cast("array<string>")))


def clip_bounds(stops: DataFrame, tl: DataFrame, ends: DataFrame, mode: str, conf: Config = DEFAULT) -> DataFrame:
    """Clips of onsets with stops: adds start, end, stop, confirmed, review, minimum of the mode.

    `ends`: KEYS, `duration` of each recording. A column `geometry` of `stops` (how far the cue's line confirms the onset, null
    if unknown) below 0.5 calls for review. Onsets without sustained motion to the end are no shots.
    """
    m = conf.modes[mode]
    level = p.confidence_band(c("confidence"))
    rows = stops.where("stop_reason <> 'no_sustained_ball_motion'").join(ends, list(KEYS)).withColumn("strike", c("t"))
    review = (level != "high") | c("stop_review") | ~c("confirmed")
    if "geometry" in rows.columns:
        review = review | (F.coalesce("geometry", F.lit(1.0)) < 0.5)
    if m.strict:
        start = F.greatest(F.lit(0.0), c("strike") - m.pre_s)
        first = F.least("stop", c("strike") + conf.strict_after_s)
        stop = F.least(first, start + conf.strict_max_clip_s)
        confirmed = c("confirmed") & (stop >= c("stop"))
        minimum = F.greatest(start, F.least("duration", F.greatest(stop, c("strike") + conf.strict_after_s), start + conf.strict_max_clip_s))
        return rows.withColumns({"start": start, "end": minimum, "minimum": minimum, "review": review | ~confirmed, "uncapped": c("stop"), "confirmed": confirmed, "stop": stop})
    if m.prep:
        rows = preparation_start(rows, tl, m.prep_max_s)
        start = c("prep")
    else:
        start = F.greatest(F.lit(0.0), c("strike") - m.pre_s)
    after = max(m.post_s, min(m.reaction_max_s, m.post_s + 1.0)) if m.reaction else m.post_s
    end = c("stop") + after
    wide = F.when(level == "low", conf.fail_safe_s).otherwise(0.0)
    return rows.withColumns(
        {"start": F.greatest(F.lit(0.0), start - wide), "end": F.least("duration", end + wide), "minimum": c("stop"), "review": review, "uncapped": c("stop")}
    )


def importance(shots: DataFrame, tl: DataFrame, low: str = "clip_start", high: str = "clip_end", stop: str = "stop", begin: str = "strike", replay: Column | None = None) -> DataFrame:
    """Adds `importance`: motion, area and sound in the clip, travel time, and sound in the 3 s after the stop; 0.3
    without rows in the clip."""
    spans = shots.select(*KEYS, c(low).alias("_a"), c(high).alias("_b"), c(stop).alias("_c")).distinct()
    spans = spans.withColumns({"_lo": F.least("_a", "_c"), "_hi": F.greatest("_b", c("_c") + 3.0)})
    rows = tl.select(*KEYS, c("t").alias("_t"), "motion_score", "motion_area_ratio", "audio_rms")
    here, later = c("_t").between(c("_a"), c("_b")), c("_t").between(c("_c"), c("_c") + 3.0)
    stats = within(rows, spans, KEYS, "_t", "_lo", "_hi").groupBy(*KEYS, "_a", "_b", "_c").agg(
        *[F.avg(F.when(here, c(x))).alias(f"_{x}") for x in ("motion_score", "motion_area_ratio", "audio_rms")], F.avg(F.when(later, c("audio_rms"))).alias("_loud")
    )
    joined = shots.join(stats.withColumnsRenamed({"_a": low, "_b": high, "_c": stop}), [*KEYS, low, high, stop], "left")
    value = (
        0.2 * c("_motion_score") + 0.15 * F.least(F.lit(1.0), c("_motion_area_ratio") / 0.02) + 0.10 * F.least(F.lit(1.0), (c(stop) - c(begin)) / 15.0)
        + 0.25 * (p.flag(replay) if replay is not None else F.lit(0.0)) + 0.10 * c("_audio_rms") + 0.2 * F.coalesce("_loud", F.lit(0.0))
    )
    return joined.withColumn("importance", F.when(c("_motion_score").isNull(), 0.3).otherwise(p.clip(value))).drop("_motion_score", "_motion_area_ratio", "_audio_rms", "_loud")


def signatures(marks: DataFrame, tl: DataFrame, seconds: float = 3.0, points: int = 16) -> DataFrame:
    """Adds `signature`: the motion score of the next `seconds`, linearly resampled to `points`; zeros without rows."""
    spans = marks.select(*KEYS, c("t").alias("_lo"), (c("t") + seconds).alias("_hi")).distinct()
    rows = tl.select(*KEYS, c("t").alias("_t"), "motion_score")
    series = within(rows, spans, KEYS, "_t", "_lo", "_hi").groupBy(*KEYS, "_lo").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_t", "motion_score"))), lambda x: x["motion_score"]).alias("_s")
    )
    joined = marks.join(series.withColumnRenamed("_lo", "t"), [*KEYS, "t"], "left").withColumn("_s", F.coalesce("_s", F.array(F.lit(0.0))))
    n = F.size("_s") - 1

    def at(k: Column) -> Column:
        x = k * n / float(points - 1)
        low = F.floor(x).cast("int")
        return F.get("_s", low) + (F.get("_s", F.least(low + 1, n)) - F.get("_s", low)) * (x - low)

    return joined.withColumn("signature", F.transform(F.sequence(F.lit(0), F.lit(points - 1)), at)).drop("_s")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, 0 when either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v), F.lit(0.0), lambda acc, z: acc + z)
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    return F.when((na > 1e-6) & (nb > 1e-6), dot(a, b) / (na * nb)).otherwise(0.0)


def running_offsets(shots: DataFrame, keys: list[str], low: str, high: str, order: str) -> DataFrame:
    """Adds `rec_in` and `rec_out`: where each clip lies when a key's clips are joined in order."""
    from pyspark.sql import Window

    length = F.greatest(F.lit(0.0), c(high) - c(low))
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return shots.withColumn("rec_out", F.sum(length).over(before)).withColumn("rec_in", c("rec_out") - length)


def timeline_events(shots: DataFrame, keys: list[str], strike: str, stop: str, high: str) -> DataFrame:
    """Two events a shot: cue_strike and ball_stop, with their `t` and `until`."""
    events = F.array(
        F.struct(F.lit("cue_strike").alias("event_type"), c(strike).alias("t"), c(stop).alias("until")),
        F.struct(F.lit("ball_stop").alias("event_type"), c(stop).alias("t"), c(high).alias("until")),
    )
    return shots.select(*keys, "shot_id", F.inline(events)).where("t is not null")
