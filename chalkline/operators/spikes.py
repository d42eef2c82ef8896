"""Implausible readings: spikes, drop-outs, stuck values and physically impossible ones, judged per source."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chalkline.operators.sequence import SHARD_MS, shard_of, to_ms
from chalkline.session import cut


@dataclass(frozen=True)
class Reading:
    """A measured column. `zero_is_normal`: a source at rest delivers 0 or next to it, so the field has no drop-outs and 0 is never stuck."""

    name: str
    zero_is_normal: bool = False


@dataclass(frozen=True)
class Fences:
    """What counts as out of line. All distances are between logarithms; quartiles are those of the source and of its hour.

    expand: interquartile ranges from a quartile of the levels to the outer fence.
    expand_steps: interquartile ranges from the upper quartile of the steps between readings to the fence for steps.
    least: no fence for steps is nearer than this factor, and by level alone a reading is out of line `far` beyond a quartile.
    regime: readings beyond an outer fence that make up this share of all (and `regime_rows`) are a regime of their own
    (activity, rest), with fences of its own: errors are rarer.
    burst: readings in a row that a spike may last; reach_ms: readings further apart are no neighbours.
    still: a stretch is stuck if no step in it exceeds this part of the steps' interquartile range;
    min_run: readings at different times it must have.
    context_rows: readings an hour must have for its quartiles to count; it then counts half, the source the other half.
    """

    expand: float = 3.0
    expand_steps: float = 6.0
    least: float = 3.0
    far: float = 10.0
    regime: float = 0.01
    regime_rows: int = 8
    reach_ms: int = 30_000
    still: float = 1 / 32
    min_run: int = 7
    context_rows: int = 200
    accuracy: float = 0.02


#: Buckets of steps below this are those of no step at all.
_NO_STEP = 1e-4
#: Rows without a time are spread over so many groups of each source.
_TIMELESS = 1024


def _width(accuracy: float) -> float:
    return math.log((1 + accuracy) / (1 - accuracy))


def sketch(values: DataFrame, by: Sequence[str], value: str, accuracy: float) -> DataFrame:
    """Mergeable quantile sketch of positive finite values: counts of buckets of equal relative width.

    A bucket's middle is within `accuracy` of every value in it. Sketches of parts (partitions, hours) merge by adding
    counts, exactly and in any order, so a source of any size is reduced before the shuffle. Returns by, `bucket`, `n`.
    """
    x = F.col(value)
    return (
        values.where((x > 0) & (x < F.lit(math.inf)))
        .groupBy(*by, F.floor(F.ln(x) / F.lit(_width(accuracy))).cast("int").alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def quartiles(counts: DataFrame, by: Sequence[str], accuracy: float) -> DataFrame:
    """The sketch's rows with `q1` and `q3`, the logarithms of their group's quartiles. A group holds only its buckets."""
    at = F.percentile("bucket", F.array(F.lit(0.25), F.lit(0.75)), F.col("n")).over(Window.partitionBy(*by))
    return counts.withColumn("_q", at).withColumns({"q1": (F.col("_q")[0] + 0.5) * _width(accuracy), "q3": (F.col("_q")[1] + 0.5) * _width(accuracy)}).drop("_q")


def _level_fences(counts: DataFrame, by: Sequence[str], f: Fences) -> DataFrame:
    """Per group: `n`, `floor` (lower quartile), and the logarithms `upper` and `lower` of the expanded interquartile fences."""
    reach = (F.col("q3") - F.col("q1")) * f.expand
    middle, far = (F.col("bucket") + 0.5) * _width(f.accuracy), F.lit(math.log(f.far))
    above, below = F.when(middle > F.col("q3") + reach, F.col("n")), F.when(middle < F.col("q1") - reach, F.col("n"))
    parts = quartiles(counts, by, f.accuracy).groupBy(*by).agg(
        F.sum("n").alias("n"), F.first("q1").alias("q1"), F.first("q3").alias("q3"),
        F.sum(above).alias("above"), F.sum(below).alias("below"),
        F.percentile(F.when(above.isNotNull(), F.col("bucket")), F.array(F.lit(0.25), F.lit(0.75)), F.col("n")).alias("_b"),
    )
    many = lambda c: F.coalesce(F.col(c), F.lit(0)) >= F.greatest(F.col("n") * f.regime, F.lit(f.regime_rows))
    active = F.col("_b")[1] - F.col("_b")[0]
    return parts.select(
        *by, "n", F.exp("q1").alias("floor"),
        F.when(many("above"), (F.col("_b")[1] + 0.5) * _width(f.accuracy) + F.greatest(active * _width(f.accuracy) * f.expand, far))
        .otherwise(F.col("q3") + F.greatest(reach, far)).alias("upper"),
        F.when(~many("below"), F.col("q1") - F.greatest(reach, far)).alias("lower"),
    )


def _step_fences(counts: DataFrame, by: Sequence[str], f: Fences) -> DataFrame:
    """Per group: `n`, `fence` of the size of a step, and `still`, the greatest step of a stretch stuck at a value."""
    stats = quartiles(counts, by, f.accuracy).groupBy(*by).agg(F.sum("n").alias("n"), F.exp(F.first("q1")).alias("q1"), F.exp(F.first("q3")).alias("q3"))
    spread = F.col("q3") - F.col("q1")
    return stats.select(*by, "n", (F.col("q3") + spread * f.expand_steps).alias("fence"), (spread * f.still).alias("still"))


def _by_hour(counts: DataFrame, n_fields: int, columns: Sequence[str], fences, f: Fences) -> DataFrame:
    """One row per source and hour with each of `columns` for each field (`upper_0`, ...).

    The hours' sketches are merged into the source's by adding counts. An hour with enough readings of its own moves the
    source's fences halfway to its own, outwards or inwards.
    """

    def wide(sketches: DataFrame, by: Sequence[str], prefix: str, least: int) -> DataFrame:
        # Everything after the repartitioning groups within it.
        stats = fences(sketches.repartition(*by), [*by, "field"], f)
        return stats.groupBy(*by).agg(*[F.expr(f"max(if(field = {i} and n >= {least}, {c}, null))").alias(f"{prefix}{c}_{i}") for i in range(n_fields) for c in columns])

    merged = counts.groupBy("src", "field", "bucket").agg(F.sum("n").alias("n"))
    both = wide(counts, ["src", "hour"], "own_", f.context_rows).join(wide(merged, ["src"], "", 0), ["src"], "left")
    names = [f"{c}_{i}" for c in columns for i in range(n_fields)]
    return both.selectExpr("src", "hour", *[c if c.startswith("floor") else f"if(own_{c} is null, {c}, ({c} + own_{c}) / 2) as {c}" for c in names])


def _sound(x: str) -> str:
    """SQL: the reading is possible."""
    return f"(not isnan({x}) and {x} >= 0 and {x} < double('infinity'))"


def _series(rows: DataFrame, keys: Sequence[str], n: int, f: Fences) -> DataFrame:
    """One row per source, hour and time: the greatest and least usable value of each field, and all rows of that time.

    Rows near an hour's edge come once more into the hour next to it, marked as `halo`, for their neighbours there.
    """
    into = f"pmod(ms, {SHARD_MS})"
    places = (
        f"case when {into} < {f.reach_ms} then array(struct(hour, false as halo), struct(hour - 1 as hour, true as halo))"
        f" when {into} >= {SHARD_MS - f.reach_ms} then array(struct(hour, false as halo), struct(hour + 1 as hour, true as halo))"
        " else array(struct(hour, false as halo)) end"
    )
    values = [f"v{i}" for i in range(n)]
    spread = rows.select("src", "ms", "row", *values, F.expr(f"inline({places})"))
    return (
        spread.repartition(*keys)
        .groupBy(*keys, "ms", "halo", F.expr("if(ms is null, row, null)").alias("alone"))
        .agg(
            *[F.expr(f"max(if({_sound(v)}, {v}, null))").alias(f"x{i}") for i, v in enumerate(values)],
            *[F.expr(f"min(if({_sound(v)}, {v}, null))").alias(f"m{i}") for i, v in enumerate(values)],
            *[F.expr(f"coalesce(bool_or(not {_sound(v)}), false)").alias(f"bad{i}") for i, v in enumerate(values)],
            F.expr(f"collect_list(if(halo, null, struct(row, {', '.join(values)})))").alias("rows"),
        )
    )


def _columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr("*", *[f"{expression} as {name}" for name, expression in columns.items()])


def _surroundings(series: DataFrame, keys: Sequence[str], n: int, f: Fences) -> DataFrame:
    """Add for each field, as logarithms: `base` and `top` of what is around a reading, and its `step` from the one before.

    base: the higher one of the sides, a side being the lower one of the two readings next to it; so a spike of one or
    two readings stands above its base. top: the same upside down. With readings on one side only, that side counts.
    Base and step know nothing below the floor.
    """
    over = f"over (partition by {', '.join(keys)} order by ms)"
    at = {f"at{i}": f"case when x{i} is not null and ms is not null then struct(ms, ln(greatest(x{i}, floor_{i})) as y, ln(x{i}) as z) end" for i in range(n)}
    sides = {"p1": "lag(at{i}, 1)", "p2": "lag(at{i}, 2)", "n1": "lead(at{i}, 1)", "n2": "lead(at{i}, 2)"}
    around = {f"{name}_{i}": f"{call.format(i=i)} ignore nulls {over}" for i in range(n) for name, call in sides.items()}
    seen = {}
    for i in range(n):
        near = lambda side, part, i=i: f"if(abs({side}_{i}.ms - at{i}.ms) <= {f.reach_ms}, {side}_{i}.{part}, null)"
        low = [f"least({near(s + '1', 'y')}, {near(s + '2', 'y')})" for s in "pn"]
        high = [f"greatest({near(s + '1', 'z')}, {near(s + '2', 'z')})" for s in "pn"]
        moving = f"at{i}.y > ln(floor_{i}) and {near('p1', 'y')} > ln(floor_{i})"
        seen |= {
            f"base_{i}": f"greatest({', '.join(low)})",
            f"top_{i}": f"least({', '.join(high)})",
            f"step_{i}": f"if({moving}, greatest(abs(at{i}.y - {near('p1', 'y')}), {_NO_STEP}D), null)",
        }
    return _columns(_columns(_columns(series, at), around), seen).drop(*at, *around)


def _spike(i: int, x: str, f: Fences) -> str:
    """SQL: a usable value of field i stands above what is around it, or beyond the upper fence of the levels."""
    fence = f"greatest(coalesce(fence_{i}, 0), {math.log(f.least)!r}D)"
    return f"({x} > 0 and (coalesce(ln(greatest({x}, floor_{i})) - base_{i} > {fence}, false) or coalesce(ln({x}) > upper_{i}, false)))"


def _drop(i: int, x: str, at_rest: bool, f: Fences) -> str:
    """SQL: a usable value falls out. A fall out of activity ends on the usual level; a drop-out goes below it."""
    if at_rest:
        return "false"
    fence = f"greatest(coalesce(fence_{i}, 0), {math.log(f.least)!r}D)"
    return f"({x} > 0 and ((coalesce(top_{i} - ln({x}) > {fence}, false) and {x} < floor_{i}) or coalesce(ln({x}) < lower_{i}, false)))"


def _alike(a: str, b: str, still: str) -> str:
    """SQL: no step of note lies between the values."""
    return f"({a} = {b} or coalesce(abs(ln({a}) - ln({b})) <= coalesce({still}, 0), false))"


def _with_stretches(judged: DataFrame, keys: Sequence[str], fields: Sequence[Reading], f: Fences) -> DataFrame:
    """Add for each field `odd` (spike or drop-out), `c` (the value, if nothing is wrong with it so far) and its stretch
    within the hour: `run` (number), `len`, `opens`, `closes` (it holds the hour's first, last value)."""
    over = f"over (partition by {', '.join(keys)} order by ms)"
    upto = over.replace(")", " rows between unbounded preceding and current row)")
    steps: list[dict[str, str]] = [{}, {}, {}, {}, {}, {}]
    for i, r in enumerate(fields):
        some = f"x{i} > 0" if r.zero_is_normal else f"x{i} is not null"
        steps[0][f"odd{i}"] = f"coalesce({_spike(i, f'x{i}', f)} or {_drop(i, f'm{i}', r.zero_is_normal, f)}, false)"
        steps[1][f"c{i}"] = f"if(ms is not null and not halo and not odd{i} and {some}, x{i}, null)"
        steps[2] |= {f"pc{i}": f"lag(c{i}, 1) ignore nulls {over}", f"nc{i}": f"lead(c{i}, 1) ignore nulls {over}", f"pos{i}": f"count(c{i}) {upto}"}
        begins = f"(c{i} is not null and (pc{i} is null or not {_alike(f'c{i}', f'pc{i}', f'still_{i}')}))"
        finishes = f"(c{i} is not null and (nc{i} is null or not {_alike(f'nc{i}', f'c{i}', f'still_{i}')}))"
        steps[3] |= {f"b{i}": begins, f"e{i}": f"if({finishes}, struct(pos{i} as pos, nc{i} is null as closes), null)"}
        steps[4] |= {
            f"run{i}": f"sum(int(b{i})) {upto}",
            f"start{i}": f"max(if(b{i}, pos{i}, null)) {upto}",
            f"end{i}": f"coalesce(e{i}, lead(e{i}, 1) ignore nulls {over})",
        }
        steps[5] |= {f"len{i}": f"end{i}.pos - start{i} + 1", f"opens{i}": f"start{i} = 1", f"closes{i}": f"end{i}.closes"}
    out = judged
    for columns in steps:
        out = _columns(out, columns)
    return out


def flag_readings(
    df: DataFrame, source: Sequence[str], t: str, row_id: str, fields: Sequence[Reading], fences: Fences = Fences()
) -> DataFrame:
    """Readings that cannot be right: `row_id`, `field_name`, `reason`, `value`.

    reason: impossible (not finite or negative), spike, dropout, stuck (every reading of the stretch).

    * Spikes and drop-outs: readings beyond the expanded interquartile fences of the levels, and those that rise and fall
      (fall and rise) by more than the expanded interquartile fence of the source's steps within two readings.
    * Stuck: a stretch of readings whose steps are all far below the source's usual ones: variance zero but for noise of
      the last digits. What is flagged otherwise does not end a stretch.

    Null is no reading. A source is a value of the `source` columns, null included. Readings are ordered by `t`
    (seconds); of readings of one time the greatest is what others are compared with, each is flagged by its own value.
    Readings with a null `t` are judged by level only. Other columns are ignored, whatever their names. No rows in, none
    out.

    Quantile sketches of levels and steps are built per source and hour with map-side combine and merged by adding counts.
    Rows are shuffled by (source, hour), so no source is one group; hours see their neighbours' edges as a halo. What is
    flagged is written to the shared folder; of it only stretches at an hour's edge are compared across hours.
    """
    f, n = fences, len(fields)
    keys = ["src", "hour"]
    values = [f"v{i}" for i in range(n)]
    timeless = F.lit(-(1 << 41)) - F.pmod(F.xxhash64("row", *values), F.lit(_TIMELESS))
    rows = df.select(
        # A struct is never null, and null parts of it are equal: a source whatever its columns hold.
        F.struct(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(source)]).alias("src"),
        F.col(f"`{row_id}`").alias("row"),
        to_ms(f"`{t}`").alias("ms"),
        *[F.col(f"`{r.name}`").cast("double").alias(v) for r, v in zip(fields, values)],
    ).withColumn("hour", F.coalesce(shard_of("ms", SHARD_MS), timeless))
    pairs = lambda c: F.expr("inline(array(" + ", ".join(f"struct({i} as field, {c}{i} as value)" for i in range(n)) + "))")
    by = [*keys, "field"]
    levels = cut(_by_hour(sketch(rows.select(*keys, pairs("v")), by, "value", f.accuracy), n, ("floor", "upper", "lower"), _level_fences, f), "levels")
    around = _surroundings(_series(rows, keys, n, f).join(levels, keys, "left"), keys, n, f)
    steps = cut(sketch(around.where("not halo").select(*keys, pairs("step_")), by, "value", f.accuracy), "steps")
    usual = _by_hour(steps, n, ("fence", "still"), _step_fences, f)
    marked = _with_stretches(around.join(usual, keys, "left"), keys, fields, f)

    wanted, entries, reasons = [], [], []
    for i, r in enumerate(fields):
        edge = f"(c{i} is not null and (opens{i} or closes{i}))"
        stuck = f"(c{i} is not null and len{i} >= {f.min_run})"
        wanted += [f"odd{i}", f"bad{i}", edge, stuck]
        here = _alike("value", f"c{i}", f"still_{i}")
        reasons.append(
            f"when field = {i} then case when not {_sound('value')} then 'impossible' when {_spike(i, 'value', f)} then 'spike'"
            f" when {_drop(i, 'value', r.zero_is_normal, f)} then 'dropout' when {here} and {stuck} then 'stuck' when {here} and {edge} then '' end"
        )
        entries.append(f"struct({i} as field, r.v{i} as value, c{i} as c, {edge} as edge, still_{i} as still, run{i} as run, len{i} as len, opens{i} as opens, closes{i} as closes)")
    kept = (
        marked.where("not halo and (" + " or ".join(wanted) + ")")
        .selectExpr("*", "explode(rows) as r")
        .selectExpr("*", f"inline(array({', '.join(entries)}))")
        .where("value is not null")
        .selectExpr(*by, "ms", "r.row as row", "value", f"case {' '.join(reasons)} end as reason", "c", "edge", "still", "run", "len", "opens", "closes")
        .where("reason is not null")
    )
    kept = cut(kept, "readings")
    names = F.element_at(F.array(*[F.lit(r.name) for r in fields]), F.col("field") + 1)
    out = lambda d, why: d.select(F.col("row").alias("row_id"), names.alias("field_name"), why.alias("reason"), "value")
    return out(kept.where("reason <> ''"), F.col("reason")).unionByName(out(_stuck_over_hours(kept, f), F.lit("stuck")))


def _stuck_over_hours(kept: DataFrame, f: Fences) -> DataFrame:
    """Readings of stretches that are long enough only with those at the edges of the hours before and after."""
    by = ["src", "hour", "field", "run"]
    ends = (
        kept.where("edge and reason in ('', 'stuck')")
        .groupBy(*by)
        .agg(
            F.min_by("c", "ms").alias("first"), F.max_by("c", "ms").alias("last"), F.max("len").alias("len"), F.max("still").alias("still"),
            F.bool_or("opens").alias("opens"), F.bool_or("closes").alias("closes"),
        )
    )
    over = "over (partition by src, field order by hour, run)"
    goes_on = f"coalesce(opens and lag(closes) {over} and {_alike(f'lag(last) {over}', 'first', 'still')}, false)"
    chained = _columns(_columns(ends, {"joins": goes_on}), {"chain": f"sum(int(not joins)) {over}"})
    long = _columns(chained, {"total": "sum(len) over (partition by src, field, chain)"}).where(f"total >= {f.min_run} and len < {f.min_run}").select(*by)
    return kept.where("edge and reason = ''").join(long, by, "left_semi")
