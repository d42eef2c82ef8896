"""Irregular readings onto a regular grid of seconds, gaps filled by a low-rank factorisation or marked."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chalkline.operators.sequence import join_by, shard_of, sittings, to_ms
from chalkline.session import cut

RANK = 2
#: Seconds before and after that make up the rows of the factorised matrix, besides the second itself.
REACH = 2


def usable(value: Column) -> Column:
    """The value if it can be used: not null, finite, not negative."""
    x = value.cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x < F.lit(math.inf)), x)


def _cells(df: DataFrame, entity: Sequence[str], t: str, fields: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Mean usable value per entity, second and field (`x0`, `x1`, ...), and the readings' times alone."""
    keys = [f"_k{i}" for i in range(len(entity))]
    rows = df.select(
        *[F.col(f"`{c}`").alias(k) for c, k in zip(entity, keys)],
        to_ms(f"`{t}`").alias("ms"),
        *[usable(F.col(f"`{f}`")).alias(f"x{i}") for i, f in enumerate(fields)],
    ).where("ms is not null")
    slot = shard_of("ms", 1000).alias("slot")
    cells = rows.groupBy(*keys, slot).agg(*[F.avg(f"x{i}").alias(f"x{i}") for i in range(len(fields))])
    return cells, rows.select(*keys, "ms")


def _grid(cells: DataFrame, times: DataFrame, keys: Sequence[str], n: int, pause_ms: int) -> DataFrame:
    """A row for each second of each sitting, and REACH seconds around each shard (`halo`), with the means found."""
    width = pause_ms // 1000
    spans = sittings(times, keys, "ms", pause_ms, pause_ms).select(
        *keys,
        "shard",
        F.greatest(shard_of("sitting_start", 1000), F.col("shard") * width).alias("a"),
        F.least(shard_of("sitting_end", 1000), F.col("shard") * width + width - 1).alias("b"),
        shard_of("sitting_start", 1000).alias("begin"),
    )
    seconds = spans.select(
        *keys, "shard", "a", "b", "begin", F.explode(F.sequence(F.col("a") - REACH, F.col("b") + REACH)).alias("slot"),
        *[F.lit(None).cast("double").alias(f"x{i}") for i in range(n)],
    ).select(*keys, "shard", "slot", (~F.col("slot").between(F.col("a"), F.col("b"))).alias("halo"), (F.col("slot") - F.col("begin")).alias("off"), *[f"x{i}" for i in range(n)])
    # A cell belongs to its shard and, near an edge, also to the neighbour that sees it as halo.
    home = shard_of("slot", width)
    shards = F.array_distinct(F.array(home, shard_of(F.col("slot") - REACH, width), shard_of(F.col("slot") + REACH, width)))
    known = cells.select(*keys, F.explode(shards).alias("shard"), "slot", F.lit(None).cast("boolean").alias("halo"), F.lit(None).cast("bigint").alias("off"), *[f"x{i}" for i in range(n)])
    both = seconds.unionByName(known).repartition(*keys, "shard")
    # One exchange serves this aggregation and the window of the next step; cells outside the grid have no halo mark.
    return (
        both.groupBy(*keys, "shard", "slot")
        .agg(F.max("halo").alias("halo"), F.max("off").alias("off"), *[F.max(f"x{i}").alias(f"x{i}") for i in range(n)])
        .where("halo is not null")
    )


def _neighbours(grid: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """Add the scaled values of the seconds around, `y0`, `y1`, ... (field by field, lag by lag); drop the halo."""
    order = Window.partitionBy(*keys, "shard").orderBy("slot")
    out, lags = {}, range(-REACH, REACH + 1)
    for i in range(n):
        for j, d in enumerate(lags):
            there = F.lead(f"z{i}", d).over(order) if d else F.col(f"z{i}")
            out[f"y{i * len(lags) + j}"] = there.cast("float")
    return grid.withColumns(out).where(~F.col("halo")).drop("halo", "shard", *[f"z{i}" for i in range(n)])


def _total(terms: Sequence[Column]) -> Column:
    out = F.lit(0.0)
    for term in terms:
        out = out + term
    return out


def _solved(a: Column, b: Column, d: Column, e: Column, g: Column, ridge: float) -> tuple[Column, Column]:
    """Least squares of rank 2 in closed form, from the sums of the normal equations."""
    a, d = a + ridge, d + ridge
    det = a * d - b * b
    return (d * e - b * g) / det, (a * g - b * e) / det


def _factor(ys: Sequence[str], loadings: np.ndarray, ridge: float) -> tuple[Column, Column]:
    """A second's factors: least squares of its known values against the loadings."""
    zero = F.lit(0.0)
    known = [F.col(y).isNotNull() for y in ys]
    p, q = loadings[:, 0], loadings[:, 1]
    return _solved(
        _total([F.when(k, F.lit(float(v * v))).otherwise(zero) for k, v in zip(known, p)]),
        _total([F.when(k, F.lit(float(v * w))).otherwise(zero) for k, v, w in zip(known, p, q)]),
        _total([F.when(k, F.lit(float(w * w))).otherwise(zero) for k, w in zip(known, q)]),
        _total([F.coalesce(F.col(y) * float(v), zero) for y, v in zip(ys, p)]),
        _total([F.coalesce(F.col(y) * float(w), zero) for y, w in zip(ys, q)]),
        ridge,
    )


SUMS = ("aa", "ab", "bb", "ay", "by")


def _normal(a: Column, b: Column, y: Column) -> dict[str, Column]:
    """What a known value adds to the normal equations of the other side's factors; null where it is not known."""
    known = y.isNotNull()
    return {"aa": F.when(known, a * a), "ab": F.when(known, a * b), "bb": F.when(known, b * b), "ay": a * y, "by": b * y}


def sources_by_time(cells: DataFrame, keys: Sequence[str], fields: int, ridge: float, most: int = 5, enough: float = 0.02) -> tuple[DataFrame, DataFrame]:
    """Factors of the matrix with a row for each source (entity and field) and a column for each second of a sitting.

    Alternating least squares of rank 2 over the known cells `z0`, `z1`, ... of `cells` (keys, `off`). Returns the rows'
    factors (keys, `p_i`, `q_i`, known cells `c_i`) and the columns' (`off`, `p`, `q`, the sums they come from, known
    cells `c`). Every half pass is an aggregation with map-side combine that leaves one row per source or per second;
    passes end when the rows' factors move by less than `enough` (relative), after `most` at the latest.
    """
    counted = cells.groupBy(*keys).agg(*[F.count(f"z{i}").alias(f"c_{i}") for i in range(fields)])
    # Any start will do that is the same in every run: the second factor differs by source.
    start = {f"p_{i}": F.lit(1.0) for i in range(fields)} | {f"q_{i}": F.pmod(F.xxhash64(*keys, F.lit(i)), F.lit(1000)) / 1000.0 - 0.5 for i in range(fields)}
    rows = cut(counted.withColumns(start), "grid-rows")
    for _ in range(most):
        seen = join_by(cells, rows, keys)
        each = [_normal(F.col(f"p_{i}"), F.col(f"q_{i}"), F.col(f"z{i}")) for i in range(fields)]
        sums = [F.sum(_total([F.coalesce(e[name], F.lit(0.0)) for e in each])).alias(name) for name in SUMS]
        columns = seen.groupBy("off").agg(*sums, F.sum(_total([F.col(f"z{i}").isNotNull().cast("int") for i in range(fields)])).alias("c"))
        p, q = _solved(*[F.col(name) for name in SUMS], ridge)
        columns = cut(columns.withColumns({"p": p, "q": q}), "grid-columns")
        seen = cells.join(columns.select("off", "p", "q"), "off")
        sums = [F.coalesce(F.sum(c), F.lit(0.0)).alias(f"{name}_{i}") for i in range(fields) for name, c in _normal(F.col("p"), F.col("q"), F.col(f"z{i}")).items()]
        solved = seen.groupBy(*keys).agg(*sums, *[F.count(f"z{i}").alias(f"c_{i}") for i in range(fields)])
        new = {}
        for i in range(fields):
            new[f"p_{i}"], new[f"q_{i}"] = _solved(*[F.col(f"{name}_{i}") for name in SUMS], ridge)
        after = cut(solved.withColumns(new).drop(*[f"{name}_{i}" for i in range(fields) for name in SUMS]), "grid-rows")
        factors = [f"{f}_{i}" for i in range(fields) for f in "pq"]
        both = join_by(after, rows.select(*keys, *[F.col(c).alias(f"old_{c}") for c in factors]), keys)
        moved = both.agg(F.sum(_total([(F.col(c) - F.col(f"old_{c}")) ** 2 for c in factors])).alias("moved"), F.sum(_total([F.col(c) ** 2 for c in factors])).alias("size")).first()
        rows = after
        if not moved["size"] or moved["moved"] <= enough**2 * moved["size"]:
            break
    return rows, columns


def _loadings(wide: DataFrame, ys: Sequence[str], iterations: int, ridge: float) -> np.ndarray:
    """Alternating least squares. Each pass sends the driver one row of 5 sums per matrix row, whatever the size."""
    m, half = len(ys), len(ys) // 2
    loadings = np.ones((m, RANK))
    loadings[:half, 1] = 0.5
    loadings[half:, 1] = -0.5
    for _ in range(iterations):
        u, v = _factor(ys, loadings, ridge)
        rows = wide.where(F.coalesce(*[F.col(y) for y in ys]).isNotNull()).select(*ys, u.alias("u"), v.alias("v"))
        sums = []
        for y in ys:
            k = F.col(y).isNotNull()
            for name, term in (("uu", F.col("u") * F.col("u")), ("uv", F.col("u") * F.col("v")), ("vv", F.col("v") * F.col("v"))):
                sums.append(F.sum(F.when(k, term)).alias(f"{y}_{name}"))
            sums += [F.sum(F.col("u") * F.col(y)).alias(f"{y}_u"), F.sum(F.col("v") * F.col(y)).alias(f"{y}_v")]
        s = rows.agg(*sums).first()
        for i, y in enumerate(ys):
            if s[f"{y}_uu"] is None:
                loadings[i] = 0.0
                continue
            normal = np.array([[s[f"{y}_uu"] + ridge, s[f"{y}_uv"]], [s[f"{y}_uv"], s[f"{y}_vv"] + ridge]])
            loadings[i] = np.linalg.solve(normal, np.array([s[f"{y}_u"], s[f"{y}_v"]]))
        # Factors are free up to scale; unit columns keep the ridge meaningful.
        norm = np.sqrt((loadings**2).mean(axis=0))
        loadings = loadings / np.where(norm > 0, norm, 1.0)
    return loadings


def complete_grid(
    df: DataFrame, entity: Sequence[str], t: str, fields: Sequence[str], pause_s: int = 3600, iterations: int = 3, ridge: float = 1.0
) -> DataFrame:
    """One value per entity, field and second of a sitting: entity, `field_name`, `slot`, `value`, `status`.

    status: observed (the mean of the second's usable readings, untouched), filled, or unsupported (value null: neither
    factorisation has RANK known values for it). A second runs from floor(t); a sitting ends where the
    entity's readings, usable or not, pause for `pause_s` or more. Readings with a null or infinite `t` are left out;
    repeated rows weigh in the mean; a null entity is an entity of its own; other columns are ignored.

    Two factorisations of rank 2 by alternating least squares, on the scale log(1 + x / the entity's mean) around the
    field's mean. One has the sources (entity and field) as rows and the seconds of a sitting as columns
    (`sources_by_time`): it fills a second of which other sources have RANK values, however far the source's own readings
    are. The other tells what a second owes to those around it: its rows are each field's value at the second and at the
    REACH seconds before and after, its columns all seconds; it is used where RANK of these are known. What either says
    is scaled, for each field, by how well it foretells the known values when they are left out. Works for two or more
    fields. The driver sees one row of sums a pass.
    """
    keys = [f"_k{i}" for i in range(len(entity))]
    n = len(fields)
    cells, times = _cells(df, entity, t, fields)
    grid = _grid(cells, times, keys, n, pause_s * 1000)
    scales = cells.groupBy(*keys).agg(*[F.avg(f"x{i}").alias(f"m{i}") for i in range(n)])
    scaled = join_by(grid, scales, keys).withColumns(
        {f"z{i}": F.when(F.col(f"m{i}") > 0, F.log1p(F.col(f"x{i}") / F.col(f"m{i}"))).otherwise(F.col(f"x{i}") * 0) for i in range(n)}
    )
    wide = cut(_neighbours(scaled, keys, n), "grid")
    per = 2 * REACH + 1
    ys = [f"y{i}" for i in range(n * per)]
    # Around each field's mean, so that what little is known of a second pulls towards the mean, not to zero.
    means = wide.agg(*[F.avg(f"y{i * per + REACH}").alias(f"c{i}") for i in range(n)]).first()
    centre = [float(means[f"c{i}"] or 0.0) for i in range(n)]
    wide = wide.withColumns({y: F.col(y) - centre[k // per] for k, y in enumerate(ys)})
    loadings = _loadings(wide, ys, iterations, ridge)
    u, v = _factor(ys, loadings, ridge)
    support = _total([F.col(y).isNotNull().cast("int") for y in ys]).cast("int")
    centres = [i * per + REACH for i in range(n)]
    cells = wide.select(*keys, "off", *[F.col(ys[c]).alias(f"z{i}") for i, c in enumerate(centres)]).where(F.coalesce(*[F.col(ys[c]) for c in centres]).isNotNull())
    by_source, by_time = sources_by_time(cells, keys, n, ridge)
    whole = join_by(wide, by_source, keys).join(by_time, "off", "left")
    # Left out: a known value's own part is taken from the sums before they are solved.
    tests = []
    for i, c in enumerate(centres):
        z, p, q = F.col(ys[c]), F.col(f"p_{i}"), F.col(f"q_{i}")
        own = _normal(p, q, z)
        tp, tq = _solved(*[F.col(name) - own[name] for name in SUMS], ridge)
        near = _factor([y for y in ys if y != ys[c]], np.delete(loadings, c, axis=0), ridge)
        for name, guess in ((f"t{i}", p * tp + q * tq), (f"n{i}", near[0] * float(loadings[c, 0]) + near[1] * float(loadings[c, 1]))):
            tests += [F.sum(F.when(z.isNotNull(), guess * z)).alias(f"{name}_y"), F.sum(F.when(z.isNotNull(), guess * guess)).alias(f"{name}_g")]
    told = whole.agg(*tests).first()
    part = lambda name: max(0.0, min(1.0, (told[f"{name}_y"] or 0.0) / told[f"{name}_g"])) if told[f"{name}_g"] else 0.0
    rows = []
    for i, field in enumerate(fields):
        here = centres[i]
        close = (F.col("u") * float(loadings[here, 0]) + F.col("v") * float(loadings[here, 1])) * part(f"n{i}")
        far = (F.col(f"p_{i}") * F.col("p") + F.col(f"q_{i}") * F.col("q")) * part(f"t{i}")
        fit = F.when(F.col("support") >= RANK, close).otherwise(far) + centre[i]
        guess = F.expm1(F.greatest(fit, F.lit(0.0)))
        seen = F.col(f"x{i}").isNotNull()
        backed = (F.col("support") >= RANK) | ((F.col(f"c_{i}") >= RANK) & (F.col("c") >= RANK))
        rows.append(
            F.struct(
                F.lit(field).alias("field_name"),
                F.when(seen, F.col(f"x{i}")).when(backed, guess * F.col(f"m{i}")).alias("value"),
                F.when(seen, "observed").when(backed & F.col(f"m{i}").isNotNull(), "filled").otherwise("unsupported").alias("status"),
            )
        )
    factors = ["p", "q", "c", *[f"{f}_{i}" for i in range(n) for f in "pqc"]]
    solved = whole.select(*keys, "slot", *[f"{c}{i}" for i in range(n) for c in "xm"], *factors, u.alias("u"), v.alias("v"), support.alias("support"))
    return solved.select(*[F.col(k).alias(c) for c, k in zip(entity, keys)], "slot", F.inline(F.array(*rows))).select(
        *entity, "field_name", "slot", "value", "status"
    )
