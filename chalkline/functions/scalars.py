"""Scalar functions over times, rates, sizes and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: Column | float, high: Column | float) -> Column:
    lift = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.greatest(lift(low), F.least(lift(high), x))


def time_text(seconds: Column) -> Column:
    """MM:SS.mmm, with hours before if there are any; negative times are 0."""
    ms = F.rint(F.greatest(seconds, F.lit(0.0)) * 1000).cast("bigint")
    part = lambda unit, size: F.pmod(F.floor(ms / unit).cast("bigint"), F.lit(size))
    hours = F.floor(ms / 3_600_000).cast("bigint")
    rest = F.format_string("%02d:%02d.%03d", part(60_000, 60), part(1000, 60), F.pmod(ms, F.lit(1000)))
    return F.when(hours > 0, F.concat(F.format_string("%02d:", hours), rest)).otherwise(rest)


def fraction(text: Column) -> Column:
    """A number or a fraction "a/b"; 0 for 0/0, for N/A and whatever else is no number."""
    top, bottom = F.split(text, "/").getItem(0), F.try_element_at(F.split(text, "/"), F.lit(2))
    value = F.try_divide(F.trim(top).try_cast("double"), F.coalesce(F.when(bottom.isNotNull(), F.trim(bottom).try_cast("double")), F.when(bottom.isNull(), F.lit(1.0))))
    return F.coalesce(value, F.lit(0.0))


def variable_rate(average: Column, nominal: Column) -> Column:
    """Whether two frame rates (as fractions) differ by more than 2 percent, or one is not positive."""
    a, r = fraction(average), fraction(nominal)
    return F.when((a <= 0) | (r <= 0), True).otherwise(F.abs(a - r) > 0.02 * F.greatest(a, r))


def fit_even(width: Column, height: Column, most_width: int, most_height: int) -> Column:
    """Size that fits the box without growing, sides even and at least 2, as struct(width, height)."""
    scale = F.least(F.lit(1.0), F.lit(float(most_width)) / width, F.lit(float(most_height)) / height)
    even = lambda x: F.greatest(F.lit(2), (F.rint(x * scale / 2) * 2).cast("int"))
    return F.struct(even(width).alias("width"), even(height).alias("height"))


def to_source(t: Column, proxy_s: Column, source_s: Column) -> Column:
    """A time of the proxy on the source's clock: linear, within the source."""
    return clamp(F.when(proxy_s > 0, t * source_s / proxy_s).otherwise(t), F.lit(0.0), source_s)


def frame_at(t: Column, rate: Column) -> Column:
    return F.rint(t * rate).cast("bigint")


def file_name(stem: Column, most: int = 80) -> Column:
    """A name without characters that are no letters, digits, underscores or hyphens, of at most `most` characters."""
    return F.substring(F.regexp_replace(stem, r"[^\p{L}\p{N}_-]", "_"), 1, most)


def fingerprint(*columns: Column | str) -> Column:
    """SHA-256 of the columns' values as JSON."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)
