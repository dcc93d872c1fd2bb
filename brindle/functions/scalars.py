"""Scalar functions with the engine's semantics, as Column expressions; all stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def int_div(a: Column, b: Column) -> Column:
    """Truncating integer division."""
    return F.call_function("div", a, b)


def date_diff_seconds(a: Column, b: Column) -> Column:
    """Seconds from a to b."""
    return F.timestamp_diff("SECOND", a.cast("timestamp_ntz"), b.cast("timestamp_ntz"))


def date_part(field: str, d: Column) -> Column:
    """year, month, day or hour as bigint."""
    return F.date_part(F.lit(field), d).cast("bigint")


def add_interval(d: Column, months: int = 0, days: int = 0) -> Column:
    """d plus calendar months (clamped to the month's end) and days."""
    out = d + F.make_ym_interval(F.lit(0), F.lit(months)) if months else d
    return out + F.make_dt_interval(F.lit(days)) if days else out


def concat_all(*parts: Column) -> Column:
    """NULL if any part is NULL."""
    return F.concat(*parts)


def hash_of(*parts: Column) -> Column:
    return F.xxhash64(*parts)


def is_a(a: Column, b: Column) -> Column:
    """Null-safe equality."""
    return a.eqNullSafe(b)


def random_in_range(low: int, high: int, seed: int) -> Column:
    """Whole number in [low, high)."""
    return F.floor(F.rand(seed) * (high - low) + low).cast("bigint")


#: Terms that erf's series needs at the largest argument for which it isn't 1 in double precision.
ERF_TERMS, ERF_MOST = 150, 6.0


def erf(x: Column) -> Column:
    """Error function (Spark has none): x exp(-x^2) (1 + 2x^2/3 (1 + 2x^2/5 (...))), whose terms are all positive; within 1e-14."""
    x = x.cast("double")
    steps = F.sequence(F.lit(ERF_TERMS), F.lit(1), F.lit(-1))
    series = F.aggregate(steps, F.lit(1.0), lambda s, k: F.lit(1.0) + s * (F.lit(2.0) * x * x / (F.lit(2) * k + F.lit(1)).cast("double")))
    inside = F.lit(2.0 / math.sqrt(math.pi)) * x * F.exp(-x * x) * series
    return F.when(F.isnan(x), x).when(x > ERF_MOST, 1.0).when(x < -ERF_MOST, -1.0).otherwise(inside)
