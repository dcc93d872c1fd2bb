"""Null order, top-k, set operations with positional types, rollup, frames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LADDER = ["tinyint", "smallint", "int", "bigint", "decimal", "float", "double", "string", "timestamp_ntz", "date"]


def asc(c: str | Column) -> Column:
    """Ascending, NULL last (NULL counts as the greatest value)."""
    return (F.col(c) if isinstance(c, str) else c).asc_nulls_last()


def desc(c: str | Column) -> Column:
    """Descending, NULL first."""
    return (F.col(c) if isinstance(c, str) else c).desc_nulls_first()


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """Limit over sort; Spark fuses them into a bounded heap a partition."""
    return df.orderBy(*order).limit(k)


def _common(a: T.DataType, b: T.DataType) -> str:
    if a == b:
        return a.simpleString()
    if isinstance(a, T.DecimalType) and isinstance(b, T.DecimalType):
        scale = max(a.scale, b.scale)
        return f"decimal({min(38, max(a.precision - a.scale, b.precision - b.scale) + scale)},{scale})"
    if isinstance(a, T.NullType):
        return b.simpleString()
    if isinstance(b, T.NullType):
        return a.simpleString()
    rank = lambda t: _LADDER.index(t.simpleString().split("(")[0])
    top = max(a, b, key=rank)
    if isinstance(top, T.DecimalType):
        return f"decimal({min(38, 19 + top.scale)},{top.scale})"
    return top.simpleString()


def unified(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with common types by position, under the left side's names."""
    if len(left.columns) != len(right.columns):
        raise ValueError("set operations need as many columns on both sides")
    types = [_common(a.dataType, b.dataType) for a, b in zip(left.schema, right.schema, strict=True)]
    names = left.columns
    return tuple(d.toDF(*names).select(*(F.col(f"`{n}`").cast(t).alias(n) for n, t in zip(names, types, strict=True))) for d in (left, right))


def set_operation(kind: str, left: DataFrame, right: DataFrame) -> DataFrame:
    """union, union all, intersect, intersect all, except, except all."""
    a, b = unified(left, right)
    return {"union": lambda: a.union(b).distinct(), "union all": lambda: a.unionAll(b), "intersect": lambda: a.intersect(b), "intersect all": lambda: a.intersectAll(b), "except": lambda: a.subtract(b), "except all": lambda: a.exceptAll(b)}[kind.lower()]()


def rollup(df: DataFrame, keys: list[str], aggs: list[Column], grouping: bool = True) -> DataFrame:
    """ROLLUP; with `grouping`, a bigint g_<key> says whether the key was rolled up."""
    extra = [F.grouping(k).cast("bigint").alias(f"g_{k}") for k in keys] if grouping else []
    return df.rollup(*keys).agg(*aggs, *extra)


def rows_frame(partition: list[str], order: list[Column], start: int | None = None, end: int | None = 0) -> WindowSpec:
    """ROWS frame; None is unbounded."""
    w = Window.partitionBy(*partition).orderBy(*order)
    return w.rowsBetween(Window.unboundedPreceding if start is None else start, Window.unboundedFollowing if end is None else end)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
