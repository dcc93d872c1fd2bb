"""Join forms that need more than one DataFrame call."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def single_join(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """A scalar per left row: NULL without a match, an error if a left row meets more than one (keys that no left row has may repeat)."""
    n = "__n"
    one = right.groupBy(*keys).agg(F.count("*").alias(n), F.any_value(value).alias(value))
    kind = one.schema[value].dataType
    # the check stands above the join: it looks at keys that were met, and only there
    checked = F.when(F.coalesce(F.col(n), F.lit(0)) <= 1, F.col(value)).otherwise(F.raise_error(F.lit("a scalar subquery gave more than one row")).cast(kind))
    return left.join(one, keys, "left").withColumn(value, checked).drop(n)


def mark_join(left: DataFrame, right: DataFrame, left_value: str, right_value: str, mark: str = "mark") -> DataFrame:
    """left and a boolean `mark` = left_value IN (right), in three-valued logic.

    The right side is reduced to its distinct values and two facts (has NULL, is empty); equi join, so
    it is a hash or merge join with AQE skew handling.
    """
    distinct = right.select(F.col(right_value).alias("__r")).distinct()
    facts = distinct.agg(F.coalesce(F.max(F.col("__r").isNull().cast("int")), F.lit(0)).alias("__nulls"), F.count("*").alias("__rows"))
    hit = distinct.where(F.col("__r").isNotNull()).withColumn("__hit", F.lit(True))
    joined = left.join(hit, left[left_value] == hit["__r"], "left").crossJoin(F.broadcast(facts))  # facts is one row
    value = F.when(F.col("__rows") == 0, False).when(F.col("__hit"), True).when(F.col(left_value).isNull() | (F.col("__nulls") == 1), F.lit(None).cast("boolean")).otherwise(False)
    return joined.withColumn(mark, value).drop("__r", "__hit", "__nulls", "__rows")


COMPARE: dict[str, Callable[[Column, Column], Column]] = {"=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def quantified_value(left: DataFrame, right: DataFrame, row_key: list[str], op: str, left_value: str, right_value: str, quantifier: str, out: str, on: Column | None = None) -> DataFrame:
    """left and `out` = left_value op ANY|ALL (right) in three-valued logic.

    Without `on`, right is reduced to one row of facts (least, greatest, counts), or for = ANY and <> ALL to
    its distinct values in a hash join; no row pairs are compared.  With `on` (give it equalities: the
    correlation) the rows that it joins are compared and aggregated by row_key, left's unique columns.
    """
    any_, compare = quantifier.upper() in ("ANY", "SOME"), COMPARE[op]
    if on is None and op == ("=" if any_ else "<>"):
        found = mark_join(left, right, left_value, right_value, out)
        return found if any_ else found.withColumn(out, ~F.col(out))
    x = F.col(left_value)
    if on is None:
        v = F.col(right_value)
        facts = right.agg(F.min(v).alias("__lo"), F.max(v).alias("__hi"), F.count("*").alias("__rows"), F.count(v).alias("__known"))
        joined = left.crossJoin(F.broadcast(facts))  # facts is one row
        if op in ("=", "<>"):
            decided = (x != F.col("__lo")) | (x != F.col("__hi"))
        else:
            bound = F.col("__hi" if (op[0] == ">") != any_ else "__lo")
            decided = compare(x, bound) if any_ else ~compare(x, bound)
        unknown = x.isNull() | (F.col("__known") < F.col("__rows"))
        value = F.when(decided, any_).when(F.col("__rows") == 0, not any_).when(unknown, F.lit(None).cast("boolean")).otherwise(not any_)
        return joined.withColumn(out, value).drop("__lo", "__hi", "__rows", "__known")
    r = right.select(F.col(right_value).alias("__r"), *[c for c in right.columns if c != right_value], F.lit(True).alias("__m"))
    joined = left.join(r, on, "left")
    c = compare(x, F.col("__r"))
    true_, false_, null_ = (F.coalesce(F.max((F.col("__m") & y).cast("int")), F.lit(0)) == 1 for y in (F.coalesce(c, F.lit(False)), F.coalesce(~c, F.lit(False)), c.isNull()))
    value = F.when(true_ if any_ else false_, any_).when(null_, F.lit(None).cast("boolean")).otherwise(not any_)
    keep = [c for c in left.columns if c not in row_key]
    return joined.groupBy(*row_key).agg(*(F.any_value(c).alias(c) for c in keep), value.alias(out))


def collection_join(left: DataFrame, right: DataFrame, keys: list[str], collect: list[str], out: str) -> DataFrame:
    """left and an array of the matching right rows' `collect` columns (empty without matches)."""
    lists = right.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*collect))).alias(out))
    empty = F.array().cast(lists.schema[out].dataType)
    return left.join(lists, keys, "left").withColumn(out, F.coalesce(F.col(out), empty))


def group_join(left: DataFrame, right: DataFrame, keys: list[str], aggs: list[Column], how: str = "left") -> DataFrame:
    """Aggregate the right side on the join keys first, then join: one row a key crosses the exchange."""
    return left.join(right.groupBy(*keys).agg(*aggs), keys, how)


def null_safe_join(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], how: str = "inner") -> DataFrame:
    """Equi join in which NULL equals NULL."""
    on = [left[a].eqNullSafe(right[b]) for a, b in pairs]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return left.join(right, cond, how)
