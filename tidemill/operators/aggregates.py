"""Aggregate calls with planned types, DISTINCT and FILTER, and grouping sets."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.numeric import INT_BITS, wrap


def _of(x: Column, where: Column | None) -> Column:
    """The argument where the filter is true; elsewhere NULL, which calls skip."""
    return x if where is None else F.when(where, x)


def count(where: Column | None = None) -> Column:
    return F.count(_of(F.lit(1), where))


def count_of(x: Column, distinct: bool = False, where: Column | None = None) -> Column:
    return (F.count_distinct if distinct else F.count)(_of(x, where))


def sum_of(x: Column, kind: str = "bigint", distinct: bool = False, where: Column | None = None) -> Column:
    """SUM in the argument's type: integers wrap, decimals become NULL on overflow."""
    value = _of(x, where)
    total = F.sum_distinct if distinct else F.sum
    if kind in INT_BITS:
        return wrap(total(value.cast("decimal(20,0)")), kind)
    return total(value).cast(kind) if not kind.startswith("decimal") else F.call_function("try_sum", value).try_cast(kind) if not distinct else total(value).try_cast(kind)


def sum0(x: Column, kind: str = "bigint", where: Column | None = None) -> Column:
    """SUM with zero for no rows."""
    return F.coalesce(sum_of(x, kind, where=where), F.lit(0).cast(kind))


def avg_of(x: Column, kind: str = "bigint", distinct: bool = False, where: Column | None = None) -> Column:
    """AVG in the argument's type: integers truncate toward zero, decimals round half up."""
    value = _of(x, where)
    total, number = (F.sum_distinct, F.count_distinct) if distinct else (F.sum, F.count)
    if kind in INT_BITS:
        s, n = total(value.cast("decimal(20,0)")), number(value)
        return F.when(n > 0, ((s - s % n) / n).cast(kind))
    if kind.startswith("decimal"):
        return F.when(number(value) > 0, (total(value) / number(value)).cast(kind))
    return (total(value) / F.nullif(number(value), F.lit(0))).cast(kind)


def min_of(x: Column, where: Column | None = None) -> Column:
    return F.min(_of(x, where))


def max_of(x: Column, where: Column | None = None) -> Column:
    return F.max(_of(x, where))


def grouping_sets(df: DataFrame, sets: list[list[str]], columns: list[str], **calls: Column) -> DataFrame:
    """GROUP BY GROUPING SETS: Catalyst's Expand and one aggregation."""
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(*(v.alias(k) for k, v in calls.items()))


def expand(df: DataFrame, projections: list[list[Column]], names: list[str]) -> DataFrame:
    """Row-major expansion: every input row once for each projection."""
    return df.select(F.inline(F.array(*(F.struct(*(c.alias(n) for c, n in zip(p, names, strict=True))) for p in projections))))


def split_distinct(df: DataFrame, keys: list[str], calls: dict[str, tuple[Column, Callable[[str], Column]]], distinct: dict[str, tuple[str, Column | None]]) -> DataFrame:
    """Aggregates with several COUNT(DISTINCT column) FILTER (...), without a copy of each row for every one of them.

    calls: name -> (aggregate, how its partial results combine); distinct: name -> (column, filter or None). Rows are first
    grouped by the keys and one counted column, with a flag for each filter, which splits a hot group by that column's
    values; then the flags are counted. The small results of several columns are joined; NULL keys are a group.
    """
    by_column: dict[str, list[str]] = {}
    for name, (column, _) in distinct.items():
        by_column.setdefault(column, []).append(name)
    out = None
    for column, names in by_column.items():
        plain = calls if out is None else {}
        flag = lambda name: F.max(F.lit(True) if distinct[name][1] is None else distinct[name][1]).alias(name)
        once = df.groupBy(*keys, F.col(column).alias("_value")).agg(*(c.alias(n) for n, (c, _) in plain.items()), *map(flag, names))
        counted = lambda name: F.count(F.when(F.col(name) & F.col("_value").isNotNull(), 1)).alias(name)
        part = once.groupBy(*keys).agg(*(combine(n).alias(n) for n, (_, combine) in plain.items()), *map(counted, names))
        if out is None:
            out = part
        else:
            other = part.select(*(F.col(k).alias(f"_{k}") for k in keys), *names)
            on = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))
            out = out.join(other, on).drop(*(f"_{k}" for k in keys))
    return out
