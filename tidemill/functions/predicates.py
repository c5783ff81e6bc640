"""Comparisons, truth tests and conditionals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OPERATORS = {
    "=": lambda a, b: a == b,
    "<>": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}


def compare(a: Column, operator: str, b: Column, floating: bool = False) -> Column:
    """A comparison; with floating, a NaN on either side makes it false."""
    plain = _OPERATORS[operator](a, b)
    return plain & ~F.isnan(a) & ~F.isnan(b) if floating else plain


def is_distinct(a: Column, b: Column) -> Column:
    """IS DISTINCT FROM, never NULL."""
    return ~a.eqNullSafe(b)


def is_not_distinct(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def is_true(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def is_false(x: Column) -> Column:
    return F.coalesce(~x, F.lit(False))


def is_not_true(x: Column) -> Column:
    return ~is_true(x)


def is_not_false(x: Column) -> Column:
    return ~is_false(x)


def between(x: Column, low: Column, high: Column) -> Column:
    return x.between(low, high)


def is_in(x: Column, *values: object) -> Column:
    return x.isin(*values)


def like(x: Column, pattern: str) -> Column:
    """LIKE without an escape character: a backslash stands for itself."""
    return x.like(pattern.replace("\\", "\\\\"))


def starts_with(x: Column, prefix: Column) -> Column:
    return F.startswith(x, prefix)


def ends_with(x: Column, suffix: Column) -> Column:
    return F.endswith(x, suffix)


def if_then(condition: Column, yes: Column, no: Column) -> Column:
    return F.when(condition, yes).otherwise(no)


def null_if(a: Column, b: Column) -> Column:
    return F.when(~is_true(a == b), a)


def char(x: Column, n: int) -> Column:
    """CHAR(n): padded with spaces, or cut, to n code points."""
    return F.rpad(x, n, " ")


def type_name(name: str) -> Column:
    """TYPEOF, planned as a literal."""
    return F.lit(name)
