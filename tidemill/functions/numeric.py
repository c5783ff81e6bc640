"""Arithmetic with wrapping integers, IEEE floating point and planned decimal types."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of the integer types.
INT_BITS = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}


def wrap(value: Column, kind: str) -> Column:
    """An exact integer (decimal or wider integer) wrapped to two's complement of the type."""
    half, whole = 1 << (INT_BITS[kind] - 1), 1 << INT_BITS[kind]
    exact = value.cast("decimal(38,0)")
    shifted = F.pmod(exact + F.lit(str(half)).cast("decimal(38,0)"), F.lit(str(whole)).cast("decimal(38,0)"))
    return (shifted - F.lit(str(half)).cast("decimal(38,0)")).cast(kind)


def _wide(x: Column, kind: str) -> Column:
    return x.cast("decimal(20,0)") if kind == "bigint" else x.cast("bigint")


def add(a: Column, b: Column, kind: str = "bigint") -> Column:
    return wrap(_wide(a, kind) + _wide(b, kind), kind)


def subtract(a: Column, b: Column, kind: str = "bigint") -> Column:
    return wrap(_wide(a, kind) - _wide(b, kind), kind)


def multiply(a: Column, b: Column, kind: str = "bigint") -> Column:
    """Wrapping product; a BIGINT is cut into two halves, so no exact value exceeds 38 digits."""
    if kind != "bigint":
        return wrap(_wide(a, kind) * _wide(b, kind), kind)
    low = F.pmod(b.cast("decimal(20,0)"), F.lit(1 << 32).cast("decimal(20,0)"))
    high = wrap((b.cast("decimal(20,0)") - low) / F.lit(1 << 32).cast("decimal(20,0)"), "bigint")
    upper = F.pmod((a.cast("decimal(19,0)") * high.cast("decimal(19,0)")).cast("decimal(38,0)"), F.lit(1 << 32).cast("decimal(38,0)"))
    return wrap((upper * F.lit(1 << 32).cast("decimal(12,0)")).cast("decimal(38,0)") + (a.cast("decimal(19,0)") * low.cast("decimal(11,0)")).cast("decimal(38,0)"), "bigint")


def divide(a: Column, b: Column) -> Column:
    """Integer division toward zero; a zero divisor raises."""
    exact = (a - a % b).cast("decimal(20,0)") / b.cast("decimal(20,0)")
    return exact.cast("bigint")


def float_divide(a: Column, b: Column) -> Column:
    """IEEE division: x/0 is an infinity by the signs, 0/0 is NaN."""
    a, b = a.cast("double"), b.cast("double")
    zero_sign = F.when(b.cast("string") == "-0.0", -1.0).otherwise(1.0)
    infinite = F.when(a < 0, -1.0).otherwise(1.0) * zero_sign * F.lit(float("inf"))
    return F.when(b != 0, F.try_divide(a, b)).when(b.isNull() | a.isNull(), None).when((a == 0) | F.isnan(a), F.lit(float("nan"))).otherwise(infinite)


def decimal_divide(a: Column, b: Column, precision: int, scale: int) -> Column:
    """Decimal division, rounded half up to the planned type; a zero divisor raises."""
    return (a / b).cast(f"decimal({precision},{scale})")


def mod(a: Column, b: Column) -> Column:
    """Remainder with the dividend's sign."""
    return a % b


def negate(x: Column, kind: str = "bigint") -> Column:
    return wrap(-x.cast("decimal(20,0)"), kind)


def narrow(x: Column, kind: str) -> Column:
    """CAST to a narrower integer, keeping the low bits."""
    return wrap(x, kind)


def decimal_cast(x: Column, precision: int, scale: int) -> Column:
    """CAST to a decimal: half up, NULL on overflow."""
    return x.try_cast(f"decimal({precision},{scale})")


def try_cast(x: Column, kind: str) -> Column:
    return x.try_cast(kind)


def absolute(x: Column, kind: str = "bigint") -> Column:
    """ABS; the smallest integer stays itself."""
    return F.when(x >= 0, x).otherwise(negate(x, kind)) if kind in INT_BITS else F.abs(x)


def ceiling(x: Column) -> Column:
    """CEIL of a DOUBLE, as a DOUBLE."""
    return F.when(F.abs(x) < 2.0**53, F.ceil(x).cast("double")).otherwise(x)


def floor(x: Column) -> Column:
    return F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)


def sign(x: Column, kind: str) -> Column:
    return F.signum(x).cast(kind)


def truncate(x: Column, scale: int = 0) -> Column:
    """TRUNCATE of an integer toward zero at a power of ten; a scale of zero or more changes nothing."""
    return x if scale >= 0 else x - x % F.lit(10 ** min(-scale, 18))


def extremum(greatest: bool, *values: Column) -> Column:
    """GREATEST or LEAST: NULL if any value is."""
    missing = reduce(lambda a, b: a | b, (v.isNull() for v in values))
    return F.when(~missing, (F.greatest if greatest else F.least)(*values))


def ln(x: Column) -> Column:
    """Natural logarithm: NaN below zero, minus infinity at zero."""
    return F.when(x > 0, F.ln(x)).when(x == 0, F.lit(float("-inf"))).when(x.isNotNull(), F.lit(float("nan")))


def log10(x: Column) -> Column:
    return F.when(x > 0, F.log10(x)).when(x == 0, F.lit(float("-inf"))).when(x.isNotNull(), F.lit(float("nan")))


def log(base: Column, x: Column) -> Column:
    """LOG(base, x) as a quotient of natural logarithms under IEEE rules."""
    return float_divide(ln(x), ln(base))


def log2(x: Column) -> Column:
    return F.when(x > 0, F.log2(x)).when(x == 0, F.lit(float("-inf"))).when(x.isNotNull(), F.lit(float("nan")))


def sqrt(x: Column) -> Column:
    return F.when(x >= 0, F.sqrt(x)).when(x.isNotNull(), F.lit(float("nan")))


def inet_ntoa(x: Column) -> Column:
    """Dotted form of 0 to 2^32 - 1, otherwise NULL."""
    part = lambda shift: F.shiftright(x.cast("bigint"), shift).bitwiseAND(F.lit(255)).cast("string")
    return F.when(x.between(0, (1 << 32) - 1), F.concat_ws(".", part(24), part(16), part(8), part(0)))


def inet_aton(x: Column) -> Column:
    """The number of an address of one to four parts; the last part of a short form fills the rest. Parts above 255: NULL."""
    parts = F.transform(F.split(x, r"\."), lambda p: p.try_cast("bigint"))
    n = F.size(parts)
    good = x.rlike(r"^[0-9]{1,10}(\.[0-9]{1,10}){0,3}$") & F.forall(parts, lambda p: p.between(0, 255))
    last = F.element_at(parts, -1)
    head = F.aggregate(F.slice(parts, 1, n - 1), F.struct(F.lit(0).cast("bigint").alias("v"), F.lit(24).alias("s")), lambda acc, p: F.struct((acc["v"] + p * F.pow(F.lit(2), acc["s"]).cast("bigint")).alias("v"), (acc["s"] - 8).alias("s")), lambda acc: acc["v"])
    return F.when(good, F.when(n == 1, last).otherwise(head + last))
