"""Time and count windows as table functions: every row, with its window's bounds."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Microseconds of the units of an interval literal.
UNITS = {"DAY": 86_400_000_000, "HOUR": 3_600_000_000, "MINUTE": 60_000_000, "SECOND": 1_000_000}


def _length(interval: str) -> int:
    """The length of an interval literal such as "'10' MINUTE", in microseconds."""
    number, unit = re.fullmatch(r"'(-?[0-9.]+)' (DAY|HOUR|MINUTE|SECOND)S?", interval).groups()
    return round(float(number) * UNITS[unit])


def _micros(interval: str) -> Column:
    return F.lit(_length(interval)).cast("bigint")


def _in_utc() -> bool:
    """Whether the session's zone is UTC, where a wall-clock time and an instant are the same number."""
    return SparkSession.active().conf.get("spark.sql.session.timeZone") in ("UTC", "Etc/UTC", "Z")


def as_micros(ts: Column) -> Column:
    """Microseconds of a wall-clock time since 1970, by its own fields, so that no zone or change of clocks has a part."""
    if _in_utc():
        return F.unix_micros(ts.cast("timestamp"))
    t = ts.cast("timestamp_ntz")
    minutes = F.unix_date(t.cast("date")).cast("bigint") * 1440 + F.hour(t) * 60 + F.minute(t)
    return minutes * 60_000_000 + (F.extract(F.lit("SECOND"), t) * 1_000_000).cast("bigint")


def at_micros(micros: Column) -> Column:
    """The wall-clock time of microseconds since 1970."""
    if _in_utc():
        return F.timestamp_micros(micros).cast("timestamp_ntz")
    seconds = (micros.cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)")
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)


def _bounded(df: DataFrame, start: Column, end: Column) -> DataFrame:
    at = at_micros
    return df.withColumns({"window_start": at(start), "window_end": at(end), "window_time": at(end - 1000)})


def tumble(df: DataFrame, ts: str, size: str, offset: str = "'0' SECOND") -> DataFrame:
    """TUMBLE: one window for each row; rows without a time are dropped. window_time is a millisecond before the end."""
    t, n = as_micros(F.col(ts)), _micros(size)
    start = t - F.pmod(t - _micros(offset), n)
    return _bounded(df.where(F.col(ts).isNotNull()), start, start + n)


def hop(df: DataFrame, ts: str, slide: str, size: str, offset: str = "'0' SECOND") -> DataFrame:
    """HOP: a row for each window that holds the row's time, newest first."""
    t, s, n = as_micros(F.col(ts)), _micros(slide), _micros(size)
    last = t - F.pmod(t - _micros(offset), s)
    starts = F.when(last > t - n, F.sequence(last, t - n + F.pmod(last - (t - n) - 1, s) + 1, -s)).otherwise(F.array().cast("array<bigint>"))
    rows = df.where(F.col(ts).isNotNull()).withColumn("_start", F.explode(starts))
    return _bounded(rows, F.col("_start"), F.col("_start") + n).drop("_start")


def cumulate(df: DataFrame, ts: str, step: str, size: str, offset: str = "'0' SECOND") -> DataFrame:
    """CUMULATE: windows of one start with ends growing by a step, from the first that holds the row's time."""
    t, s, n = as_micros(F.col(ts)), _micros(step), _micros(size)
    start = t - F.pmod(t - _micros(offset), n)
    first = t - F.pmod(t - _micros(offset), s) + s
    rows = df.where(F.col(ts).isNotNull()).withColumns({"_start": start, "_ends": F.sequence(first, start + n, s)})
    rows = rows.withColumn("_end", F.explode("_ends"))
    return _bounded(rows, F.col("_start"), F.col("_end")).drop("_start", "_end", "_ends")


#: name -> (aggregate of rows, how the results of slices combine).
Calls = dict[str, tuple[Column, Callable[[str], Column]]]


def _sliced(df: DataFrame, ts: str, width: int, keys: list[str], calls: Calls, offset: str, windowed: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Aggregates rows by slice, then only the slices' results go to all windows that hold them.

    That pays where a key has many rows a slice; where it has about one, windows of the rows themselves save a shuffle.
    """
    slices = tumble(df, ts, f"'{width / UNITS['SECOND']:.6f}' SECOND", offset)
    part = slices.groupBy(*keys, F.col("window_start").alias("_slice")).agg(*(c.alias(n) for n, (c, _) in calls.items()))
    return windowed(part, "_slice").groupBy(*keys, "window_start", "window_end").agg(*(combine(n).alias(n) for n, (_, combine) in calls.items()))


def hop_aggregate(df: DataFrame, ts: str, slide: str, size: str, keys: list[str], calls: Calls, offset: str = "'0' SECOND") -> DataFrame:
    """GROUP BY keys and HOP window, by slices of the greatest width of which slide and size are multiples."""
    width = math.gcd(_length(slide), _length(size))
    return _sliced(df, ts, width, keys, calls, offset, lambda part, at: hop(part, at, slide, size, offset))


def cumulate_aggregate(df: DataFrame, ts: str, step: str, size: str, keys: list[str], calls: Calls, offset: str = "'0' SECOND") -> DataFrame:
    """GROUP BY keys and CUMULATE window, by slices of a step; the size is a multiple of it."""
    return _sliced(df, ts, _length(step), keys, calls, offset, lambda part, at: cumulate(part, at, step, size, offset))


def session(df: DataFrame, ts: str, gap: str, keys: list[str]) -> DataFrame:
    """SESSION: rows of a key at most a gap apart share a window, from the first to the gap after the last."""
    t, n = as_micros(F.col(ts)), _micros(gap)
    order = Window.partitionBy(*keys).orderBy(ts)
    new = F.coalesce((t - as_micros(F.lag(ts).over(order)) > n).cast("int"), F.lit(1))
    rows = df.where(F.col(ts).isNotNull()).withColumn("_new", new).withColumn("_session", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy(*keys, "_session")
    rows = rows.withColumns({"_low": F.min(ts).over(whole), "_high": F.max(ts).over(whole)})
    return _bounded(rows, as_micros(F.col("_low")), as_micros(F.col("_high")) + n).drop("_new", "_session", "_low", "_high")


def count_tumble(df: DataFrame, n: int, keys: list[str], order: list[str]) -> DataFrame:
    """Row-count windows: rows of a key by arrival, n at a time; a last window with fewer rows gives nothing."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = df.withColumn("window_index", F.floor((F.row_number().over(w) - 1) / n).cast("bigint"))
    full = F.count("*").over(Window.partitionBy(*keys, "window_index")) == n
    return rows.withColumn("_full", full).where("_full").drop("_full")


def count_hop(df: DataFrame, slide: int, n: int, keys: list[str], order: list[str]) -> DataFrame:
    """Sliding row-count windows: every `slide` rows of a key, the last n rows (fewer at first)."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    rows = df.withColumn("_nth", nth)
    first = F.ceil(F.col("_nth") / slide)
    last = F.floor((F.col("_nth") + n - 1) / slide)
    rows = rows.withColumn("window_index", F.explode(F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))
    total = F.max("_nth").over(Window.partitionBy(*keys))
    return rows.withColumn("_total", total).where(F.col("window_index") * slide <= F.col("_total")).drop("_nth", "_total")
