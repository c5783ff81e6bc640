"""Date and time functions. TIME values are integers of milliseconds of the day."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fields of a date and the Spark functions that give them.
_DATE_FIELDS = {
    "YEAR": F.year, "QUARTER": F.quarter, "MONTH": F.month, "WEEK": F.weekofyear, "DAY": F.dayofmonth, "DOY": F.dayofyear, "DOW": F.dayofweek,
    "ISODOW": lambda d: F.extract(F.lit("DAYOFWEEK_ISO"), d), "ISOYEAR": lambda d: F.extract(F.lit("YEAROFWEEK"), d),
}
_TIME_FIELDS = {"HOUR": (3_600_000, None), "MINUTE": (60_000, 60), "SECOND": (1_000, 60), "MILLISECOND": (1, 1_000)}


def extract(field: str, d: Column) -> Column:
    """A calendar field of a DATE, as BIGINT; EPOCH is in seconds."""
    if field == "EPOCH":
        return F.unix_date(d).cast("bigint") * 86_400
    return _DATE_FIELDS[field](d).cast("bigint")


def epoch_millis(ts: Column) -> Column:
    """Milliseconds since the epoch of a TIMESTAMP without zone."""
    return F.unix_millis(ts.cast("timestamp"))


def clock(field: str, ts: Column) -> Column:
    """HOUR, MINUTE, SECOND or MILLISECOND of a TIMESTAMP, truncating toward the epoch."""
    return clock_of_time(field, epoch_millis(ts) % 86_400_000)


def clock_of_time(field: str, millis: Column) -> Column:
    """The same of a TIME."""
    size, base = _TIME_FIELDS[field]
    whole = ((millis - millis % size).cast("decimal(20,0)") / size).cast("bigint")
    return whole if base is None else whole % base


def date_format(ts: Column, pattern: str) -> Column:
    return F.date_format(ts, pattern)


def plus(ts: Column, interval: str) -> Column:
    """TIMESTAMP plus an interval literal; months are clamped to the month's end."""
    return ts + F.expr(f"INTERVAL {interval}")


def minus(ts: Column, interval: str) -> Column:
    return ts - F.expr(f"INTERVAL {interval}")


def timestamp_diff(unit: str, a: Column, b: Column) -> Column:
    return F.timestamp_diff(unit, a, b)


def overlaps(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """OVERLAPS of two periods, whichever end comes first."""
    return (F.least(a0, a1) <= F.greatest(b0, b1)) & (F.least(b0, b1) <= F.greatest(a0, a1))


def convert_tz(text: Column, source: str, target: str) -> Column:
    return F.date_format(F.convert_timezone(F.lit(source), F.lit(target), F.to_timestamp_ntz(text)), "yyyy-MM-dd HH:mm:ss")
