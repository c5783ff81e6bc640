"""Top-N, RANK, deduplication, OVER aggregates, sort and limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int | Column, offset: int = 0, rank: str | None = None) -> DataFrame:
    """Rows offset+1 to n of each key by order (no keys: of the table); n may be a column. Catalyst limits groups early."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    out = df.withColumn("_nth", nth).where((F.col("_nth") <= n) & (F.col("_nth") > offset))
    return out.withColumnRenamed("_nth", rank) if rank else out.drop("_nth")


def rank_range(df: DataFrame, keys: list[str], order: list[Column], low: int, high: int, rank: str = "rank_number", dense: bool = False) -> DataFrame:
    """Rows whose RANK (or DENSE_RANK) lies from low to high; ties share a rank."""
    by = (F.dense_rank if dense else F.rank)().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(rank, by).where((F.col(rank) <= high) & (F.col(rank) >= low))


def deduplicate(df: DataFrame, keys: list[str], ts: str, seq: str, keep: str = "last") -> DataFrame:
    """One row for each key: the first, or the last, by time; of equal times the first, or last, arrival."""
    order = [F.col(ts).desc(), F.col(seq).desc()] if keep == "last" else [F.col(ts).asc(), F.col(seq).asc()]
    return top_n(df.where(F.col(ts).isNotNull()), keys, order, 1)


def window_deduplicate(df: DataFrame, keys: list[str], ts: str, seq: str, keep: str = "last") -> DataFrame:
    """The same in each window; df carries window_start and window_end."""
    return deduplicate(df, ["window_start", "window_end", *keys], ts, seq, keep)


def window_top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str | None = None) -> DataFrame:
    return top_n(df, ["window_start", "window_end", *keys], order, n, rank=rank)


def over(df: DataFrame, keys: list[str], order: list[Column], rows: int | None = None, seconds: int | None = None, peers: bool = False, **calls: Column) -> DataFrame:
    """Running aggregates up to the current row.

    rows: so many preceding rows; seconds: a range of time before; peers: rows of equal order share a value; else all
    preceding rows.
    """
    w = Window.partitionBy(*keys)
    if seconds is not None:
        (by,) = order
        frame = w.orderBy(F.unix_micros(by.cast("timestamp"))).rangeBetween(-seconds * 1_000_000, Window.currentRow)
    elif rows is not None:
        frame = w.orderBy(*order).rowsBetween(-rows, Window.currentRow)
    else:
        frame = w.orderBy(*order)
        frame = frame.rangeBetween(Window.unboundedPreceding, Window.currentRow) if peers else frame.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns({k: v.over(frame) for k, v in calls.items()})


def sort(df: DataFrame, order: list[Column]) -> DataFrame:
    return df.orderBy(*order)


def sort_limit(df: DataFrame, order: list[Column], n: int, offset: int = 0) -> DataFrame:
    """ORDER BY with OFFSET and LIMIT: each task keeps its own top rows."""
    return df.orderBy(*order).offset(offset).limit(n)


def limit(df: DataFrame, n: int, offset: int = 0) -> DataFrame:
    """LIMIT without an order: which rows is undefined."""
    return df.offset(offset).limit(n)
