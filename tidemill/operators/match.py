"""MATCH_RECOGNIZE for strict sequences of rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def match_recognize(df: DataFrame, keys: list[str], order: list[str], pattern: list[str], define: dict[str, Callable[[Callable[[str], Column]], Column]], measures: dict[str, tuple[str, str]], skip: str = "past last row") -> DataFrame:
    """Rows (keys, measures), one for each match of variables that follow one another directly.

    define maps a variable to its condition, a function of the variable's row (called with a column name); measures maps a
    name to (variable, column). With skip "to next row" every start may match: leads and a filter. With "past last row"
    matches don't share rows: in order, each start at or behind the end of the last match is taken.
    """
    w, n = Window.partitionBy(*keys).orderBy(*order), len(pattern)
    used = sorted({c for _, c in measures.values()} | {c for v in pattern for c in _columns_of(define.get(v), df)})
    rows = df.select(*keys, F.row_number().over(w).alias("_nth"), *(F.lead(F.struct(*used), k).over(w).alias(f"_{v}") if k else F.struct(*used).alias(f"_{v}") for k, v in enumerate(pattern)), F.lead(F.lit(1), n - 1).over(w).alias("_whole"))
    hit = F.col("_whole").isNotNull() if n > 1 else F.lit(True)
    for v in pattern:
        if v in define:
            hit = hit & F.coalesce(define[v](lambda c, v=v: F.col(f"_{v}.{c}")), F.lit(False))
    hits = rows.where(hit)
    out = [F.col(f"_{v}.{c}").alias(name) for name, (v, c) in measures.items()]
    if skip == "to next row":
        return hits.select(*keys, *out)
    by = Window.partitionBy(*keys).orderBy("_nth")
    starts = hits.select(*keys, "_nth", *out).withColumn("_gap", F.col("_nth") - F.lag("_nth").over(by))
    # A start at least n rows behind the one before begins a segment: no match before it can reach it.
    starts = starts.withColumn("_segment", F.sum(F.when(F.col("_gap") < n, 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy(*keys, "_segment")
    inner = F.max(F.when(F.col("_gap") < n, F.col("_gap"))).over(whole)
    starts = starts.withColumns({"_dense": F.coalesce(inner, F.lit(1)) == 1, "_first": F.min("_nth").over(whole)})
    # Where every row of a segment is a start, each n-th one is taken; only other segments are folded one by one.
    dense = starts.where("_dense").where((F.col("_nth") - F.col("_first")) % n == 0).select(*keys, *measures)
    lists = starts.where("not _dense").groupBy(*keys, "_segment").agg(F.array_sort(F.collect_list(F.struct("_nth", *measures))).alias("_hits"))
    kind = lists.schema["_hits"].dataType.simpleString()
    picked = F.aggregate(
        "_hits",
        F.struct(F.lit(0).alias("next"), F.array().cast(kind).alias("out")),
        lambda acc, x: F.when(x["_nth"] >= acc["next"], F.struct((x["_nth"] + n).alias("next"), F.array_append(acc["out"], x).alias("out"))).otherwise(acc),
        lambda acc: acc["out"],
    )
    return dense.unionByName(lists.select(*keys, F.inline(picked)).drop("_nth"))


def _columns_of(condition: Callable | None, df: DataFrame) -> set[str]:
    """The columns that a condition asks for."""
    if condition is None:
        return set()
    asked: set[str] = set()

    def ask(c: str) -> Column:
        asked.add(c)
        return df[c]

    condition(ask)
    return asked
