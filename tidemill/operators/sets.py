"""Set operations, row replication and the expansion of collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_all(first: DataFrame, *others: DataFrame) -> DataFrame:
    for other in others:
        first = first.union(other)
    return first


def union_distinct(first: DataFrame, *others: DataFrame) -> DataFrame:
    return union_all(first, *others).distinct()


def intersect(a: DataFrame, b: DataFrame, all_rows: bool = False) -> DataFrame:
    return a.intersectAll(b) if all_rows else a.intersect(b)


def difference(a: DataFrame, b: DataFrame, all_rows: bool = False) -> DataFrame:
    return a.exceptAll(b) if all_rows else a.subtract(b)


def replicate(df: DataFrame, times: Column) -> DataFrame:
    """Each row as often as `times` says; zero, negative or NULL: not at all."""
    n = F.when(times > 0, times.cast("int")).otherwise(F.lit(0))
    return df.withColumn("_times", F.explode(F.array_repeat(F.lit(1), n))).drop("_times")


def unnest(df: DataFrame, collection: Column, name: str, ordinality: str | None = None, outer: bool = False) -> DataFrame:
    """UNNEST of an array, with a 1-based ordinality if named; outer keeps rows of empty and NULL arrays."""
    if ordinality is None:
        return df.withColumn(name, (F.explode_outer if outer else F.explode)(collection))
    out = df.select("*", (F.posexplode_outer if outer else F.posexplode)(collection).alias("_pos", name))
    return out.withColumn(ordinality, F.col("_pos") + 1).drop("_pos")


def unnest_rows(df: DataFrame, collection: Column, outer: bool = False) -> DataFrame:
    """UNNEST of an array of rows into columns; NULL rows are left out."""
    some = F.filter(collection, lambda x: x.isNotNull())
    return df.select("*", (F.inline_outer if outer else F.inline)(some))


def unnest_map(df: DataFrame, collection: Column, key: str, value: str, outer: bool = False, ordinality: str | None = None) -> DataFrame:
    """UNNEST of a map, with a 1-based ordinality if named; outer keeps rows of empty and NULL maps."""
    if ordinality is None:
        return df.select("*", (F.explode_outer if outer else F.explode)(collection).alias(key, value))
    out = df.select("*", (F.posexplode_outer if outer else F.posexplode)(collection).alias("_pos", key, value))
    return out.withColumn(ordinality, F.col("_pos") + 1).drop("_pos")


def unnest_multiset(df: DataFrame, collection: Column, name: str, outer: bool = False, ordinality: str | None = None) -> DataFrame:
    """Each element of a map from elements to counts as often as it counts, with a 1-based ordinality if named."""
    times = F.transform(F.map_entries(collection), lambda e: F.array_repeat(e["key"], F.greatest(F.coalesce(e["value"], F.lit(0)), F.lit(0)).cast("int")))
    return unnest(df, F.flatten(times), name, ordinality, outer)
