"""Changelog relations: rows with `op` (+I, -U, +U, -D) and an arrival number `seq`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ADDS, REMOVES = ("+I", "+U"), ("-U", "-D")


def signed(op: str = "op") -> Column:
    return F.when(F.col(op).isin(*ADDS), 1).otherwise(-1)


def from_changelog(df: DataFrame, kinds: dict[str, str], column: str) -> DataFrame:
    """Names an external change column's values as row kinds; rows with other values are left out."""
    pairs = [F.lit(x) for kv in kinds.items() for x in kv]
    return df.withColumn("op", F.try_element_at(F.create_map(*pairs), F.col(column))).where(F.col("op").isNotNull()).drop(column)


def to_changelog(df: DataFrame, op: str = "+I") -> DataFrame:
    """An append relation as a changelog."""
    return df.withColumn("op", F.lit(op))


def drop_update_before(df: DataFrame) -> DataFrame:
    return df.where("op <> '-U'")


def fold(df: DataFrame, columns: list[str]) -> DataFrame:
    """The relation that a changelog amounts to: each row as often as it was added more than removed."""
    from tidemill.operators.sets import replicate

    net = df.groupBy(*columns).agg(F.sum(signed()).alias("_n"))
    return replicate(net, F.col("_n")).select(*columns)


def upsert_fold(df: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """The latest row of each key, unless that was deleted."""
    payload = [c for c in df.columns if c not in keys]
    latest = df.where("op <> '-U'").groupBy(*keys).agg(F.max_by(F.struct(*payload), F.col(seq)).alias("_last"))
    return latest.select(*keys, "_last.*").where("op <> '-D'")


def normalize(df: DataFrame, keys: list[str], seq: str = "seq", update_before: bool = True, keep: Column | None = None) -> DataFrame:
    """An upsert changelog as a full one.

    The state of a key before each change is the row before it by arrival. A first row is +I; another one is -U (with the
    old row) and +U; an equal one gives nothing; a delete gives -D with the old row, or nothing without one. keep, a
    condition on rows, turns an update that fails it into a delete and hides rows that fail it.
    """
    payload = [c for c in df.columns if c not in (*keys, seq, "op")]
    row = F.struct(*keys, *payload)
    rows = df.where("op <> '-U'")
    state = F.when(F.col("op") == "-D", None).otherwise(row)
    if keep is not None:
        state = F.when(keep, state)
    order = Window.partitionBy(*keys).orderBy(seq)
    rows = rows.withColumn("_now", state).withColumn("_old", F.lag("_now").over(order))
    item = lambda op, r: F.struct(F.lit(op).alias("op"), r.alias("row"))
    now, old = F.col("_now"), F.col("_old")
    updates = F.array(*([item("-U", old)] if update_before else []), item("+U", now))
    kind = rows.select(F.array(item("+I", now)).alias("x")).schema["x"].dataType
    changes = (
        F.when(now.isNotNull() & old.isNull(), F.array(item("+I", now)).cast(kind))
        .when(now.isNotNull() & (now != old), updates.cast(kind))
        .when(now.isNull() & old.isNotNull(), F.array(item("-D", old)).cast(kind))
    )
    return rows.select(seq, F.posexplode(changes).alias("_nth", "_change")).select(seq, F.col("_nth").alias("nth"), "_change.op", "_change.row.*")


def aggregate_changelog(df: DataFrame, keys: list[str], value: str, seq: str = "seq") -> DataFrame:
    """The changelog of SELECT keys, COUNT(*), SUM(value) GROUP BY keys, change by change.

    Running signed sums by arrival; a group's first result is +I, later ones -U and +U unless nothing changed, and -D when
    its count returns to zero.
    """
    order = Window.partitionBy(*keys).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    n, total = F.sum(signed()), F.sum(signed() * F.coalesce(F.col(value), F.lit(0)))
    some = F.sum(F.when(F.col(value).isNotNull(), signed()).otherwise(0))
    rows = df.select(*keys, seq, n.over(order).cast("bigint").alias("n"), F.when(some.over(order) > 0, total.over(order)).cast("bigint").alias("total"))
    rows = rows.withColumn("_now", F.when(F.col("n") > 0, F.struct("n", "total"))).withColumn("_old", F.lag("_now").over(Window.partitionBy(*keys).orderBy(seq)))
    item = lambda op, r: F.struct(F.lit(op).alias("op"), F.col(f"{r}.n").alias("n"), F.col(f"{r}.total").alias("total"))
    now, old = F.col("_now"), F.col("_old")
    changes = F.when(now.isNotNull() & old.isNull(), F.array(item("+I", "_now"))).when(now.isNotNull() & (now != old), F.array(item("-U", "_old"), item("+U", "_now"))).when(now.isNull() & old.isNotNull(), F.array(item("-D", "_old")))
    return rows.select(*keys, seq, F.posexplode(changes).alias("nth", "c")).select(*keys, seq, "nth", "c.*")


def retract_aggregate(df: DataFrame, keys: list[str], **calls: Column) -> DataFrame:
    """Aggregates over what a changelog amounts to, extrema included: the fold, then one aggregation."""
    columns = [c for c in df.columns if c not in ("op", "seq")]
    return fold(df, columns).groupBy(*keys).agg(*(v.alias(k) for k, v in calls.items()))
