"""Joins: regular, theta, interval, temporal, lookup, window and multi-way."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.operators.windows import _micros, as_micros

#: A lookup table is broadcast up to this size, checked against the optimizer's estimate; larger ones are shuffled.
LOOKUP_BYTES = 64 << 20


def regular(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], how: str = "inner", null_safe: bool = False, residual: Column | None = None) -> DataFrame:
    """An equi join of any type; null-safe keys match NULLs, a residual that is NULL doesn't match."""
    on = [left[a].eqNullSafe(right[b]) if null_safe else left[a] == right[b] for a, b in keys]
    condition = reduce(lambda x, y: x & y, [*on, *([residual] if residual is not None else [])])
    return left.join(right, condition, how)


def theta(left: DataFrame, right: DataFrame, condition: Column, how: str = "inner", limit: int = LOOKUP_BYTES) -> DataFrame:
    """A join on any predicate.

    An inner join broadcasts a side within the limit, else its parts meet pairwise. Of an outer, semi or anti join the side
    that isn't kept must be within the limit, as each kept row has to see all of it; a larger one raises.
    """
    if how in ("inner", "cross"):
        if size_in_bytes(right) <= limit:
            return left.join(F.broadcast(right), condition, how)
        if size_in_bytes(left) <= limit:
            return F.broadcast(left).join(right, condition, how)
        return left.join(right.hint("SHUFFLE_REPLICATE_NL"), condition, how)
    other = left if how in ("right", "right_outer") else right
    if size_in_bytes(other) > limit:
        raise ValueError(f"a {how} join without equal keys needs its other side within {limit} bytes; give it a key, or a range to bucket by")
    return F.broadcast(left).join(right, condition, how) if other is left else left.join(F.broadcast(right), condition, how)


def multiway(inputs: list[DataFrame], conditions: list[Column], types: list[str]) -> DataFrame:
    """A left-deep chain of joins."""
    out = inputs[0]
    for other, on, how in zip(inputs[1:], conditions, types, strict=True):
        out = out.join(other, on, how)
    return out


def size_in_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a table's size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def lookup(probe: DataFrame, table: DataFrame, on: Column, how: str = "inner", limit: int = LOOKUP_BYTES) -> DataFrame:
    """A join to a snapshot of a lookup table, broadcast if its estimated size is within the limit, else shuffled."""
    return probe.join(F.broadcast(table) if size_in_bytes(table) <= limit else table, on, how)


def interval(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], left_ts: str, right_ts: str, lower: str, upper: str, how: str = "inner", bucket: str | None = None) -> DataFrame:
    """Equal keys and lower <= left_ts - right_ts <= upper, given as interval literals such as "'-5' MINUTE".

    A bucket, an interval literal too, keeps a key with very many rows from meeting itself all over: the rows of one side
    then go to the buckets of time that their range meets, those of the other to their own. Outer joins add the rows that
    have no match in their bucket.
    """
    low, high = F.expr(f"INTERVAL {lower}"), F.expr(f"INTERVAL {upper}")

    def met(a: DataFrame, b: DataFrame) -> Column:
        near = (a[left_ts] >= b[right_ts] + low) & (a[left_ts] <= b[right_ts] + high)
        return reduce(lambda x, y: x & y, [*(a[k] == b[j] for k, j in keys), near])

    if bucket is None:
        return left.join(right, met(left, right), how)
    size = _micros(bucket)
    at = lambda c: F.floor(as_micros(c) / size)
    spread = lambda first, last: F.explode(F.sequence(first, last))
    own, near_right = left.withColumn("_bucket", at(left[left_ts])), right.withColumn("_buckets", spread(at(right[right_ts] + low), at(right[right_ts] + high)))
    out = own.join(near_right, met(own, near_right) & (own["_bucket"] == near_right["_buckets"])).drop("_bucket", "_buckets")
    nulls = lambda df: [F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields]
    if how in ("left", "full"):
        alone = own.join(near_right, met(own, near_right) & (own["_bucket"] == near_right["_buckets"]), "left_anti")
        out = out.union(alone.select(*(alone[c] for c in left.columns), *nulls(right)))
    if how in ("right", "full"):
        own_right, near_left = right.withColumn("_bucket", at(right[right_ts])), left.withColumn("_buckets", spread(at(left[left_ts] - high), at(left[left_ts] - low)))
        alone = own_right.join(near_left, met(near_left, own_right) & (own_right["_bucket"] == near_left["_buckets"]), "left_anti")
        out = out.union(alone.select(*nulls(left), *(alone[c] for c in right.columns)))
    return out


def versions(table: DataFrame, key: str, ts: str, seq: str | None = None) -> DataFrame:
    """A versioned table's rows with valid_from and valid_to; of equal times the later arrival counts."""
    order = [F.col(ts), *([F.col(seq)] if seq else [])]
    nxt = F.lead(ts).over(Window.partitionBy(key).orderBy(*order))
    return table.withColumns({"valid_from": F.col(ts), "valid_to": nxt}).where(F.col("valid_to").isNull() | (F.col("valid_from") < F.col("valid_to")))


def temporal(probe: DataFrame, build: DataFrame, probe_key: str, build_key: str, probe_ts: str, build_ts: str, columns: list[str], how: str = "left", seq: str | None = None, op: str | None = None, residual: Column | None = None) -> DataFrame:
    """Each probe row with the latest version at its time: event-time temporal join.

    Both sides are merged by key and time, and the latest version is carried forward: one shuffle and one sort, whatever
    the number of versions. op names the build's change column: -D ends a version, -U is skipped. With a residual that
    fails (or is NULL) a left join pads with NULLs and an inner join drops the row. columns: the build's, as `b_<name>`
    for the residual and under their own names in the result.
    """
    versioned = build.where(F.col(op) != "-U") if op else build
    payload = F.struct(*(F.col(c) for c in columns))
    live = F.when(F.col(op) != "-D", payload) if op else payload
    rows = versioned.select(F.col(build_key).alias("_k"), F.col(build_ts).alias("_t"), F.lit(0).alias("_side"), (F.col(seq) if seq else F.lit(0)).cast("bigint").alias("_seq"), F.struct(live.alias("v")).alias("_version"), F.lit(None).alias("_probe"))
    probes = probe.select(F.col(probe_key).alias("_k"), F.col(probe_ts).alias("_t"), F.lit(1).alias("_side"), F.lit(0).cast("bigint").alias("_seq"), F.lit(None).alias("_version"), F.struct(*probe.columns).alias("_probe"))
    merged = rows.withColumn("_probe", F.lit(None).cast(probes.schema["_probe"].dataType)).unionByName(probes.withColumn("_version", F.lit(None).cast(rows.schema["_version"].dataType)))
    order = Window.partitionBy("_k").orderBy("_t", "_side", "_seq").rowsBetween(Window.unboundedPreceding, 0)
    found = merged.withColumn("_at", F.last("_version", ignorenulls=True).over(order)).where("_side = 1 ")
    version = F.when(F.col("_k").isNotNull(), F.col("_at.v"))
    out = found.select("_probe.*", version.alias("_v"))
    if residual is not None:
        out = out.withColumns({f"b_{c}": F.col(f"_v.{c}") for c in columns}).withColumn("_v", F.when(F.coalesce(residual, F.lit(False)), F.col("_v"))).drop(*(f"b_{c}" for c in columns))
    if how == "inner":
        out = out.where(F.col("_v").isNotNull())
    return out.select(*probe.columns, *(F.col(f"_v.{c}").alias(c) for c in columns))


def window_join(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], how: str = "inner", residual: Column | None = None) -> DataFrame:
    """Rows of both sides in one window; both carry window_start and window_end, the result once."""
    bounds = {"window_start": "_start", "window_end": "_end"}
    other = right.withColumnsRenamed(bounds)
    on = [left[a] == other[b] for a, b in [*bounds.items(), *keys]] + ([residual] if residual is not None else [])
    out = left.join(other, reduce(lambda x, y: x & y, on), how)
    if "semi" in how or "anti" in how:
        return out
    if how in ("right", "full", "outer"):
        out = out.withColumns({a: F.coalesce(a, b) for a, b in bounds.items()})
    return out.drop(*bounds.values())


def exists(left: DataFrame, right: DataFrame, condition: Column, negated: bool = False) -> DataFrame:
    """EXISTS or NOT EXISTS, and IN for an equality."""
    return left.join(right, condition, "left_anti" if negated else "left_semi")


def not_in(left: DataFrame, value: str, right: DataFrame, column: str) -> DataFrame:
    """NOT IN of SQL: nothing if the right side has a NULL; rows with a NULL value only if the right side is empty."""
    facts = right.agg(F.count("*").alias("_n"), F.count(column).alias("_some"))
    kept = left.crossJoin(F.broadcast(facts)).where((F.col("_n") == 0) | ((F.col("_n") == F.col("_some")) & F.col(value).isNotNull())).drop("_n", "_some")
    return kept.join(right.select(F.col(column).alias("_in")), F.col(value) == F.col("_in"), "left_anti")
