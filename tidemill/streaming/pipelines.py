"""Streaming forms of the windowed operators: watermarks, append and update output, and a flush of the last windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: A time that no record has: a row with it moves the watermark past every window of a bounded stream.
FAR = "2999-01-01 00:00:00"


def event_time(df: DataFrame, ts: str, delay: str) -> DataFrame:
    """Gives the column a watermark; a TIMESTAMP without zone is read as UTC, as watermarks need an instant."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def without_late(df: DataFrame, ts: str, watermark: Column) -> tuple[DataFrame, DataFrame]:
    """(rows on time, late rows) for a known watermark, where late rows are wanted instead of dropped and counted."""
    on_time = F.col(ts).isNull() | (F.col(ts) > watermark)
    return df.where(on_time), df.where(~on_time)


def windowed(df: DataFrame, ts: str, size: str, keys: list[str], calls: dict[str, Column], slide: str | None = None) -> DataFrame:
    """TUMBLE or HOP aggregates, appended when the watermark passes a window's end."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    out = df.groupBy(w.alias("w"), *keys).agg(*(v.alias(k) for k, v in calls.items()))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *calls)


def sessions(df: DataFrame, ts: str, gap: str, keys: list[str], calls: dict[str, Column]) -> DataFrame:
    """SESSION aggregates; rows at most a gap apart share a session."""
    out = df.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(*(v.alias(k) for k, v in calls.items()))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *calls)


def attached(df: DataFrame, ts: str, size: str, keys: list[str], name: str = "n") -> DataFrame:
    """The largest count of a key in each window: an aggregate over another one's windows."""
    inner = df.groupBy(F.window(ts, size).alias("w"), *keys).agg(F.count("*").alias(name))
    outer = inner.groupBy(F.window(F.window_time("w"), size).alias("w")).agg(F.max(name).alias("top"))
    return outer.select(F.col("w.start").alias("window_start"), "top")


def interval_join(left: DataFrame, right: DataFrame, on: Column, left_ts: str, right_ts: str, lower: str, upper: str, how: str = "inner") -> DataFrame:
    """Both sides watermarked: state is kept only as long as the bounds need it, which also ends outer rows' wait."""
    near = (left[left_ts] >= right[right_ts] + F.expr(f"INTERVAL {lower}")) & (left[left_ts] <= right[right_ts] + F.expr(f"INTERVAL {upper}"))
    return left.join(right, on & near, how)


def keep_first(df: DataFrame, keys: list[str]) -> DataFrame:
    """Row-time deduplication that keeps the first row of a key within the watermark's delay."""
    return df.dropDuplicatesWithinWatermark(keys)


def counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """A group aggregate without windows; written in update mode it is an upsert stream by key."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def lookup(stream: DataFrame, table: DataFrame, on: Column, how: str = "inner") -> DataFrame:
    """A stream joined to a snapshot."""
    return stream.join(table, on, how)


def collect(df: DataFrame, checkpoint: str, mode: str = "append", name: str = "out") -> list:
    """Runs a bounded stream to its end into memory; for tests and small results."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.sql(f"SELECT * FROM {name}").collect()


def upsert_parquet(df: DataFrame, keys: list[str], target: str, checkpoint: str) -> StreamingQuery:
    """Materialises an update stream by key: each batch's rows replace older ones; a batch run again gives the same table."""

    def merge(batch: DataFrame, epoch: int) -> None:
        spark: SparkSession = batch.sparkSession
        old = spark.read.parquet(f"{target}/{epoch - 1}") if epoch else batch.limit(0)
        merged = old.join(batch.select(*keys), keys, "left_anti").unionByName(batch)
        merged.write.mode("overwrite").parquet(f"{target}/{epoch}")

    return df.writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
