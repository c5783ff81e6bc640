"""Sources and sinks: files, Kafka with JSON, CSV lookups, result digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader, StreamingQuery
from pyspark.sql.types import StructType


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Inline typed rows; no rows are fine."""
    return spark.createDataFrame(rows, schema)


def seed_row(spark: SparkSession) -> DataFrame:
    """One row without columns."""
    return spark.range(1).select()


def files(spark: SparkSession, kind: str, path: str, schema: StructType | str | None = None, **options: str) -> DataFrame:
    """Parquet, ORC, CSV, JSON or text files."""
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def csv_lookup(spark: SparkSession, path: str, schema: str, columns: list[str], delimiter: str = ",", quote: str = '"', comment: str | None = None, header: bool = False, lenient: bool = False, empty_is_null: bool = True) -> DataFrame:
    """A CSV lookup table: projected columns; comments, quotes, header; lenient drops malformed rows, else they raise."""
    reader = spark.read.schema(schema).option("sep", delimiter).option("quote", quote).option("header", header).option("mode", "DROPMALFORMED" if lenient else "FAILFAST").option("enforceSchema", True)
    if comment:
        reader = reader.option("comment", comment)
    reader = reader.option("nullValue", "" if empty_is_null else "\0").option("emptyValue", "" if not empty_is_null else None)
    return reader.csv(path).select(*columns)


def kafka_json(reader: DataStreamReader, servers: str, topic: str, schema: StructType | str) -> DataFrame:
    """A topic of JSON records, read as a stream; needs the Kafka connector on the session."""
    raw = reader.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").load()
    return json_records(raw.select(F.col("value").cast("string").alias("value")), schema)


def json_records(raw: DataFrame, schema: StructType | str, column: str = "value") -> DataFrame:
    return raw.select(F.from_json(column, schema).alias("_r")).select("_r.*")


def to_kafka_json(df: DataFrame, servers: str, topic: str, checkpoint: str) -> StreamingQuery:
    """Writes a stream as JSON records; the checkpoint makes restarts continue where they ended."""
    out = df.select(F.to_json(F.struct(*df.columns)).alias("value"))
    return out.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint).start()


def discard(df: DataFrame) -> None:
    """Runs a query and keeps nothing."""
    df.write.format("noop").mode("overwrite").save()


def digest(df: DataFrame) -> tuple[int, str]:
    """(rows, order-free digest) of a result, for comparing runs."""
    row = df.select(F.xxhash64(*[F.to_json(F.struct(c)) for c in df.columns]).alias("h")).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string").alias("h")).first()
    return row.n, row.h
