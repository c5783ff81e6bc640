"""Parquet tables by name under a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table `name` under `folder`; Catalyst prunes columns and pushes filters into the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
