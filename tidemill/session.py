"""Session settings that the operators rely on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: What every session needs for the results described in the docstrings; none of it is about size.
SEMANTICS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def local_session(app: str = "tidemill", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller brings their own."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    settings = SEMANTICS | {
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.driver.host": "127.0.0.1",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    } | conf
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def with_semantics(spark: SparkSession) -> SparkSession:
    """Sets the semantic settings on a session that someone else made."""
    for k, v in SEMANTICS.items():
        if not k.startswith("spark.sql.adaptive"):
            spark.conf.set(k, v)
    return spark
