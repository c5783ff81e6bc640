"""Windows in zones with changing clocks, bucketed interval joins, sizes of theta joins, and digests that SQL lacks."""

import hashlib
import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemill.functions import strings
from tidemill.operators import joins, windows


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_windows_do_not_depend_on_the_zone(spark, zone):
    times = [datetime(2024, 5, 10, 2, 30), datetime(2024, 3, 10, 2, 30), datetime(2024, 11, 3, 1, 30, 0, 123456), datetime(1969, 12, 31, 23, 59, 59, 999999), datetime(1900, 1, 1)]
    size, epoch = timedelta(hours=10), datetime(1970, 1, 1)
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = spark.createDataFrame([(t.isoformat(),) for t in times], "t string").select(F.col("t").cast("timestamp_ntz").alias("ts"))
        got = {r.ts: (r.window_start, r.window_end, r.window_time) for r in windows.tumble(rows, "ts", "'10' HOUR").collect()}
        hops = Counter(r.ts for r in windows.hop(rows, "ts", "'5' HOUR", "'10' HOUR").collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    for t in times:
        start = epoch + (t - epoch) // size * size
        assert got[t] == (start, start + size, start + size - timedelta(milliseconds=1))
    assert hops == dict.fromkeys(times, 2)


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
def test_bucketed_interval_join(spark, how):
    r = random.Random(1)
    at = lambda: datetime(2024, 1, 1) + timedelta(minutes=r.randint(0, 600))
    left = spark.createDataFrame([(r.randint(0, 3), i, at()) for i in range(60)] + [(None, 99, at())], "k int, a int, ts timestamp_ntz")
    right = spark.createDataFrame([(r.randint(1, 4), i, at()) for i in range(60)] + [(None, 98, at())], "j int, b int, us timestamp_ntz")
    plain = joins.interval(left, right, [("k", "j")], "ts", "us", "'-12' MINUTE", "'7' MINUTE", how)
    fast = joins.interval(left, right, [("k", "j")], "ts", "us", "'-12' MINUTE", "'7' MINUTE", how, bucket="'10' MINUTE")
    assert fast.columns == plain.columns
    assert Counter(map(tuple, fast.collect())) == Counter(map(tuple, plain.collect()))


def test_theta_join_checks_sizes(spark):
    small, large = spark.range(3).toDF("a"), spark.range(1000).toDF("b")
    less = F.col("b") < F.col("a")
    assert joins.theta(large, small, less, "left", limit=1000).count() == 1001
    assert joins.theta(small, large, less, limit=1).count() == joins.theta(large, small, less, limit=1).count() == 3
    with pytest.raises(ValueError):
        joins.theta(small, large, less, "left", limit=1000)


@pytest.mark.parametrize("bits", [224, 256, 384, 512])
def test_digests(spark, bits):
    got = spark.range(1).select(strings.sha2(F.lit("aé"), F.lit(bits)).alias("v")).first().v
    assert got == hashlib.new(f"sha{bits}", "aé".encode()).hexdigest()
