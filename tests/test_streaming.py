import collections
import decimal
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemill.streaming import pipelines, stateful

DAY = datetime(2024, 1, 1)
SCHEMA = "k bigint, v bigint, seq bigint, ts timestamp_ntz"


def rows(n=60, step=7):
    return [(i * 13 % 5, i * 31 % 17, i, DAY + timedelta(minutes=(i * step) % 240)) for i in range(n)]


@pytest.fixture
def stream(spark, tmp_path):
    """A stream of three files of rows in arrival order, then a file with a row of the far future."""

    def make(data, parts=3, sentinel=True):
        folder = tmp_path / f"in-{len(list(tmp_path.iterdir()))}"
        size = -(-len(data) // parts)
        files = [data[i * size : (i + 1) * size] for i in range(parts)]
        if sentinel:
            files += [[(-1, 0, -1, datetime(2999, 1, 1))], [(-1, 0, -2, datetime(2999, 1, 2))]]
        for i, part in enumerate(files):
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
        return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))

    return make


def run(df, tmp_path, mode="append", name="t"):
    return pipelines.collect(df, str(tmp_path / f"checkpoint-{name}"), mode, name)


def test_windows_flush_and_equal_batch(stream, tmp_path):
    data = rows()
    got = run(pipelines.windowed(pipelines.event_time(stream(data), "ts", "5 hours"), "ts", "1 hour", ["k"], {"n": F.count("*")}), tmp_path)
    want = collections.Counter((k, ts.replace(minute=0)) for k, _, _, ts in data)
    assert {(r.k, r.window_start): r.n for r in got if r.k >= 0} == dict(want)


def test_sessions_share_the_gap_boundary(stream, tmp_path):
    at = lambda m: DAY + timedelta(minutes=m)
    data = [(1, 0, i, at(m)) for i, m in enumerate([0, 10, 21, 50])]
    got = run(pipelines.sessions(pipelines.event_time(stream(data), "ts", "1 day"), "ts", "10 minutes", ["k"], {"n": F.count("*")}), tmp_path)
    assert sorted((r.window_start, r.n) for r in got if r.k == 1) == [(at(0), 2), (at(21), 1), (at(50), 1)]


def test_attached_window_aggregate(stream, tmp_path):
    data = rows()
    got = run(pipelines.attached(pipelines.event_time(stream(data), "ts", "5 hours"), "ts", "1 hour", ["k"]), tmp_path)
    n = collections.Counter((k, ts.replace(minute=0)) for k, _, _, ts in data)
    want = {}
    for (_, w), c in n.items():
        want[w] = max(c, want.get(w, 0))
    assert {r.window_start: r.top for r in got if r.window_start.year == 2024} == want


def test_interval_join(stream, tmp_path):
    data = rows(40)
    left = pipelines.event_time(stream(data), "ts", "5 hours")
    right = pipelines.event_time(stream(data).select(F.col("k").alias("k2"), F.col("seq").alias("seq2"), F.col("ts").alias("ts2")), "ts2", "5 hours")
    got = run(pipelines.interval_join(left, right, F.expr("k = k2"), "ts", "ts2", "'-10' MINUTE", "'10' MINUTE"), tmp_path)
    want = {(a[2], b[2]) for a in data for b in data if a[0] == b[0] and abs(a[3] - b[3]) <= timedelta(minutes=10)}
    assert {(r.seq, r.seq2) for r in got if r.k >= 0} == want


def test_counts_in_update_mode_materialise(spark, stream, tmp_path):
    data = rows()
    pipelines.upsert_parquet(pipelines.counts(stream(data, sentinel=False), ["k"]), ["k"], str(tmp_path / "table"), str(tmp_path / "c")).awaitTermination()
    last = max((tmp_path / "table").iterdir(), key=lambda p: int(p.name))
    assert {r.k: r.n for r in spark.read.parquet(str(last)).collect()} == dict(collections.Counter(r[0] for r in data))


def test_keep_first(stream, tmp_path):
    data = rows()
    got = run(pipelines.keep_first(pipelines.event_time(stream(data), "ts", "5 hours"), ["k"]), tmp_path)
    assert len([r for r in got if r.k >= 0]) == 5


def folded(changes):
    count = collections.Counter()
    for op, *row in changes:
        count[tuple(row)] += 1 if op in ("+I", "+U") else -1
    assert min(count.values()) >= 0
    return {r for r, n in count.items() if n}


def test_keep_last(stream, tmp_path):
    data = rows()
    got = run(stateful.keep_last(stream(data, sentinel=False), ["k"], "ts"), tmp_path, "update")
    want = {}
    for r in data:
        if r[0] not in want or r[3] >= want[r[0]][3]:
            want[r[0]] = r
    assert folded(map(tuple, got)) == set(want.values())


def test_top_n(stream, tmp_path):
    data = rows()
    got = run(stateful.top_n(stream(data, sentinel=False), ["k"], "v", "seq", 3), tmp_path, "update")
    want = set()
    for k in range(5):
        want |= set(sorted((r for r in data if r[0] == k), key=lambda r: (-r[1], r[2]))[:3])
    assert folded(map(tuple, got)) == want


def test_distinct_count_with_removals(stream, tmp_path):
    data = rows()
    signed = stream(data, sentinel=False).withColumn("op", F.when(F.col("seq") % 4 == 3, "-D").otherwise("+I"))
    signed = signed.withColumn("v", F.when(F.col("seq") % 4 == 3, F.expr("(seq - 1) * 31 % 17")).otherwise(F.col("v"))).withColumn("k", F.when(F.col("seq") % 4 == 3, F.expr("(seq - 1) * 13 % 5")).otherwise(F.col("k")))
    got = run(stateful.distinct_count(signed, ["k"], "v"), tmp_path, "update")
    left = collections.Counter()
    for k, v, i, _ in data:
        if i % 4 == 3:
            left[((i - 1) * 13 % 5, (i - 1) * 31 % 17)] -= 1
        else:
            left[(k, v)] += 1
    want = {(k, len({v for (j, v), n in left.items() if j == k and n})) for k in range(5)}
    assert folded(map(tuple, got)) == want


def test_left_outer_join_retracts_padding(stream, tmp_path):
    data = rows(30)
    left = stream(data, sentinel=False).select("k", "seq")
    right = stream([r for r in data if r[0] != 2], sentinel=False).select("k", F.col("v").alias("w")).where("w > 8")
    got = run(stateful.left_outer_join(left, right, "k"), tmp_path, "update")
    count = collections.Counter()
    for r in got:
        count[(r.key, r.l.seq, r.r.w if r.r else None)] += 1 if r.op == "+I" else -1
    want = collections.Counter()
    for a in data:
        hits = [b[1] for b in data if b[0] == a[0] != 2 and b[1] > 8]
        for w in hits or [None]:
            want[(a[0], a[2], w)] += 1
    assert {k: n for k, n in count.items() if n} == dict(want)


def test_temporal_join(stream, tmp_path):
    data = rows(40)
    probe, build = stream(data).select("k", "seq", "ts"), stream([r for r in data if r[2] % 5 == 0]).select("k", F.col("v").alias("w"), "ts")
    got = run(stateful.temporal_join(probe, build, "k", "ts", "5 hours"), tmp_path)
    versions = [r for r in data if r[2] % 5 == 0]
    want = {}
    for k, _, i, ts in data:
        before = [r for r in versions if r[0] == k and r[3] <= ts]
        want[i] = max(before, key=lambda r: (r[3], r[2]))[1] if before else None
    assert {r.l.seq: r.r.w if r.r else None for r in got if r.key >= 0} == want


def test_running_sum_by_event_time(stream, tmp_path):
    data = rows(40)
    got = run(stateful.running_sum(stream(data), "k", "ts", "seq", "v", "5 hours"), tmp_path)
    want, total = {}, collections.Counter()
    for k, v, i, _ in sorted(data, key=lambda r: (r[3], r[2])):
        total[k] += v
        want[i] = total[k]
    assert {r.seq: r.running for r in got if r.key >= 0} == want


def test_top_n_counts_equal_rows_and_nulls(stream, tmp_path):
    row = (1, 9, 5, DAY)
    data = [row, (1, 1, 1, DAY), (1, None, 2, DAY), row, (1, 7, 3, DAY)]
    got = run(stateful.top_n(stream(data, parts=5, sentinel=False), ["k"], "v", "seq", 3), tmp_path, "update")
    count = collections.Counter()
    for op, *r in map(tuple, got):
        count[tuple(r)] += 1 if op == "+I" else -1
    assert {r: n for r, n in count.items() if n} == {row: 2, (1, 7, 3, DAY): 1}


def test_distinct_count_group_lifecycle(stream, tmp_path):
    """A group goes with its last row and starts anew; a removal may come first."""
    data = [(1, 4, 0, DAY), (1, 4, 1, DAY), (1, 6, 2, DAY), (2, 5, 1, DAY), (2, 5, 0, DAY), (2, 8, 0, DAY)]
    signed = stream(data, parts=6, sentinel=False).withColumn("op", F.when(F.col("seq") == 1, "-D").otherwise("+I"))
    got = run(stateful.distinct_count(signed, ["k"], "v"), tmp_path, "update")
    by_key = {k: [(r.op, r.n) for r in got if r.k == k] for k in (1, 2)}
    assert by_key[1] == [("+I", 1), ("-D", 1), ("+I", 1)]
    assert by_key[2][-1] == ("+I", 1) and folded((r.op, r.k, r.n) for r in got) == {(1, 1), (2, 1)}


def test_keep_last_with_null_times(stream, tmp_path):
    data = [(1, 0, 0, None), (1, 1, 1, DAY), (1, 2, 2, None)]
    got = run(stateful.keep_last(stream(data, sentinel=False), ["k"], "ts"), tmp_path, "update")
    assert folded(map(tuple, got)) == {(1, 1, 1, DAY)}


def test_group_aggregate_of_any_calls_with_removals(stream, tmp_path):
    """Every third row is removed later, each of key 3 is; the changes fold to what is left, aggregated."""
    data = [(i * 13 % 5, None if i % 11 == 0 else i * 31 % 17 - 8, i, DAY) for i in range(60)]
    removed = [r for r in data if r[2] % 3 == 0 or r[0] == 3]
    arrivals = [*data[:30], *(r for r in removed if r[2] < 30), *data[30:], *(r for r in removed if r[2] >= 30)]
    seen, signed = set(), []
    for k, v, i, ts in arrivals:
        signed.append((k, v, i + (1000 if i in seen else 0), ts))
        seen.add(i)
    df = stream(signed, 5, False).withColumn("op", F.expr("if(seq >= 1000, '-D', '+I')")).withColumn("d", F.expr("cast(v as decimal(9,2)) / 4").cast("decimal(9,2)"))
    Call = stateful.Call  # noqa: N806
    calls = {
        "n": Call("COUNT"), "total": Call("SUM", "v"), "average": Call("AVG", "v"), "low": Call("MIN", "v"), "high": Call("MAX", "v", where="v < 5"),
        "kinds": Call("COUNT", "v", True), "once": Call("SUM", "v", True, "v > 0"), "cents": Call("SUM", "d"), "mean": Call("AVG", "d"),
    }
    got = run(stateful.group_aggregate(df, ["k"], calls), tmp_path, "update")
    want, left = set(), [r for r in data if r not in removed]
    for k in {r[0] for r in left}:
        vs = [v for j, v, _, _ in left if j == k and v is not None]
        number = len([r for r in left if r[0] == k])
        if not vs:
            want.add((k, number, None, None, None, None, 0, None, None, None))
            continue
        some = lambda xs, f: f(xs) if xs else None
        cents = sum(decimal.Decimal(v * 25) / 100 for v in vs)
        mean = (cents / len(vs)).quantize(decimal.Decimal("0.01"), decimal.ROUND_HALF_UP)
        want.add((k, number, sum(vs), int(sum(vs) / len(vs)), min(vs), some([v for v in vs if v < 5], max), len(set(vs)), some({v for v in vs if v > 0}, sum), cents, mean))
    assert folded(map(tuple, got)) == want and 3 not in {w[0] for w in want}
    assert {r.op for r in got} == {"+I", "-U", "+U", "-D"}


def test_group_aggregate_forgets_keys_after_their_time(spark, tmp_path):
    """With a time to live a stream runs on, so this stops it: a key's state is gone in a later batch, and +I comes again."""
    folder = tmp_path / "later"
    first = spark.createDataFrame([(1, 2, 0, DAY)], SCHEMA).coalesce(1)
    first.write.mode("append").parquet(str(folder))
    df = spark.readStream.schema(SCHEMA).parquet(str(folder)).withColumn("op", F.lit("+I"))
    out = stateful.group_aggregate(df, ["k"], {"n": stateful.Call("COUNT")}, ttl=1000)
    query = out.writeStream.format("memory").queryName("forgets").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        for rows_seen in (1, 2):
            end = time.monotonic() + 40
            while spark.table("forgets").count() < rows_seen and time.monotonic() < end:
                time.sleep(0.5)
            if rows_seen == 1:
                time.sleep(3)
                first.write.mode("append").parquet(str(folder))
        assert [tuple(r) for r in spark.table("forgets").collect()] == [("+I", 1, 1), ("+I", 1, 1)]
    finally:
        query.stop()
