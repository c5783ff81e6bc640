"""Hand-written results for semantics that the oracle's tables don't reach."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.testing import assertDataFrameEqual

from tidemill.functions import collections as C
from tidemill.functions import numeric, predicates, strings, temporal
from tidemill.operators import aggregates, changelog, joins, match, ranking, sets, windows
from tidemill.sources import connectors, nexmark

LOW, HIGH = -(2**63), 2**63 - 1


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def lit(x, kind):
    return F.lit(x).cast(kind)


def test_integers_wrap(spark):
    big = lambda x: lit(x, "bigint")
    assert one(spark, numeric.add(big(HIGH), big(1))) == LOW
    assert one(spark, numeric.subtract(big(LOW), big(1))) == HIGH
    for a, b in ((HIGH, HIGH), (LOW, -1), (LOW, LOW), (123456789012, -987654321098), (-7, 3), (HIGH, 2)):
        assert one(spark, numeric.multiply(big(a), big(b))) == (a * b + 2**63) % 2**64 - 2**63
    assert one(spark, numeric.add(lit(2**31 - 1, "int"), lit(1, "int"), "int")) == -(2**31)
    assert one(spark, numeric.negate(big(LOW))) == LOW and one(spark, numeric.absolute(big(LOW))) == LOW
    assert one(spark, numeric.narrow(lit(300, "int"), "tinyint")) == 44
    assert one(spark, numeric.divide(big(-7), big(2))) == -3 and one(spark, numeric.mod(lit(-5, "int"), lit(3, "int"))) == -2
    assert one(spark, numeric.truncate(big(-1789), -2)) == -1700
    with pytest.raises(Exception, match="(?i)zero"):
        one(spark, numeric.divide(big(1), big(0)))


def test_floating_point(spark):
    inf = float("inf")
    assert one(spark, numeric.float_divide(F.lit(1.0), F.lit(0.0))) == inf and one(spark, numeric.float_divide(F.lit(-1.0), F.lit(0.0))) == -inf
    assert one(spark, numeric.float_divide(F.lit(1.0), F.lit(-0.0))) == -inf
    assert str(one(spark, numeric.float_divide(F.lit(0.0), F.lit(0.0)))) == "nan"
    assert one(spark, numeric.ln(F.lit(0.0))) == -inf and str(one(spark, numeric.log10(F.lit(-1.0)))) == "nan" and str(one(spark, numeric.sqrt(F.lit(-1.0)))) == "nan"
    nan = F.lit(float("nan"))
    assert one(spark, predicates.compare(nan, "=", nan, floating=True)) is False and one(spark, predicates.compare(nan, ">", F.lit(1.0), floating=True)) is False
    assert one(spark, numeric.ceiling(F.lit(1.2))) == 2.0 and one(spark, numeric.floor(F.lit(1e300))) == 1e300
    assert one(spark, numeric.extremum(True, F.lit(1), F.lit(None).cast("int"))) is None
    assert one(spark, numeric.decimal_cast(lit("99.995", "decimal(10,3)"), 4, 2)) is None
    assert str(one(spark, numeric.decimal_cast(lit("1.005", "decimal(10,3)"), 4, 2))) == "1.01"


def test_text(spark):
    assert one(spark, strings.initcap(F.lit("a_b cD1e"))) == "A_B Cd1e"
    assert one(spark, strings.ascii_code(F.lit("é"))) == -61 and one(spark, strings.ascii_code(F.lit(""))) == 0
    assert one(spark, strings.hash_code(F.lit("Ab"))) == 2113 and one(spark, strings.hash_code(F.lit("polygenelubricants"))) == -(2**31)
    assert [one(spark, strings.split_index(F.lit("a||b"), "|", i)) for i in (0, 1, 2, 3, -1)] == ["a", "", "b", None, None]
    assert one(spark, strings.split_index(F.lit(""), "|", 0)) is None
    assert bytes(one(spark, strings.unhex(F.lit("A41")))) == b"\x00\x41" and one(spark, strings.unhex(F.lit("G1"))) is None
    assert one(spark, strings.url_decode(F.lit("%zz"))) is None
    assert one(spark, strings.json_quote(F.lit('a"\né'))) == '"a\\"\\n\\u00e9"'
    assert one(spark, strings.regexp_extract(F.lit("abc"), "(x)", 1)) is None and one(spark, strings.regexp_extract(F.lit("ab"), "a(x*)", 1)) == ""
    assert one(spark, strings.elt(F.lit(3), F.lit("a"), F.lit("b"))) is None and one(spark, strings.translate(F.lit("abc"), "ab", None)) == "c"
    assert one(spark, numeric.inet_ntoa(F.lit(3232235777))) == "192.168.1.1" and one(spark, numeric.inet_ntoa(lit(-1, "bigint"))) is None
    assert [one(spark, numeric.inet_aton(F.lit(x))) for x in ("192.168.1.1", "127.1", "5", "1.2.3", "1.256.1.1", "x")] == [3232235777, 2130706433, 5, 16908291, None, None]
    with pytest.raises(Exception, match="digest"):
        one(spark, strings.sha2(F.lit("x"), F.lit(100)))


def test_collections(spark):
    a = F.expr("array(3, null, 1)")
    assert one(spark, C.element_at(a, F.lit(0))) is None and one(spark, C.element_at(a, F.lit(4))) is None and one(spark, C.element_at(a, F.lit(1))) == 3
    assert one(spark, C.contains(a, lit(None, "int"))) is True and one(spark, C.remove(a, lit(None, "int"))) == [3, 1]
    assert one(spark, C.sort(a)) == [None, 1, 3] and one(spark, C.sort(a, False)) == [3, 1, None] and one(spark, C.sort(a, True, False)) == [1, 3, None] and one(spark, C.sort(a, False, True)) == [None, 3, 1]
    five = F.expr("array(1, 2, 3, 4, 5)")
    assert [one(spark, C.slice_of(five, F.lit(s), F.lit(e))) for s, e in ((2, 4), (-2, -1), (3, 9), (1, 0), (4, 2))] == [[2, 3, 4], [4, 5], [3, 4, 5], [], []]
    assert one(spark, C.slice_of(five, F.lit(4))) == [4, 5] and one(spark, C.slice_of(five, lit(None, "int"), F.lit(2))) is None
    assert one(spark, C.element(F.expr("array(7)"))) == 7 and one(spark, C.element(F.expr("cast(array() as array<int>)"))) is None
    with pytest.raises(Exception, match="more than one"):
        one(spark, C.element(five))


def test_clock_truncates_toward_the_epoch(spark):
    t = F.expr("TIMESTAMP_NTZ'1969-12-31 23:59:59.999'")
    assert one(spark, temporal.clock("HOUR", t)) == 0 and one(spark, temporal.clock("MILLISECOND", t)) == -1
    assert one(spark, temporal.clock_of_time("MINUTE", F.lit(3_723_004))) == 2
    assert one(spark, temporal.extract("EPOCH", F.expr("DATE'1969-12-31'"))) == -86_400


def at(ms):
    return datetime(1970, 1, 1) + timedelta(milliseconds=ms)


def bounds(df):
    ms = lambda t: round((t - datetime(1970, 1, 1)).total_seconds() * 1000)
    return [(r.i, ms(r.window_start), ms(r.window_end), ms(r.window_time)) for r in df.orderBy("i", F.desc("window_start"), "window_end").collect()]


def test_windows_before_and_on_boundaries(spark):
    df = spark.createDataFrame([(0, at(-1)), (1, at(0)), (2, at(3000)), (3, at(9000)), (4, None)], "i int, ts timestamp_ntz")
    assert [b[1:3] for b in bounds(windows.tumble(df, "ts", "'10' SECOND"))] == [(-10_000, 0), (0, 10_000), (0, 10_000), (0, 10_000)]
    assert bounds(windows.tumble(df.where("i = 0"), "ts", "'10' SECOND", "'2' SECOND")) == [(0, -8_000, 2_000, 1_999)]
    assert [b[1] for b in bounds(windows.hop(df.where("i in (0, 3)"), "ts", "'4' SECOND", "'10' SECOND"))] == [-4_000, -8_000, 8_000, 4_000, 0]
    assert [b[1:3] for b in bounds(windows.cumulate(df.where("i in (0, 2)"), "ts", "'2' SECOND", "'10' SECOND"))] == [(-10_000, 0), (0, 4_000), (0, 6_000), (0, 8_000), (0, 10_000)]
    s = spark.createDataFrame([(0, at(0)), (1, at(10)), (2, at(21)), (3, None)], "i int, ts timestamp_ntz").withColumn("k", F.lit(1))
    assert [b[1:3] for b in bounds(windows.session(s, "ts", "'0.010' SECOND", ["k"]))] == [(0, 20), (0, 20), (21, 31)]


def test_gapped_hop_has_rows_outside_every_window(spark):
    df = spark.createDataFrame([(0, at(1000)), (1, at(3500))], "i int, ts timestamp_ntz")
    assert [b[0] for b in bounds(windows.hop(df, "ts", "'4' SECOND", "'2' SECOND"))] == [0]


def test_temporal_join_versions(spark):
    probe = spark.createDataFrame([(1, 5), (1, 10), (1, 19), (1, 20), (1, 40), (2, 10), (None, 10)], "k int, t int")
    build = spark.createDataFrame([(1, 10, "a", "+I", 1), (1, 20, "b", "+U", 2), (1, 20, "c", "+U", 3), (1, 30, "c", "-D", 4), (None, 1, "n", "+I", 5)], "id int, at int, v string, op string, seq int")
    got = [(r.k, r.t, r.v) for r in joins.temporal(probe, build, "k", "id", "t", "at", ["v"], seq="seq", op="op").orderBy("k", "t").collect()]
    assert got == [(None, 10, None), (1, 5, None), (1, 10, "a"), (1, 19, "a"), (1, 20, "c"), (1, 40, None), (2, 10, None)]
    assert joins.temporal(probe, build, "k", "id", "t", "at", ["v"], how="inner", seq="seq", op="op", residual=F.col("b_v") == "a").count() == 2
    assert joins.versions(build.where("op <> '-D'"), "id", "at", "seq").where("id = 1").count() == 2


def test_lookup_is_broadcast_only_within_its_limit(spark):
    probe, small = spark.range(100), spark.range(10).withColumnRenamed("id", "k")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(joins.lookup(probe, small, F.col("id") == F.col("k")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert "SortMergeJoin" in plan(joins.lookup(probe, small, F.col("id") == F.col("k"), limit=1))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_top_n_limits_groups_before_the_shuffle(spark, sf_dir):
    df = ranking.top_n(nexmark.bid(spark, sf_dir), ["auction"], [F.desc("price")], 3)
    assert "WindowGroupLimit" in df._jdf.queryExecution().executedPlan().toString()


def test_not_in_with_nulls(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "a int")
    assert joins.not_in(left, "a", spark.createDataFrame([(1,), (None,)], "b int"), "b").count() == 0
    assert [r.a for r in joins.not_in(left, "a", spark.createDataFrame([(1,)], "b int"), "b").collect()] == [2]
    assert joins.not_in(left, "a", spark.createDataFrame([], "b int"), "b").count() == 3


def test_aggregates_wrap_and_truncate(spark):
    df = spark.createDataFrame([(2**31 - 1,), (1,), (None,)], "x int")
    row = df.agg(aggregates.sum_of(F.col("x"), "int").alias("s"), aggregates.avg_of(F.lit(-7) + F.coalesce("x", F.lit(0)) * 0, "bigint").alias("a"), aggregates.sum0(F.col("x"), "int", F.lit(False)).alias("z"), aggregates.avg_of(F.col("x"), "int", where=F.lit(False)).alias("n")).first()
    assert (row.s, row.a, row.z, row.n) == (-(2**31), -7, 0, None)
    mixed = spark.createDataFrame([(-7,), (-8,)], "x bigint").agg(aggregates.avg_of(F.col("x")).alias("a")).first()
    assert mixed.a == -7


def test_dedup_prefers_later_arrivals_of_equal_times(spark):
    df = spark.createDataFrame([("k", 5, 1), ("k", 5, 2), ("k", 4, 3), ("k", None, 4)], "k string, ts int, seq int")
    assert ranking.deduplicate(df, ["k"], "ts", "seq").first().seq == 2 and ranking.deduplicate(df, ["k"], "ts", "seq", "first").first().seq == 3


def test_match_skips_past_the_last_row(spark):
    df = spark.createDataFrame([("k", i, i) for i in range(1, 8)] + [("j", 1, 9)], "k string, seq int, v int")
    any_row = {v: (lambda c: c("v") > 0) for v in "ABC"}
    args = (df, ["k"], ["seq"], list("ABC"), any_row, {"a": ("A", "v"), "c": ("C", "v")})
    assert sorted((r.a, r.c) for r in match.match_recognize(*args).collect()) == [(1, 3), (4, 6)]
    assert sorted((r.a, r.c) for r in match.match_recognize(*args, skip="to next row").collect()) == [(i, i + 2) for i in range(1, 6)]


def test_match_takes_starts_in_order(spark):
    import random

    r = random.Random(8)
    rows = [(k, i, r.choice([0, 1, 1, 1, 1])) for k in range(6) for i in range(r.randint(0, 60))]
    df = spark.createDataFrame(rows, "k int, seq int, v int")
    want = []
    for k in range(6):
        mine, at = [(i, v) for j, i, v in rows if j == k], 0
        while at + 3 <= len(mine):
            if mine[at][1] == 1 and mine[at + 2][1] == 1:
                want.append((k, mine[at][0], mine[at + 2][0]))
                at += 3
            else:
                at += 1
    one = lambda c: c("v") == 1
    got = match.match_recognize(df, ["k"], ["seq"], list("ABC"), {"A": one, "C": one}, {"a": ("A", "seq"), "c": ("C", "seq")})
    assert sorted(map(tuple, got.collect())) == want


def test_expansion(spark):
    df = spark.createDataFrame([(1, [1, None]), (2, []), (3, None)], "k int, a array<int>")
    assert sorted(((r.k, r.v, r.i) for r in sets.unnest(df, F.col("a"), "v", "i").collect()), key=str) == [(1, 1, 1), (1, None, 2)]
    assert len(sets.unnest(df, F.col("a"), "v", outer=True).collect()) == 4
    rows = spark.createDataFrame([(1, [(1, "x"), None])], "k int, a array<struct<n:int,s:string>>")
    assert [(r.n, r.s) for r in sets.unnest_rows(rows, F.col("a")).collect()] == [(1, "x")]
    n = spark.createDataFrame([(2,), (0,), (-1,), (None,)], "n int")
    assert sets.replicate(n, F.col("n")).count() == 2


def test_changelog(spark):
    log = spark.createDataFrame([(1, "+I", "k", 5), (2, "+U", "k", 5), (3, "+U", "k", 7), (4, "-D", "k", 7), (5, "-D", "k", 7), (6, "+I", "j", 1)], "seq int, op string, k string, v int")
    rows = [(r.seq, r.op, r.k, r.v) for r in changelog.normalize(log, ["k"]).orderBy("seq", "nth").collect()]
    assert rows == [(1, "+I", "k", 5), (3, "-U", "k", 5), (3, "+U", "k", 7), (4, "-D", "k", 7), (6, "+I", "j", 1)]
    kept = [(r.seq, r.op, r.v) for r in changelog.normalize(log, ["k"], keep=F.col("v") < 6).orderBy("seq", "nth").collect()]
    assert kept == [(1, "+I", 5), (3, "-D", 5), (6, "+I", 1)]
    full = changelog.normalize(log, ["k"]).drop("nth")
    assert [tuple(r) for r in changelog.fold(full, ["k", "v"]).collect()] == [("j", 1)]
    agg = [(r.seq, r.op, r.n, r.total) for r in changelog.aggregate_changelog(full.withColumn("g", F.lit(0)), ["g"], "v").orderBy("seq", "nth").collect()]
    assert agg[0] == (1, "+I", 1, 5) and agg[-1][1:] == ("+I", 1, 1) and ("-D" in [a[1] for a in agg])


def test_sources(spark, tmp_path):
    (tmp_path / "t.csv").write_text('# note\nk,v\n1,"a,b"\n2,\nx,bad\n')
    read = lambda **o: connectors.csv_lookup(spark, str(tmp_path / "t.csv"), "k int, v string", ["v", "k"], comment="#", header=True, **o)
    assert [(r.k, r.v) for r in read(lenient=True).collect()] == [(1, "a,b"), (2, None)]
    with pytest.raises(Exception, match="(?i)malformed"):
        read().collect()
    assert connectors.values(spark, [], "a int").count() == 0 and connectors.seed_row(spark).count() == 1
    raw = spark.createDataFrame([('{"a": 1}',), ("broken",)], "value string")
    assert [r.a for r in connectors.json_records(raw, "a int").collect()] == [1, None]
    connectors.discard(raw)
    assert connectors.digest(raw) == connectors.digest(raw.repartition(2).orderBy("value"))
    events = nexmark.generated(spark, 5000)
    assert {r.event_type: r["count"] for r in events.groupBy("event_type").count().collect()} == {0: 100, 1: 300, 2: 4600}
    assert connectors.digest(events) == connectors.digest(nexmark.generated(spark, 5000, parts=3))


@pytest.mark.parametrize(("slide", "size"), [("'4' HOUR", "'10' HOUR"), ("'10' MINUTE", "'10' MINUTE"), ("'3' HOUR", "'1' HOUR")])
def test_slices_give_the_windows_of_whole_rows(spark, slide, size):
    rows = spark.range(3000).select((F.col("id") % 7).alias("k"), F.expr("if(id % 50 = 0, null, timestamp_ntz'1969-12-30 01:07:03.5' + make_dt_interval(0, 0, id * 37 % 5000, id))").alias("ts"), F.expr("nullif(id % 13, 5)").alias("v"))
    calls = {"n": (F.count("*"), F.sum), "low": (F.min("v"), F.min), "total": (F.sum("v"), F.sum)}
    plain = [c.alias(name) for name, (c, _) in calls.items()]
    bounds = ["k", "window_start", "window_end"]
    for offset in ("'0' SECOND", "'-90' SECOND"):
        assertDataFrameEqual(windows.hop_aggregate(rows, "ts", slide, size, ["k"], calls, offset), windows.hop(rows, "ts", slide, size, offset).groupBy(*bounds).agg(*plain))
        assertDataFrameEqual(windows.cumulate_aggregate(rows, "ts", "'2' HOUR", "'8' HOUR", ["k"], calls, offset), windows.cumulate(rows, "ts", "'2' HOUR", "'8' HOUR", offset).groupBy(*bounds).agg(*plain))
