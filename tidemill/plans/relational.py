"""Queries over the relational tables, with the DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import collections as C
from tidemill.functions import numeric, predicates, strings, temporal
from tidemill.operators import changelog, joins, ranking, sets, windows
from tidemill.plans.registry import register
from tidemill.sources.tables import table


@register(
    "window_max_join",
    """WITH w AS (SELECT time_bucket(INTERVAL '10 minutes', ts) AS ws, max(value) AS top FROM events GROUP BY 1)
    SELECT e.event_id, e.user_id, e.value, w.ws AS window_start, w.ws + INTERVAL '10 minutes' AS window_end
    FROM events e JOIN w ON time_bucket(INTERVAL '10 minutes', e.ts) = w.ws AND e.value = w.top""",
)
def window_max_join(spark: SparkSession, folder: str) -> DataFrame:
    """Each ten-minute window's highest events: window aggregate joined back on window and value."""
    events = table(spark, folder, "events").select("event_id", "user_id", "value", F.window("ts", "10 minutes").alias("w"))
    top = events.groupBy("w").agg(F.max("value").alias("value"))
    return events.join(top, ["w", "value"]).select(
        "event_id", "user_id", "value", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end")
    )


# Filters and projections.


@register("filter_predicates", """SELECT o_orderkey, o_totalprice FROM orders WHERE (o_totalprice BETWEEN 1000 AND 200000 OR o_orderpriority IN ('1-URGENT', '2-HIGH'))
  AND o_orderstatus IS DISTINCT FROM 'P' AND o_orderpriority LIKE '%-%' AND starts_with(o_orderpriority, '1') IS NOT TRUE AND o_orderstatus NOT IN ('X') AND NOT ends_with(o_orderpriority, 'LOW')""")
def filter_predicates(spark: SparkSession, folder: str) -> DataFrame:
    price, kind = F.col("o_totalprice"), F.col("o_orderpriority")
    rows = table(spark, folder, "orders").where(predicates.between(price, F.lit(1000), F.lit(200_000)) | predicates.is_in(kind, "1-URGENT", "2-HIGH"))
    rows = rows.where(predicates.is_distinct(F.col("o_orderstatus"), F.lit("P")) & predicates.like(kind, "%-%") & predicates.is_not_true(predicates.starts_with(kind, F.lit("1"))))
    return rows.where(~predicates.is_in(F.col("o_orderstatus"), "X") & ~predicates.ends_with(kind, F.lit("LOW"))).select("o_orderkey", "o_totalprice")


@register("calc_numeric", """SELECT l_orderkey, l_linenumber, l_orderkey * l_partkey - l_suppkey AS product, l_partkey // l_linenumber AS quotient, l_partkey % 7 AS remainder, -l_suppkey AS negative, abs(l_suppkey - 50) AS distance,
  ceil(l_extendedprice) AS up, floor(l_extendedprice) AS down, CAST(sign(l_suppkey - 50) AS BIGINT) AS side, l_partkey - l_partkey % 100 AS hundreds, greatest(l_partkey, l_suppkey) AS high, least(l_partkey, l_suppkey) AS low,
  bin(l_linenumber) AS bits, hex(l_linenumber) AS hexa FROM lineitem""")
def calc_numeric(spark: SparkSession, folder: str) -> DataFrame:
    o, p, s, n, x = (F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"))
    return table(spark, folder, "lineitem").select(
        o, n, numeric.subtract(numeric.multiply(o, p), s).alias("product"), numeric.divide(p, n).alias("quotient"), numeric.mod(p, F.lit(7)).alias("remainder"), numeric.negate(s).alias("negative"),
        numeric.absolute(s - 50).alias("distance"), numeric.ceiling(x).alias("up"), numeric.floor(x).alias("down"), numeric.sign(s - 50, "bigint").alias("side"), numeric.truncate(p, -2).alias("hundreds"),
        numeric.extremum(True, p, s).alias("high"), numeric.extremum(False, p, s).alias("low"), F.bin(n).alias("bits"), F.hex(n).alias("hexa"),
    )


@register("calc_math", """SELECT p_partkey, round(sqrt(p_retailprice), 6) AS a, round(pow(p_retailprice, 2), 3) AS b, round(ln(p_retailprice), 9) AS c, round(log10(p_retailprice), 9) AS d, round(log2(p_size), 9) AS e, round(exp(p_size / 20.0), 6) AS f,
  round(sin(p_size), 9) AS g, round(cos(p_size), 9) AS h, round(tan(p_size), 6) AS i, round(cot(p_size), 6) AS j, round(sinh(p_size / 10.0), 6) AS k, round(tanh(p_size / 10.0), 9) AS l, round(asin(p_size / 100.0), 9) AS m, round(acos(p_size / 100.0), 9) AS n,
  round(atan(p_size), 9) AS o, round(atan2(p_size, 3), 9) AS p, round(degrees(p_size), 6) AS q, round(radians(p_size), 9) AS r, round(ln(p_retailprice) / ln(3.0), 9) AS s, round(pi(), 9) AS t FROM part""")
def calc_math(spark: SparkSession, folder: str) -> DataFrame:
    x, n = F.col("p_retailprice"), F.col("p_size")
    nine = lambda c, name: F.round(c, 9).alias(name)
    six = lambda c, name: F.round(c, 6).alias(name)
    return table(spark, folder, "part").select(
        "p_partkey", six(numeric.sqrt(x), "a"), F.round(F.pow(x, F.lit(2)), 3).alias("b"), nine(numeric.ln(x), "c"), nine(numeric.log10(x), "d"), nine(numeric.log2(n), "e"), six(F.exp(n / 20.0), "f"), nine(F.sin(n), "g"), nine(F.cos(n), "h"),
        six(F.tan(n), "i"), six(F.cot(n), "j"), six(F.sinh(n / 10.0), "k"), nine(F.tanh(n / 10.0), "l"), nine(F.asin(n / 100.0), "m"), nine(F.acos(n / 100.0), "n"), nine(F.atan(n), "o"), nine(F.atan2(n, F.lit(3.0)), "p"), six(F.degrees(n), "q"),
        nine(F.radians(n), "r"), nine(numeric.log(F.lit(3.0), x), "s"), nine(F.pi(), "t"),
    )


@register("calc_text", """SELECT p_partkey, upper(p_name) AS a, lower(p_type) AS b, length(p_name) AS c, p_name || '/' || p_brand AS d, concat_ws('-', p_brand, NULL, p_type) AS e, substring(p_name, 2, 3) AS f, trim('  ' || p_name || ' ') AS g, replace(p_name, 'e', 'EE') AS h,
  translate(p_name, 'aei', '12') AS i, split_part(p_brand, '#', 2) AS j, strpos(p_name, 'e') AS k, left(p_name, 2) AS l, right(p_name, 2) AS m, repeat(p_brand, 2) AS n, reverse(p_name) AS o, md5(p_name) AS p, sha1(p_name) AS q, sha256(p_name) AS r, to_base64(encode(p_name)) AS s,
  lpad(p_name, 12, '*') AS t, rpad(p_name, 12, '*') AS u, url_encode(p_name || '&?') AS v, hex(p_name) AS w, length(p_name) - length(replace(p_name, 'e', '')) AS x, ['x', 'y', 'z'][p_partkey % 4] AS y, nullif(p_name, 'red widget') AS z FROM part""")
def calc_text(spark: SparkSession, folder: str) -> DataFrame:
    n, b, t = F.col("p_name"), F.col("p_brand"), F.col("p_type")
    return table(spark, folder, "part").select(
        "p_partkey", F.upper(n).alias("a"), F.lower(t).alias("b"), F.char_length(n).cast("bigint").alias("c"), strings.concat(n, F.lit("/"), b).alias("d"), F.concat_ws("-", b, F.lit(None).cast("string"), t).alias("e"), F.substring(n, 2, 3).alias("f"),
        strings.trim(F.concat(F.lit("  "), n, F.lit(" "))).alias("g"), strings.replace(n, F.lit("e"), F.lit("EE")).alias("h"), strings.translate(n, "aei", "12").alias("i"), strings.split_index(b, "#", 1).alias("j"), strings.position(F.lit("e"), n).cast("bigint").alias("k"),
        strings.left(n, F.lit(2)).alias("l"), strings.right(n, F.lit(2)).alias("m"), F.repeat(b, F.lit(2)).alias("n"), F.reverse(n).alias("o"), F.md5(n).alias("p"), F.sha1(n).alias("q"), strings.sha2(n, F.lit(256)).alias("r"), strings.to_base64(n).alias("s"),
        F.lpad(n, 12, "*").alias("t"), F.rpad(n, 12, "*").alias("u"), F.replace(strings.url_encode(F.concat(n, F.lit("&?"))), F.lit("+"), F.lit("%20")).alias("v"), F.hex(n).alias("w"), strings.count_char(n, "e").alias("x"),
        strings.elt(F.col("p_partkey") % 4, F.lit("x"), F.lit("y"), F.lit("z")).alias("y"), predicates.null_if(n, F.lit("red widget")).alias("z"),
    )


@register("calc_temporal", """SELECT o_orderkey, year(d) AS a, quarter(d) AS b, month(d) AS c, week(d) AS d, day(d) AS e, dayofyear(d) AS f, dayofweek(d) + 1 AS g, isodow(d) AS h, isoyear(d) AS i, CAST(epoch(d) AS BIGINT) AS j,
  strftime(t, '%Y/%m/%d %H:%M:%S') AS k, t + INTERVAL '1 month' AS l, t - INTERVAL '36 hours' AS m, hour(t) AS n, date_diff('day', DATE '1995-01-01', d) AS o FROM (SELECT *, CAST(o_orderdate AS DATE) AS d, o_orderdate + to_seconds(o_orderkey % 86400) AS t FROM orders)""")
def calc_temporal(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"), F.expr("o_orderdate + make_dt_interval(0, 0, 0, o_orderkey % 86400)").alias("t"))
    fields = ["YEAR", "QUARTER", "MONTH", "WEEK", "DAY", "DOY", "DOW", "ISODOW", "ISOYEAR", "EPOCH"]
    return rows.select(
        "o_orderkey", *(temporal.extract(f, F.col("d")).alias(c) for f, c in zip(fields, "abcdefghij", strict=True)), temporal.date_format(F.col("t"), "yyyy/MM/dd HH:mm:ss").alias("k"), temporal.plus(F.col("t"), "'1' MONTH").alias("l"),
        temporal.minus(F.col("t"), "'36' HOUR").alias("m"), temporal.clock("HOUR", F.col("t")).alias("n"), F.date_diff("d", F.lit("1995-01-01").cast("date")).cast("bigint").alias("o"),
    )


@register("calc_collections", """SELECT l_orderkey, l_linenumber, a[2] AS a, len(a) AS b, list_contains(a, 3) AS c, list_reverse(a) AS d, list_append(a, 9) AS e, list_prepend(9, a) AS f, list_concat(a, [1]) AS g, CAST(coalesce(list_position(a, 5), 0) AS BIGINT) AS h,
  list_filter(a, lambda x: x IS DISTINCT FROM 5) AS i, list_min(a) AS j, list_max(a) AS k, array_to_string(a, '-') AS l, list_sort(a) AS m, a[2:3] AS n, len(list_distinct(a)) AS o FROM (SELECT *, [l_partkey % 10, l_suppkey % 10, CAST(l_linenumber AS BIGINT), 5] AS a FROM lineitem)""")
def calc_collections(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.array(F.expr("l_partkey % 10"), F.expr("l_suppkey % 10"), F.col("l_linenumber").cast("bigint"), F.lit(5).cast("bigint")).alias("v"))
    v, long = F.col("v"), lambda x: F.lit(x).cast("bigint")
    return rows.select(
        "l_orderkey", "l_linenumber", C.element_at(v, F.lit(2)).alias("a"), C.cardinality(v).cast("bigint").alias("b"), C.contains(v, long(3)).alias("c"), C.reverse(v).alias("d"), C.append(v, long(9)).alias("e"), C.prepend(v, long(9)).alias("f"), C.concat(v, F.array(long(1))).alias("g"),
        C.position(v, long(5)).cast("bigint").alias("h"), C.remove(v, long(5)).alias("i"), F.array_min(v).alias("j"), F.array_max(v).alias("k"), C.join(v.cast("array<string>"), "-").alias("l"), C.sort(v).alias("m"), C.slice_of(v, F.lit(2), F.lit(3)).alias("n"), C.cardinality(C.distinct(v)).cast("bigint").alias("o"),
    )


@register("calc_json_regex", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_exists(props, '$.z') AS z, regexp_extract(props, '([0-9]+)', 1) AS digits, regexp_replace(props, '[0-9]+', '#') AS masked, regexp_matches(props, '6') AS six FROM events""")
def calc_json_regex(spark: SparkSession, folder: str) -> DataFrame:
    p = F.col("props")
    return table(spark, folder, "events").select(
        "event_id", strings.json_value(p, "$.k").cast("bigint").alias("k"), strings.json_exists(p, "$.z").alias("z"), strings.regexp_extract(p, "([0-9]+)", 1).alias("digits"), F.regexp_replace(p, "[0-9]+", "#").alias("masked"), p.rlike("6").alias("six")
    )


@register("calc_conditional", """SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'middle' ELSE 'low' END AS band, coalesce(nullif(o_orderstatus, 'F'), 'none') AS status, TRY_CAST(o_orderpriority[1] AS INTEGER) AS level FROM orders""")
def calc_conditional(spark: SparkSession, folder: str) -> DataFrame:
    price = F.col("o_totalprice")
    band = predicates.if_then(price > 300_000, F.lit("high"), predicates.if_then(price > 100_000, F.lit("middle"), F.lit("low")))
    return table(spark, folder, "orders").select("o_orderkey", band.alias("band"), F.coalesce(predicates.null_if(F.col("o_orderstatus"), F.lit("F")), F.lit("none")).alias("status"), numeric.try_cast(F.left("o_orderpriority", F.lit(1)), "int").alias("level"))


@register("values", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'a'), (2, NULL), (NULL, 'c')) v(n, s)")
def values(spark: SparkSession, folder: str) -> DataFrame:
    from tidemill.sources.connectors import values as inline

    return inline(spark, [(1, "a"), (2, None), (None, "c")], "n bigint, s string")


# Joins.

for how, word in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("full", "FULL JOIN")):

    def equi(spark: SparkSession, folder: str, how: str = how) -> DataFrame:
        c, o = table(spark, folder, "customer"), table(spark, folder, "orders")
        return joins.regular(c, o, [("c_custkey", "o_custkey")], how, residual=c["c_nationkey"] < 20).select(c["c_custkey"], o["o_orderkey"])

    register(f"join_{how}", f"SELECT c_custkey, o_orderkey FROM customer c {word} orders o ON c_custkey = o_custkey AND c_nationkey < 20")(equi)

for how, word in (("left_semi", "EXISTS"), ("left_anti", "NOT EXISTS")):

    def half(spark: SparkSession, folder: str, how: str = how) -> DataFrame:
        c, o = table(spark, folder, "customer"), table(spark, folder, "orders")
        return joins.exists(c, o, c["c_custkey"] == o["o_custkey"], how == "left_anti").select("c_custkey", "c_name")

    register(f"join_{how}", f"SELECT c_custkey, c_name FROM customer WHERE {word} (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")(half)


@register("join_not_in", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def join_not_in(spark: SparkSession, folder: str) -> DataFrame:
    return joins.not_in(table(spark, folder, "customer"), "c_custkey", table(spark, folder, "orders"), "o_custkey").select("c_custkey")


@register("join_null_safe", "SELECT a.c_custkey AS a, b.s_suppkey AS b FROM (SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM customer) a JOIN (SELECT s_suppkey, nullif(s_nationkey, 3) AS k FROM supplier) b ON a.k IS NOT DISTINCT FROM b.k")
def join_null_safe(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "customer").select("c_custkey", F.expr("nullif(c_nationkey, 3)").alias("k"))
    b = table(spark, folder, "supplier").select("s_suppkey", F.expr("nullif(s_nationkey, 3)").alias("j"))
    return joins.regular(a, b, [("k", "j")], null_safe=True).select(F.col("c_custkey").alias("a"), F.col("s_suppkey").alias("b"))


@register("join_theta", "SELECT n_nationkey, s_suppkey FROM nation LEFT JOIN supplier ON s_acctbal < n_nationkey * 20")
def join_theta(spark: SparkSession, folder: str) -> DataFrame:
    n, s = table(spark, folder, "nation"), table(spark, folder, "supplier")
    return joins.theta(n, s, s["s_acctbal"] < n["n_nationkey"] * 20, "left").select("n_nationkey", "s_suppkey")


@register("join_multiway", "SELECT n_name, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM nation JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey GROUP BY n_name")
def join_multiway(spark: SparkSession, folder: str) -> DataFrame:
    n, c, o, li = (table(spark, folder, t) for t in ("nation", "customer", "orders", "lineitem"))
    rows = joins.multiway([li, o, c, n], [o["o_orderkey"] == li["l_orderkey"], c["c_custkey"] == o["o_custkey"], n["n_nationkey"] == c["c_nationkey"]], ["inner"] * 3)
    return rows.groupBy("n_name").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("bigint").alias("quantity"))


@register("scalar_subquery", "SELECT s_suppkey FROM supplier WHERE s_acctbal > (SELECT avg(c_acctbal) FROM customer)")
def scalar_subquery(spark: SparkSession, folder: str) -> DataFrame:
    average = table(spark, folder, "customer").agg(F.avg("c_acctbal"))
    return table(spark, folder, "supplier").where(F.col("s_acctbal") > average.scalar()).select("s_suppkey")


# Windows.

BUCKET = "time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01')"


def events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", "user_id", "event_type", F.expr("cast(round(value * 100) as bigint)").alias("cents"), "ts")


@register("tumble", f"SELECT event_id, {BUCKET} AS window_start, {BUCKET} + INTERVAL '6 hours' AS window_end, {BUCKET} + INTERVAL '6 hours' - INTERVAL '1 millisecond' AS window_time FROM events")
def tumble(spark: SparkSession, folder: str) -> DataFrame:
    return windows.tumble(events(spark, folder), "ts", "'6' HOUR").select("event_id", "window_start", "window_end", "window_time")


@register("hop", """SELECT event_id, s AS window_start, s + INTERVAL '10 hours' AS window_end FROM (SELECT event_id, ts, time_bucket(INTERVAL '4 hours', ts, TIMESTAMP '1970-01-01') - to_hours(CAST(4 * k AS INTEGER)) AS s FROM events, range(3) r(k)) WHERE s + INTERVAL '10 hours' > ts""")
def hop(spark: SparkSession, folder: str) -> DataFrame:
    return windows.hop(events(spark, folder), "ts", "'4' HOUR", "'10' HOUR").select("event_id", "window_start", "window_end")


@register("cumulate", """SELECT event_id, s AS window_start, s + to_hours(CAST(2 * k AS INTEGER)) AS window_end FROM (SELECT event_id, ts, time_bucket(INTERVAL '10 hours', ts, TIMESTAMP '1970-01-01') AS s FROM events), range(1, 6) r(k) WHERE s + to_hours(CAST(2 * k AS INTEGER)) > ts""")
def cumulate(spark: SparkSession, folder: str) -> DataFrame:
    return windows.cumulate(events(spark, folder), "ts", "'2' HOUR", "'10' HOUR").select("event_id", "window_start", "window_end")


SESSION = """s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (
  SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL '5 hours' THEN 0 ELSE 1 END AS new FROM events))"""


@register("session", f"WITH {SESSION} SELECT event_id, min(ts) OVER (PARTITION BY user_id, g) AS window_start, max(ts) OVER (PARTITION BY user_id, g) + INTERVAL '5 hours' AS window_end FROM s")
def session(spark: SparkSession, folder: str) -> DataFrame:
    return windows.session(events(spark, folder), "ts", "'5' HOUR", ["user_id"]).select("event_id", "window_start", "window_end")


@register("session_aggregate", f"WITH {SESSION} SELECT user_id, count(*) AS n, min(ts) AS window_start, max(ts) + INTERVAL '5 hours' AS window_end FROM s GROUP BY user_id, g")
def session_aggregate(spark: SparkSession, folder: str) -> DataFrame:
    w = F.session_window("ts", "5 hours")
    return events(spark, folder).groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n")).select("user_id", "n", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"))


@register("tumble_aggregate", f"SELECT user_id, {BUCKET} AS window_start, count(*) AS n, CAST(sum(round(value * 100)) AS BIGINT) AS cents, min(event_type) AS low, max(event_type) AS high, count(DISTINCT event_type) AS kinds FROM events GROUP BY ALL")
def tumble_aggregate(spark: SparkSession, folder: str) -> DataFrame:
    """One-phase and two-phase window aggregates are one plan: partial sums before the shuffle, final ones after it."""
    rows = windows.tumble(events(spark, folder), "ts", "'6' HOUR")
    return rows.groupBy("user_id", "window_start").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"), F.min("event_type").alias("low"), F.max("event_type").alias("high"), F.count_distinct("event_type").alias("kinds"))


@register("cumulate_aggregate", """SELECT s AS window_start, s + to_hours(CAST(2 * k AS INTEGER)) AS window_end, count(*) AS n FROM (SELECT ts, time_bucket(INTERVAL '10 hours', ts, TIMESTAMP '1970-01-01') AS s FROM events), range(1, 6) r(k) WHERE s + to_hours(CAST(2 * k AS INTEGER)) > ts GROUP BY ALL""")
def cumulate_aggregate(spark: SparkSession, folder: str) -> DataFrame:
    return windows.cumulate_aggregate(events(spark, folder), "ts", "'2' HOUR", "'10' HOUR", [], {"n": (F.count("*"), F.sum)})


@register("attached_window_aggregate", f"SELECT w AS window_start, max(n) AS top FROM (SELECT user_id, {BUCKET} AS w, count(*) AS n FROM events GROUP BY ALL) GROUP BY w")
def attached_window_aggregate(spark: SparkSession, folder: str) -> DataFrame:
    """An aggregate over the bounds that another windowed aggregate produced."""
    inner = windows.tumble(events(spark, folder), "ts", "'6' HOUR").groupBy("user_id", "window_start", "window_end").agg(F.count("*").alias("n"))
    return inner.groupBy("window_start", "window_end").agg(F.max("n").alias("top")).drop("window_end")


@register("legacy_hop_aggregate", """SELECT user_id, s AS starttime, s + INTERVAL '10 hours' AS endtime, count(*) AS n, CAST(sum(cents) // count(cents) AS BIGINT) AS average FROM (
  SELECT user_id, ts, CAST(round(value * 100) AS BIGINT) AS cents, time_bucket(INTERVAL '2 hours', ts, TIMESTAMP '1970-01-01') - to_hours(CAST(2 * k AS INTEGER)) AS s FROM events, range(5) r(k)) GROUP BY ALL""")
def legacy_hop_aggregate(spark: SparkSession, folder: str) -> DataFrame:
    w = F.window("ts", "10 hours", "2 hours")
    out = events(spark, folder).groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n"), F.expr("sum(cents) div count(cents)").alias("average"))
    return out.select("user_id", F.col("w.start").alias("starttime"), F.col("w.end").alias("endtime"), "n", "average")


@register("count_window", "SELECT user_id, g AS window_index, CAST(sum(c) AS BIGINT) AS cents FROM (SELECT user_id, CAST(round(value * 100) AS BIGINT) AS c, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 10 AS g FROM events) GROUP BY ALL HAVING count(*) = 10")
def count_window(spark: SparkSession, folder: str) -> DataFrame:
    return windows.count_tumble(events(spark, folder), 10, ["user_id"], ["event_id"]).groupBy("user_id", "window_index").agg(F.sum("cents").alias("cents"))


@register("count_window_hop", """SELECT user_id, k AS window_index, count(*) AS n FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth, count(*) OVER (PARTITION BY user_id) AS total FROM events) JOIN range(1, 100000) r(k) ON nth <= 5 * k AND nth > 5 * k - 12 AND 5 * k <= total GROUP BY ALL""")
def count_window_hop(spark: SparkSession, folder: str) -> DataFrame:
    return windows.count_hop(events(spark, folder), 5, 12, ["user_id"], ["event_id"]).groupBy("user_id", "window_index").agg(F.count("*").alias("n"))


for how, word in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("full", "FULL JOIN")):

    def window_pair(spark: SparkSession, folder: str, how: str = how) -> DataFrame:
        rows = windows.tumble(events(spark, folder), "ts", "'6' HOUR")
        a = rows.where("event_type = 'purchase'").select("window_start", "window_end", "user_id", F.col("event_id").alias("a"))
        b = rows.where("event_type = 'click'").select("window_start", "window_end", F.col("user_id").alias("other"), F.col("event_id").alias("b"))
        return joins.window_join(a, b, [("user_id", "other")], how).select("window_start", "a", "b")

    register(f"window_join_{how}", f"""WITH w AS (SELECT *, {BUCKET} AS s FROM events) SELECT coalesce(x.s, y.s) AS window_start, x.event_id AS a, y.event_id AS b FROM (SELECT * FROM w WHERE event_type = 'purchase') x {word} (SELECT * FROM w WHERE event_type = 'click') y ON x.s = y.s AND x.user_id = y.user_id""")(window_pair)


@register("window_join_semi", f"""WITH w AS (SELECT *, {BUCKET} AS s FROM events) SELECT event_id FROM w x WHERE event_type = 'purchase' AND EXISTS (SELECT 1 FROM w y WHERE y.event_type = 'click' AND y.s = x.s AND y.user_id = x.user_id)""")
def window_join_semi(spark: SparkSession, folder: str) -> DataFrame:
    rows = windows.tumble(events(spark, folder), "ts", "'6' HOUR")
    a, b = rows.where("event_type = 'purchase'"), rows.where("event_type = 'click'").select("window_start", "window_end", F.col("user_id").alias("other"))
    return joins.window_join(a, b, [("user_id", "other")], "left_semi").select("event_id")


@register("window_top_n", f"SELECT event_id, n FROM (SELECT event_id, CAST(row_number() OVER (PARTITION BY {BUCKET} ORDER BY value DESC, event_id) AS INTEGER) AS n FROM events) WHERE n <= 3")
def window_top_n(spark: SparkSession, folder: str) -> DataFrame:
    rows = windows.tumble(events(spark, folder), "ts", "'6' HOUR")
    return ranking.window_top_n(rows, [], [F.desc("cents"), F.asc("event_id")], 3, "n").select("event_id", "n")


@register("window_dedup", f"SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY {BUCKET}, user_id ORDER BY ts DESC, event_id DESC) = 1")
def window_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.window_deduplicate(windows.tumble(events(spark, folder), "ts", "'6' HOUR"), ["user_id"], "ts", "event_id").select("event_id")


# Expansion and replication.


@register("unnest_ordinality", "SELECT vec_id, CAST(round(e * 1000) AS BIGINT) AS v, i FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS i FROM embeddings)")
def unnest_ordinality(spark: SparkSession, folder: str) -> DataFrame:
    rows = sets.unnest(table(spark, folder, "embeddings").select("vec_id", "embedding"), F.col("embedding"), "e", "i")
    # In the vectors' own FLOAT, as the product of two floats can be a half where the exact one isn't.
    return rows.select("vec_id", F.round(F.col("e") * F.lit(1000).cast("float")).cast("bigint").alias("v"), F.col("i").cast("bigint").alias("i"))


@register("unnest_left", "SELECT o_orderkey, CASE WHEN n > 0 THEN i END AS i FROM (SELECT o_orderkey, o_orderkey % 3 AS n, unnest(CASE WHEN o_orderkey % 3 = 0 THEN [CAST(0 AS BIGINT)] ELSE range(o_orderkey % 3) END) AS i FROM orders)")
def unnest_left(spark: SparkSession, folder: str) -> DataFrame:
    some = F.expr("if(o_orderkey % 3 = 0, cast(array() as array<bigint>), sequence(0L, o_orderkey % 3 - 1))")
    return sets.unnest(table(spark, folder, "orders").select("o_orderkey"), some, "i", outer=True)


@register("unnest_map", "SELECT c_custkey, k, v FROM (SELECT c_custkey, unnest(['name', 'segment']) AS k, unnest([c_name, c_mktsegment]) AS v FROM customer)")
def unnest_map(spark: SparkSession, folder: str) -> DataFrame:
    m = F.create_map(F.lit("name"), F.col("c_name"), F.lit("segment"), F.col("c_mktsegment"))
    return sets.unnest_map(table(spark, folder, "customer").select("c_custkey", "c_name", "c_mktsegment"), m, "k", "v").select("c_custkey", "k", "v")


@register("unnest_multiset", "SELECT c_custkey, 'x' AS e FROM customer, range(2) UNION ALL SELECT c_custkey, 'y' FROM customer")
def unnest_multiset(spark: SparkSession, folder: str) -> DataFrame:
    return sets.unnest_multiset(table(spark, folder, "customer").select("c_custkey"), F.create_map(F.lit("x"), F.lit(2), F.lit("y"), F.lit(1)), "e")


@register("unnest_map_ordinality", "SELECT c_custkey, k, v, i FROM (SELECT c_custkey, unnest(['name', 'segment']) AS k, unnest([c_name, c_mktsegment]) AS v, unnest([CAST(1 AS BIGINT), 2]) AS i FROM customer)")
def unnest_map_ordinality(spark: SparkSession, folder: str) -> DataFrame:
    m = F.create_map(F.lit("name"), F.col("c_name"), F.lit("segment"), F.col("c_mktsegment"))
    rows = sets.unnest_map(table(spark, folder, "customer").select("c_custkey", "c_name", "c_mktsegment"), m, "k", "v", outer=True, ordinality="i")
    return rows.select("c_custkey", "k", "v", F.col("i").cast("bigint").alias("i"))


@register("unnest_multiset_left", "SELECT c_custkey, e, CAST(row_number() OVER (PARTITION BY c_custkey) AS BIGINT) AS i FROM (SELECT c_custkey, 'x' AS e FROM customer, range(3) r(k) WHERE k < c_custkey % 3) UNION ALL SELECT c_custkey, NULL, NULL FROM customer WHERE c_custkey % 3 = 0")
def unnest_multiset_left(spark: SparkSession, folder: str) -> DataFrame:
    rows = sets.unnest_multiset(table(spark, folder, "customer").select("c_custkey"), F.create_map(F.lit("x"), F.col("c_custkey") % 3), "e", outer=True, ordinality="i")
    return rows.select("c_custkey", "e", F.col("i").cast("bigint").alias("i"))


@register("unnest_rows", "SELECT n_nationkey, x, y FROM (SELECT n_nationkey, unnest([n_nationkey, n_regionkey]) AS x, unnest(['a', 'b']) AS y FROM nation)")
def unnest_rows(spark: SparkSession, folder: str) -> DataFrame:
    item = lambda x, y: F.struct(F.col(x).alias("x"), F.lit(y).alias("y"))
    return sets.unnest_rows(table(spark, folder, "nation").select("n_nationkey", "n_regionkey"), F.array(item("n_nationkey", "a"), item("n_regionkey", "b"))).select("n_nationkey", "x", "y")


@register("replicate_rows", "SELECT s_suppkey FROM supplier, range(10) r(k) WHERE k < s_suppkey % 4 - 1")
def replicate_rows(spark: SparkSession, folder: str) -> DataFrame:
    return sets.replicate(table(spark, folder, "supplier").select("s_suppkey"), F.col("s_suppkey") % 4 - 1)


# Changelogs: events as upserts of a user and event type, errors as deletes.

CHANGES = """c AS (SELECT event_id AS seq, user_id, CAST(round(value * 100) AS BIGINT) // 4000 AS band, CASE event_type WHEN 'error' THEN '-D' ELSE '+U' END AS op FROM events)"""
NORMAL = """n AS (SELECT seq, user_id, CASE WHEN op <> '-D' THEN band END AS now, lag(CASE WHEN op <> '-D' THEN band END) OVER (PARTITION BY user_id ORDER BY seq) AS old FROM c),
  o AS (SELECT seq, '+I' AS op, user_id, now AS band FROM n WHERE now IS NOT NULL AND old IS NULL UNION ALL SELECT seq, '-U', user_id, old FROM n WHERE now <> old
  UNION ALL SELECT seq, '+U', user_id, now FROM n WHERE now <> old UNION ALL SELECT seq, '-D', user_id, old FROM n WHERE now IS NULL AND old IS NOT NULL)"""


def changes(spark: SparkSession, folder: str) -> DataFrame:
    rows = events(spark, folder).select(F.col("event_id").alias("seq"), "user_id", F.expr("cents div 4000").alias("band"), F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("kind"))
    return changelog.from_changelog(rows, {"delete": "-D", "upsert": "+U"}, "kind")


def normalized(spark: SparkSession, folder: str) -> DataFrame:
    return changelog.normalize(changes(spark, folder), ["user_id"])


@register("changelog_normalize", f"WITH {CHANGES}, {NORMAL} SELECT * FROM o")
def changelog_normalize(spark: SparkSession, folder: str) -> DataFrame:
    return normalized(spark, folder).drop("nth")


@register("changelog_drop_update_before", f"WITH {CHANGES}, {NORMAL} SELECT * FROM o WHERE op <> '-U'")
def changelog_drop_update_before(spark: SparkSession, folder: str) -> DataFrame:
    return changelog.drop_update_before(normalized(spark, folder)).drop("nth")


LATEST = "l AS (SELECT user_id, max_by(band, seq) AS band, max_by(op, seq) AS op FROM c GROUP BY user_id)"


@register("changelog_upsert_fold", f"WITH {CHANGES}, {LATEST} SELECT user_id, band FROM l WHERE op <> '-D'")
def changelog_upsert_fold(spark: SparkSession, folder: str) -> DataFrame:
    return changelog.upsert_fold(changes(spark, folder), ["user_id"]).select("user_id", "band")


@register("changelog_fold", f"WITH {CHANGES}, {LATEST} SELECT user_id, band FROM l WHERE op <> '-D'")
def changelog_fold(spark: SparkSession, folder: str) -> DataFrame:
    return changelog.fold(normalized(spark, folder), ["user_id", "band"])


@register("changelog_retract_aggregate", f"WITH {CHANGES}, {LATEST} SELECT band, count(*) AS n, min(user_id) AS low, max(user_id) AS high FROM l WHERE op <> '-D' GROUP BY band")
def changelog_retract_aggregate(spark: SparkSession, folder: str) -> DataFrame:
    rows = normalized(spark, folder).drop("nth")
    return changelog.retract_aggregate(rows, ["band"], n=F.count("*"), low=F.min("user_id"), high=F.max("user_id"))


@register("changelog_aggregate", """WITH r AS (SELECT event_id AS seq, user_id, count(*) OVER w AS n, CAST(sum(round(value * 100)) OVER w AS BIGINT) AS total FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
  p AS (SELECT *, lag(n) OVER w AS n0, lag(total) OVER w AS t0 FROM r WINDOW w AS (PARTITION BY user_id ORDER BY seq))
  SELECT user_id, seq, '+I' AS op, n, total FROM p WHERE n0 IS NULL UNION ALL SELECT user_id, seq, '-U', n0, t0 FROM p WHERE n0 IS NOT NULL UNION ALL SELECT user_id, seq, '+U', n, total FROM p WHERE n0 IS NOT NULL""")
def changelog_aggregate(spark: SparkSession, folder: str) -> DataFrame:
    rows = changelog.to_changelog(events(spark, folder).select(F.col("event_id").alias("seq"), "user_id", "cents"))
    return changelog.aggregate_changelog(rows, ["user_id"], "cents").drop("nth")
