"""The auction workload q0 to q23 and its single-operator queries, with the DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import strings
from tidemill.operators import aggregates as A
from tidemill.operators import joins, match, ranking, sets, windows
from tidemill.plans.registry import register
from tidemill.sources import nexmark as N

BID = ["auction", "bidder", "price", "dateTime", "extra"]
BID_SQL = 'auction, bidder, price, "dateTime", extra'


def sql(relations: str, body: str) -> str:
    return "WITH " + ",\n".join(N.SQL[r] for r in relations.split()) + "\n" + body


def hours(n: int) -> str:
    return f"'{n}' HOUR"


TUMBLE = "time_bucket(INTERVAL '10 hours', \"dateTime\", TIMESTAMP '1970-01-01')"
HOPS = """hops AS (
  SELECT *, CAST(to_timestamp(s) AS TIMESTAMP) AS window_start, CAST(to_timestamp(s + 36000) AS TIMESTAMP) AS window_end FROM (
    SELECT bid.*, unnest([epoch_us("dateTime") // 7200000000 * 7200 - k * 7200 FOR k IN range(5)]) AS s FROM bid))"""
RANKS = """count(*) AS total_bids, count(*) FILTER (WHERE price < 10000) AS rank1_bids,
  count(*) FILTER (WHERE price >= 10000 AND price < 1000000) AS rank2_bids, count(*) FILTER (WHERE price >= 1000000) AS rank3_bids"""
DISTINCTS = ",\n".join(
    f"""count(DISTINCT {c}) AS total_{c}s, count(DISTINCT {c}) FILTER (WHERE price < 10000) AS rank1_{c}s,
  count(DISTINCT {c}) FILTER (WHERE price >= 10000 AND price < 1000000) AS rank2_{c}s, count(DISTINCT {c}) FILTER (WHERE price >= 1000000) AS rank3_{c}s"""
    for c in ("bidder", "auction")
)
CHANNEL_ID = r"(&|^)channel_id=([^&]*)"


def rank_filters() -> list[tuple[str, Column | None]]:
    p = F.col("price")
    return [("total", None), ("rank1", p < 10_000), ("rank2", (p >= 10_000) & (p < 1_000_000)), ("rank3", p >= 1_000_000)]


def rank_counts() -> list[Column]:
    return [A.count(where).alias(f"{name}_bids") for name, where in rank_filters()]


def rank_distincts(df: DataFrame, keys: list[str], **calls: tuple[Column, Callable[[str], Column]]) -> DataFrame:
    """The bids of each rank, and their different bidders and auctions."""
    calls |= {f"{name}_bids": (A.count(where), F.sum) for name, where in rank_filters()}
    return A.split_distinct(df, keys, calls, {f"{name}_{c}s": (c, where) for c in ("bidder", "auction") for name, where in rank_filters()})


@register("q0", sql("bid", f"SELECT {BID_SQL} FROM bid"))
def q0(spark: SparkSession, folder: str) -> DataFrame:
    return N.bid(spark, folder).select(*BID)


@register("q1", sql("bid", 'SELECT auction, bidder, CAST(price * 0.908 AS DECIMAL(23,3)) AS price, "dateTime", extra FROM bid'))
def q1(spark: SparkSession, folder: str) -> DataFrame:
    return N.bid(spark, folder).select("auction", "bidder", F.expr("0.908 * price").cast("decimal(23,3)").alias("price"), "dateTime", "extra")


@register("q2", sql("bid", "SELECT auction, price FROM bid WHERE auction % 123 = 0"))
def q2(spark: SparkSession, folder: str) -> DataFrame:
    return N.bid(spark, folder).where("auction % 123 = 0").select("auction", "price")


@register("q3", sql("auction person", "SELECT name, city, state, a.id FROM auction a JOIN person p ON seller = p.id WHERE category = 10 AND state IN ('OR', 'ID', 'CA')"))
def q3(spark: SparkSession, folder: str) -> DataFrame:
    a, p = N.auction(spark, folder).where("category = 10").select("id", "seller"), N.person(spark, folder).where(F.col("state").isin("OR", "ID", "CA"))
    return joins.regular(a, p, [("seller", "id")]).select(p["name"], p["city"], p["state"], a["id"])


def winning(spark: SparkSession, folder: str) -> DataFrame:
    """Bids on an auction while it was open."""
    a = N.auction(spark, folder).withColumnsRenamed({"dateTime": "opened", "extra": "auction_extra"})
    b = N.bid(spark, folder).withColumnsRenamed({"dateTime": "bid_dateTime", "extra": "bid_extra"})
    return a.join(b, (a["id"] == b["auction"]) & b["bid_dateTime"].between(a["opened"], a["expires"]))


OPEN_SQL = 'auction a JOIN bid b ON a.id = b.auction AND b."dateTime" BETWEEN a."dateTime" AND a.expires'


@register("q4", sql("auction bid", f"SELECT category, CAST(sum(top) // count(top) AS BIGINT) AS final FROM (SELECT a.id, category, max(price) AS top FROM {OPEN_SQL} GROUP BY a.id, category) GROUP BY category"))
def q4(spark: SparkSession, folder: str) -> DataFrame:
    top = winning(spark, folder).groupBy("id", "category").agg(F.max("price").alias("top"))
    return top.groupBy("category").agg(A.avg_of(F.col("top")).alias("final"))


@register(
    "q5",
    sql("bid", "").rstrip() + f""", {HOPS}, n AS (SELECT auction, count(*) AS num, window_start, window_end FROM hops GROUP BY ALL)
SELECT auction, num, window_start AS starttime FROM n JOIN (SELECT max(num) AS top, window_start, window_end FROM n GROUP BY ALL) USING (window_start, window_end) WHERE num >= top""",
)
def q5(spark: SparkSession, folder: str) -> DataFrame:
    """The auctions with the most bids in each sliding window; one shuffle by window serves the maximum and the join."""
    hops = windows.hop(N.bid(spark, folder).select("auction", "dateTime"), "dateTime", hours(2), hours(10))
    n = hops.groupBy("auction", "window_start", "window_end").agg(F.count("*").alias("num"))
    top = n.groupBy("window_start", "window_end").agg(F.max("num").alias("top"))
    return joins.window_join(n, top, [], residual=F.col("num") >= F.col("top")).select("auction", "num", F.col("window_start").alias("starttime"))


@register(
    "q6",
    sql("auction bid", f"""SELECT seller, CAST(sum(price) OVER w // count(price) OVER w AS BIGINT) AS avg_price FROM (
  SELECT a.id, seller, price, b."dateTime" AS t, row_number() OVER (PARTITION BY a.id, seller ORDER BY price DESC, b."dateTime", seq) AS n FROM {OPEN_SQL}) WHERE n <= 1
WINDOW w AS (PARTITION BY seller ORDER BY t, id ROWS BETWEEN 10 PRECEDING AND CURRENT ROW)"""),
)
def q6(spark: SparkSession, folder: str) -> DataFrame:
    best = ranking.top_n(winning(spark, folder), ["id", "seller"], [F.desc("price"), F.asc("bid_dateTime"), F.asc("seq")], 1)
    sums = ranking.over(best, ["seller"], [F.asc("bid_dateTime"), F.asc("id")], rows=10, s=F.sum("price"), n=F.count("price"))
    return sums.select("seller", F.expr("s div n").alias("avg_price"))


@register("q7", sql("bid", f"""SELECT {BID_SQL} FROM bid JOIN (SELECT max(price) AS top, {TUMBLE} + INTERVAL '10 hours' AS w FROM bid GROUP BY {TUMBLE}) ON price = top
WHERE "dateTime" BETWEEN w - INTERVAL '10 hours' AND w"""))
def q7(spark: SparkSession, folder: str) -> DataFrame:
    """Each window's highest bids; the range makes a bid on a boundary meet both windows."""
    b = N.bid(spark, folder).select(*BID)
    top = windows.tumble(b, "dateTime", hours(10)).groupBy("window_start", "window_end").agg(F.max("price").alias("top"))
    return b.join(top, (F.col("price") == F.col("top")) & F.col("dateTime").between(F.col("window_start"), F.col("window_end"))).select(*BID)


@register("q8", sql("person auction", f"""SELECT id, name, p.w AS starttime FROM (SELECT DISTINCT id, name, {TUMBLE} AS w FROM person) p JOIN (SELECT DISTINCT seller, {TUMBLE} AS w FROM auction) a ON id = seller AND p.w = a.w"""))
def q8(spark: SparkSession, folder: str) -> DataFrame:
    p = windows.tumble(N.person(spark, folder).select("id", "name", "dateTime"), "dateTime", hours(10)).select("id", "name", "window_start", "window_end").distinct()
    a = windows.tumble(N.auction(spark, folder).select("seller", "dateTime"), "dateTime", hours(10)).select("seller", "window_start", "window_end").distinct()
    return joins.window_join(p, a, [("id", "seller")]).select("id", "name", F.col("window_start").alias("starttime"))


AUCTION_COLUMNS = ["id", "itemName", "description", "initialBid", "reserve", "opened", "expires", "seller", "category", "auction_extra"]


@register(
    "q9",
    sql("auction bid", f"""SELECT * EXCLUDE n FROM (SELECT a.id, "itemName", description, "initialBid", reserve, a."dateTime" AS opened, expires, seller, category, a.extra AS auction_extra, auction, bidder, price, b."dateTime" AS bid_dateTime, b.extra AS bid_extra,
  row_number() OVER (PARTITION BY a.id ORDER BY price DESC, b."dateTime", seq) AS n FROM {OPEN_SQL}) WHERE n <= 1"""),
)
def q9(spark: SparkSession, folder: str) -> DataFrame:
    best = ranking.top_n(winning(spark, folder), ["id"], [F.desc("price"), F.asc("bid_dateTime"), F.asc("seq")], 1)
    return best.select(*AUCTION_COLUMNS, "auction", "bidder", "price", "bid_dateTime", "bid_extra")


@register("q10", sql("bid", f"""SELECT {BID_SQL}, strftime("dateTime", '%Y-%m-%d') AS day, strftime("dateTime", '%H:%M') AS minute FROM bid"""))
def q10(spark: SparkSession, folder: str) -> DataFrame:
    return N.bid(spark, folder).select(*BID, F.date_format("dateTime", "yyyy-MM-dd").alias("day"), F.date_format("dateTime", "HH:mm").alias("minute"))


SESSIONS = """s AS (SELECT *, sum(new) OVER (PARTITION BY bidder ORDER BY "dateTime", seq) AS g FROM (
  SELECT *, CASE WHEN "dateTime" - lag("dateTime") OVER (PARTITION BY bidder ORDER BY "dateTime", seq) <= INTERVAL '10 hours' THEN 0 ELSE 1 END AS new FROM bid))"""


@register("q11", sql("bid", "").rstrip() + f""", {SESSIONS} SELECT bidder, count(*) AS bid_count, min("dateTime") AS starttime, max("dateTime") + INTERVAL '10 hours' AS endtime FROM s GROUP BY bidder, g""")
def q11(spark: SparkSession, folder: str) -> DataFrame:
    w = F.session_window("dateTime", "10 hours")
    return N.bid(spark, folder).groupBy("bidder", w.alias("w")).agg(F.count("*").alias("bid_count")).select("bidder", "bid_count", F.col("w.start").alias("starttime"), F.col("w.end").alias("endtime"))


@register("q12", sql("bid", "SELECT bidder, count(*) AS bid_count, seq // 1000 AS batch FROM bid GROUP BY ALL"))
def q12(spark: SparkSession, folder: str) -> DataFrame:
    """Processing time in a bounded run: arrival numbers stand for the clock, a thousand to a window."""
    return N.bid(spark, folder).groupBy("bidder", F.expr("seq div 1000").alias("batch")).agg(F.count("*").alias("bid_count"))


@register("q13", sql("bid side_input", 'SELECT auction, bidder, price, "dateTime", value FROM bid JOIN side_input ON auction % 10000 = key'))
def q13(spark: SparkSession, folder: str) -> DataFrame:
    s = N.side_input(spark)
    return joins.lookup(N.bid(spark, folder), s, F.col("auction") % 10_000 == s["key"]).select("auction", "bidder", "price", "dateTime", "value")


@register("q14", sql("bid", """SELECT auction, bidder, CAST(price * 0.908 AS DECIMAL(23,3)) AS price, CASE WHEN hour("dateTime") BETWEEN 8 AND 18 THEN 'dayTime' WHEN hour("dateTime") <= 6 OR hour("dateTime") >= 20 THEN 'nightTime' ELSE 'otherTime' END AS "bidTimeType",
  "dateTime", extra, length(extra) - length(replace(extra, '9', '')) AS c_counts FROM bid WHERE price * 0.908 > 1000000 AND price * 0.908 < 50000000"""))
def q14(spark: SparkSession, folder: str) -> DataFrame:
    hour, price = F.hour("dateTime"), F.expr("0.908 * price").cast("decimal(23,3)")
    kind = F.when(hour.between(8, 18), "dayTime").when((hour <= 6) | (hour >= 20), "nightTime").otherwise("otherTime")
    rows = N.bid(spark, folder).withColumn("p", price).where((F.col("p") > 1_000_000) & (F.col("p") < 50_000_000))
    return rows.select("auction", "bidder", F.col("p").alias("price"), kind.alias("bidTimeType"), "dateTime", "extra", strings.count_char(F.col("extra"), "9").alias("c_counts"))


@register("q15", sql("bid", f"""SELECT strftime("dateTime", '%Y-%m-%d') AS day, {RANKS}, {DISTINCTS} FROM bid GROUP BY 1"""))
def q15(spark: SparkSession, folder: str) -> DataFrame:
    return rank_distincts(N.bid(spark, folder).withColumn("day", F.date_format("dateTime", "yyyy-MM-dd")), ["day"])


@register("q16", sql("bid", f"""SELECT channel, strftime("dateTime", '%Y-%m-%d') AS day, max(strftime("dateTime", '%H:%M')) AS minute, {RANKS}, {DISTINCTS} FROM bid GROUP BY 1, 2"""))
def q16(spark: SparkSession, folder: str) -> DataFrame:
    rows = N.bid(spark, folder).withColumns({"day": F.date_format("dateTime", "yyyy-MM-dd"), "clock": F.date_format("dateTime", "HH:mm")})
    return rank_distincts(rows, ["channel", "day"], minute=(F.max("clock"), F.max))


@register("q17", sql("bid", f"""SELECT auction, strftime("dateTime", '%Y-%m-%d') AS day, {RANKS}, min(price) AS min_price, max(price) AS max_price, CAST(sum(price) // count(price) AS BIGINT) AS avg_price, CAST(sum(price) AS BIGINT) AS sum_price FROM bid GROUP BY 1, 2"""))
def q17(spark: SparkSession, folder: str) -> DataFrame:
    p = F.col("price")
    return N.bid(spark, folder).groupBy("auction", F.date_format("dateTime", "yyyy-MM-dd").alias("day")).agg(
        *rank_counts(), F.min(p).alias("min_price"), F.max(p).alias("max_price"), A.avg_of(p).alias("avg_price"), A.sum_of(p).alias("sum_price")
    )


@register("q18", sql("bid", """SELECT auction, bidder, price, channel, url, "dateTime", extra FROM bid QUALIFY row_number() OVER (PARTITION BY bidder, auction ORDER BY "dateTime" DESC, seq DESC) = 1"""))
def q18(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.deduplicate(N.bid(spark, folder), ["bidder", "auction"], "dateTime", "seq").drop("seq")


@register("q19", sql("bid", """SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY auction ORDER BY price DESC, seq) AS INTEGER) AS rank_number FROM bid) WHERE rank_number <= 10"""))
def q19(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.top_n(N.bid(spark, folder), ["auction"], [F.desc("price"), F.asc("seq")], 10, rank="rank_number")


@register("q20", sql("bid auction", """SELECT auction, bidder, price, channel, url, b."dateTime" AS bid_dateTime, b.extra AS bid_extra, "itemName", description, "initialBid", reserve, a."dateTime" AS opened, expires, seller, category, a.extra AS auction_extra FROM bid b JOIN auction a ON auction = id WHERE category = 10"""))
def q20(spark: SparkSession, folder: str) -> DataFrame:
    b = N.bid(spark, folder).withColumnsRenamed({"dateTime": "bid_dateTime", "extra": "bid_extra"}).drop("seq")
    a = N.auction(spark, folder).where("category = 10").withColumnsRenamed({"dateTime": "opened", "extra": "auction_extra"})
    return joins.regular(b, a, [("auction", "id")]).drop("id")


@register("q21", sql("bid", rf"""SELECT auction, bidder, price, channel, CASE lower(channel) WHEN 'apple' THEN '0' WHEN 'google' THEN '1' WHEN 'facebook' THEN '2' WHEN 'baidu' THEN '3' ELSE regexp_extract(url, '{CHANNEL_ID}', 2) END AS channel_id
FROM bid WHERE regexp_matches(url, '{CHANNEL_ID}') OR lower(channel) IN ('apple', 'google', 'facebook', 'baidu')"""))
def q21(spark: SparkSession, folder: str) -> DataFrame:
    known = F.create_map(*(F.lit(x) for kv in {"apple": "0", "google": "1", "facebook": "2", "baidu": "3"}.items() for x in kv))
    found = F.coalesce(F.try_element_at(known, F.lower("channel")), strings.regexp_extract(F.col("url"), CHANNEL_ID, 2))
    return N.bid(spark, folder).select("auction", "bidder", "price", "channel", found.alias("channel_id")).where("channel_id is not null")


@register("q22", sql("bid", "SELECT auction, bidder, price, channel, split_part(url, '/', 4) AS dir1, split_part(url, '/', 5) AS dir2, split_part(url, '/', 6) AS dir3 FROM bid"))
def q22(spark: SparkSession, folder: str) -> DataFrame:
    return N.bid(spark, folder).select("auction", "bidder", "price", "channel", *(strings.split_index(F.col("url"), "/", i).alias(f"dir{i - 2}") for i in (3, 4, 5)))


@register("q23", sql("bid person auction", """SELECT bidder, price, channel, url, b.extra AS bid_extra, p.id AS person_id, name, "emailAddress", "creditCard", city, state, p.extra AS person_extra, "itemName", description, "initialBid", reserve, a."dateTime" AS opened, expires, seller, category, a.extra AS auction_extra
FROM bid b JOIN person p ON p.id = bidder JOIN auction a ON seller = bidder"""))
def q23(spark: SparkSession, folder: str) -> DataFrame:
    b = N.bid(spark, folder).select("bidder", "price", "channel", "url", F.col("extra").alias("bid_extra"))
    p = N.person(spark, folder).drop("dateTime").withColumnsRenamed({"id": "person_id", "extra": "person_extra"})
    a = N.auction(spark, folder).drop("id").withColumnsRenamed({"dateTime": "opened", "extra": "auction_extra"})
    return joins.multiway([b, p, a], [p["person_id"] == b["bidder"], a["seller"] == b["bidder"]], ["inner", "inner"])


# Single-operator workloads.



@register("aggregate_modifiers", sql("bid", """SELECT bidder, count(DISTINCT auction) AS distinct_auctions, count(*) FILTER (WHERE price >= 1000000) AS expensive, CAST(sum(DISTINCT price) FILTER (WHERE price >= 1000000) AS BIGINT) AS distinct_spend,
  CAST(sum(price) // count(price) AS BIGINT) AS average, CAST(sum(DISTINCT price) FILTER (WHERE price >= 1000000) // count(DISTINCT price) FILTER (WHERE price >= 1000000) AS BIGINT) AS average_distinct,
  min(price) FILTER (WHERE price >= 1000000) AS low, max(price) FILTER (WHERE price >= 1000000) AS high FROM bid GROUP BY bidder"""))
def aggregate_modifiers(spark: SparkSession, folder: str) -> DataFrame:
    p, dear = F.col("price"), F.col("price") >= 1_000_000
    return N.bid(spark, folder).groupBy("bidder").agg(
        A.count_of(F.col("auction"), True).alias("distinct_auctions"), A.count(dear).alias("expensive"), A.sum_of(p, distinct=True, where=dear).alias("distinct_spend"), A.avg_of(p).alias("average"),
        A.avg_of(p, distinct=True, where=dear).alias("average_distinct"), A.min_of(p, dear).alias("low"), A.max_of(p, dear).alias("high"),
    )


@register("global_aggregate", sql("bid", "SELECT count(*) AS bids, count(price) AS prices, CAST(sum(price) AS BIGINT) AS spend, min(bidder) AS low, max(auction) AS high, CAST(coalesce(sum(price) FILTER (WHERE price < 0), 0) AS BIGINT) AS none FROM bid"))
def global_aggregate(spark: SparkSession, folder: str) -> DataFrame:
    p = F.col("price")
    return N.bid(spark, folder).agg(A.count().alias("bids"), A.count_of(p).alias("prices"), A.sum_of(p).alias("spend"), F.min("bidder").alias("low"), F.max("auction").alias("high"), A.sum0(p, where=p < 0).alias("none"))


@register("group_aggregate", sql("bid", "SELECT bidder, count(*) AS bids, CAST(sum(price) AS BIGINT) AS spend, min(price) AS low, max(price) AS high FROM bid GROUP BY bidder"))
def group_aggregate(spark: SparkSession, folder: str) -> DataFrame:
    p = F.col("price")
    return N.bid(spark, folder).groupBy("bidder").agg(A.count().alias("bids"), A.sum_of(p).alias("spend"), F.min(p).alias("low"), F.max(p).alias("high"))


@register("decimal_average", sql("bid", "SELECT bidder, CAST(round(sum(CAST(price AS DECIMAL(20,2))) / count(price), 6) AS DOUBLE) AS average FROM bid GROUP BY bidder"))
def decimal_average(spark: SparkSession, folder: str) -> DataFrame:
    return N.bid(spark, folder).groupBy("bidder").agg(F.round(A.avg_of(F.col("price").cast("decimal(20,2)"), "decimal(38,6)").cast("double"), 6).alias("average"))


@register("grouping_sets", sql("bid", "SELECT bidder, channel, count(*) AS bids, CAST(sum(price) AS BIGINT) AS spend FROM bid GROUP BY GROUPING SETS ((bidder), (channel))"))
def grouping_sets(spark: SparkSession, folder: str) -> DataFrame:
    return A.grouping_sets(N.bid(spark, folder), [["bidder"], ["channel"]], ["bidder", "channel"], bids=A.count(), spend=A.sum_of(F.col("price")))


@register("cube", sql("bid", "SELECT bidder, channel, CAST(grouping_id(bidder, channel) AS BIGINT) AS g, count(*) AS bids FROM bid GROUP BY CUBE (bidder, channel)"))
def cube(spark: SparkSession, folder: str) -> DataFrame:
    return N.bid(spark, folder).cube("bidder", "channel").agg(F.grouping_id().alias("g"), F.count("*").alias("bids"))


@register("rollup", sql("bid", "SELECT bidder, channel, count(*) AS bids FROM bid GROUP BY ROLLUP (bidder, channel)"))
def rollup(spark: SparkSession, folder: str) -> DataFrame:
    return N.bid(spark, folder).rollup("bidder", "channel").agg(F.count("*").alias("bids"))


@register("expand", sql("bid", "SELECT bidder AS who, price AS amount, 0 AS kind FROM bid UNION ALL SELECT NULL, auction, 1 FROM bid"))
def expand(spark: SparkSession, folder: str) -> DataFrame:
    return A.expand(N.bid(spark, folder), [[F.col("bidder"), F.col("price"), F.lit(0)], [F.lit(None).cast("bigint"), F.col("auction"), F.lit(1)]], ["who", "amount", "kind"])


@register("select_distinct", sql("bid", "SELECT DISTINCT bidder, channel FROM bid"))
def select_distinct(spark: SparkSession, folder: str) -> DataFrame:
    return N.bid(spark, folder).select("bidder", "channel").distinct()


@register("interval_join", sql("auction bid", """SELECT id AS auction, bidder, price, b."dateTime" AS bid_time FROM auction a JOIN bid b ON id = auction AND b."dateTime" BETWEEN a."dateTime" AND a."dateTime" + INTERVAL '10 hours'"""))
def interval_join(spark: SparkSession, folder: str) -> DataFrame:
    b, a = N.bid(spark, folder), N.auction(spark, folder)
    return joins.interval(b, a, [("auction", "id")], "dateTime", "dateTime", "'0' HOUR", "'10' HOUR", bucket="'10' HOUR").select(b["auction"], b["bidder"], b["price"], b["dateTime"].alias("bid_time"))


for how in ("left", "right", "full"):

    def interval_outer(spark: SparkSession, folder: str, how: str = how) -> DataFrame:
        b, a = N.bid(spark, folder), N.auction(spark, folder)
        return joins.interval(b, a, [("auction", "id")], "dateTime", "dateTime", "'-2' HOUR", "'10' HOUR", how).select(b["auction"], b["seq"], a["id"])

    register(f"interval_join_{how}", sql("auction bid", f"""SELECT auction, b.seq, id FROM bid b {how} JOIN auction a ON id = auction AND b."dateTime" BETWEEN a."dateTime" - INTERVAL '2 hours' AND a."dateTime" + INTERVAL '10 hours'"""))(interval_outer)


TEMPORAL = """v AS (SELECT *, lead("dateTime") OVER (PARTITION BY id ORDER BY "dateTime", seq) AS upto FROM versioned_auction)
SELECT auction, bidder, price, b."dateTime" AS bid_time, seller, category FROM bid b {how} JOIN v ON auction = id AND v."dateTime" <= b."dateTime" AND (upto IS NULL OR b."dateTime" < upto) AND {residual}"""


@register("temporal_join", sql("auction bid versioned_auction", "").rstrip() + ", " + TEMPORAL.format(how="LEFT", residual="category >= 0"))
def temporal_join(spark: SparkSession, folder: str) -> DataFrame:
    b = N.bid(spark, folder).select("auction", "bidder", "price", F.col("dateTime").alias("bid_time"))
    return joins.temporal(b, N.versioned_auction(spark, folder), "auction", "id", "bid_time", "dateTime", ["seller", "category"], seq="seq", residual=F.col("b_category") >= 0)


@register("temporal_join_inner", sql("auction bid versioned_auction", "").rstrip() + ", " + TEMPORAL.format(how="", residual="true"))
def temporal_join_inner(spark: SparkSession, folder: str) -> DataFrame:
    b = N.bid(spark, folder).select("auction", "bidder", "price", F.col("dateTime").alias("bid_time"))
    return joins.temporal(b, N.versioned_auction(spark, folder), "auction", "id", "bid_time", "dateTime", ["seller", "category"], how="inner", seq="seq")


@register("temporal_function_join", sql("bid", """SELECT seq, price, latest FROM (SELECT seq, price, lag(price) OVER (PARTITION BY bidder ORDER BY seq) AS latest FROM bid) WHERE latest IS NOT NULL"""))
def temporal_function_join(spark: SparkSession, folder: str) -> DataFrame:
    """Processing time: each row meets the row of its key that arrived last before it, by arrival numbers."""
    b = N.bid(spark, folder)
    build = b.select("bidder", (F.col("seq") + 1).alias("arrived"), F.col("price").alias("latest"))
    return joins.temporal(b.select("bidder", "seq", "price"), build, "bidder", "bidder", "seq", "arrived", ["latest"], how="inner").drop("bidder")


@register("over_event_time", sql("bid", """SELECT bidder, auction, price, "dateTime", CAST(sum(price) OVER (PARTITION BY auction ORDER BY "dateTime", seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM bid"""))
def over_event_time(spark: SparkSession, folder: str) -> DataFrame:
    out = ranking.over(N.bid(spark, folder), ["auction"], [F.asc("dateTime"), F.asc("seq")], running=F.sum("price"))
    return out.select("bidder", "auction", "price", "dateTime", "running")


@register("over_processing_time", sql("bid", """SELECT bidder, auction, price, "dateTime", CAST(sum(price) OVER (PARTITION BY auction ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM bid"""))
def over_processing_time(spark: SparkSession, folder: str) -> DataFrame:
    out = ranking.over(N.bid(spark, folder), ["auction"], [F.asc("seq")], running=F.sum("price"))
    return out.select("bidder", "auction", "price", "dateTime", "running")


@register("over_peers", sql("bid", """SELECT bidder, auction, price, CAST(sum(price) OVER w AS BIGINT) AS running, count(*) OVER w AS n, min(price) OVER w AS low, max(price) OVER w AS high, CAST(sum(price) OVER w // count(*) OVER w AS BIGINT) AS average FROM bid WINDOW w AS (PARTITION BY bidder ORDER BY price)"""))
def over_peers(spark: SparkSession, folder: str) -> DataFrame:
    p = F.col("price")
    out = ranking.over(N.bid(spark, folder), ["bidder"], [F.asc("price")], peers=True, running=F.sum(p), n=F.count("*"), low=F.min(p), high=F.max(p))
    return out.select("bidder", "auction", "price", "running", "n", "low", "high", F.expr("running div n").alias("average"))


@register("over_bounded_rows", sql("bid", """SELECT bidder, auction, price, "dateTime", CAST(sum(price) OVER (PARTITION BY bidder ORDER BY seq ROWS BETWEEN 100 PRECEDING AND CURRENT ROW) AS BIGINT) AS running FROM bid"""))
def over_bounded_rows(spark: SparkSession, folder: str) -> DataFrame:
    out = ranking.over(N.bid(spark, folder), ["bidder"], [F.asc("seq")], rows=100, running=F.sum("price"))
    return out.select("bidder", "auction", "price", "dateTime", "running")


@register("over_bounded_range", sql("bid", """SELECT bidder, auction, price, "dateTime", CAST(sum(price) OVER (PARTITION BY auction ORDER BY "dateTime" RANGE BETWEEN INTERVAL '10 hours' PRECEDING AND CURRENT ROW) AS BIGINT) AS running FROM bid"""))
def over_bounded_range(spark: SparkSession, folder: str) -> DataFrame:
    out = ranking.over(N.bid(spark, folder), ["auction"], [F.col("dateTime")], seconds=36_000, running=F.sum("price"))
    return out.select("bidder", "auction", "price", "dateTime", "running")


@register("match_recognize", sql("bid", """SELECT bidder, max(auction) FILTER (WHERE k = 0) AS first_auction, max(auction) FILTER (WHERE k = 1) AS second_auction, max(auction) FILTER (WHERE k = 2) AS third_auction FROM (
  SELECT bidder, auction, (row_number() OVER w - 1) % 3 AS k, (row_number() OVER w - 1) // 3 AS g FROM bid WINDOW w AS (PARTITION BY bidder ORDER BY seq)) GROUP BY bidder, g HAVING count(*) = 3"""))
def match_recognize(spark: SparkSession, folder: str) -> DataFrame:
    some = lambda c: c("auction").isNotNull()
    return match.match_recognize(N.bid(spark, folder), ["bidder"], ["seq"], ["A", "B", "C"], {"A": some, "B": some, "C": some}, {"first_auction": ("A", "auction"), "second_auction": ("B", "auction"), "third_auction": ("C", "auction")})


@register("match_recognize_next", sql("bid", """SELECT bidder, s1 AS first_seq, s3 AS last_seq FROM (SELECT bidder, seq AS s1, price AS p1, lead(price, 1) OVER w AS p2, lead(price, 2) OVER w AS p3, lead(seq, 2) OVER w AS s3 FROM bid WINDOW w AS (PARTITION BY bidder ORDER BY seq)) WHERE p1 < 1000000 AND p2 >= 1000000 AND p3 < 1000000"""))
def match_recognize_next(spark: SparkSession, folder: str) -> DataFrame:
    low, high = (lambda c: c("price") < 1_000_000), (lambda c: c("price") >= 1_000_000)
    return match.match_recognize(N.bid(spark, folder), ["bidder"], ["seq"], ["A", "B", "C"], {"A": low, "B": high, "C": low}, {"first_seq": ("A", "seq"), "last_seq": ("C", "seq")}, skip="to next row")


@register("unnest_array", sql("bid", "SELECT auction, unnest([auction, bidder, price]) AS v, unnest([1, 2, 3]) AS i FROM bid"))
def unnest_array(spark: SparkSession, folder: str) -> DataFrame:
    return sets.unnest(N.bid(spark, folder).select("auction", F.array("auction", "bidder", "price").alias("a")), F.col("a"), "v", "i").drop("a")


@register("dedup_first", sql("bid", """SELECT auction, bidder, price, seq FROM bid QUALIFY row_number() OVER (PARTITION BY bidder, auction ORDER BY seq) = 1"""))
def dedup_first(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.deduplicate(N.bid(spark, folder), ["bidder", "auction"], "seq", "seq", "first").select("auction", "bidder", "price", "seq")


@register("dedup_last", sql("bid", """SELECT auction, bidder, price, seq FROM bid QUALIFY row_number() OVER (PARTITION BY bidder, auction ORDER BY seq DESC) = 1"""))
def dedup_last(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.deduplicate(N.bid(spark, folder), ["bidder", "auction"], "seq", "seq").select("auction", "bidder", "price", "seq")


@register("bounded_rank", sql("bid", f"""SELECT * FROM (SELECT {BID_SQL}, CAST(rank() OVER (PARTITION BY bidder ORDER BY price DESC) AS INTEGER) AS rank_number FROM bid) WHERE rank_number BETWEEN 2 AND 10"""))
def bounded_rank(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.rank_range(N.bid(spark, folder).select(*BID), ["bidder"], [F.desc("price")], 2, 10)


@register("dense_rank", sql("bid", f"""SELECT * FROM (SELECT {BID_SQL}, CAST(dense_rank() OVER (PARTITION BY bidder ORDER BY price DESC) AS INTEGER) AS rank_number FROM bid) WHERE rank_number <= 3"""))
def dense_rank(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.rank_range(N.bid(spark, folder).select(*BID), ["bidder"], [F.desc("price")], 1, 3, dense=True)


@register("top_n", sql("bid", f"""SELECT * FROM (SELECT {BID_SQL}, CAST(row_number() OVER (PARTITION BY bidder ORDER BY price DESC, "dateTime" DESC, auction) AS INTEGER) AS row_num FROM bid) WHERE row_num BETWEEN 3 AND 10"""))
def top_n(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.top_n(N.bid(spark, folder).select(*BID), ["bidder"], [F.desc("price"), F.desc("dateTime"), F.asc("auction")], 10, 2, "row_num")


@register("top_n_variable", sql("bid", "SELECT bidder, auction, seq FROM bid QUALIFY row_number() OVER (PARTITION BY bidder ORDER BY price DESC, seq) <= bidder % 4"))
def top_n_variable(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.top_n(N.bid(spark, folder), ["bidder"], [F.desc("price"), F.asc("seq")], F.col("bidder") % 4).select("bidder", "auction", "seq")




def total_order() -> list[Column]:
    return [F.desc("price"), F.asc("auction"), F.asc("bidder"), F.asc("dateTime"), F.asc("extra")]


@register("bounded_sort", sql("bid", f"SELECT {BID_SQL} FROM bid ORDER BY price DESC, auction, bidder, \"dateTime\", extra"))
def bounded_sort(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.sort(N.bid(spark, folder).select(*BID), total_order())


@register("bounded_sort_limit", sql("bid", f"SELECT {BID_SQL} FROM bid ORDER BY price DESC, auction, bidder, \"dateTime\", extra LIMIT 1000 OFFSET 50"))
def bounded_sort_limit(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.sort_limit(N.bid(spark, folder).select(*BID), total_order(), 1000, 50)


@register("temporal_sort", sql("bid", f"SELECT {BID_SQL} FROM bid ORDER BY \"dateTime\", price DESC"))
def temporal_sort(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.sort(N.bid(spark, folder).select(*BID), [F.asc("dateTime"), F.desc("price")])


@register("limit", sql("bid", "SELECT least(count(*) - 50, 1000) AS n FROM bid"))
def limit(spark: SparkSession, folder: str) -> DataFrame:
    """LIMIT with OFFSET: which rows is undefined, so their number is the result."""
    return ranking.limit(N.bid(spark, folder), 1000, 50).agg(F.count("*").alias("n"))


@register("sort_merge_join", sql("bid", """SELECT l.auction, l.bidder, l.price, l."dateTime" FROM bid l JOIN bid r ON l.auction = r.auction AND l.bidder = r.bidder AND l.price = r.price AND l."dateTime" = r."dateTime" """))
def sort_merge_join(spark: SparkSession, folder: str) -> DataFrame:
    keys = ["auction", "bidder", "price", "dateTime"]
    left, right = N.bid(spark, folder).select(*keys), N.bid(spark, folder).select(*keys)
    return left.hint("MERGE").join(right, keys)


@register("hash_join", sql("bid", "SELECT l.seq FROM bid l JOIN bid r ON l.seq = r.seq + 1 AND l.bidder = r.bidder"))
def hash_join(spark: SparkSession, folder: str) -> DataFrame:
    left, right = N.bid(spark, folder).select("seq", "bidder"), N.bid(spark, folder).select((F.col("seq") + 1).alias("seq"), "bidder")
    return left.join(right.hint("SHUFFLE_HASH"), ["seq", "bidder"]).select("seq")


def parts_of(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    b = N.bid(spark, folder).select("auction", "channel", F.hour("dateTime").alias("h"))
    return b.where("h < 16").drop("h"), b.where("h >= 8").drop("h")


PARTS = """x AS (SELECT auction, channel FROM bid WHERE hour("dateTime") < 16), y AS (SELECT auction, channel FROM bid WHERE hour("dateTime") >= 8)"""
for name, word, run in (
    ("intersect", "INTERSECT", lambda a, b: sets.intersect(a, b)),
    ("intersect_all", "INTERSECT ALL", lambda a, b: sets.intersect(a, b, True)),
    ("except", "EXCEPT", lambda a, b: sets.difference(a, b)),
    ("except_all", "EXCEPT ALL", lambda a, b: sets.difference(a, b, True)),
    ("union_all", "UNION ALL", lambda a, b: sets.union_all(a, b)),
    ("union_distinct", "UNION", lambda a, b: sets.union_distinct(a, b)),
):
    register(f"set_{name}", sql("bid", "").rstrip() + f", {PARTS} SELECT * FROM x {word} SELECT * FROM y")(lambda spark, folder, run=run: run(*parts_of(spark, folder)))
