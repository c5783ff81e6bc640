"""The auction model over the driver's tables: bids from events, auctions from orders, persons from customers.

The events are minutes apart, so queries take hours where the original workload takes seconds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.sources.tables import table

#: The first day of the events and the states of persons.
FIRST_DAY = "2024-01-01 00:00:00"
STATES = ("OR", "ID", "CA", "WA", "AZ")
CHANNELS = {"click": "apple", "view": "Google", "purchase": "facebook", "error": "baidu"}


def bid(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    channel = F.concat(F.lit("channel-"), (F.col("event_id") % 100).cast("string"))
    for kind, name in CHANNELS.items():
        channel = F.when(F.col("event_type") == kind, name).otherwise(channel)
    tail = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("&channel_id="), (F.col("event_id") % 1000).cast("string"))).otherwise("")
    url = F.concat(F.lit("https://auction.example/a"), (F.col("event_id") % 10).cast("string"), F.lit("/b"), F.col("user_id").cast("string"), F.lit("/item.htm?query=1"), tail)
    return e.select(
        ((F.col("event_id") * 37 + F.col("user_id") * 11) % 1000).alias("auction"), F.col("user_id").alias("bidder"), (F.round(F.col("value") * 100).cast("bigint") * 100).alias("price"),
        channel.alias("channel"), url.alias("url"), F.col("ts").alias("dateTime"), F.col("props").alias("extra"), F.col("event_id").alias("seq"),
    )


def _at(seconds: str) -> F.Column:
    return F.expr(f"TIMESTAMP_NTZ'{FIRST_DAY}' + make_dt_interval(0, 0, 0, {seconds})")


def auction(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    first = F.round(F.col("o_totalprice") * 100).cast("bigint")
    opened = o.withColumn("opened", _at("o_orderkey * 7919 % 2592000"))
    return opened.select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("item-"), (F.col("o_orderkey") % 50).cast("string")).alias("itemName"), F.col("o_orderpriority").alias("description"), first.alias("initialBid"),
        (first * 2).alias("reserve"), F.col("opened").alias("dateTime"), F.expr("opened + make_dt_interval(cast(o_orderkey % 10 + 1 as int))").alias("expires"), F.col("o_custkey").alias("seller"),
        (F.col("o_orderkey") % 5 + 10).alias("category"), F.col("o_orderstatus").alias("extra"),
    )


def person(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "customer")
    state = F.element_at(F.array(*map(F.lit, STATES)), (F.col("c_nationkey") % 5 + 1).cast("int"))
    return c.select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.concat(F.lower("c_name"), F.lit("@mail.example")).alias("emailAddress"), F.lpad(F.col("c_custkey").cast("string"), 16, "0").alias("creditCard"),
        F.concat(F.lit("city-"), (F.col("c_nationkey")).cast("string")).alias("city"), state.alias("state"), _at("c_custkey * 6151 % 2592000").alias("dateTime"), F.col("c_mktsegment").alias("extra"),
    )


def versioned_auction(spark: SparkSession, folder: str) -> DataFrame:
    """Auctions with a second version halfway to their end, in another category."""
    a = auction(spark, folder)
    first = a.select("id", "seller", "category", "dateTime", F.lit(0).alias("seq"))
    second = a.select("id", "seller", (F.col("category") - 20).alias("category"), F.expr("dateTime + make_dt_interval(cast(id % 10 div 2 as int))").alias("dateTime"), F.lit(1).alias("seq"))
    return first.unionByName(second.where("id % 2 = 0"))


def side_input(spark: SparkSession) -> DataFrame:
    """A lookup table of 10,000 keys."""
    return spark.range(10_000).select(F.col("id").alias("key"), F.concat(F.lit("value-"), F.col("id").cast("string")).alias("value"))


#: The same relations in DuckDB, as common table expressions.
SQL = {
    "bid": """bid AS (
  SELECT (event_id * 37 + user_id * 11) % 1000 AS auction, user_id AS bidder, CAST(round(value * 100) AS BIGINT) * 100 AS price,
    CASE event_type WHEN 'click' THEN 'apple' WHEN 'view' THEN 'Google' WHEN 'purchase' THEN 'facebook' WHEN 'error' THEN 'baidu'
      ELSE 'channel-' || (event_id % 100) END AS channel,
    'https://auction.example/a' || (event_id % 10) || '/b' || user_id || '/item.htm?query=1' ||
      CASE WHEN event_id % 3 = 0 THEN '&channel_id=' || (event_id % 1000) ELSE '' END AS url,
    ts AS "dateTime", props AS extra, event_id AS seq FROM events)""",
    "auction": """auction AS (
  SELECT o_orderkey AS id, 'item-' || (o_orderkey % 50) AS "itemName", o_orderpriority AS description,
    CAST(round(o_totalprice * 100) AS BIGINT) AS "initialBid", CAST(round(o_totalprice * 100) AS BIGINT) * 2 AS reserve,
    TIMESTAMP '2024-01-01 00:00:00' + to_seconds(o_orderkey * 7919 % 2592000) AS "dateTime",
    TIMESTAMP '2024-01-01 00:00:00' + to_seconds(o_orderkey * 7919 % 2592000) + to_days(CAST(o_orderkey % 10 + 1 AS INTEGER)) AS expires,
    o_custkey AS seller, o_orderkey % 5 + 10 AS category, o_orderstatus AS extra FROM orders)""",
    "person": """person AS (
  SELECT c_custkey AS id, c_name AS name, lower(c_name) || '@mail.example' AS "emailAddress", lpad(CAST(c_custkey AS VARCHAR), 16, '0') AS "creditCard",
    'city-' || c_nationkey AS city, ['OR', 'ID', 'CA', 'WA', 'AZ'][c_nationkey % 5 + 1] AS state,
    TIMESTAMP '2024-01-01 00:00:00' + to_seconds(c_custkey * 6151 % 2592000) AS "dateTime", c_mktsegment AS extra FROM customer)""",
    "versioned_auction": """versioned_auction AS (
  SELECT id, seller, category, "dateTime", 0 AS seq FROM auction
  UNION ALL SELECT id, seller, category - 20, "dateTime" + to_days(CAST(id % 10 // 2 AS INTEGER)), 1 FROM auction WHERE id % 2 = 0)""",
    "side_input": "side_input AS (SELECT i AS key, 'value-' || i AS value FROM range(10000) t(i))",
}


def generated(spark: SparkSession, n: int, seed: int = 42, parts: int | None = None) -> DataFrame:
    """A seeded, bounded stream of n events in one table: event_type (0 person, 1 auction, 2 bid), the rows, event_time.

    Of 50 events one is a person, three are auctions and the rest bids; every number comes from a hash of the event's
    number, so any part of the stream can be made anywhere, again.
    """
    r = lambda salt, m: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(m))
    at = F.timestamp_millis(F.lit(1_600_000_000_000) + F.col("id") * 10).cast("timestamp_ntz")
    rows = spark.range(0, n, 1, parts) if parts else spark.range(n)
    kind = F.when(F.col("id") % 50 == 0, 0).when(F.col("id") % 50 <= 3, 1).otherwise(2)
    rows = rows.withColumns({"event_type": kind, "at": at})
    text = lambda prefix, salt, m: F.concat(F.lit(prefix), r(salt, m).cast("string"))
    persons, auctions = F.floor(F.col("id") / 50) + 1, F.floor(F.col("id") / 50) * 3 + 1
    person = F.struct((F.floor(F.col("id") / 50) + 1000).alias("id"), text("name-", 1, 1000).alias("name"), text("mail-", 2, 10_000).alias("emailAddress"), text("card-", 3, 10_000).alias("creditCard"), text("city-", 4, 10).alias("city"), F.element_at(F.array(*map(F.lit, STATES)), (r(5, 5) + 1).cast("int")).alias("state"), F.col("at").alias("dateTime"), F.lit("").alias("extra"))
    auction = F.struct((F.floor(F.col("id") / 50) * 3 + F.col("id") % 50 + 999).alias("id"), text("item-", 6, 50).alias("itemName"), text("about-", 7, 50).alias("description"), (r(8, 1000) + 1).alias("initialBid"), (r(8, 1000) + r(9, 1000) + 1).alias("reserve"), F.col("at").alias("dateTime"), F.timestamp_millis(F.lit(1_600_000_000_000) + F.col("id") * 10 + r(10, 20_000)).cast("timestamp_ntz").alias("expires"), (F.pmod(r(11, 1 << 40), persons) + 1000).alias("seller"), (r(12, 5) + 10).alias("category"), F.lit("").alias("extra"))
    bid = F.struct((F.pmod(r(13, 1 << 40), auctions) + 1000).alias("auction"), (F.pmod(r(14, 1 << 40), persons) + 1000).alias("bidder"), (F.pow(F.lit(10.0), r(15, 600) / 100.0 + 2)).cast("bigint").alias("price"), F.element_at(F.array(*map(F.lit, ("apple", "Google", "facebook", "baidu", "channel-1", "channel-2"))), (r(16, 6) + 1).cast("int")).alias("channel"), F.concat(F.lit("https://auction.example/a/b/item.htm?query=1&channel_id="), r(17, 1000).cast("string")).alias("url"), F.col("at").alias("dateTime"), F.lit("").alias("extra"))
    return rows.select("event_type", F.when(kind == 0, person).alias("person"), F.when(kind == 1, auction).alias("auction"), F.when(kind == 2, bid).alias("bid"), F.col("at").alias("event_time"))
