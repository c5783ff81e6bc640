import pytest
from pyspark.sql import functions as F

from tidemill import functions
from tidemill.operators import windows
from tidemill.plans import dialect
from tidemill.sources import nexmark


@pytest.fixture(scope="module")
def bid(spark, sf_dir):
    df = nexmark.bid(spark, sf_dir)
    df.createOrReplaceTempView("bid")
    return df


CALLS = {
    "TUMBLE(TABLE bid, DESCRIPTOR(`dateTime`), INTERVAL '10' HOUR)": lambda b: windows.tumble(b, "dateTime", "'10' HOUR"),
    "HOP(TABLE bid, DESCRIPTOR(dateTime), INTERVAL '2' HOUR, INTERVAL '10' HOUR)": lambda b: windows.hop(b, "dateTime", "'2' HOUR", "'10' HOUR"),
    "CUMULATE(TABLE bid, DESCRIPTOR(dateTime), INTERVAL '2' hour, INTERVAL '10'\n HOUR, INTERVAL '1' MINUTE)": lambda b: windows.cumulate(b, "dateTime", "'2' HOUR", "'10' HOUR", "'1' MINUTE"),
    "SESSION(TABLE bid PARTITION BY bidder, auction, DESCRIPTOR(dateTime), INTERVAL '5' DAY)": lambda b: windows.session(b, "dateTime", "'5' DAY", ["bidder", "auction"]),
}


@pytest.mark.parametrize("call", CALLS)
def test_window_functions_in_sql(spark, bid, call):
    text = f"SELECT channel, window_start, window_end, count(*) AS n, max(price) AS top FROM TABLE({call}) GROUP BY channel, window_start, window_end"
    want = CALLS[call](bid).groupBy("channel", "window_start", "window_end").agg(F.count("*").alias("n"), F.max("price").alias("top"))
    assert sorted(map(tuple, dialect.sql(spark, text).collect())) == sorted(map(tuple, want.collect()))


def test_windows_join_and_other_sql(spark, bid):
    text = """WITH a AS (SELECT auction, window_start, count(*) AS n FROM TABLE(TUMBLE(TABLE bid, DESCRIPTOR(dateTime), INTERVAL '10' HOUR)) GROUP BY auction, window_start),
    m AS (SELECT window_start, max(n) AS top FROM a GROUP BY window_start) SELECT a.auction, a.n FROM a JOIN m ON a.window_start = m.window_start AND a.n >= m.top"""
    assert dialect.sql(spark, text).count() > 0
    assert dialect.sql(spark, "SELECT 1 AS x").first().x == 1


#: The names of the scalar functions that queries may use.
NAMES = """PLUS MINUS TIMES DIVIDE MOD NEGATE TRY_CAST TYPEOF COMPARE IS_DISTINCT BETWEEN IN LIKE STARTSWITH ENDSWITH IF COALESCE IFNULL NULLIF GREATEST LEAST ABS CEIL FLOOR SIGN SQRT POWER EXP LN LOG10 LOG SIN COS TAN COT
SINH TANH ASIN ACOS ATAN ATAN2 DEGREES RADIANS PI E TRUNCATE INET_NTOA INET_ATON BIN HEX UNHEX MD5 SHA1 SHA2 TO_BASE64 CHAR_LENGTH LOWER UPPER CONCAT CONCAT_WS SUBSTRING TRIM BTRIM LTRIM RTRIM REPLACE TRANSLATE ELT
SPLIT_INDEX SPLIT POSITION INSTR LOCATE LEFT RIGHT REPEAT REVERSE INITCAP ASCII CHR HASH_CODE URL_ENCODE URL_DECODE JSON_QUOTE REGEXP_EXTRACT DATE_FORMAT EXTRACT CLOCK TIMESTAMP_PLUS ELEMENT_AT MAP_VALUE CARDINALITY
ELEMENT ARRAY_CONTAINS ARRAY_REVERSE ARRAY_APPEND ARRAY_PREPEND ARRAY_CONCAT ARRAY_POSITION ARRAY_REMOVE ARRAY_MIN ARRAY_MAX ARRAY_JOIN ARRAY_SORT ARRAY_SLICE ARRAY_DISTINCT ARRAY_UNION ARRAY_INTERSECT ARRAY_EXCEPT
MAP_KEYS MAP_VALUES MAP_ENTRIES ROUND COSH LOG2 UUID RAND LPAD RPAD OVERLAY IS_ALPHA IS_DIGIT IS_DECIMAL STR_TO_MAP PRINTF ENCODE DECODE FROM_BASE64 PARSE_URL REGEXP REGEXP_COUNT REGEXP_EXTRACT_ALL REGEXP_INSTR
REGEXP_SUBSTR REGEXP_REPLACE IS_JSON JSON_EXISTS JSON_VALUE CURRENT_DATE CURRENT_TIMESTAMP LOCALTIMESTAMP NOW FROM_UNIXTIME UNIX_TIMESTAMP TO_DATE TO_TIMESTAMP TIMESTAMPDIFF OVERLAPS CONVERT_TZ MAP_FROM_ARRAYS
MAP_UNION""".split()


def test_every_function_is_there():
    assert [n for n in NAMES if n not in functions.FUNCTIONS] == []
    assert all(map(callable, functions.FUNCTIONS.values()))


def test_further_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    f = functions.FUNCTIONS
    assert one(f["CONVERT_TZ"](F.lit("1970-01-01 00:00:00"), "UTC", "America/Los_Angeles")) == "1969-12-31 16:00:00"
    assert one(f["IS_JSON"](F.lit('{"a": 1}'))) is True and one(f["IS_JSON"](F.lit("{"))) is False
    assert one(f["IS_ALPHA"](F.lit("añ"))) is True and one(f["IS_DECIMAL"](F.lit("-1.5"))) is True and one(f["IS_DIGIT"](F.lit("1a"))) is False
    d = lambda s: F.lit(s).cast("date")
    assert one(f["OVERLAPS"](d("2020-01-01"), d("2020-02-01"), d("2020-03-01"), d("2020-01-15"))) is True
    assert one(f["TIMESTAMPDIFF"]("MONTH", F.lit("2020-01-31").cast("timestamp"), F.lit("2020-03-01").cast("timestamp"))) == 1
    assert one(f["MAP_UNION"](F.create_map(F.lit(1), F.lit("a")), F.create_map(F.lit(1), F.lit("b")))) == {1: "b"}
