"""Registered queries against their own SQL on small tables with rows that the given ones don't have."""

import duckdb

from tidemill.plans import registry


def both(spark, folder, name, table, rows, schema):
    """The query's rows and its SQL's, sorted."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
    con = duckdb.connect()
    con.sql(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    want = con.sql(registry.oracle_sql()[name])
    got = registry.queries()[name](spark, str(folder)).select(*want.columns)
    return sorted(map(tuple, got.collect()), key=repr), sorted(want.fetchall(), key=repr)


def test_casts_of_products_beyond_an_address(spark, tmp_path):
    rows = [(1, 10), (65_535, 18), (65_536, 18), (65_537, 10), (131_072, 6), (1_199_999, 20)]
    got, want = both(spark, tmp_path, "calc_casts", "part", rows, "p_partkey long, p_size int")
    assert got == want and {r[0]: r[9:] for r in got}[65_537] == ("0.2.0.1", 65_537**2)


def test_casts_of_odd_keys(spark, tmp_path):
    """A zero key and a missing one beside a zero divisor, a missing size, keys of more than ten digits."""
    rows = [(0, 10), (0, 3), (7, None), (None, 10), (None, 3), (10**10 + 1, 12), (9 * 10**12, 25)]
    got, want = both(spark, tmp_path, "calc_casts", "part", rows, "p_partkey long, p_size int")
    assert len(got) == len(rows) and got == want


def test_unnested_products_round_as_floats(spark, tmp_path):
    """Products that are halves as floats only, of both signs, missing and large elements, an empty and a missing vector."""
    halves = [(n + 0.5) / 1000 for n in range(-1000, 1000)]
    rows = [(1, halves), (2, [0.3195, None, -0.3195, -0.0, 0.00049999997, 16777.217, 1e15, -1e-40]), (3, []), (4, None), (5, [None])]
    got, want = both(spark, tmp_path, "unnest_ordinality", "embeddings", rows, "vec_id long, embedding array<float>")
    assert len(got) == len(halves) + 9 and got == want
    assert (2, 320, 1) in got and (2, -320, 3) in got
