import random
import re
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemill.llm import mixing


def water(sizes):
    """Targets by sharing the excess again and again; sizes: {source: words}."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        share = sum(weight[s] for s in order if s not in capped)
        target = {s: Fraction(3 * sizes[s]) if s in capped else Fraction(weight[s] * left, share) for s in order}
        over = {s for s in order if s not in capped and target[s] > 3 * sizes[s]}
        if not over:
            return target
        capped |= over


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check(rows, got):
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + words(t)
    target = water(sizes)
    assert sorted(str(d) for d, _, _ in rows) == sorted(str(r.doc_id) for r in got)
    taken, largest = dict.fromkeys(sizes, 0), dict.fromkeys(sizes, 0)
    source = {d: s for d, _, s in rows}
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - float(target[s])) <= 1e-9 * max(1, r.target)
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r.size
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    for s, t in target.items():
        assert abs(taken[s] - t) <= largest[s] + 1e-6, s


@pytest.mark.parametrize("seed", range(4))
def test_targets_and_taken(spark, seed):
    r = random.Random(seed)
    names = ["b", "a", "Ω", "Z", None, "", "a1"]
    rows = [(i, r.choice([None, "", "w " * r.randint(0, 60), " x\ty\n"]), r.choice(names[: 2 + seed * 2])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("size", F.lit("clash")).withColumn("src", F.lit(1))
    got = mixing.mix(docs).collect()
    check(rows, got)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()))
    mix = mixing.mixed(docs)
    assert mix.columns == docs.columns
    assert {(x.doc_id, x["count"]) for x in mix.groupBy("doc_id").count().collect()} == {(x.doc_id, x.copies) for x in got if x.copies}


def test_edge_rows(spark):
    rows = [(None, "a b", "s"), (1, "a b", "s"), (1, "a b", "s"), (1, None, None), (2, "x" * 300_000, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.mix(docs).collect()
    assert len(got) == 5 and sum(r.size for r in got) == 7
    assert mixing.mixed(docs).count() == sum(r.copies for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixed(docs.limit(0)).count() == 0
    nothing = spark.createDataFrame([(1, None, "s"), (2, "", "t")], "doc_id bigint, text string, source string")
    assert {(r.target, r.taken) for r in mixing.mix(nothing).collect()} == {(0.0, 0)}


def test_against_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = sorted(map(tuple, mixing.mix(docs).collect()))
    assert got == sorted(con.sql(mixing.ORACLE).fetchall())
    check([(r.doc_id, r.text, r.source) for r in docs.collect()], mixing.mix(docs).collect())
