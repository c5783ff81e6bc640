import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tidemill.llm import exact

ROWS = [
    (5, "a b"), (3, "ab"), (2, " a  b"), (9, "ab "), (1, None), (4, ""), (None, "ab"), (7, "é x"), (8, "éx"), (6, "z" * 200_000), (10, "z" * 200_000),
    (11, "w"), (11, "w"), (11, "w "), (12, "Ab"), (None, "only"), (None, "only"),
]


def brute(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), d is None, d or 0, d))
    out = []
    for plain, members in groups.items():
        members.sort(key=lambda m: m[:3])
        for k, m in enumerate(members):
            out.append((m[3], members[0][3], len(members), k == 0, hashlib.sha256(plain.encode()).hexdigest()))
    return sorted(out, key=str)


def run(docs, **parameters):
    return sorted((tuple(r) for r in exact.exact_duplicates(docs, **parameters).collect()), key=str)


@pytest.mark.parametrize("parameters", [{}, {"memtable": 2}, {"filter_bits": 64}, {"digest_bytes": 1}, {"digest_bytes": 0, "filter_bits": 64}])
def test_against_brute_force(spark, parameters):
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string").withColumn("digest", F.lit("x")).withColumn("best", F.lit(None).cast("int"))
    assert run(docs, **parameters) == brute(ROWS)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert run(docs) == [] and exact.deduplicated(docs).count() == 0


def test_runs_are_sorted_and_merge(spark):
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string").coalesce(1)
    runs = exact.runs(docs, memtable=3)
    digests = [r.digest for r in runs.collect()]
    assert sum(a > b for a, b in zip(digests, digests[1:])) >= 1
    whole = {tuple(r) for r in exact.compact(runs).collect()}
    first, second = exact.compact(exact.runs(docs.where("doc_id < 6"))), exact.runs(docs.where("doc_id >= 6 or doc_id is null"))
    assert {tuple(r) for r in exact.compact(first, second).collect()} == whole


def test_deduplicated_keeps_all_columns(spark):
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string").withColumn("_nth", F.lit(1)).withColumn("kept", F.lit("c"))
    out = exact.deduplicated(docs.withColumnRenamed("_nth", "nth"))
    assert out.columns == ["doc_id", "text", "nth", "kept"]
    want = sorted(str(d) for d, k, _, kept, _ in brute(ROWS) if kept)
    assert sorted(str(r.doc_id) for r in out.collect()) == want


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert run(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])
