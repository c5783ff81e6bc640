import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemill.llm import simhash
from tidemill.llm.common import components


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, radius=4):
    fps = sorted({f for _, f in rows})
    parent = {f: f for f in fps}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= radius:
                parent[root(a)] = root(b)
    low = {}
    for d, f in rows:
        if d is not None:
            low[root(f)] = min(d, low.get(root(f), d))
    return sorted(((d, f"{f:016x}", low.get(root(f))) for d, f in rows), key=str)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "cé", " ", "\t", "\n", "\x0b", " ", "word "])))
def test_fingerprint(parts):
    text = "".join(parts)
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


def test_segments_leave_one_open_bit():
    assert [n for _, n in simhash.segments(4)] == [21, 21, 22]
    assert sum(n for _, n in simhash.segments(3)) == 64


def test_edge_rows(spark):
    base = "one two three four five six seven eight nine ten " * 40
    rows = [(5, base), (3, base), (9, base + "eleven"), (1, None), (2, ""), (7, "A b"), (8, "a  B"), (None, base), (6, "x" * 300_000), (3, base)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("fp", F.lit("clash")).withColumn("key", F.lit(None).cast("int"))
    got = sorted((tuple(r)[:3] for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == brute_components([(d, brute_fingerprint(t)) for d, t in rows])
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_dense_ball_is_one_component_without_all_pairs(spark):
    rng = np.random.default_rng(1)
    center = int(rng.integers(1 << 63))
    fps = {center}
    for _ in range(400):
        f = center
        for b in rng.integers(0, 12, 3):
            f ^= 1 << int(b)
        fps.add(f)
    fps |= {int(x) for x in rng.integers(0, 1 << 62, 300)} | {center ^ (0xF << 40), center ^ (0xFF << 40)}
    rows = [(i, f) for i, f in enumerate(sorted(fps))]
    table = spark.createDataFrame([(int(np.uint64(f).view(np.int64)), i) for i, f in rows], "fp bigint, doc_id bigint")
    got = {r.fp: r.component_id for r in simhash.classes(table).collect()}
    want = {f: c for (_, f), (_, _, c) in zip(sorted(rows, key=lambda r: str((r[0], f"{r[1]:016x}"))), brute_components(rows), strict=True)}
    assert {np.int64(k).view(np.uint64).item(): v for k, v in got.items()} == {f: want[f] for _, f in rows}


def test_blocks_change_nothing(spark):
    rng = np.random.default_rng(2)
    fps = {int(x) for x in rng.integers(0, 1 << 63, 40)}
    for f in list(fps):
        g = f
        for b in rng.choice(64, 4, replace=False):
            g ^= 1 << int(b)
        fps |= {g, g ^ 1 << 5, g ^ 1 << 63}
    rows = [(i, f) for i, f in enumerate(sorted(fps))]
    table = spark.createDataFrame([(int(np.uint64(f).view(np.int64)), i) for i, f in rows], "fp bigint, doc_id bigint")
    want = {f: c for (_, f), (_, _, c) in zip(sorted(rows, key=lambda r: str((r[0], f"{r[1]:016x}"))), brute_components(rows), strict=True)}
    for blocks in (1, 5):
        got = {np.int64(r.fp).view(np.uint64).item(): r.component_id for r in simhash.classes(table, blocks=blocks).collect()}
        assert got == {f: want[f] for _, f in rows}


def test_components_of_a_long_path(spark):
    n = 300
    edges = spark.createDataFrame([(i * 7 % n, (i + 1) * 7 % n) for i in range(n - 1)], "a bigint, b bigint")
    got = components(edges).collect()
    assert {r.node for r in got} == set(range(1, n)) and {r.root for r in got} == {0}
    assert components(edges.limit(0)).count() == 0


def test_whole_table_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = sorted((tuple(r) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == brute_components([(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()])
