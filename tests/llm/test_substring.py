import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemill.llm import substring


def brute(rows, window=35):
    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    seen = {}
    for _, words in split:
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            seen[key] = seen.get(key, 0) + 1
    out = []
    for d, words in split:
        gone = set()
        for i in range(len(words) - window + 1):
            if seen[tuple(words[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((d, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def run(docs, **parameters):
    return sorted((tuple(r) for r in substring.remove_repeats(docs, **parameters).collect()), key=str)


def test_cover():
    assert substring.is_cover(substring.COVER, substring.PERIOD)
    assert not substring.is_cover((0, 1, 2), 21)
    for i in range(21):
        for j in range(21):
            assert any((i + d) % 21 in substring.COVER and (j + d) % 21 in substring.COVER for d in range(21))


@pytest.mark.parametrize("block", [40, 1 << 19])
def test_planted_passages(spark, block):
    r = random.Random(5)
    word = lambda: r.choice(["é", "a", "b", "c", "Dd"]) + str(r.randint(0, 400))
    passages = [[word() for _ in range(n)] for n in (34, 35, 36, 50, 90)]
    rows = []
    for i in range(60):
        words = [word() for _ in range(r.randint(0, 80))]
        for _ in range(r.randint(0, 3)):
            at = r.randint(0, len(words))
            words[at:at] = r.choice(passages)
        rows.append((i, r.choice([" ", "\n", "\t "]).join(words)))
    rows += [(60, "w " * 200), (61, None), (62, ""), (None, rows[3][1]), (63, rows[4][1]), (64, rows[4][1]), (64, rows[4][1]), (65, "z" * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("found", F.lit(3)).withColumn("text_key", F.lit("x"))
    assert run(docs, block=block) == brute(rows)
    kept = {r.doc_id: r.kept for r in substring.remove_repeats(docs, keep_text=True).where("doc_id in (60, 61)").collect()}
    assert kept == {60: "", 61: ""}


def test_other_windows(spark):
    r = random.Random(6)
    rows = [(i, " ".join(r.choice("abc") for _ in range(r.randint(0, 60)))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert run(docs, window=9, period=7, cover=(0, 1, 3)) == brute(rows, 9)
    with pytest.raises(ValueError):
        substring.remove_repeats(docs, window=9, period=7, cover=(0, 1))


def test_homes_agree():
    ids = [5, -7, 2**40]
    objects = substring._column([*ids, None, "x"])
    assert substring._homes(substring._column(ids), 1000).tolist() == substring._homes(objects, 1000).tolist()[:3]


def test_text_ids(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([("a", text), ("b", text + " more"), (None, "short"), ("b", "x")], "doc_id string, text string")
    assert run(docs) == brute([tuple(r) for r in docs.collect()])


def test_empty(spark):
    assert run(spark.createDataFrame([], "doc_id bigint, text string")) == []


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert run(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])
