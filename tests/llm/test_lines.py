import hashlib
import random
import re

import duckdb
from pyspark.sql import functions as F

from tidemill.llm import lines


def brute(rows, window=3, words=10):
    seen, out = {}, []
    split = [(d, t.split("\n") if t is not None else []) for d, t in rows]
    for d, ls in sorted(split, key=lambda x: (x[0] is None, x[0] or 0)):
        gone, counts = set(), [len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in ls]
        for i in range(len(ls)):
            n = next((k for k in range(1, window + 1) if sum(counts[i : i + k]) >= words), window)
            if i + n > len(ls) or not any(counts[i : i + n]):
                continue
            key = tuple(ls[i : i + n])
            if key in seen:
                gone.update(range(i, i + n))
            seen.setdefault(key, (d, i))
        kept = "\n".join(x for i, x in enumerate(ls) if i not in gone)
        out.append((d, len(ls), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def run(docs, **parameters):
    return sorted((tuple(r)[:4] for r in lines.remove_repeated_lines(docs, **parameters).collect()), key=str)


def test_against_brute_force(spark):
    r = random.Random(3)
    runs = [[f"line {r.randint(0, 99)}" for _ in range(n)] for n in (2, 3, 4, 9)]
    rows = []
    for i in range(80):
        ls = [r.choice(["", "a", f"x{r.randint(0, 500)}"]) for _ in range(r.randint(1, 12))]
        for _ in range(r.randint(0, 2)):
            at = r.randint(0, len(ls))
            ls[at:at] = r.choice(runs)
        rows.append((r.choice([-1, 1]) * (i + 1), "\n".join(ls)))
    long = [" ".join(f"w{r.randint(0, 9)}" for _ in range(n)) for n in (5, 6, 10, 30)]
    rows += [(600 + i, "\n".join(r.choice([*long, "", " ", "a"]) for _ in range(r.randint(1, 6)))) for i in range(40)]
    rows += [(500, None), (501, ""), (502, "same\n" * 5000), (None, rows[0][1]), (503, "z" * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("mark", F.lit(1)).withColumn("start", F.lit("x"))
    assert run(docs) == brute(rows)
    assert run(docs, window=2) == brute(rows, 2) and run(docs, window=1) == brute(rows, 1)
    assert run(docs, words=5) == brute(rows, 3, 5) and run(docs, words=1000) == brute(rows, 3, 1000)


def test_repeated_rows_are_one_place(spark):
    text = "a\nb\nc\nd"
    docs = spark.createDataFrame([(1, text), (1, text), (2, "x\n" + text)], "doc_id bigint, text string")
    assert sorted(r[2] for r in run(docs)) == [0, 0, 4]
    assert run(docs.limit(0)) == []


def test_one_long_line_is_a_run_and_blank_lines_are_none(spark):
    long = " ".join("abcdefghij")
    docs = spark.createDataFrame([(1, f"x\n{long}\ny"), (2, long), (3, "\n\n\n\n"), (4, "q\n\n\n\n"), (5, long[:-2])], "doc_id bigint, text string")
    assert {r.doc_id: r.n_removed for r in lines.remove_repeated_lines(docs).collect()} == {1: 0, 2: 1, 3: 0, 4: 0, 5: 0}


def test_against_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = run(docs)
    assert got == sorted((tuple(r) for r in con.sql(lines.ORACLE).fetchall()), key=str) == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert sum(r[2] for r in got) > 0
