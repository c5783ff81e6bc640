import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from tidemill.llm import pii

LINE = "write to u{0}@mail{0}.example.org from 10.0.{1}.{2}, call +1 (555) 010-{3:04d} or token = \"A7f{0:029d}\""


def test_many_matches_in_one_text(spark):
    """Thousands of matches of mixed kinds in one text, by offsets found anew and in little time."""
    text = "\n".join(LINE.format(i, i // 250 % 250, i % 250, i % 10_000) for i in range(5_333))
    docs = spark.createDataFrame([(1, text), (2, "none")], "doc_id bigint, text string").repartition(1)
    model = pii.train(spark)
    pii.personal_data(docs.where("doc_id = 2"), model=model).collect()
    began = time.perf_counter()
    got = {r.doc_id: r for r in pii.personal_data(docs, model=model).collect()}
    took = time.perf_counter() - began
    want = []
    for kind, pattern in (("email", r"u\d+@mail\d+\.example\.org"), ("ip", r"10\.0\.\d+\.\d+"), ("phone", r"\+1 \(555\) 010-\d{4}")):
        want += [(m.start(), ("email", "ip", "card", "phone").index(kind), f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text)]
    assert (got[1].n_email, got[1].n_ip, got[1].n_phone) == (5_333,) * 3
    assert got[1].base_sha256 == hashlib.sha256(",".join(x for _, _, x in sorted(want)).encode()).hexdigest()
    secrets = [m.start(1) for m in re.finditer(r'"(A7f\d+)"', text)]
    found = {int(x.split(":")[1]) for x in got[1].spans.split(",") if x.startswith("secret")}
    assert found == set(secrets)
    assert took < 15


def test_overlaps_against_all_pairs(spark):
    """free() and unlikelier() against all pairs; spans of a kind don't overlap, as matches of one pattern don't."""
    r = random.Random(2)

    def kind(k, most):
        at, out = 0, []
        for _ in range(r.randint(0, most)):
            at += r.randint(0, 20)
            end = at + r.randint(1, 40)
            out.append((at, k, end, r.choice([0.6, 0.7, 0.8])))
            at = end
        return out

    rows = [tuple(kind(k, n) for k, n in enumerate((150, 200, 30))) for _ in range(40)]
    df = spark.createDataFrame(rows, ", ".join(f"k{k} {pii.SPAN}" for k in range(3)))
    got = df.select("*", F.expr(pii.free("k1", "concat(k0, k2)")).alias("free"), F.expr(pii.unlikelier("k1", "k0")).alias("a"), F.expr(pii.unlikelier("k1", "k2")).alias("b")).collect()
    meets = lambda a, b: a.s < b.e and b.s < a.e
    for row in got:
        assert row.free == [a for a in row.k1 if not any(meets(a, b) for b in row.k0 + row.k2)]
        best = lambda others: [a for a in row.k1 if not any(meets(a, b) and (b.p > a.p or b.p == a.p and b.k < a.k) for b in others)]
        assert row.a == best(row.k0) and row.b == best(row.k2)
