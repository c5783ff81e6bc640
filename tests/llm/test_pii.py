import hashlib
import re

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemill.llm import boosting, pii


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    text = text or ""
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 14 <= len(digits) <= 19 and luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


@pytest.fixture(scope="module")
def model(spark):
    return pii.train(spark)


def check(spark, model, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in pii.personal_data(docs, model=model).collect():
        want = brute(texts[r.doc_id])
        joined = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in want)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(w[3] == k for w in want) for k in PLAIN), texts[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), (texts[r.doc_id], r.spans, joined)
        assert [s for s in r.spans.split(",") if s.split(":")[0] in PLAIN] == [s for s in joined.split(",") if s] or not joined
        starts = [int(s.split(":")[1]) for s in r.spans.split(",") if s]
        assert starts == sorted(starts)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["a", "Z", "@", ".", "-", " ", "+", "1", "23", "255", "4", "(", ")", "_", "é", "🙂", "x@y.z", "4111 1111 1111 1111", "1.2.3.4", "+1 (017) 555-7713", "\n"]), max_size=14).map("".join), min_size=40, max_size=40))
def test_base_against_plain_patterns(spark, model, texts):
    check(spark, model, texts)


def test_edges(spark, model):
    texts = [None, "", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.0255", "4111111111111111", "4111-1111 1111-1111", "4111--1111 1111 1111", "1 4111111111111111",
             "+1234567890", "++12 34567890-", "+1 (2) 3", "x" * 200_000, "1" * 50_000, "1 " * 20_000, "a." * 20_000, "-" * 50_000 + "a@b.co", "é🙂 a@b.co 🙂 10.0.0.1", "1.1.1.1 " * 300]
    check(spark, model, texts)


def test_whole_table(spark, model, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    check(spark, model, [r.text for r in rows])


def test_added_spans(spark, model):
    texts = ['the token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" here', "plain words and nothing more in this text", "call 555-123-4567 now", "the commit 04dbebab91ab85687d33eeaaf9ac699e1188f962 is fine", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("base", F.lit(1)).withColumn("s", F.lit("x"))
    got = {r.doc_id: r.spans for r in pii.personal_data(docs, model=model).collect()}
    assert got[0] == "secret:13:53" and got[1] == "" and got[2] == "line:5:17" and got[4] == ""
    assert pii.personal_data(docs.limit(0), model=model).count() == 0


def test_held_out_precision(spark, model):
    rows = pii.examples(1300, seed=99)
    docs = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(rows)], "doc_id bigint, text string")
    right = chosen = private = caught = 0
    for r in pii.spans(docs, model).collect():
        _, a, b, label = rows[r.doc_id]
        hits = [x for x in [*r.base, *r.extra] if x.s < b and a < x.e]
        chosen += bool(hits)
        right += bool(hits) and label
        private += label
        caught += bool(hits) and label
    assert right / chosen > 0.9 and caught / private > 0.75


def test_boosting_learns_and_its_column_agrees(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 10, (900, 3)).astype(float)
    y = ((x[:, 0] > 4) ^ (x[:, 1] > 6)).astype(float)
    model = boosting.boost(x, y)
    p = model.probability(x)
    assert ((p > 0.5) == y).mean() > 0.97
    table = spark.createDataFrame(x[:50].tolist(), "a double, b double, c double")
    got = [r.p for r in table.select(model.column({0: F.col("a"), 1: F.col("b"), 2: F.col("c")}).alias("p")).collect()]
    assert np.allclose(got, p[:50])
    assert boosting.threshold(np.array([0.9, 0.8, 0.7]), np.array([1.0, 1.0, 0.0]), 0.95) == 0.8
