from pyspark.sql import functions as F
from test_pii import brute

from tidemill.llm import pii


def test_long_domains_and_tokens(spark):
    domain = "x@a" + ".b" * 100_000
    token = "Ab3/" * 50_000
    texts = [f"mail {domain} end", "x@a" + ".b" * 1001, f'token = "{token}="', "k" * 513, "k" * 15]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    secret = dict(pii.GENERATORS)["secret"]
    rows = docs.select("doc_id", pii.found("text", pii.EMAIL).alias("email"), pii.found("text", secret).alias("secret")).orderBy("doc_id").collect()
    for r in rows:
        assert [(x.s, x.e) for x in r.email] == [(s, e) for s, _, e, kind in brute(texts[r.doc_id]) if kind == "email"]
    assert [(x.s, x.e) for x in rows[2].secret] == [(9, 9 + len(token) + 1)]
    assert [[(x.s, x.e) for x in r.secret] for r in rows[3:]] == [[(0, 513)], []]
