from pyspark.sql import functions as F
from test_spotsigs import brute_signatures

from tidemill.llm import spotsigs


def test_all_common_words_are_anchors(spark):
    assert len(set(spotsigs.ANCHORS)) == 89
    texts = [f"{w} cat sat" for w in dict.fromkeys(spotsigs.ANCHORS)] + [f"{w}x cat sat" for w in spotsigs.ANCHORS]
    texts += ["in cat dog", "inn cat dog", "for cat dog"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.n for r in docs.select("doc_id", F.size(spotsigs.signatures(F.concat("text", F.lit(" the end ran")))).alias("n")).collect()}
    assert got == {d: len(brute_signatures(f"{t} the end ran")) for d, t in enumerate(texts)}


def test_chains_go_on_behind_many_common_words(spark):
    texts = ["the " * k + "cat dog" for k in (1, 25, 26, 100, 100_000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = docs.select("doc_id", spotsigs.signatures(F.col("text")).alias("s")).collect()
    # One chain each: the anchor and the same two words.
    assert len({tuple(r.s) for r in rows}) == 1 and len(rows) == 5
