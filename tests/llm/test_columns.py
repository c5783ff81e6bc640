"""Extra columns of any names and types come back as they were."""

import pytest
from pyspark.sql import functions as F

from tidemill.llm import exact, language, mixing, sentencepiece, shingles, simhash

NAMES = ["_nth", "nth", "sha", "points", "kept_id", "kept_sha", "kept_points", "mix_id", "mix_a", "copies", "key_a", "copy", "text_key", "_text_key", "_sha", "_points", "_key", "_copies", "key", "last", "id", "_salt", "score"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "the dog and the cat sat on a mat", "en", "s"), (2, "der hund und die katze", "de", None), (2, "der hund und die katze", "de", None), (3, None, None, "s"), (None, "", "en", "t")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    df = df.withColumns({n: F.concat(F.lit(n), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for n in NAMES})
    return df.withColumn("m", F.create_map(F.lit("k"), F.col("doc_id"))).withColumn("deep", F.array(F.struct(F.create_map(F.lit(1), F.col("lang")).alias("x"))))


STAGES = [exact.deduplicated, mixing.mixed, simhash.representatives, shingles.representatives]


@pytest.mark.parametrize("stage", STAGES)
def test_columns_stay(docs, stage):
    want = [r.asDict(recursive=True) for r in docs.collect()]
    out = stage(docs)
    assert out.columns == docs.columns
    got = [r.asDict(recursive=True) for r in out.collect()]
    assert got and all(r in want for r in got)
    assert stage(docs.limit(0)).count() == 0


def test_named_columns_are_replaced(docs):
    clash = docs.withColumns({"lang_pred": F.lit(7), "ids": F.lit("x"), "n_pieces": F.lit("y")})
    found = language.predicted(clash, language.fit(clash)).collect()
    assert len(found) == 5 and {r.lang_pred for r in found} == {"en", "de", "und"}
    rows = sentencepiece.encoded(clash).collect()
    assert all(len(r.ids) == r.n_pieces for r in rows)
