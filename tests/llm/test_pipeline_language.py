import corpus_pipeline
from tidemill.llm import language


def kept(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert language.fit(docs).languages == []
    out = corpus_pipeline.identify_language(spark, docs, "")
    assert out.columns == docs.columns
    return sorted(r.doc_id for r in out.collect())


def test_stage_keeps_texts_when_no_language_is_labelled(spark):
    texts = ["the cat", None, "", "12 %%", "中文", "x" * 70_000, "é"]
    assert kept(spark, [(i, t, None, "s", 0) for i, t in enumerate(texts)]) == [0, 4, 5, 6]


def test_stage_keeps_texts_when_labelled_rows_cannot_be_learned_from(spark):
    long = [(1, "word " * 20_000, "en", "s", 0), (2, "", "en", "s", 0), (3, "plain text", None, "s", 0)]
    assert kept(spark, long) == [1, 3]
