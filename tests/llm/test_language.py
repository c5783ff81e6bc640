import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tidemill.llm import language


def brute_ngrams(text):
    s = [ord(c) if c.isalpha() else 0 for c in text.lower()]
    s = [c for i, c in enumerate(s) if c or i == 0 or s[i - 1]]
    return sorted({(len(g), g) for n in (1, 2, 3) for g in (tuple(s[i : i + n]) for i in range(len(s) - n + 1))})


def test_ngrams_against_brute_force():
    texts = ["The cat -- sat!", "é中🙂 x", "a", "", "  ", "AbAbAb"]
    for t in texts:
        assert len(np.unique(language.ngrams(t))) == len(brute_ngrams(t))


def brute_kernel(a, b):
    """Of two lists of n-gram sets."""
    return np.array([[len(x & y) / np.sqrt(max(1, len(x)) * max(1, len(y))) for y in b] for x in a])


def test_whole_query_against_brute_kernel(spark, sf_dir):
    """All predictions from the kernel's definition: Nystroem features of sets of n-grams, and ridge regression."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    p = language.Parameters(most=30, landmarks=24)
    chosen = language.sample(docs, parameters=p)
    held = {r.doc_id for r in docs.where(language.held_out("doc_id")).collect()}
    by_text = {r.text: r for r in docs.collect() if r.doc_id not in held}
    assert all(by_text[t].lang == lang for t, lang in chosen)
    per = Counter(lang for _, lang in chosen)
    assert per == {lang: min(30, n) for lang, n in Counter(r.lang for r in docs.collect() if r.doc_id not in held and r.text and r.lang).items()}
    langs = sorted(per)
    turns = [[t for t, x in chosen if x == lang] for lang in langs]
    marks = [set(brute_ngrams(ts[i])) for i in range(30) for ts in turns if i < len(ts)][:24]
    sets = [set(brute_ngrams(t)) for t, _ in chosen]
    values, vectors = np.linalg.eigh(brute_kernel(marks, marks))
    root = vectors @ np.diag(1 / np.sqrt(values)) @ vectors.T
    x = brute_kernel(sets, marks) @ root
    y = np.array([[1.0 if lang == k else -1.0 for k in langs] for _, lang in chosen])
    w = np.linalg.solve(x.T @ x + p.ridge * len(x) * np.eye(24), x.T @ y)
    got = {r.doc_id: r for r in language.identify(docs, parameters=p).collect()}
    rows = docs.collect()
    known = [r for r in rows if r.text and any(map(str.isalpha, r.text))]
    want = brute_kernel([set(brute_ngrams(r.text)) for r in known], marks) @ root @ w
    for r, v in zip(known, want, strict=True):
        assert abs(got[r.doc_id].score - min(1, max(0, (v.max() + 1) / 2))) < 0.02
        top = np.sort(v)[-2:]
        assert got[r.doc_id].lang_pred == langs[v.argmax()] or top[1] - top[0] < 0.02
    assert all(got[r.doc_id].lang_pred == "und" for r in rows if r not in known)


def alphabet(start, n, r):
    return [chr(start + i) for i in r.choice(n, 40, replace=False)]


def test_many_languages_and_large_scripts(spark):
    """70 languages are all learned, and late and large scripts keep their n-grams."""
    r = np.random.default_rng(1)
    scripts = {f"l{i:02d}": [chr(0x61 + j) for j in r.choice(26, 9, replace=False)] for i in range(66)}
    scripts |= {"zh": alphabet(0x4E00, 400, r), "ja": alphabet(0x3041, 80, r), "xx": alphabet(0x20000, 400, r), "he": [chr(0x5D0 + j) for j in range(27)]}
    rows = []
    for lang, letters in scripts.items():
        words = ["".join(r.choice(letters, r.integers(2, 5))) for _ in range(30)]
        rows += [(len(rows) + i, " ".join(r.choice(words, 40)), lang) for i in range(24)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.fit(docs)
    assert model.languages == sorted(scripts)
    truth = {d: lang for d, _, lang in rows}
    held = [x for x in language.identify(docs).collect() if x.held_out]
    right = Counter(truth[x.doc_id] for x in held if x.lang_pred == truth[x.doc_id])
    total = Counter(truth[x.doc_id] for x in held)
    assert all(right[k] / total[k] >= 0.9 for k in ("zh", "ja", "xx", "he"))
    assert sum(right.values()) / sum(total.values()) >= 0.9


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.lang_pred != "und"]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.95
    assert Counter(r.lang_pred for r in got)["und"] < 10


def test_labels_of_held_out_rows_and_other_columns_have_no_influence(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plain = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs).collect()}
    changed = docs.withColumn("lang", F.when(language.held_out("doc_id"), "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("zz"))
    assert {r.doc_id: (r.lang_pred, r.score) for r in language.identify(changed).collect()} == plain


def test_edge_rows(spark):
    rows = [(1, "the dog and the cat", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "123 %%", None), (None, "the cat", None), (4, "", "de"), (5, "und die " * 30_000, None), (1, "the dog and the cat", "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("score", F.lit("clash"))
    got = language.identify(docs).collect()
    assert len(got) == len(rows)
    assert sorted((str(r.doc_id), r.lang_pred) for r in got if r.lang_pred == "und") == [("3", "und"), ("4", "und"), ("4", "und")]
    assert {r.lang_pred for r in got if r.doc_id == 5} == {"de"}
    assert language.identify(docs.limit(0)).count() == 0
    unlabelled = language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in unlabelled} == {("und", 0.0)}
