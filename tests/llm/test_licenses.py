import random
import re

from pyspark.sql import functions as F

from tidemill.llm import licenses

SCANNER = licenses.Scanner()


def brute(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    places = []
    for label, phrase in licenses.PHRASES:
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_statistics_against_brute_force():
    r = random.Random(1)
    sequences = [[r.randint(0, 3) for _ in range(r.randint(1, 12))] for _ in range(6)]
    automaton = licenses.Automaton(sequences)
    inside = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i, len(s) + 1)}
    for _ in range(200):
        text = [r.randint(0, 4) for _ in range(20)]
        for i, (state, length) in enumerate(automaton.statistics(text), 1):
            best = max(n for n in range(i + 1) if tuple(text[i - n : i]) in inside)
            assert length == best
            ends = {(t, e) for t, s in enumerate(sequences) for e in range(length, len(s) + 1) if s[e - length : e] == text[i - length : i]}
            assert not length or set(automaton.ends[state]) == ends


def check(rows, got):
    for r in got:
        want = brute(rows[r.doc_id])
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == want
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))


def test_base_places(spark):
    r = random.Random(2)
    bits = ["MIT", "license", "License,", "apache", "general", "GENERAL public", "public", "the", "wörd", "mit-license", "x1", "..", "\n"]
    rows = {i: " ".join(r.choice(bits) for _ in range(r.randint(0, 30))) for i in range(300)}
    rows |= {300: None, 301: "", 302: "mit license " * 20_000, 303: "MITLICENSE mit\x00license", 304: "a" * 200_000}
    docs = spark.createDataFrame(list(rows.items()), "doc_id bigint, text string").withColumn("labels", F.lit(1)).withColumn("spans", F.lit("s"))
    got = licenses.scan(docs).collect()
    assert len(got) == len(rows)
    check(rows, got)
    assert licenses.scan(docs.limit(0)).count() == 0


def test_templates(spark):
    notice = dict(licenses.TEMPLATES[::-1])["mit"]
    long = licenses.TEMPLATES[1][1]
    cut = " ".join(long.split()[:20] + ["some", "words", "between"] + long.split()[20:45])
    texts = {0: f"before {long} after", 1: cut.upper(), 2: " ".join(long.split()[:10]), 3: "x\nLicensed under CC BY-NC 4.0.", 4: notice, 5: "the of and this is with free"}
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()}
    assert got[0].labels == "mit" and got[0].base_labels == "" and got[0].score == 1.0
    assert [(s.label, s.first_word, s.end_word) for s in got[0].spans if s.covered == 1.0] == [("mit", 1, 1 + len(licenses.words_of(long.encode())))]
    assert got[1].labels == "mit" and got[2].labels == "" and 0 < got[2].score < 0.75
    assert got[3].labels == "cc-by-nc" and got[4].labels == got[4].base_labels == "mit" and got[5].labels == "" and got[5].score == 0


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = licenses.scan(docs).collect()
    rows = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == len(rows)
    check(rows, got)
