import random

import corpus_pipeline
from tidemill.llm import shingles, simhash


def brute_set(text, words=5):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) or frozenset([tuple(w)] if w else [])


def brute_kept(rows):
    """The smallest id of each component of rows (doc_id, text) linked at a Jaccard likeness of 4 / 5, in whole numbers."""
    sets = {d: brute_set(t) for d, t in rows}
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return sorted(d for d in ids if root(d) == d)


def texts(seed):
    """Near copies on both sides of the threshold, a line that all share, and short and empty texts."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("bcdfgh") for _ in range(5))
    line = " ".join(word() for _ in range(30))
    rows = []
    for _ in range(25):
        base = [word() for _ in range(r.randint(3, 300))]
        for _ in range(r.randint(1, 5)):
            near = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 30))):
                near[r.randrange(len(near))] = word()
            rows.append(" ".join(near) + r.choice(["", "\n" + line]))
    # Exactly 4 / 5: eight of ten shingles.
    rows += ["p0 " + " ".join(f"q{i}" for i in range(12)), " ".join(f"q{i}" for i in range(12)) + " p1"]
    return [(i, t) for i, t in enumerate([*rows, "", "a b", "A  b", rows[0]])]


def test_stage_against_brute_jaccard(spark):
    rows = texts(5)
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect())
    assert got == brute_kept(rows)
    # Links of at most four bits leave copies that the threshold asks to go.
    assert len(simhash.representatives(docs).collect()) > len(got)


def test_order_changes_nothing(spark, monkeypatch):
    rows = texts(6)
    monkeypatch.setattr(shingles, "LEAST", 1 << 30)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r.doc_id for r in shingles.representatives(docs).collect()) == brute_kept(rows)


def test_edge_rows(spark):
    rows = [(3, None), (2, ""), (None, "x y"), (None, "z"), (5, "X y"), (5, "X y"), (7, "one two three four five six")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(map(tuple, shingles.representatives(docs).collect()), key=str)
    assert got == sorted([(2, ""), (5, "X y"), (None, "z"), (7, "one two three four five six")], key=str)
    assert shingles.representatives(docs.limit(0)).count() == 0


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = sorted(r.doc_id for r in shingles.representatives(docs).collect())
    assert got == brute_kept([(r.doc_id, r.text) for r in docs.collect()])
