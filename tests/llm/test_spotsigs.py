import hashlib
import random
import re

from pyspark.sql import functions as F

from tidemill.llm import spotsigs


def brute_signatures(text):
    """The chains of a text as tuples; the whole text where there is none."""
    words = re.findall(r"[^\W_]+", text.lower())
    out = set()
    for i, w in enumerate(words):
        if w not in spotsigs.ANCHORS:
            continue
        chain, at = [w], i + 1
        while len(chain) <= spotsigs.CHAIN:
            before = at
            while at < len(words) and words[at] in spotsigs.ANCHORS:
                at += 1
            if at == len(words) or at - before > spotsigs.PASSED:
                break
            chain.append(words[at])
            at += 1
        if len(chain) == spotsigs.CHAIN + 1:
            out.add(tuple(chain))
    return frozenset(out) or frozenset([tuple(words)])


def jaccard(a, b):
    return len(a & b) / len(a | b)


def brute(rows):
    """rows: {doc_id: text} with single ids."""
    order = sorted(rows, reverse=True)
    out = {}
    for k, d in enumerate(order):
        text, nxt = rows[d] or "", rows[order[(k + 1) % len(order)]] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + nxt[:cut]
        own = brute_signatures(text)
        out[d] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), jaccard(own, brute_signatures(edited)), jaccard(own, brute_signatures(nxt)))
    return out


def check(rows, got):
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        n, sha, near_edited, near_next = want[r.doc_id]
        assert (r.n_chars, r.edited_sha256) == (n, sha)
        assert abs(r.near_edited - near_edited) < 1e-12 and abs(r.near_next - near_next) < 1e-12
        assert (r.fingerprint == r.edited_fingerprint) == (r.near_edited == 1.0)
    prints = {}
    for r in got:
        assert prints.setdefault(rows[r.doc_id] or "", r.fingerprint) == r.fingerprint


def test_against_brute_force(spark):
    r = random.Random(4)
    words = [*spotsigs.ANCHORS[:8], "Hund", "katze", "ñandú", "x1", "..", "--", "\n", "中文"]
    rows = {i * 3: " ".join(r.choice(words) for _ in range(r.randint(0, 40))) for i in range(120)}
    rows |= {1000: None, 1001: "", 1002: "the " * 20, 1003: "🙂 the cat sat", 1004: rows[3], 5: "of the dog and cat " * 20_000}
    docs = spark.createDataFrame(list(rows.items()), "doc_id bigint, text string").withColumn("key", F.lit(1)).withColumn("sigs", F.lit("x"))
    check(rows, spotsigs.edited_likeness(docs).collect())


def test_repeated_and_null_ids(spark):
    rows = [(2, "the cat sat on"), (2, "a cat"), (2, "a cat"), (None, "the dog ran"), (1, "xyz")]
    got = spotsigs.edited_likeness(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted((r.n_chars, r.edited_sha256) for r in got) == sorted([(14, sha("the cat sa" + "xyz")), (5, sha("a cax")), (5, sha("a cax")), (11, sha("the dog " + "a c")), (3, sha("xyt"))])
    alone = spotsigs.edited_likeness(spark.createDataFrame([(7, "abc def")], "doc_id bigint, text string")).first()
    assert alone.edited_sha256 == sha("abc d" + "ab") and alone.near_next == 1.0
    assert spotsigs.edited_likeness(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_whole_table(spark, sf_dir):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    check(rows, spotsigs.edited_likeness(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect())


def brute_classes(rows, threshold=0.8):
    sets = {d: brute_signatures(t or "") for d, t in rows}
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if jaccard(sets[a], sets[b]) >= threshold - 1e-9:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: root(d) for d in ids}


def test_near_duplicates(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("bcdfgh") for _ in range(4))
    rows, n = [], 0
    for _ in range(12):
        base = " ".join(x for _ in range(r.randint(2, 40)) for x in ("the", word(), word()))
        for k in range(r.randint(1, 9)):
            parts = base.split()
            for _ in range(k % 4):
                parts[r.randrange(len(parts))] = word()
            rows.append((n, " ".join(parts)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {x.doc_id: x.component_id for x in spotsigs.near_duplicates(docs).collect()} == brute_classes(rows)
    assert spotsigs.near_duplicates(docs.limit(0)).count() == 0
