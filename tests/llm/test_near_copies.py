"""The pipeline's near dedup goes through SimHash first; what fingerprints miss is found by the exact rest."""

from itertools import pairwise

import numpy as np
import pytest
import xxhash
from test_shingles import brute_kept, brute_set, texts

import corpus_pipeline
from tidemill.llm import shingles, simhash

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CUTS = list(pairwise(range(0, 65, 16)))


def meet(x, y, bits=16):
    """Whether fingerprints differ by at most one bit in one of four segments and by at most `bits` in all."""
    d = x ^ y
    return d.bit_count() <= bits and any((d >> a & (1 << b - a) - 1).bit_count() <= 1 for a, b in CUTS)


def brute_fingerprint(found):
    hashes = [xxhash.xxh64_intdigest(b" ".join(s), 42) for s in found]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_links_found_by_fingerprints_alone(spark, monkeypatch):
    rows = texts(5)
    sets = sorted({s for s in (brute_set(t) for _, t in rows) if s}, key=sorted)
    fps = [brute_fingerprint(s) for s in sets]
    alike = [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    parent = list(range(len(sets)))

    def root(i):
        return i if parent[i] == i else root(parent[i])

    for i, j in alike:
        if meet(fps[i], fps[j]):
            parent[root(i)] = root(j)
    want = len({root(i) for i in range(len(sets))}) + 1
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], DOCS)
    whole = sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect())
    assert whole == brute_kept(rows)
    # Without the rest, what the stage joins is what fingerprints lead to, confirmed on the sets.
    monkeypatch.setattr(shingles, "linked", lambda buckets, near, by, about, may, known: known)
    found = [r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    assert len(found) == want
    assert len(whole) < want < len(sets) + 1


def test_sets_brought_together_without_telling_every_task(spark, monkeypatch):
    rows = texts(7)
    monkeypatch.setattr(shingles, "TOLD", -1)
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], DOCS)
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == brute_kept(rows)


@pytest.mark.parametrize("bits", [6, 16])
def test_candidates_against_brute_force(spark, bits):
    rng = np.random.default_rng(3)
    fps = []
    for f in (int(x) for x in rng.integers(0, 1 << 63, 40)):
        fps += [f, f]
        for n in (1, 4, 9, 14):
            g = f
            for b in rng.choice(64, n, replace=False):
                g ^= 1 << int(b)
            fps.append(g)
    least = {f: fps.index(f) for f in fps}
    want = {(least[f], i) for i, f in enumerate(fps) if least[f] != i}
    want |= {tuple(sorted((least[f], least[g]))) for f in least for g in least if f != g and meet(f, g, bits)}
    table = spark.createDataFrame([(i, int(np.uint64(f).view(np.int64))) for i, f in enumerate(fps)], "node bigint, fp bigint")
    got = sorted(map(tuple, simhash.candidates(table, 6, bits).collect()))
    assert got == sorted(want)
    assert simhash.candidates(table.limit(0), 6, bits).count() == 0
