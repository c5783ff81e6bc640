"""The pipeline's stages, one after the other, against brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import sentencepiece
from test_mixing import water, words
from test_simhash import brute_components, brute_fingerprint

import corpus_pipeline
from tidemill.llm import sentencepiece as ours

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=ours.MODEL)


def plain(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = docs.limit(120)
    extra = spark.createDataFrame([(90001, None, "en", "s", 0), (90002, "12 %%", None, None, 5), (90003, "", "en", "s", 0)], docs.schema)
    copy = base.where("doc_id % 10 = 0").withColumn("doc_id", base["doc_id"] + 100_000)
    rows = base.unionByName(extra).unionByName(copy).unionByName(base.where("doc_id % 15 = 0"))
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    before = spark.read.parquet(str(tmp_path / "documents.parquet"))
    held = [r.asDict() for r in before.collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact dedup", "near dedup", "mixing", "tokens"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, str(tmp_path)).write.parquet(str(tmp_path / f"stage-{k}"))
        before = spark.read.parquet(str(tmp_path / f"stage-{k}"))
        out = [r.asDict() for r in before.collect()]
        key = lambda r: (r["doc_id"], r["text"])
        if name == "language":
            assert Counter(map(key, out)) == Counter(key(r) for r in held if any(map(str.isalpha, r["text"] or "")))
        elif name == "exact dedup":
            best = {}
            for r in sorted(held, key=lambda r: (-len(r["text"]), r["doc_id"])):
                best.setdefault(plain(r["text"]), key(r))
            assert Counter(map(key, out)) == Counter(best.values())
        elif name == "near dedup":
            found = brute_components([(r["doc_id"], brute_fingerprint(r["text"])) for r in held])
            assert sorted(r["doc_id"] for r in out) == sorted({c for _, _, c in found})
        elif name == "mixing":
            sizes, taken, largest = Counter(), Counter(), Counter()
            for r in held:
                sizes[r["source"]] += words(r["text"])
                largest[r["source"]] = max(largest[r["source"]], words(r["text"]))
            for r in out:
                taken[r["source"]] += words(r["text"])
            for s, t in water(sizes).items():
                assert abs(taken[s] - t) <= largest[s]
            assert max(Counter(r["doc_id"] for r in out).values()) <= 3
        else:
            texts = {r["doc_id"]: r["text"] for r in held}
            assert Counter(r["doc_id"] for r in out) == Counter(r["doc_id"] for r in held)
            for r in out:
                want = LIBRARY.encode(texts[r["doc_id"]])
                assert r["ids"] == want and r["round_trip"] and r["ids_sha256"] == hashlib.sha256(np.array(want, "<i4").tobytes()).hexdigest()
        if k < 4:
            assert before.columns == docs.columns
        held = out


def test_run_on_an_empty_table(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
