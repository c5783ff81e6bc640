"""The encoder's memory doesn't grow with the words of a batch of texts, and workers don't send texts back unasked."""

import random
import resource
import sys
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tidemill.llm import language
from tidemill.llm import sentencepiece as ours
from tidemill.llm.common import give_back

with open(ours.MODEL, "rb") as f:
    MODEL = ours.Model.parse(f.read())


def test_a_batch_of_texts_is_not_held_word_by_word():
    draw = random.Random(3)
    words = ["".join(draw.choices("abcdefghij", k=draw.randint(2, 9))) for _ in range(1000)]
    texts = [" ".join(draw.choices(words, k=2000)) for _ in range(200)]
    codec = ours.Codec(MODEL)
    codec.encode([" ".join(words)])
    tracemalloc.start()
    try:
        ids = codec.encode(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert [codec.decode(i.tolist()) for i in ids] == texts
    assert peak < 2 * sum(i.nbytes for i in ids) + 1_000_000


def test_a_remembered_word_takes_four_bytes_a_piece():
    codec = ours.Codec(MODEL)
    words = [f"w{k}x{k * k}" for k in range(2000)] + ["\x00͸", "é\U0010fffd", "▁"]
    ids = codec.encode(words)
    pieces = sum(map(len, ids))
    held = sum(sys.getsizeof(v) for v in codec.memory.values())
    assert held <= 4 * pieces + 64 * len(codec.memory)
    assert all(i.dtype == np.int32 for i in ids)


@pytest.mark.parametrize("with_ids", [True, False])
def test_the_text_stays_out_if_not_asked_for(spark, with_ids):
    docs = spark.createDataFrame([(1, "one two  three", "x"), (2, None, "y"), (3, "", None), (3, "", None)], "doc_id long, text string, other string")
    whole, less = ours.encoded(docs, with_ids=with_ids), ours.encoded(docs, with_ids=with_ids, with_text=False)
    assert less.columns == [c for c in whole.columns if c != "text"]
    key = lambda r: str(r)
    assert sorted(less.collect(), key=key) == sorted(whole.drop("text").collect(), key=key)


def test_free_memory_of_a_worker_goes_back():
    def resident() -> int:
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * resource.getpagesize()

    held = [np.ones(1 << 13) for _ in range(2000)] + [pa.array(np.ones(1 << 20)).cast(pa.float32()) for _ in range(8)]
    last = np.ones(1 << 13)  # on top of the rest, which stays with the process when freed
    full = resident()
    del held
    give_back()
    assert full - resident() > 100 << 20 and last.sum() == 1 << 13


def test_limits_of_languages_need_no_python_worker(spark, monkeypatch):
    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return df

    monkeypatch.setattr(language.F, "broadcast", seen)
    docs = spark.createDataFrame([(k, f"some text {k}", "en" if k % 2 else "de") for k in range(40)], "doc_id long, text string, lang string")
    assert {lang for _, lang in language.sample(docs)} == {"en", "de"}
    assert plans and all("LocalRelation" in p and "RDD" not in p for p in plans)
