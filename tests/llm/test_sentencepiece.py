import hashlib
import struct

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemill.llm import sentencepiece as ours

RAW = open(ours.MODEL, "rb").read()
CODEC = ours.Codec(ours.Model.parse(RAW))
LIBRARY = sentencepiece.SentencePieceProcessor(model_proto=RAW)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abehtinors  \n\té中🙂A.,0") | st.characters(exclude_categories=["Cs"], exclude_characters="▁\0"), max_size=60))
def test_bpe_against_the_library(text):
    (ids,) = CODEC.encode([text])
    assert ids.tolist() == LIBRARY.encode(text)
    assert CODEC.decode(ids.tolist()) == text == LIBRARY.decode(ids.tolist())


@pytest.mark.parametrize("text", ["", " ", "   ", "a" * 3000, "a b" * 3000, " " * 500 + "x", "the  of   and", "\n\n", "x" * 63 + "y" * 63, "ñandú über été"])
def test_bpe_edges(text):
    (ids,) = CODEC.encode([text])
    assert ids.tolist() == LIBRARY.encode(text)
    assert CODEC.decode(ids.tolist()) == text


def unigram_model(byte_fallback):
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def field(number, value):
        if isinstance(value, int):
            return varint(number << 3) + varint(value)
        if isinstance(value, float):
            return varint(number << 3 | 5) + struct.pack("<f", value)
        return varint(number << 3 | 2) + varint(len(value)) + value

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    if byte_fallback:
        pieces += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    for k, p in enumerate(["▁", "t", "h", "e", "a", "n", "d", "th", "he", "▁the", "▁an", "and", "▁a", "nd", "en", "ate", "hen", "▁▁", "é"]):
        pieces.append((p, -1.0 - ((k * 37) % 19) / 3.7 - (3.0 if len(p) == 1 else 0), 1))
    body = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, k)) for p, s, k in pieces)
    trainer = field(3, 1) + field(35, int(byte_fallback))
    return body + field(2, trainer) + field(3, field(1, b"identity") + field(3, 1) + field(4, 0) + field(5, 1))


@pytest.mark.parametrize("byte_fallback", [False, True])
def test_viterbi_against_the_library(byte_fallback):
    raw = unigram_model(byte_fallback)
    library, codec = sentencepiece.SentencePieceProcessor(model_proto=raw), ours.Codec(ours.Model.parse(raw))
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("thean d é中"), rng.integers(0, 40))) for _ in range(400)]
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        assert ids.tolist() == library.encode(text)
        assert not byte_fallback or codec.decode(ids.tolist()) == text


def test_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in ours.digests(docs).collect():
        want = LIBRARY.encode(texts[r.doc_id])
        assert (r.n_pieces, r.ids_sha256) == (len(want), hashlib.sha256(np.array(want, "<i4").tobytes()).hexdigest())
        assert r.round_trip and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, 5), (None, "", None), (1, "a b", 1), (1, "a b", 1)], "doc_id bigint, text string, extra int")
    rows = ours.encoded(docs).collect()
    assert sorted((r.doc_id or 0, r.n_pieces, r.ids) for r in rows) == [(0, 0, []), (1, 0, []), (1, 2, LIBRARY.encode("a b")), (1, 2, LIBRARY.encode("a b"))]
    assert ours.digests(docs.limit(0)).count() == 0
