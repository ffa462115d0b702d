"""Pieces and texts against the sentencepiece library."""

import hashlib
import random

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from reeltally.llm import chunks, pieces, queries

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", " ", "  a", "a  b ", "x\ny\t z", "▁q", "é中😀", "<s>a</s>", "<0x0A>", "a\x00b", "﻿a", "\r\n", "ﬁ Ａ", "x" * 500, "word" * 50, " " * 777, "a" + " " * 40 + "b", "日本語テキスト" * 20, "Ａｂ ｃ", "\U0010ffff"]


@pytest.fixture(scope="module")
def data():
    with open(MODEL, "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def lib():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def own(data):
    return pieces.Segmenter(data)


def same(own, lib, texts):
    for text, ids in zip(texts, own.encode_batch(texts)):
        assert ids.tolist() == lib.encode(text, add_bos=True, add_eos=True), text
        assert own.decode(ids) == lib.decode(ids.tolist())


def test_texts(own, lib):
    assert own.apart
    same(own, lib, TEXTS)
    r = random.Random(1)
    same(own, lib, ["".join(r.choice("abcdefgh  éß中Ａ\n\t▁<>0x1😀İ") for _ in range(r.randrange(150))) for _ in range(500)])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=6))
def test_any_text(texts):
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    with open(MODEL, "rb") as f:
        same(pieces.segmenter(f.read()), lib, texts)


def test_long_chunks_and_steps_agree(own):
    r = random.Random(2)
    for _ in range(300):
        text = "".join(r.choice("▁▁▁aehnrst") for _ in range(r.randrange(1, 33)))
        symbols = own.of_char[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        ids, _, _ = own.merged_many(symbols, np.array([0]), np.array([len(symbols)]))
        assert ids.tolist() == own.merged(symbols.tolist())


def test_pieces_that_cross_marks_keep_texts_whole(own, lib, monkeypatch):
    monkeypatch.setattr(own, "apart", False)
    same(own, lib, TEXTS)


def test_decodes_any_ids(own, lib):
    r = random.Random(3)
    for _ in range(2000):
        ids = [r.choice([r.randrange(32000), r.randrange(3, 259), 0, 1, 2, 28705]) for _ in range(r.randrange(12))]
        assert own.decode(np.array(ids, np.int64)) == lib.decode(ids)


def test_other_models_raise(data):
    with pytest.raises(ValueError):
        pieces.read_model(b"")


def test_distinct_survives_collisions(monkeypatch):
    for key in (chunks.mixed, lambda x: x * np.uint64(0)):
        monkeypatch.setattr(chunks, "mixed", key)
        symbols = np.frombuffer(b"abcababxabcab", np.uint8)
        begins = np.array([0, 3, 5, 8, 11])
        first, which = chunks.distinct(symbols, begins)
        size = np.diff(begins, append=len(symbols))
        assert chunks.gathered(symbols, begins, size, first[which]).tobytes() == symbols.tobytes()
    assert [len(x) for x in chunks.distinct(symbols[:0], begins[:0])] == [0, 0]


def test_op13_is_the_library(spark, sf, lib):
    docs = duckdb.connect().execute(f"select doc_id, coalesce(text, '') from '{sf}/documents.parquet'").fetchall()
    out = queries.QUERIES["op13_sentence_pieces"](spark, sf).toPandas().set_index("doc_id")
    assert len(out) == len(docs)
    for doc, text in docs:
        ids = lib.encode(text, add_bos=True, add_eos=True)
        assert out.n_tokens[doc] == len(ids)
        assert out.ids_sha256[doc] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert out.decoded_sha256[doc] == hashlib.sha256(lib.decode(ids).encode()).hexdigest()


def test_odd_rows(spark, lib):
    texts = [(1, None), (2, ""), (None, "lone row"), (4, "long text " * 60_000), (5, "é"), (5, "é"), (6, "z" * 20_000)]
    df = spark.createDataFrame([(*x, "k", 1) for x in texts], "doc_id long, text string, ids string, n_tokens int")
    out = sorted((r.id or 0, r.n_tokens, r.ids, r.decoded) for r in pieces.sentence_pieces(df.repartition(2), MODEL).collect())
    want = [(i or 0, lib.encode(t or "", add_bos=True, add_eos=True), t or "") for i, t in texts]
    assert out == sorted((i, len(ids), ids, t) for i, ids, t in want)
    assert pieces.sentence_pieces(df.limit(0), MODEL).count() == 0
