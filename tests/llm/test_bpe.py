"""Chunked BPE against the plain library, and the round trip."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

pytest.importorskip("pagewright.llm")
from pagewright.llm import bpe  # noqa: E402
from pagewright.llm.queries import QUERIES, multilingual_bytes  # noqa: E402

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def vocabulary():
    return multilingual_bytes()


@pytest.fixture(scope="module")
def plain(vocabulary):
    return bpe.Codec(vocabulary).encoding


def row(plain, text):
    ids = plain.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_query_equals_library(spark, plain):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    got = QUERIES["op4_byte_bpe"](spark, DIR).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == row(plain, texts[r.doc_id])


def hard_texts():
    rng = random.Random(3)
    alphabet = ["a", "B", "é", "漢", "7", " ", "  ", "\n", "\n\n", "\t", "'s", "'re", "'", "!", "?!", "<|endoftext|>", " ", "🙂"]
    yield None
    yield ""
    yield " "
    for length in (5, 1_000, 40_000, 90_000):
        yield "".join(rng.choice(alphabet) for _ in range(length))
    yield "x" * 100_000  # no boundary to meet at
    yield "word " * 10_000 + " " * 40_000 + "end " * 20_000
    yield "\n".join(["it's they're we've"] * 6_000)
    yield "a b" * 30_000 + "y" * 40_000 + " c" * 30_000


def test_hard_texts(spark, plain, vocabulary):
    texts = list(hard_texts())
    rows = [(i, t, b"k") for i, t in enumerate(texts)] + [(7, texts[7], b"k"), (None, texts[8], b"k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key binary")
    encoded = bpe.encode(docs, vocabulary)
    got = bpe.encode(docs, vocabulary, digests=True).collect()
    assert len(got) == len(rows)
    for r in got:
        i = 8 if r.doc_id is None else r.doc_id
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == row(plain, texts[i]), i
    for r in bpe.decode(encoded, vocabulary).collect():
        i = 8 if r.doc_id is None else r.doc_id
        assert r.data == (texts[i] or "").encode()


def test_long_texts_are_cut(spark, vocabulary):
    text = "some words, in lines.\n" * 10_000
    long_texts = spark.createDataFrame([("k", text)], "key string, text string")
    spread = bpe.shared(spark, vocabulary)
    cuts = bpe.cut_points(long_texts, spread).first().cuts
    assert len(cuts) == (len(text) - 1) // bpe.CHUNK
    ids = np.frombuffer(bpe.encode_long(long_texts, spread).first().ids, dtype="<u4").tolist()
    assert ids == bpe.Codec(vocabulary).encode(text)


def test_empty_table(spark, vocabulary):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(docs, vocabulary, digests=True).count() == 0
    assert bpe.encode(docs, vocabulary).count() == 0
