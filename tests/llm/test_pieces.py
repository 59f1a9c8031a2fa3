"""SentencePiece encoding against the library, and the round trip."""

from __future__ import annotations

import hashlib
import random

import pytest

pytest.importorskip("pagewright.llm")
import public_tokenizers  # noqa: E402
import sentencepiece  # noqa: E402

from pagewright.llm import pieces  # noqa: E402
from pagewright.llm.queries import QUERIES, piece_model  # noqa: E402

DIR = "/root/testdata/sf0.01"
BIG = 1 << 60


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def codec():
    return pieces.Codec(piece_model())


def row(library, text):
    ids = library.encode(text or "")
    plain = library.decode(ids)
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(plain.encode()).hexdigest()


def test_query_equals_library(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    got = QUERIES["op11_sentencepiece"](spark, DIR).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == row(library, texts[r.doc_id])


ALPHABET = [
    "a", "the", "th", "in", "ing", " ", "  ", "   ", "\n", "\t", "é", "漢", "字", "🙂", "▁", "7", "12", "e", "r", "s",
    "'", "\x00", "<s>", "<0x0A>", "​", "Ω", "aa", "aaa", "ll", "=", "==", "----", "�", "\r\n",
]


def test_random_texts(library, codec):
    rng = random.Random(5)
    for _ in range(5_000):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 25)))
        ids = library.encode(text)
        assert codec.encode(text) == ids, text
        assert codec.decode(ids) == library.decode(ids), text
        assert codec.digests(text) == row(library, text), text


def test_blank_runs(library, codec):
    for n in [*range(1, 70), 5_000]:
        for text in (" " * n, " " * n + "a", "x" + " " * n + "the", "\n" + " " * n):
            assert codec.encode(text) == library.encode(text), (n, text[-3:])


def test_any_ids_decode(library, codec):
    rng = random.Random(8)
    for _ in range(2_000):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(259, 32_000), 35, 259]) for _ in range(rng.randint(0, 8))]
        assert codec.decode(ids) == library.decode(ids), ids


def test_neighbours_fit_as_merging_says(codec):
    """A sequence is right where each two neighbours are: against plain merging."""
    rng = random.Random(4)
    for _ in range(500):
        text = "▁" + "".join(rng.choice("aeinrst▁hlo") for _ in range(rng.randint(1, 30)))
        assert [codec.texts[i] for i in codec._pieces(text)] == pieces.merged(text, codec.scores)


def test_odd_rows(spark, library):
    rng = random.Random(1)
    letters = "".join(rng.choice("abcdefghijklmnop") for _ in range(60_000))
    texts = [None, "", " ", "x" * 60_000, " " * 100_000, letters, "one two", "one two", "漢" * 20_000]
    rows = [(BIG + i if i % 3 else None, t, b"n", 5) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids binary, units int").coalesce(1)
    got = pieces.encode(docs, piece_model(), digests=True).collect()
    want = sorted((str(d), *row(library, t)) for d, t, _, _ in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    back = pieces.decode(pieces.encode(docs, piece_model()), piece_model()).collect()
    assert sorted((str(r.doc_id), r.decoded) for r in back) == sorted((str(d), t or "") for d, t, _, _ in rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pieces.encode(docs, piece_model(), digests=True).count() == 0
    assert pieces.decode(pieces.encode(docs, piece_model()), piece_model()).count() == 0


def test_memory_is_bounded():
    made = []
    known = pieces.Remembered(lambda k: made.append(k) or k * 2, 10)
    for k in [*range(25), *range(15, 25)]:
        assert known[k] == k * 2 and len(known) <= 10 and len(known.older) <= 10
    assert len(made) == 25


def test_other_models_are_refused():
    with pytest.raises(pieces.UnsupportedModel):
        pieces.Model(b"")


def test_units_end_where_no_piece_goes_on(codec):
    assert codec.unit.findall("▁onth.\nTiens▁▁a_b") == ["▁onth", ".\n", "Tiens", "▁▁a_b"]
    for text in codec.scores:
        assert codec.unit.findall(text) == [text]
    assert pieces.unit_pattern(["a", "s", "'", "'s", "▁a"]).findall("▁a's.a▁") == ["▁a's.a", "▁"]
    assert pieces.unit_pattern(["a▁a"]).findall("▁a.\na") == ["▁a.\na"]
