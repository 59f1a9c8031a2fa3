"""64-bit ids beside nulls, and other odd input, through the Python stages."""

from __future__ import annotations

import hashlib

import pytest

pytest.importorskip("pagewright.llm")
from pagewright.llm import bpe, secrets, simhash, warc  # noqa: E402
from pagewright.llm.queries import multilingual_bytes  # noqa: E402

BIG = 1 << 60
IDS = [BIG + 1, None, BIG + 3, BIG + 2, None, 7]


def docs(spark):
    rows = [(i, "one text" if n % 2 else f"other text {n}") for n, i in enumerate(IDS)]
    return spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)


def ids_of(rows, name="doc_id"):
    return sorted((r[name] is None, r[name] or 0) for r in rows)


def test_document_ids_stay_exact(spark):
    want = sorted((i is None, i or 0) for i in IDS)
    table = docs(spark)
    for out in (
        simhash.near_duplicates(table),
        secrets.secret_spans(table),
        bpe.encode(table, multilingual_bytes(), digests=True),
        bpe.encode(table, multilingual_bytes()),
        bpe.decode(bpe.encode(table, multilingual_bytes()), multilingual_bytes()),
    ):
        assert ids_of(out.collect()) == want


def test_components_keep_ids_apart(spark):
    rows = [(BIG + 3, "same words here"), (BIG + 1, "same words here"), (None, "quite another text")]
    table = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(table).collect()}
    assert got == {BIG + 3: BIG + 1, BIG + 1: BIG + 1, None: None}


def archive_trip(spark, rows, **more):
    folder = warc.archive_folder(spark)
    warc.make_folder(spark, folder)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    archives = warc.write_archives(pages, folder, **more)
    return archives, warc.read_archives(archives)


def test_page_ids_stay_exact(spark):
    rows = [(i, None, "same") for i in (BIG + 1, BIG + 3, BIG + 2, None)] + [(BIG + 4, None, "alone")]
    got = {r.page_id: (r.record_type, r.refers_to) for r in archive_trip(spark, rows)[1].collect()}
    assert got == {
        BIG + 1: ("revisit", BIG + 3),
        BIG + 2: ("revisit", BIG + 3),
        BIG + 3: ("response", None),
        None: ("revisit", BIG + 3),
        BIG + 4: ("response", None),
    }


def test_archives_are_read_by_as_many_tasks(spark):
    rows = [(i, None, f"{i} " * 40) for i in range(60)]
    archives, read = archive_trip(spark, rows, archive_bytes=500)
    assert archives.count() > 8
    assert read.rdd.getNumPartitions() == archives.count()
    assert ids_of(read.collect(), "page_id") == [(False, i) for i in range(60)]


def test_a_million_blanks(spark):
    texts = ["a" + " " * 1_000_000 + "b", "\n" * 1_000_000, "x\t" + " " * 300_000]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in bpe.encode(table, multilingual_bytes(), digests=True).collect():
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    codec = bpe.Codec(multilingual_bytes())
    text = "it's " + " " * 200_000 + "one\n" + "\n" * 150_000 + " two"
    assert codec.encode(text) == codec.encoding.encode_ordinary(text)
