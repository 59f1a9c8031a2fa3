"""WARC round trip, framing and digests."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io

import pytest

pytest.importorskip("pagewright.llm")
from pagewright.llm import warc  # noqa: E402


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


ROWS = [
    (1, "http://a/", "same", "x"),
    (9, "http://b/", "same", "x"),
    (4, None, "same", "y"),
    (5, "http://c/\r\nX: y", None, "x"),
    (6, "http://d/", "", "x"),
    (7, "http://é/", "<p>é漢\r\n\r\nWARC/1.1</p>" * 20_000, "x"),
    (7, "http://é/", "<p>é漢\r\n\r\nWARC/1.1</p>" * 20_000, "x"),
    (None, "http://e/", "same", "x"),
    (None, "http://f/", "no id", "x"),
]
FIELDS = "page_id long, url string, html string, digest string"


def round_trip(spark, rows, **more):
    folder = warc.archive_folder(spark)
    warc.make_folder(spark, folder)
    archives = warc.write_archives(spark.createDataFrame(rows, FIELDS), folder, **more)
    return archives, warc.read_archives(archives)


def test_round_trip(spark):
    archives, read = round_trip(spark, ROWS, archive_bytes=600)
    got = read.collect()
    assert len(got) == len(ROWS) == sum(r.records for r in archives.collect())
    seen = sorted(
        (r.page_id or 0, r.payload_digest, r.payload_bytes, r.record_type, r.refers_to or 0, len(r.payload)) for r in got
    )
    long = ROWS[5][2]
    want = [
        (1, digest("same"), 4, "revisit", 9, 0),
        (4, digest("same"), 4, "revisit", 9, 0),
        (9, digest("same"), 4, "response", 0, 4),
        (5, digest(""), 0, "revisit", 6, 0),
        (6, digest(""), 0, "response", 0, 0),
        *[(7, digest(long), len(long.encode()), "response", 0, len(long.encode()))] * 2,
        (0, digest("same"), 4, "revisit", 9, 0),
        (0, digest("no id"), 5, "response", 0, 5),
    ]
    assert seen == sorted(want)
    assert {r.url for r in got} >= {"http://c/%0D%0AX: y", "http://é/", ""}


def test_small_payloads_are_responses(spark):
    _, read = round_trip(spark, ROWS, min_revisit_bytes=5)
    assert {r.record_type for r in read.where("payload_bytes < 5").collect()} == {"response"}


def test_empty_table(spark):
    archives, read = round_trip(spark, [])
    assert archives.count() == 0 and read.count() == 0


def archive(*payloads: bytes) -> bytes:
    return b"".join(
        warc.gzip_member(warc.record_bytes(i, "u", p, warc.block_digest(p), None)) for i, p in enumerate(payloads)
    )


def test_members_stand_alone():
    data = archive(b"one", b"two" * 50_000)
    assert gzip.decompress(data).count(b"WARC/1.1\r\n") == 2
    assert [p for _, _, p in warc.read_records(io.BytesIO(data))] == [b"one", b"two" * 50_000]


@pytest.mark.parametrize(
    "damage",
    [
        lambda d: d[:-9],
        lambda d: d[:40] + bytes([d[40] ^ 255]) + d[41:],
        lambda d: warc.gzip_member(gzip.decompress(d).replace(b"payload text", b"payload tex_")),
        lambda d: warc.gzip_member(gzip.decompress(d).replace(b"payload text", b"payload")),
        lambda d: warc.gzip_member(gzip.decompress(d).replace(b"payload text", b"payload text and more")),
        lambda d: warc.gzip_member(b"no record"),
    ],
)
def test_damage_is_found(damage):
    with pytest.raises(warc.DamagedArchive):
        list(warc.read_records(io.BytesIO(damage(archive(b"payload text")))))
