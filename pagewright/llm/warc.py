"""WARC archives: one gzip member per record, written and read in sequence."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import stored
from pagewright.session import ensure_checkpoint_dir

# Names and values of the WARC 1.1 format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_TYPE = "application/http;msgtype=response"
RECORD_ID = "<urn:pagewright:page:{}>"
NULL_ID = "none"
# Payloads of fewer bytes are always stored as responses.
MIN_REVISIT_BYTES = 0
# Bytes read from an archive at a time.
READ_BYTES = 1 << 16
# Reading tasks at most; beyond it, a task reads one archive after another.
READ_TASKS = 100_000
# A task begins a new archive when one has grown to this many bytes.
ARCHIVE_BYTES = 1 << 28


def block_digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def header_bytes(first: str, fields: dict[str, str]) -> bytes:
    lines = [first, *(f"{k}: {v}" for k, v in fields.items())]
    return ("\r\n".join(lines) + "\r\n\r\n").encode("utf-8")


def header_value(text: str | None) -> str:
    """One header line's worth of text: line breaks are percent-encoded."""
    return (text or "").replace("\r", "%0D").replace("\n", "%0A")


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """A response, or with ``refers_to`` a revisit that leaves the payload out."""
    revisit = refers_to is not None
    http = header_bytes(
        "HTTP/1.1 200 OK", {"Content-Type": "text/html; charset=utf-8", "Content-Length": str(len(payload))}
    )
    block = http if revisit else http + payload
    fields = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": RECORD_ID.format(NULL_ID if page_id is None else page_id),
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": header_value(url),
        "Content-Type": HTTP_TYPE,
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Block-Digest": f"sha1:{block_digest(block)}",
        "Content-Length": str(len(block)),
    }
    if revisit:
        fields |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": RECORD_ID.format(refers_to)}
    return header_bytes(VERSION, fields) + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class DamagedArchive(ValueError):
    """An archive breaks its own framing or digests."""


@dataclass
class Source:
    """Bytes of one gzip member after another, unpacked as they are asked for."""

    file: object
    packed: bytes = b""
    plain: bytearray = field(default_factory=bytearray)
    unpacker: object = None

    def next_member(self) -> bool:
        """Step to the next member; False at the end of the archive."""
        if not self.packed:
            self.packed = self.file.read(READ_BYTES)
        if not self.packed:
            return False
        self.unpacker, self.plain = zlib.decompressobj(31), bytearray()
        return True

    def fill(self) -> bool:
        """Unpack at most READ_BYTES more; False when the member has ended."""
        if self.unpacker.eof:
            return False
        if not self.packed:
            self.packed = self.file.read(READ_BYTES)
            if not self.packed:
                raise DamagedArchive("the archive ends inside a member")
        self.plain += self.unpacker.decompress(self.packed, READ_BYTES)
        self.packed = self.unpacker.unconsumed_tail or self.unpacker.unused_data
        return True

    def until(self, mark: bytes) -> bytes:
        seen = 0
        while (at := self.plain.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.plain)
            if not self.fill():
                raise DamagedArchive("a header has no end")
        out = bytes(self.plain[:at])
        del self.plain[: at + len(mark)]
        return out

    def exactly(self, count: int) -> bytes:
        while len(self.plain) < count:
            if not self.fill():
                raise DamagedArchive("a block is shorter than its content length")
        out = bytes(self.plain[:count])
        del self.plain[:count]
        return out

    def rest(self) -> bytes:
        while self.fill():
            pass
        return bytes(self.plain)


def header_fields(raw: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = raw.decode("utf-8").split("\r\n")
    pairs = (line.partition(":") for line in lines)
    return first, {name.strip().lower(): value.strip() for name, _, value in pairs}


def read_records(file) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """(record header, HTTP header, payload) of an open archive, in order.

    Memory holds one record and two read buffers. Framing, block digest and,
    for responses, payload digest are checked; a breach raises.
    """
    source = Source(file)
    while source.next_member():
        try:
            first, head = header_fields(source.until(b"\r\n\r\n"))
            if not first.startswith("WARC/"):
                raise DamagedArchive("a member does not begin with a record")
            block = source.exactly(int(head["content-length"]))
            if source.rest() != b"\r\n\r\n":
                raise DamagedArchive("a record is longer than its content length")
        except (zlib.error, KeyError, UnicodeDecodeError) as error:
            raise DamagedArchive(str(error)) from error
        if head.get("warc-block-digest", "").removeprefix("sha1:") not in ("", block_digest(block)):
            raise DamagedArchive(f"block digest of {head.get('warc-record-id')}")
        http, payload = {}, block
        if head.get("content-type", "").startswith("application/http"):
            top, _, payload = block.partition(b"\r\n\r\n")
            http = header_fields(top)[1]
        if head.get("warc-type") == "response" and head.get("warc-payload-digest", "").removeprefix("sha1:") not in (
            "",
            block_digest(payload),
        ):
            raise DamagedArchive(f"payload digest of {head.get('warc-record-id')}")
        yield head, http, payload


ARCHIVES = "path string, records long, bytes long"
RECORDS = (
    "archive string, record_no long, page_id long, url string, record_type string, payload_digest string, "
    "payload_bytes long, refers_to long, payload binary"
)
ARROW_OF = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
# Records that one batch of a reading task holds at most.
BATCH_RECORDS = 4_096


def _write(folder: str, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = arrow_fs.FileSystem.from_uri(folder)
        path, out, records, size = "", None, 0, 0
        for batch in batches:
            # Row by row out of Arrow: ids stay whole numbers next to nulls.
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "data", "refers_to"))):
                page_id, url, data, refers_to = (value.as_py() for value in row)
                if out is None:
                    # A task that is run again takes new names; only the
                    # archives of tasks whose rows were kept are read.
                    path, records, size = f"part-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = files.open_output_stream(f"{base}/{path}", compression=None)
                data = data or b""
                member = gzip_member(record_bytes(page_id, url, data, block_digest(data), refers_to))
                out.write(member)
                records, size = records + 1, size + len(member)
                if size >= archive_bytes:
                    out.close()
                    out = None
                    yield _listed(folder, path, records, size)
        if out:
            out.close()
            yield _listed(folder, path, records, size)

    return run


def _listed(folder: str, path: str, records: int, size: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"path": [f"{folder}/{path}"], "records": [records], "bytes": [size]})


def write_archives(
    pages: DataFrame,
    folder: str,
    min_revisit_bytes: int = MIN_REVISIT_BYTES,
    archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html); list the archives.

    ``folder`` is a URI that all executors reach. Of equal payloads of at least
    ``min_revisit_bytes`` bytes the row with the largest page_id becomes the
    response and the others revisit it. Rows that repeat that page_id are
    responses too, and so are equal payloads none of which has a page_id. A
    null html is an empty payload, a null url an empty address.
    """
    data = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    named = pages.select("page_id", "url", data.alias("data")).withColumn("digest", F.sha1("data"))
    last = named.groupBy("digest").agg(F.max("page_id").alias("last"))
    refers = F.when(
        (F.octet_length("data") >= min_revisit_bytes) & ~F.col("page_id").eqNullSafe(F.col("last")), F.col("last")
    )
    rows = named.join(last, "digest").select("page_id", "url", "data", refers.alias("refers_to"))
    return stored(rows.mapInArrow(_write(folder, archive_bytes), ARCHIVES), "archives")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column("path").to_pylist():
            files, place = arrow_fs.FileSystem.from_uri(path)
            with files.open_input_stream(place, compression=None) as file:
                rows, held = [], 0
                for number, (head, http, payload) in enumerate(read_records(file)):
                    page, refers = (
                        None if not x or x.endswith(f":{NULL_ID}>") else int(x.rstrip(">").rpartition(":")[2])
                        for x in (head.get("warc-record-id"), head.get("warc-refers-to"))
                    )
                    rows.append(
                        (
                            path,
                            number,
                            page,
                            head.get("warc-target-uri"),
                            head.get("warc-type"),
                            head.get("warc-payload-digest", "").removeprefix("sha1:"),
                            int(http.get("content-length", len(payload))),
                            refers,
                            payload,
                        )
                    )
                    held += len(payload)
                    if held > 16 * READ_BYTES or len(rows) >= BATCH_RECORDS:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    fields = [part.split() for part in RECORDS.split(", ")]
    columns = [pa.array(values, ARROW_OF[kind]) for values, (_, kind) in zip(zip(*rows), fields)]
    return pa.RecordBatch.from_arrays(columns, [name for name, _ in fields])


def read_archives(archives: DataFrame) -> DataFrame:
    """Records of the archives named in ``path``, one archive after another.

    There are as many reading tasks as archives (READ_TASKS at most); each
    archive is read in sequence in bounded memory. The number is given, so
    that names, which are few bytes, are not merged into one task again.
    Revisits have an empty payload, and the length of the one they stand for.
    """
    listed = archives.select("path")
    tasks = max(1, min(listed.count(), READ_TASKS))
    return listed.repartition(tasks).mapInArrow(_read, RECORDS)


def archive_folder(spark) -> str:
    """A new folder for archives in the session's shared space, as a URI."""
    base = ensure_checkpoint_dir(spark)
    return f"{base if ':/' in base else f'file://{base}'}/warc-{uuid.uuid4().hex}"


def make_folder(spark, folder: str) -> None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
