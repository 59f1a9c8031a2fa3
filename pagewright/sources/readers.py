"""Page, store and archive sources."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright import schemas

# Member names that hold text, by archive kind.
TEXT_MEMBERS = (".txt", ".html", ".xml")
CHAPTER_MEMBERS = (".html", ".xhtml", ".htm")
# Characters of members handed over at a time.
BATCH_CHARS = 1_000_000


def read_pages(spark: SparkSession, path: str, schema: str = schemas.RAW_PAGES) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def spread(scan: DataFrame, task_bytes: int | None = None) -> DataFrame:
    """Even out a scan of fewer splits than the session has cores.

    Text work is heavy per row; a small table in one file would otherwise run
    on one core. A large table has more splits than cores and is left alone,
    unless ``task_bytes`` says how many bytes of its files a task may have.
    """
    least = scan.sparkSession.sparkContext.defaultParallelism
    if task_bytes:
        size = int(str(scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        least = max(least, -(-size // task_bytes))
    return scan.repartition(least) if scan.rdd.getNumPartitions() < least else scan


def as_pages(raw: DataFrame) -> DataFrame:
    """Fill the response columns that a bare (url, html) table lacks."""
    have = set(raw.columns)
    out = raw
    if "status_code" not in have:
        out = out.withColumn("status_code", F.lit(200))
    if "headers" not in have:
        out = out.withColumn("headers", F.create_map(F.lit("content-type"), F.lit("text/html")))
    if "content" not in have:
        out = out.withColumn("content", F.encode("html", "UTF-8"))
    if "fetched_at" not in have:
        out = out.withColumn("fetched_at", F.lit(None).cast("timestamp"))
    return out


def read_crawl_store(spark: SparkSession, path: str, layout: str = "lines") -> DataFrame:
    """Records of a hash-sharded store.

    ``layout="lines"`` has one JSON object per line, as ``write_crawl_store``
    leaves it; ``layout="files"`` has one, on any number of lines, per file.
    """
    if layout not in ("lines", "files"):
        raise ValueError(f"unknown layout: {layout}")
    return (
        spark.read.schema(schemas.STORED_RECORD)
        .option("multiLine", layout == "files")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json")
        .json(path)
    )


def read_binary(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def _members(kind: str, data: bytes) -> Iterator[tuple[str, str]]:
    source = io.BytesIO(data)
    if kind == "tar":
        with tarfile.open(fileobj=source) as tar:
            for entry in tar.getmembers():
                if entry.isfile() and entry.name.endswith(TEXT_MEMBERS):
                    yield entry.name, tar.extractfile(entry).read().decode("utf-8", errors="ignore")
        return
    wanted = CHAPTER_MEMBERS if kind == "epub" else TEXT_MEMBERS
    with zipfile.ZipFile(source) as archive:
        for name in archive.namelist():
            if name.endswith(wanted):
                yield name, archive.read(name).decode("utf-8", errors="ignore")


def _kind_of(path: str) -> str | None:
    lowered = path.lower()
    if lowered.endswith(".epub"):
        return "epub"
    if lowered.endswith((".tar", ".tar.gz", ".tgz")):
        return "tar"
    return "zip" if lowered.endswith(".zip") else None


def _told(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string()]
    names = ["path", "kind", "ordinal", "member", "text"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def _explode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # One archive at a time leaves its batch; members go out in small batches.
    for batch in batches:
        rows, size = [], 0
        for path, content in zip(batch.column("path"), batch.column("content")):
            name = path.as_py()
            kind = _kind_of(name)
            if kind is None:
                continue
            try:
                for i, (member, text) in enumerate(_members(kind, content.as_py())):
                    rows.append((name, kind, i, member, text))
                    size += len(text)
                    if size >= BATCH_CHARS:
                        yield _told(rows)
                        rows, size = [], 0
            except (zipfile.BadZipFile, tarfile.TarError, EOFError, OSError, NotImplementedError, RuntimeError):
                # What was read before the damage still counts.
                pass
        if rows:
            yield _told(rows)


def explode_archive(files: DataFrame) -> DataFrame:
    """One row per text member of ZIP, TAR and EPUB bodies.

    Containers have no native reader, so members are opened in Arrow batches;
    a bad archive gives no rows.
    """
    return files.select("path", "content").mapInArrow(_explode_batches, schemas.ARCHIVE_MEMBERS)


def archive_text(members: DataFrame) -> DataFrame:
    """Text of each archive, every member followed by a blank line."""
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", "text")))
    return members.groupBy("path").agg(
        F.concat(F.array_join(F.transform(ordered, lambda m: m["text"]), "\n\n"), F.lit("\n\n")).alias("text")
    )


def chunk_binary(df: DataFrame, content: str = "content", size: int = 10 * 1024 * 1024) -> DataFrame:
    """Fixed-size pieces of a body; the last one may be short."""
    last = F.ceil(F.octet_length(content) / F.lit(size)).cast("int") - 1
    indexes = F.when(F.octet_length(content) > 0, F.sequence(F.lit(0), last))
    rest = [c for c in df.columns if c != content]
    return df.withColumn("chunk", F.explode(indexes)).select(
        *rest, "chunk", F.substr(content, F.col("chunk") * size + 1, F.lit(size)).alias("piece")
    )
