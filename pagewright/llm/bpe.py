"""Byte-level BPE by overlapping chunks, and decoding."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Texts longer than this are encoded in chunks of this many characters.
CHUNK = 32_768
# Characters that a chunk shares with the next one.
OVERLAP = 2_048
# A match that ends this close to a cut might have gone on behind it.
UNSURE = 3
# Runs of white space from this length on are not given to the library's splitter.
LONG_BLANKS = 100_000
# Rows whose ids a worker holds at a time.
ROWS = 256


@dataclass(frozen=True)
class Vocabulary:
    """A rank file's bytes and the pattern that splits texts before merging."""

    ranks: bytes
    pattern: str

    @classmethod
    def read(cls, path: str, pattern: str) -> Vocabulary:
        with open(path, "rb") as file:
            return cls(file.read(), pattern)


class Codec:
    """Encoder, and the tables that decode ids and show them as text."""

    def __init__(self, vocabulary: Vocabulary):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.ranks.splitlines()) if a}
        self.encoding = tiktoken.Encoding("own", pat_str=vocabulary.pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.text_of = {i: str(i) for i in ranks.values()}
        self.words = regex.compile(vocabulary.pattern)

    def encode(self, text: str) -> list[int]:
        """Ids of a text.

        The library's own splitter gives up on very long runs of white space,
        so a text with one is split here, and merged match by match.
        """
        if len(text) < LONG_BLANKS or not regex.search(rf"\s{{{LONG_BLANKS}}}", text):
            return self.encoding.encode_ordinary(text)
        return [i for m in self.words.finditer(text) for i in self.encoding._encode_single_piece(m[0])]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def shown(self, ids) -> str:
        return ",".join(map(self.text_of.__getitem__, ids))


def shared(spark: SparkSession, vocabulary: Vocabulary) -> Broadcast:
    """The vocabulary for all tasks; its size is that of the rank file.

    Only plain values are sent: a broadcast value's classes would have to be
    installed on executors.
    """
    return spark.sparkContext.broadcast({"ranks": vocabulary.ranks, "pattern": vocabulary.pattern})


def codec_of(vocabulary: Broadcast) -> Codec:
    """A worker's codec, built once and kept with the broadcast value."""
    value = vocabulary.value
    if "codec" not in value:
        value["codec"] = Codec(Vocabulary(value["ranks"], value["pattern"]))
    return value["codec"]


# Ids are little-endian 32-bit integers.
IDS = "ids binary"
ARROW_OF = {
    "ids": pa.binary(),
    "data": pa.binary(),
    "n_tokens": pa.int64(),
    "ids_sha256": pa.string(),
    "decoded_sha256": pa.string(),
}


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def with_columns(batch: pa.RecordBatch, keep: list[str], added: dict[str, list]) -> pa.RecordBatch:
    """Kept columns stay as they came, 64-bit ids next to nulls included."""
    return pa.RecordBatch.from_arrays(
        [*(batch.column(c) for c in keep), *map(pa.array, added.values(), map(ARROW_OF.__getitem__, added))],
        [*keep, *added],
    )


def _encode_whole(vocabulary: Broadcast, keep: list[str], digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(vocabulary)
        for batch in _slices(batches):
            texts = (t.as_py() or "" for t in batch.column("text"))
            if digests:
                yield with_columns(batch, keep, digests_of(codec, map(codec.encode, texts)))
            else:
                ids = [np.array(codec.encode(t), dtype="<u4").tobytes() for t in texts]
                yield with_columns(batch, keep, {"ids": ids})

    return run


def _ends(codec: Codec, text: str, at_end: bool) -> list[int]:
    """Where matches end that no later text can change, white space aside.

    A match before white space may depend on what follows it, so ends right
    after white space are no places to cut.
    """
    last = len(text) if at_end else len(text) - UNSURE
    return [m.end() for m in codec.words.finditer(text) if m.end() <= last and not text[m.end() - 1].isspace()]


def _boundaries(vocabulary: Broadcast):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = codec_of(vocabulary)
        for batch in batches:
            heads, tails = [], []
            for start, text, size in zip(batch["start"], batch["part"], batch["size"]):
                ends = np.array(_ends(codec, text, start + len(text) >= size), dtype=np.int64)
                heads.append((ends[ends < OVERLAP] + start).tolist())
                tails.append((ends[ends >= CHUNK] + start).tolist())
            yield pd.DataFrame({"key": batch["key"], "part_no": batch["part_no"], "head": heads, "tail": tails})

    return run


def cut_points(long_texts: DataFrame, vocabulary: Broadcast) -> DataFrame:
    """Rows (key, cuts): where the chunks of each long text are stitched.

    ``long_texts`` has a unique key and text. Every chunk is split by the
    pattern on its own. Where a chunk and the one before it both end a match
    at one place, they agree from there on, so their first common end is a cut.
    Cuts count only as long as every earlier pair of chunks has met, for only
    then is a chunk's view known to be the whole text's; behind a pair that
    never meets, the rest is one piece.
    """
    size = F.length("text")
    starts = F.sequence(F.lit(0), F.floor((size - 1) / CHUNK).cast("int"))
    parts = long_texts.select("key", "text", size.alias("size"), F.explode(starts).alias("part_no")).select(
        "key",
        "part_no",
        "size",
        (F.col("part_no") * CHUNK).alias("start"),
        F.substring("text", F.col("part_no") * CHUNK + 1, F.lit(CHUNK + OVERLAP)).alias("part"),
    )
    seen = parts.repartition("key", "part_no").mapInPandas(
        _boundaries(vocabulary), "key string, part_no int, head array<long>, tail array<long>"
    )
    order = Window.partitionBy("key").orderBy("part_no")
    common = F.array_min(F.array_intersect("head", F.lag("tail").over(order)))
    met = seen.select("key", "part_no", common.alias("cut")).where("part_no > 0")
    lost = F.max(F.col("cut").isNull().cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return met.withColumn("lost", lost).where("lost = 0").groupBy("key").agg(F.sort_array(F.collect_list("cut")).alias("cuts"))


def _encode_pieces(vocabulary: Broadcast):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = codec_of(vocabulary)
        for batch in batches:
            ids = [np.array(codec.encode(t), dtype="<u4").tobytes() for t in batch["piece"]]
            yield pd.DataFrame({"key": batch["key"], "piece_no": batch["piece_no"], "ids": ids})

    return run


def encode_long(long_texts: DataFrame, vocabulary: Broadcast) -> DataFrame:
    """Rows (key, ids): the pieces between cuts are encoded on their own."""
    cuts = cut_points(long_texts, vocabulary)
    inner = F.coalesce("cuts", F.array().cast("array<bigint>"))
    begins = F.concat(F.array(F.lit(0).cast("long")), inner)
    ends = F.concat(inner, F.array(F.length("text").cast("long")))
    pieces = (
        long_texts.join(cuts, "key", "left")
        .select("key", "text", F.posexplode(F.arrays_zip(begins.alias("begin"), ends.alias("end"))).alias("piece_no", "at"))
        .select(
            "key",
            "piece_no",
            F.substring("text", (F.col("at.begin") + 1).cast("int"), (F.col("at.end") - F.col("at.begin")).cast("int")).alias("piece"),
        )
    )
    done = pieces.repartition("key", "piece_no").mapInPandas(_encode_pieces(vocabulary), "key string, piece_no int, ids binary")
    # A text's ids are as much one value as the text itself.
    joined = F.array_sort(F.collect_list(F.struct("piece_no", "ids")))
    whole = F.aggregate(joined, F.lit(b""), lambda out, piece: F.concat(out, piece["ids"]))
    return done.groupBy("key").agg(whole.alias("ids"))


def digests_of(codec: Codec, rows) -> dict[str, list]:
    """Count, digest of the ids and digest of the decoded bytes of each row."""
    out = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
    for ids in rows:
        out["n_tokens"].append(len(ids))
        out["ids_sha256"].append(hashlib.sha256(codec.shown(ids).encode()).hexdigest())
        out["decoded_sha256"].append(hashlib.sha256(codec.decode(ids)).hexdigest())
    return out


DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digest(vocabulary: Broadcast, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(vocabulary)
        for batch in _slices(batches):
            ids = (np.frombuffer(raw.as_py(), dtype="<u4").tolist() for raw in batch.column("ids"))
            yield with_columns(batch, keep, digests_of(codec, ids))

    return run


def encode(docs: DataFrame, vocabulary: Vocabulary, keep: list[str] | None = None, digests: bool = False) -> DataFrame:
    """Rows (``keep`` columns, ids) of all documents; ids are 32-bit integers.

    With ``digests`` the ids are decoded again in the same task, and instead of
    them come n_tokens, the digest of the ids and that of the decoded bytes.

    Texts up to CHUNK characters are encoded where they lie, without a shuffle.
    Longer ones are encoded once per different text, in pieces that any task
    can take, and joined back by the text's hash. A null text has no ids, like
    an empty one; repeated rows stay. A kept column named like one of the
    results is not possible.
    """
    keep = ["doc_id"] if keep is None else keep
    spread = shared(docs.sparkSession, vocabulary)
    fields = "".join(f"`{c}` {t}, " for c, t in docs.select(*keep).dtypes)
    is_long = F.coalesce(F.length("text") > CHUNK, F.lit(False))
    rows = docs.select(*dict.fromkeys([*keep, "text"]))
    short = rows.where(~is_long).mapInArrow(
        _encode_whole(spread, keep, digests), f"{fields}{DIGESTS if digests else IDS}"
    )
    hashed = rows.where(is_long).withColumn("_key", F.sha2("text", 256))
    texts = hashed.select(F.col("_key").alias("key"), "text").dropDuplicates(["key"])
    ids = encode_long(texts, spread).withColumnRenamed("key", "_key")
    if digests:
        ids = ids.mapInArrow(_digest(spread, ["_key"]), f"_key string, {DIGESTS}")
    return short.unionByName(hashed.select(*keep, "_key").join(ids, "_key").drop("_key"))


def _decode(vocabulary: Broadcast, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(vocabulary)
        for batch in _slices(batches):
            ids = (np.frombuffer(raw.as_py() or b"", dtype="<u4").tolist() for raw in batch.column("ids"))
            yield with_columns(batch, keep, {"data": list(map(codec.decode, ids))})

    return run


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Replace ids by ``data``, the bytes of all ids one after another."""
    keep = [c for c in encoded.columns if c != "ids"]
    fields = ", ".join(f"`{c}` {t}" for c, t in encoded.select(*keep).dtypes)
    return encoded.mapInArrow(
        _decode(shared(encoded.sparkSession, vocabulary), keep), f"{fields}{', ' if keep else ''}data binary"
    )
