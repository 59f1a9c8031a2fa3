"""Near-duplicate groups by SimHash and a binary trie self-join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.common import stored
from pagewright.llm.components import components, roots_of
from pagewright.llm.shingles import jaccard_links

SHINGLE = 3
SEED = 42
BITS = 64
# Fingerprints that differ in at most this many bits are linked.
BUDGET = 2
# Rows of a trie node that one task joins; larger nodes are split further.
NODE_ROWS = 50_000
# Bits by which a crowded node is split, and how often that is possible.
SPLIT_BITS, SPLITS = 6, 7
# Shingles whose bits are counted at a time.
CHUNK = 1 << 16
# Node pairs of at most this many row pairs are compared directly.
LEAF_PAIRS = 16


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash of a text: the majority, bit by bit, of its shingles' XXH64."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(last), CHUNK):
        pairs = zip(starts[at : at + CHUNK].tolist(), last[at : at + CHUNK].tolist())
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in pairs), dtype="<u8", count=len(last[at : at + CHUNK]))
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > len(last), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow columns keep 64-bit ids exact, next to nulls as well."""
    for batch in batches:
        marks = np.array([fingerprint(t.as_py()) for t in batch.column("text")], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("mark"), pa.array(marks.view(np.int64))], ["doc_id", "mark", "fp"]
        )


def fingerprints(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, mark, fp): whole texts as bytes, one pass, no shuffle.

    ``mark`` is a hash of the text that tells rows of one doc_id apart.
    """
    return docs.select(
        F.col("doc_id").cast("long"), F.xxhash64("text").alias("mark"), F.col("text").cast("binary").alias("text")
    ).mapInArrow(_fingerprints, "doc_id long, mark long, fp long")


def trie_links(fps: np.ndarray, low: np.ndarray, high: np.ndarray, budget: int = BUDGET) -> Iterator[tuple]:
    """Index pairs within ``budget`` bits, for each sorted range [low, high).

    A range of sorted fingerprints with a common prefix is a trie node. Node
    pairs go down the trie together, one bit at a time; a pair that takes
    different branches spends one bit of its budget, and it ends when the
    budget is overspent. Small pairs are compared at once.
    """
    keep = high - low > 1
    a0, a1 = low[keep], high[keep]
    b0, b1, spent = a0, a1, np.zeros(len(a0), dtype=np.int8)
    for bit in range(BITS - 1, -1, -1):
        small = (a1 - a0) * (b1 - b0) <= LEAF_PAIRS
        if small.any():
            yield _compare(fps, a0[small], a1[small], b0[small], b1[small], budget)
            a0, a1, b0, b1, spent = (x[~small] for x in (a0, a1, b0, b1, spent))
        if not len(a0):
            return
        ones = np.concatenate(([0], np.cumsum((fps >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)))
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        same = a0 == b0
        parts = [
            (a0, am, b0, bm, spent, np.ones_like(same)),
            (am, a1, bm, b1, spent, np.ones_like(same)),
            (a0, am, bm, b1, spent + 1, np.ones_like(same)),
            (am, a1, b0, bm, spent + 1, ~same),
        ]
        a0, a1, b0, b1, spent, wanted = (np.concatenate(x) for x in zip(*parts))
        open_ = wanted & (spent <= budget) & (a1 > a0) & (b1 > b0) & ~((a0 == b0) & (a1 - a0 < 2))
        a0, a1, b0, b1, spent = (x[open_] for x in (a0, a1, b0, b1, spent))
    if len(a0):
        yield _compare(fps, a0, a1, b0, b1, budget)


def _compare(fps, a0, a1, b0, b1, budget):
    widths, totals = b1 - b0, (a1 - a0) * (b1 - b0)
    which = np.repeat(np.arange(len(a0)), totals)
    nth = np.arange(totals.sum()) - np.repeat(np.cumsum(totals) - totals, totals)
    left, right = a0[which] + nth // widths[which], b0[which] + nth % widths[which]
    near = (left < right) & (np.bitwise_count(fps[left] ^ fps[right]) <= budget)
    return left[near], right[near]


def _link_nodes(rows: pd.DataFrame) -> pd.DataFrame:
    """Forest of the links inside each node of a set of whole nodes."""
    fps = rows["fp"].to_numpy().astype(np.int64).view(np.uint64)
    node = np.concatenate(([0], np.cumsum(rows["node"].to_numpy()[1:] != rows["node"].to_numpy()[:-1])))
    order = np.lexsort((fps, node))
    fps, node = fps[order], node[order]
    low = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
    high = np.concatenate((low[1:], [len(node)]))
    parent = np.arange(len(fps))
    for left, right in trie_links(fps, low, high):
        parent = roots_of(len(fps), left, right, parent)
    linked = parent != np.arange(len(fps))
    return pd.DataFrame({"a": fps[linked].view(np.int64), "b": fps[parent[linked]].view(np.int64)})


def _join_tries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by node; the last, open node waits for the next batch."""
    waiting: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        last = batch["node"].iloc[-1]
        done = batch["node"] != last
        if done.any():
            yield _link_nodes(pd.concat([*waiting, batch[done]], ignore_index=True))
            waiting = []
        elif waiting and waiting[-1]["node"].iloc[-1] != last:
            yield _link_nodes(pd.concat(waiting, ignore_index=True))
            waiting = []
        waiting.append(batch[~done])
    if waiting:
        yield _link_nodes(pd.concat(waiting, ignore_index=True))


def _bits(value: Column, low: int, count: int) -> Column:
    return F.shiftrightunsigned(value, low).bitwiseAND(F.lit((1 << count) - 1))


def trie_roots(distinct: DataFrame) -> DataFrame:
    """Rows (node, rest, fp), three per fingerprint.

    With two bits to spend, two fingerprints agree on one of three blocks. So
    three tries are joined, each with another block in front: nodes are the
    blocks' values, at full budget, and no pair of different nodes is left to
    visit. ``rest`` holds the bits below the node.
    """
    fp = F.col("fp")
    blocks = [
        (_bits(fp, 43, 21), _bits(fp, 0, 43)),
        (_bits(fp, 22, 21), F.shiftleft(_bits(fp, 43, 21), 22).bitwiseOR(_bits(fp, 0, 22))),
        (_bits(fp, 0, 22), _bits(fp, 22, 42)),
    ]
    nodes = [
        F.struct(F.concat_ws(":", F.lit(i), value.cast("string")).alias("node"), rest.alias("rest"))
        for i, (value, rest) in enumerate(blocks)
    ]
    return distinct.select(F.inline(F.array(*nodes)), "fp")


def split_crowded(nodes: DataFrame, node_rows: int = NODE_ROWS) -> DataFrame:
    """Replace nodes of more than ``node_rows`` rows by pairs of their children.

    A row goes to every pair of children within the budget in which its own
    child takes part. Fingerprints are distinct, so nodes shrink each time.
    """
    children = 1 << SPLIT_BITS
    near = [[o for o in range(children) if (o ^ c).bit_count() <= BUDGET] for c in range(children)]
    for step in range(SPLITS):
        crowded = nodes.groupBy("node").count().where(F.col("count") > node_rows).select("node")
        if crowded.isEmpty():
            break
        crowded = stored(crowded, "crowded")
        mine = _bits(F.col("rest"), 42 - SPLIT_BITS * (step + 1), SPLIT_BITS).cast("int")
        partners = F.element_at(F.array(*[F.array(*map(F.lit, p)) for p in near]), F.col("mine") + 1)
        pair = F.concat_ws("/", "node", F.concat_ws("-", F.least("mine", "other"), F.greatest("mine", "other")))
        parts = (
            nodes.join(crowded, "node", "left_semi")
            .withColumn("mine", mine)
            .withColumn("other", F.explode(partners))
            .select(pair.alias("node"), "rest", "fp")
        )
        nodes = stored(nodes.join(crowded, "node", "left_anti").unionByName(parts), "nodes")
    return nodes


def links(distinct: DataFrame, node_rows: int = NODE_ROWS) -> DataFrame:
    """Rows (a, b) that connect what fingerprints within BUDGET bits connect.

    ``distinct`` has one row per fingerprint ``fp``. Each node gives the forest
    of its links instead of all pairs; nothing that was linked falls apart.
    """
    nodes = split_crowded(trie_roots(distinct), node_rows).select("node", "fp")
    return nodes.repartition("node").sortWithinPartitions("node").mapInPandas(_join_tries, "a long, b long")


def near_duplicates(docs: DataFrame, node_rows: int = NODE_ROWS, jaccard: bool = False) -> DataFrame:
    """Rows (doc_id, mark, fp, component_id, keep), one per document row.

    With ``jaccard``, texts are also linked from a Jaccard similarity of 4 / 5
    of their five-word shingles on, however many bits their fingerprints differ.

    ``component_id`` is the least doc_id that links lead to, ``keep`` marks the
    rows of that document with the least ``mark``. Texts without words have
    fingerprint zero and are linked like any other. Repeated rows stay; rows
    without a doc_id are linked but name a component only if no other can.
    """
    marks = stored(fingerprints(docs), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("first")
    distinct = marks.groupBy("fp").agg(first)
    linked = links(distinct.select("fp"), node_rows)
    if jaccard:
        linked = stored(linked, "links")
        linked = linked.unionByName(jaccard_links(docs, marks.select("mark", "fp"), linked))
    found = components(linked)
    rooted = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    firsts = rooted.groupBy("root").agg(F.min("first").alias("first"))
    groups = rooted.select("fp", "root").join(firsts, "root").select("fp", "first")
    return marks.join(groups, "fp").select(
        "doc_id",
        "mark",
        "fp",
        F.col("first.doc_id").alias("component_id"),
        (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("mark") == F.col("first.mark"))).alias("keep"),
    )


def first_of_each_group(docs: DataFrame, jaccard: bool = False) -> DataFrame:
    """Documents that stay when one of each group of near duplicates stays.

    It is the one with the least doc_id; of rows that repeat it, one. Groups
    whose rows all lack a doc_id keep one row as well.
    """
    kept = near_duplicates(docs, jaccard=jaccard).where("keep").select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_kept_id"), F.col("mark").alias("_kept_mark")
    )
    keyed = docs.select(
        F.struct(*docs.columns).alias("_row"),
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_kept_id"),
        F.xxhash64("text").alias("_kept_mark"),
    )
    one = Window.partitionBy("_kept_id", "_kept_mark").orderBy("_kept_mark")
    return (
        keyed.join(kept.distinct(), ["_kept_id", "_kept_mark"], "left_semi")
        .withColumn("_n", F.row_number().over(one))
        .where("_n = 1")
        .select("_row.*")
    )


def simhash_digest(found: DataFrame) -> DataFrame:
    """doc_id, fingerprint as 16 hex digits, component_id."""
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
