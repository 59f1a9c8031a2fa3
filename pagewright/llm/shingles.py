"""Links of texts by the exact Jaccard similarity of their sets of shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import stored
from pagewright.llm.components import components
from pagewright.llm.lines import SIMILAR, SIMILAR_OF, alike_in_size, in_table, least_overlap, slot_of, slot_table

# Words of a shingle. Texts are alike from a Jaccard similarity of 4 / 5 on.
SHINGLE = 5
SEED = 42
# Shingles in the prefixes of more texts than HOT_ROWS come last in the order,
# as far as HOT_SHINGLES go. Both decide how fast the join is, never what it finds.
HOT_ROWS, HOT_SHINGLES = 500, 50_000


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted 64-bit hashes of the different shingles; short texts are one."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, dtype=np.int64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[SHINGLE - 1 :] if len(words) >= SHINGLE else ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = (digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), last.tolist()))
    return np.unique(np.fromiter(hashes, dtype="<u8", count=len(last)).view(np.int64))


def prefixes(docs: DataFrame, hot: list[int] = ()) -> DataFrame:
    """Rows (mark, n, prefix), one per different text with words.

    Similar sets share one of the n - ceil(4 / 5 * n) + 1 first shingles of
    any order: here by hash, those of ``hot`` (least hot first) last.
    """
    ranks = np.array(sorted((h, i + 1) for i, h in enumerate(hot)), dtype=np.int64).reshape(-1, 2)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for mark, text in zip(batch["mark"], batch["text"]):
                found = shingle_set(text)
                n = len(found)
                if not n:
                    continue
                if len(ranks):
                    at = np.minimum(np.searchsorted(ranks[:, 0], found), len(ranks) - 1)
                    rank = np.where(ranks[at, 0] == found, ranks[at, 1], 0)
                    found = found[np.argsort(rank, kind="stable")]
                rows.append((mark, n, found[: n + (-SIMILAR * n // SIMILAR_OF) + 1]))
            yield pd.DataFrame(rows, columns=["mark", "n", "prefix"])

    texts = docs.select(F.xxhash64("text").alias("mark"), F.col("text").cast("binary").alias("text"))
    return texts.mapInPandas(cut, "mark long, n long, prefix array<long>").dropDuplicates(["mark"])


def prefix_rows(docs: DataFrame) -> DataFrame:
    """Rows (shingle, mark, n, at) of the prefixes, common shingles last."""

    def rows(hot: list[int] = ()) -> DataFrame:
        found = prefixes(docs, hot).select("mark", "n", F.posexplode("prefix").alias("at", "shingle"))
        return stored(found, "prefixes")

    found = rows()
    crowds = found.groupBy("shingle").count().where(F.col("count") > HOT_ROWS)
    hot = [r.shingle for r in crowds.orderBy(F.desc("count"), "shingle").limit(HOT_SHINGLES).collect()]
    return rows(hot[::-1]) if hot else found


def fits(x: str, y: str):
    """Whether sizes and places of a shared shingle leave room for 4 / 5."""
    x_n, y_n = F.col(f"{x}n"), F.col(f"{y}n")
    room = 1 + F.least(x_n - F.col(f"{x}at") - 1, y_n - F.col(f"{y}at") - 1)
    # The first shared shingle of the order is never farther in than this one.
    return alike_in_size(x_n, y_n) & (room >= least_overlap(x_n, y_n))


def hub_pairs(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of each text with the first text of its shingles."""
    hubs = rows.groupBy("shingle").agg(F.min(F.struct("mark", "n", "at")).alias("hub"), F.count("*").alias("size"))
    hubs = hubs.where("size > 1").select("shingle", *[F.col(f"hub.{c}").alias(f"hub_{c}") for c in ("mark", "n", "at")])
    met = rows.join(hubs, "shingle").where((F.col("mark") != F.col("hub_mark")) & fits("", "hub_"))
    return met.select(F.col("hub_mark").alias("a"), F.col("mark").alias("b")).distinct()


def open_pairs(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs (a, b) of texts that share a shingle and are not connected yet."""
    rooted = rows.join(roots, "mark")
    mixed = rooted.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    rooted = stored(rooted.join(mixed.select("shingle"), "shingle", "left_semi"), "rooted")
    x, y = rooted.alias("x"), rooted.alias("y")
    met = (
        (F.col("x.shingle") == F.col("y.shingle"))
        & (F.col("x.mark") < F.col("y.mark"))
        & (F.col("x.root") != F.col("y.root"))
        & fits("x.", "y.")
    )
    return x.join(y, met).select(F.col("x.mark").alias("a"), F.col("y.mark").alias("b")).distinct()


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"mark": batch["mark"], "shingles": [shingle_set(t) for t in batch["text"]]})


def alike(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets are alike.

    A table of slots keeps most other texts from being cut; the joins decide.
    """
    pairs = stored(pairs, "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("mark")).distinct()
    table = slot_table(wanted.select(slot_of(F.col("mark")).alias("slot")), F.lit(1))
    texts = docs.select(F.xxhash64("text").alias("mark"), F.col("text").cast("binary").alias("text"))
    sets = texts.where(in_table(table, slot_of(F.col("mark"))) == 1).mapInPandas(_sets, "mark long, shingles array<long>")
    sets = stored(sets.join(wanted, "mark", "left_semi").dropDuplicates(["mark"]), "sets")

    def side(name: str) -> DataFrame:
        return sets.select(F.col("mark").alias(name), F.col("shingles").alias(f"{name}_set"))

    met = pairs.join(side("a"), "a").join(side("b"), "b")
    shared = F.size(F.array_intersect("a_set", "b_set"))
    enough = (SIMILAR + SIMILAR_OF) * shared >= SIMILAR * (F.size("a_set") + F.size("b_set"))
    return stored(met.where(enough).select("a", "b"), "alike")


def jaccard_links(docs: DataFrame, nodes: DataFrame, known: DataFrame) -> DataFrame:
    """Links (a, b) that connect, with ``known``, what all similar pairs connect.

    ``nodes`` gives the node (fp) of every text (mark), ``known`` has links of
    nodes. Pairs that are connected already are not compared, so a dense group
    of near copies falls to the first of its members without its pairs.
    """
    nodes = stored(nodes.distinct(), "texts")
    rows = prefix_rows(docs)

    def between_nodes(pairs: DataFrame) -> DataFrame:
        a = nodes.select(F.col("mark").alias("a"), F.col("fp").alias("fp_a"))
        b = nodes.select(F.col("mark").alias("b"), F.col("fp").alias("fp_b"))
        return pairs.join(a, "a").join(b, "b").select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b"))

    first = between_nodes(alike(hub_pairs(rows), docs))
    found = components(known.unionByName(first)).withColumnRenamed("node", "fp")
    roots = nodes.join(found, "fp", "left").select("mark", F.coalesce("root", "fp").alias("root"))
    return first.unionByName(between_nodes(alike(open_pairs(rows, roots), docs)))
