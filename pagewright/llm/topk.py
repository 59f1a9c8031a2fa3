"""Exact top-k inner product search by ball trees, one per shard."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.common import stored

K = 20
SCALE = 64
# Vectors of a shard and queries of a block: what one task holds at most.
SHARD_ROWS, BLOCK_ROWS = 8_192, 4_096
# Vectors of a tree's leaf.
LEAF_ROWS = 256
# Inner products below this bound are exact in double precision.
EXACT = 2.0**53


@dataclass
class Ball:
    """A node: rows low..high of the ordered shard, their centre and radius."""

    low: int
    high: int
    centre: np.ndarray
    radius: float
    children: tuple[Ball, ...] = ()


def ball_tree(points: np.ndarray, leaf_rows: int = LEAF_ROWS) -> tuple[Ball, np.ndarray]:
    """Root and row order: nodes are halved across their widest dimension."""
    order = np.arange(len(points))

    def build(low: int, high: int) -> Ball:
        rows = points[order[low:high]]
        centre = rows.mean(axis=0)
        radius = float(np.sqrt(((rows - centre) ** 2).sum(axis=1).max()))
        if high - low <= leaf_rows or radius == 0.0:
            return Ball(low, high, centre, radius)
        widest = int(np.argmax(rows.max(axis=0) - rows.min(axis=0)))
        middle = (high - low) // 2
        order[low:high] = order[low:high][np.argpartition(rows[:, widest], middle)]
        return Ball(low, high, centre, radius, (build(low, low + middle), build(low + middle, high)))

    return build(0, len(points)), order


def search_shard(queries: np.ndarray, query_ids, floors, vectors: np.ndarray, vec_ids, k: int = K):
    """Best ``k`` of a shard for each query: (query row, vector row, score) arrays.

    ``floors`` are scores that k vectors elsewhere already reach. Nodes are
    visited in the order of their upper bound, q * centre + |q| * radius, by
    all queries for which it still reaches the k-th best score so far. Ties
    go to the smaller vec_id; a query's own row is left out.
    """
    n, dims = vectors.shape
    by_id = np.argsort(vec_ids, kind="stable")
    vectors, vec_ids = vectors[by_id], vec_ids[by_id]
    largest = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * max(dims, 1)
    if largest >= EXACT:  # too large for doubles: plain integers, every row
        return _search_integers(queries, query_ids, floors, vectors, vec_ids, by_id, k)
    points, asked = vectors.astype(np.float64), queries.astype(np.float64)
    root, order = ball_tree(points)
    points, rank = points[order], order
    norms = np.sqrt((asked**2).sum(axis=1))
    # One key per pair: the score, then the smaller id first. -1 is no pair.
    lowest = int(-largest) - 1
    best = np.full((len(asked), k), -1, dtype=np.int64)
    kth = np.full(len(asked), -np.inf) if floors is None else floors.astype(np.float64).copy()
    if (largest * 2 + 2) * n >= 2.0**62:
        return _search_integers(queries, query_ids, floors, vectors, vec_ids, by_id, k)

    def bounds(node: Ball, rows: np.ndarray) -> np.ndarray:
        # The margin covers rounding; scores are whole numbers.
        return asked[rows] @ node.centre + norms[rows] * node.radius + 1e-6 * (1 + norms[rows])

    def visit(node: Ball, rows: np.ndarray) -> None:
        if node.children:
            seen = [bounds(child, rows) for child in node.children]
            for i in sorted(range(len(seen)), key=lambda j: -float(seen[j].max(initial=-np.inf))):
                open_ = rows[seen[i] >= kth[rows]]
                if len(open_):
                    visit(node.children[i], open_)
            return
        rows = rows[bounds(node, rows) >= kth[rows]]
        here = rank[node.low : node.high]
        scores = np.rint(asked[rows] @ points[node.low : node.high].T).astype(np.int64)
        keys = (scores - lowest) * n + (n - 1 - here)
        keys[query_ids[rows][:, None] == vec_ids[here][None, :]] = -1
        merged = np.concatenate((best[rows], keys), axis=1)
        merged = np.partition(merged, merged.shape[1] - k, axis=1)[:, -k:]
        best[rows] = merged
        reached = merged.min(axis=1)
        full = reached >= 0
        kth[rows[full]] = np.maximum(kth[rows[full]], reached[full] // n + lowest)

    visit(root, np.arange(len(asked)))
    row, _ = np.nonzero(best >= 0)
    keys = best[best >= 0]
    return row, by_id[n - 1 - keys % n], keys // n + lowest


def _search_integers(queries, query_ids, floors, vectors, vec_ids, by_id, k):
    rows, found, scores = [], [], []
    exact = vectors.astype(object)
    for i, (query, own) in enumerate(zip(queries.astype(object), query_ids)):
        values = exact @ query
        ranked = [j for j in sorted(range(len(values)), key=lambda j: (-values[j], vec_ids[j])) if vec_ids[j] != own][:k]
        rows += [i] * len(ranked)
        found += [by_id[j] for j in ranked]
        scores += [int(values[j]) for j in ranked]
    return np.array(rows, dtype=np.int64), np.array(found, dtype=np.int64), np.array(scores, dtype=np.int64)


def scaled(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, point): usable vectors as floor(SCALE * x) of every component.

    Null vectors, vectors with null or non-finite components and rows without
    a vec_id take no part. Of rows that share a vec_id the least vector does.
    """
    wide = F.transform("embedding", lambda x: x.cast("double"))
    usable = F.forall("wide", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    point = F.transform(F.col("wide"), lambda x: F.floor(F.lit(SCALE) * x))
    return (
        vectors.select("vec_id", wide.alias("wide"))
        .where(F.col("vec_id").isNotNull() & F.col("wide").isNotNull() & usable)
        .groupBy("vec_id")
        .agg(F.min(point).alias("point"))
    )


def _search(k: int, use_floor: bool):
    def run(key: tuple, queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        if not len(queries) or not len(vectors):
            return none
        asked, points = np.stack(queries["point"].to_numpy()), np.stack(vectors["point"].to_numpy())
        ids = vectors["vec_id"].to_numpy()
        floors = queries["floor"].fillna(-np.inf).to_numpy() if use_floor else None
        row, found, score = search_shard(asked, queries["query_id"].to_numpy(), floors, points, ids, k)
        return pd.DataFrame({"query_id": queries["query_id"].to_numpy()[row], "vec_id": ids[found], "score": score})

    return run


FOUND = "query_id long, vec_id long, score long"


def top_k(vectors: DataFrame, is_query: Column, k: int = K, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the ``k`` best of every query.

    ``is_query`` selects queries by vec_id; candidates are all usable rows but
    the query's own, of as many dimensions. Rows are dealt into shards and
    queries into blocks of bounded size. Every block first searches one shard;
    the k-th score found there is the floor with which it searches the others,
    so that most of their trees are cut off. A shard gives at most k rows per
    query. Fewer candidates than k are all returned; empty vectors score 0.
    """
    points = stored(scaled(vectors).withColumn("dims", F.size("point")), "points")
    sizes = points.agg(F.count("*"), F.count_if(is_query)).first()
    shards, blocks = -(-sizes[0] // shard_rows) or 1, -(-sizes[1] // block_rows) or 1
    deal = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("int")
    dealt = points.withColumn("shard", deal(shards, 1))
    asked = points.where(is_query).select("vec_id", "point", "dims", deal(blocks, 2)).toDF(
        "query_id", "point", "dims", "block"
    )
    every_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    first_shard = F.pmod(F.col("block"), F.lit(shards)).alias("shard")

    def joined(queries: DataFrame, rows: DataFrame, use_floor: bool) -> DataFrame:
        keys = ["dims", "block", "shard"]
        return (
            queries.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(_search(k, use_floor), FOUND)
        )

    replicated = dealt.select("vec_id", "point", "dims", "shard", every_block)
    home = joined(
        asked.select("*", first_shard),
        replicated.where(F.pmod(F.col("block"), F.lit(shards)) == F.col("shard")),
        False,
    )
    home = stored(home, "home")
    floors = home.groupBy("query_id").agg(
        F.when(F.count("*") >= k, F.min("score").cast("double")).alias("floor")
    )
    others = F.explode(F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: s != F.pmod(F.col("block"), F.lit(shards))))
    away = joined(
        asked.join(floors, "query_id", "left").select("*", others.alias("shard")),
        replicated.where(F.pmod(F.col("block"), F.lit(shards)) != F.col("shard")),
        True,
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        home.unionByName(away)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
