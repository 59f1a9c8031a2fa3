"""Near-duplicate vectors by an epsilon grid order join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import prefix_sums, stored
from pagewright.llm.components import components, roots_of

COSINE = 0.98
# Rows, chosen by hash, from which the principal directions are learned. They
# only decide how much is skipped, never what is found.
SAMPLE = 4_096
# Leading principal dimensions that make up the grid.
DIMS = 8
# Vectors of a sequence interval that one task holds, twice.
BLOCK_ROWS = 2_048
# Intervals are paired level by level, this many children at a time.
FAN = 32
# Intervals of at most this many vectors are compared directly.
LEAF_ROWS = 128
# Room for rounding in the projections.
MARGIN = 1e-6


def epsilon(cosine: float) -> float:
    """Distance of unit vectors at the given cosine."""
    return float(np.sqrt(max(0.0, 2 - 2 * cosine)))


def distinct_vectors(vectors: DataFrame) -> DataFrame:
    """Rows (label, embedding, rep, copies): equal vectors of a label as one.

    ``rep`` is their least vec_id. Rows without a label or a vec_id and vectors
    that are null, zero or hold null or non-finite components are left out.
    """
    inf = F.lit(float("inf"))
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)) & F.exists(
        "embedding", lambda x: x != 0
    )
    return (
        vectors.select("vec_id", "label", "embedding")
        .where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
        .where(usable)
        .groupBy("label", "embedding")
        .agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    )


def directions(distinct: DataFrame) -> dict[int, np.ndarray]:
    """Leading principal directions by vector length, from a bounded sample."""
    sample = distinct.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("embedding").collect()
    by_size: dict[int, list] = {}
    for (vector,) in sample:
        by_size.setdefault(len(vector), []).append(vector)
    out = {}
    for size, rows in by_size.items():
        units = np.array(rows, dtype=np.float64)
        units /= np.linalg.norm(units, axis=1, keepdims=True)
        out[size] = np.linalg.svd(units - units.mean(axis=0), full_matrices=True)[2][:DIMS].T
    return out


def _units(embeddings) -> np.ndarray:
    """Unit vectors; large and tiny components are scaled before squaring."""
    rows = np.array(embeddings.tolist(), dtype=np.float64)
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _project(axes: dict[int, np.ndarray], width: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = batch["embedding"].map(len)
            for size in sorted(sizes.unique()):
                rows = batch[sizes == size].reset_index(drop=True)
                # Unit directions that the sample lacks: the leading components.
                spread = axes.get(size, np.eye(size)[:, :DIMS])
                places = np.zeros((len(rows), DIMS))
                places[:, : spread.shape[1]] = _units(rows["embedding"]) @ spread
                cells = np.floor(places / width).astype(np.int64)
                grid = {f"c{i}": cells[:, i] for i in range(DIMS)}
                yield rows.assign(size=size, **grid, place=list(places))

    return run


GRID = ", ".join(f"c{i} long" for i in range(DIMS))


def in_grid_order(distinct: DataFrame, width: float) -> DataFrame:
    """Add size, place, number, and block: the interval of the sequence a row is in.

    The sequence is sorted by label, length of the vector, and grid cell on
    the leading principal dimensions.
    """
    label = dict(distinct.dtypes)["label"]
    schema = f"label {label}, embedding array<double>, rep long, copies long, size int, {GRID}, place array<double>"
    wide = distinct.withColumn("embedding", F.col("embedding").cast("array<double>"))
    placed = wide.mapInPandas(_project(directions(distinct), width), schema)
    order = ["label", "size", *[f"c{i}" for i in range(DIMS)], "rep"]
    numbered = prefix_sums(placed, order, {"number": F.lit(1).cast("long")})
    block = F.floor((F.col("number") - 1) / BLOCK_ROWS).cast("long")
    return numbered.select("label", "size", "embedding", "rep", "copies", "place", "number", block.alias("block"))


def block_pairs(rows: DataFrame, width: float) -> DataFrame:
    """Rows (label, size, a, b), a <= b: intervals not provably distant.

    Intervals are paired from the top of a tree down: pairs of long intervals
    whose boxes are farther apart than ``width`` are dropped with all below.
    """
    keys = ["label", "size"]
    corners = [f(F.get("place", F.lit(i))).alias(f"{n}{i}") for i in range(DIMS) for n, f in (("low", F.min), ("high", F.max))]
    level = stored(rows.groupBy(*keys, F.col("block").alias("node")).agg(*corners), "boxes")
    levels, top = [level], level.agg(F.max("node")).first()[0] or 0
    merged = [f(f"{n}{i}").alias(f"{n}{i}") for i in range(DIMS) for n, f in (("low", F.min), ("high", F.max))]
    while top >= FAN:
        top //= FAN
        level = level.withColumn("node", F.floor(F.col("node") / FAN).cast("long")).groupBy(*keys, "node").agg(*merged)
        levels.append(level)
    pairs = None
    for level in reversed(levels):
        left = level.select(*keys, *[F.col(c).alias(f"a_{c}") for c in level.columns if c not in keys])
        right = level.select(*keys, *[F.col(c).alias(f"b_{c}") for c in level.columns if c not in keys])
        apart = sum(
            (F.greatest(F.col(f"a_low{i}") - F.col(f"b_high{i}"), F.col(f"b_low{i}") - F.col(f"a_high{i}"), F.lit(0.0)) ** 2 for i in range(DIMS)),
            F.lit(0.0),
        )
        near = (F.col("a_node") <= F.col("b_node")) & (apart <= width * width + MARGIN)
        if pairs is None:
            met = left.join(right, keys)
        else:
            up = [F.floor(F.col(f"{s}_node") / FAN).cast("long").alias(f"{s}_up") for s in "ab"]
            met = pairs.select(*keys, F.col("a").alias("a_up"), F.col("b").alias("b_up")).join(left.select("*", up[0]), [*keys, "a_up"])
            met = met.join(right.select("*", up[1]), [*keys, "b_up"])
        pairs = stored(met.where(near).select(*keys, F.col("a_node").alias("a"), F.col("b_node").alias("b")), "pairs")
    return pairs


class Interval:
    """A run of rows in grid order with the boxes of its halves at hand."""

    def __init__(self, rows: pd.DataFrame):
        self.units = _units(rows["embedding"])
        self.places = np.array(rows["place"].tolist())
        self.copies = rows["copies"].to_numpy(dtype=np.int64)
        self.rep = rows["rep"].to_numpy(dtype=np.int64)
        self.boxes: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def box(self, low: int, high: int):
        if (low, high) not in self.boxes:
            part = self.places[low:high]
            self.boxes[low, high] = part.min(axis=0), part.max(axis=0)
        return self.boxes[low, high]


def join_intervals(a: Interval, b: Interval, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs with at least ``cosine``; of one interval with itself, i < j."""
    far, same = epsilon(cosine) ** 2 + MARGIN, a is b
    todo = [(0, len(a.rep), 0, len(b.rep))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        (al, ah), (bl, bh) = a.box(a0, a1), b.box(b0, b1)
        if (np.maximum(np.maximum(al - bh, bl - ah), 0) ** 2).sum() > far:
            continue
        if a1 - a0 <= LEAF_ROWS and b1 - b0 <= LEAF_ROWS:
            i, j = np.nonzero(a.units[a0:a1] @ b.units[b0:b1].T >= cosine)
            i, j = i + a0, j + b0
            yield (i[i < j], j[i < j]) if same else (i, j)
            continue
        am, bm = (a0 + a1) // 2, (b0 + b1) // 2
        for x in ((a0, am), (am, a1)):
            for y in ((b0, bm), (bm, b1)):
                if x[1] > x[0] and y[1] > y[0] and not (same and y[1] <= x[0]):
                    todo.append((*x, *y))


def _join(cosine: float):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        a, b = key[2], key[3]
        left = Interval(rows[rows["block"] == a].sort_values("number"))
        right = left if a == b else Interval(rows[rows["block"] == b].sort_values("number"))
        shift = 0 if a == b else len(left.rep)
        n = shift + len(right.rep)
        links, parent = np.zeros(n, dtype=np.int64), np.arange(n)
        for i, j in join_intervals(left, right, cosine):
            links += np.bincount(i, weights=right.copies[j], minlength=n).astype(np.int64)
            links += np.bincount(j + shift, weights=left.copies[i], minlength=n).astype(np.int64)
            parent = roots_of(n, i, j + shift, parent)
        rep = left.rep if a == b else np.concatenate((left.rep, right.rep))
        kept = links > 0
        return pd.DataFrame({"node": rep[kept], "links": links[kept], "root": rep[parent[kept]]})

    return run


def vector_groups(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one per row of ``vectors``.

    Vectors of one label, and of one length, are linked from ``cosine`` on.
    ``n_links`` counts the other rows linked directly, copies one by one;
    ``component_id`` is the least vec_id that links lead to. Rows that take no
    part (no label, no usable vector) have no links and are kept; so are rows
    without a vec_id, whose component_id is null. Rows that share a vec_id are
    one node: their links add up.
    """
    width = epsilon(cosine)
    distinct = stored(distinct_vectors(vectors), "distinct")
    rows = stored(in_grid_order(distinct, width), "grid")
    pairs = block_pairs(rows, width)
    tasks = pairs.select(
        "label", "size", "a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("block")
    )
    found = stored(
        rows.join(tasks, ["label", "size", "block"])
        .groupBy("label", "size", "a", "b")
        .applyInPandas(_join(cosine), "node long, links long, root long"),
        "links",
    )
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    nodes = (
        distinct.withColumnRenamed("rep", "node")
        .join(links, "node", "left")
        .join(roots, "node", "left")
        .select(
            "label",
            "embedding",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("root", "node").alias("component_id"),
        )
    )
    known = vectors.select("vec_id", "label", "embedding").join(nodes, ["label", "embedding"], "left")
    own = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return known.select(
        "vec_id",
        F.when(F.col("vec_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        own.alias("component_id"),
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
