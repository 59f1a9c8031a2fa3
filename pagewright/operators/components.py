"""Connected components over integer nodes, and the local forests that feed them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) of the connected components of ``edges`` (a, b).

    ``root`` is the least node of the component. Alternates large-star and
    small-star steps: every step is a minimum per node and a join of it, no
    neighbourhood is ever gathered in one row. It ends when a round changes
    nothing, which takes a logarithmic number of rounds. Nodes without an edge
    to another node do not appear. Null ends are ignored.
    """
    arcs = cut_lineage(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("a IS NOT NULL AND b IS NOT NULL AND u > v")
        .distinct()
    )
    seen = None
    while True:
        state = arcs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen or state[0] == 0:
            return arcs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                arcs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        seen = tuple(state)
        both = arcs.union(arcs.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = (
            both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        )
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(lower, "u")
            .select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
            .where("u > v")
            .distinct()
        )
        arcs = cut_lineage(small)


def roots_of(n: int, left: np.ndarray, right: np.ndarray, parent: np.ndarray | None = None) -> np.ndarray:
    """Least reachable index per node of a small graph, by pointer jumping."""
    parent = np.arange(n) if parent is None else parent
    while True:
        a, b = parent[left], parent[right]
        low, high = np.minimum(a, b), np.maximum(a, b)
        if not (open_ := low < high).any():
            return parent
        np.minimum.at(parent, high[open_], low[open_])
        while True:
            jumped = parent[parent]
            if (jumped == parent).all():
                break
            parent = jumped
