"""Link graph tables and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.base import as_col
from pagewright.operators.links import osint_links
from pagewright.operators.skew import lookup
from pagewright.session import cut_lineage

def site_graph(pages: DataFrame, links: DataFrame, order: str = "page_id") -> tuple[DataFrame, DataFrame]:
    """Nodes keyed by URL with the last metadata, and edges with repeats."""
    nodes = pages.groupBy("url").agg(F.max_by("metadata", order).alias("metadata"))
    return nodes, links.select("source", "target")


def osint_graph(pages: DataFrame, order: str = "page_id") -> tuple[DataFrame, DataFrame]:
    """Simple directed graph of the first visit of each URL.

    Only the winning row ids travel; the markup stays where it is scanned.
    """
    firsts = pages.groupBy("url").agg(F.min(order).alias(order)).select(order)
    edges = (
        osint_links(pages.select(order, "url", "html").join(firsts, order, "left_semi"))
        .select("source", "target")
        .distinct()
    )
    nodes = (
        pages.select("url")
        .unionByName(edges.select(F.col("source").alias("url")))
        .unionByName(edges.select(F.col("target").alias("url")))
        .distinct()
    )
    return nodes, edges


def graph_metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: node count, edge count, average degree."""
    n = nodes.agg(F.count("*").alias("num_nodes"))
    e = edges.agg(F.count("*").alias("num_edges"))
    return n.join(F.broadcast(e)).withColumn(
        "avg_degree",
        F.when(F.col("num_nodes") > 0, 2.0 * F.col("num_edges") / F.col("num_nodes")).otherwise(0.0),
    )


def inlink_score(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Inlinks over node count for every node."""
    inlinks = edges.groupBy(F.col("target").alias("url")).agg(F.count("*").alias("inlinks"))
    total = nodes.agg(F.count("*").alias("_n"))
    return (
        nodes.select("url")
        .join(inlinks, "url", "left")
        .join(F.broadcast(total))
        .select(
            "url",
            F.coalesce("inlinks", F.lit(0)).alias("inlinks"),
            (F.coalesce("inlinks", F.lit(0)) / F.col("_n")).alias("score"),
        )
    )


def pagerank(
    nodes: DataFrame, edges: DataFrame, iterations: int = 10, damping: float = 0.85, checkpoint_every: int = 3
) -> DataFrame:
    """Ranks by power iteration; the rank of sinks is shared by all nodes.

    Edges carry their out-degree from the start, so a step is one join by
    source and one aggregation by target. Sources have few outgoing links
    each; hot targets are combined before the shuffle.
    """
    n = nodes.count()
    links = edges.select("source", "target").distinct()
    degrees = links.groupBy("source").agg(F.count("*").alias("degree"))
    vertices = cut_lineage(
        nodes.select("url")
        .join(degrees, nodes["url"] == degrees["source"], "left")
        .select("url", F.coalesce("degree", F.lit(0)).alias("degree"))
    )
    links = cut_lineage(links)
    ranks = vertices.select("url", "degree", F.lit(1.0 / max(n, 1)).alias("rank"))
    for step in range(1, iterations + 1):
        shares = ranks.filter("degree > 0").select(
            F.col("url").alias("source"), (F.col("rank") / F.col("degree")).alias("share")
        )
        received = (
            links.join(shares, "source").groupBy(F.col("target").alias("url")).agg(F.sum("share").alias("got"))
        )
        sinks = ranks.agg(F.sum(F.when(F.col("degree") == 0, F.col("rank")).otherwise(0.0)).alias("lost"))
        ranks = (
            vertices.join(received, "url", "left")
            .join(F.broadcast(sinks))
            .select(
                "url",
                "degree",
                (
                    F.lit((1.0 - damping) / max(n, 1))
                    + damping * (F.coalesce("got", F.lit(0.0)) + F.coalesce("lost", F.lit(0.0)) / max(n, 1))
                ).alias("rank"),
            )
        )
        if step % checkpoint_every == 0 and step < iterations:
            ranks = cut_lineage(ranks)
    return ranks.select("url", "rank")


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Weak component per node: (url, component), the least URL of it.

    Alternates large-star and small-star steps until nothing changes, which
    takes a logarithmic number of rounds. A hub's neighbours are never listed
    in one row; each step is a minimum per node and a salted lookup of it.
    """
    arcs = (
        edges.select(F.greatest("source", "target").alias("u"), F.least("source", "target").alias("v"))
        .filter("u != v")
        .distinct()
    )
    arcs = cut_lineage(arcs)
    fingerprint = None
    # Every round but the last changes the arcs, and none grows them.
    while True:
        both = arcs.select("u", "v").union(arcs.select("v", "u"))
        # Large star: neighbours above a node move to its least neighbour.
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        large = (
            lookup(both, least, ["u"], "n", "inner", salt_from=["u", "v"])
            .filter("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .filter("u != v")
            .distinct()
        )
        # Small star: a node and its lower neighbours move to the least one.
        lower = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = (
            lookup(large, lower, ["u"], "n", "inner", salt_from=["u", "v"])
            .select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
            .filter("u != v")
            .distinct()
        )
        arcs = cut_lineage(small)
        row = arcs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (row[0], row[1]) == fingerprint:
            break
        fingerprint = (row[0], row[1])
    return (
        nodes.select("url")
        .join(arcs.select(F.col("u").alias("url"), F.col("v").alias("component")), "url", "left")
        .select("url", F.coalesce("component", "url").alias("component"))
    )


def density(nodes: Column | str, edges: Column | str) -> Column:
    """Edges over ordered pairs of nodes; zero without two nodes and an edge."""
    n, m = as_col(nodes), as_col(edges)
    return F.when((n > 1) & (m > 0), m / (n * (n - 1))).otherwise(0.0)


def graph_statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, density, connectedness, component count."""
    components = connected_components(nodes, edges).agg(F.count_distinct("component").alias("components"))
    return (
        nodes.agg(F.count("*").alias("nodes"))
        .join(F.broadcast(edges.agg(F.count("*").alias("edges"))))
        .join(F.broadcast(components))
        .select(
            "nodes",
            "edges",
            density("nodes", "edges").alias("density"),
            (F.col("components") == 1).alias("is_connected"),
            "components",
        )
    )
