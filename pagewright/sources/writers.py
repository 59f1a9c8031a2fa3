"""Sinks for records and graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.operators.graph import density


def write_crawl_store(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Records under ``s1=<2 hex>/s2=<2 hex>`` folders of the URL hash.

    Rows are brought together by folder before the write, so a folder gets
    few files instead of one per task.
    """
    h = F.sha2("url", 256)
    (
        df.withColumn("s1", F.substring(h, 1, 2))
        .withColumn("s2", F.substring(h, 3, 2))
        .repartition("s1", "s2")
        .write.partitionBy("s1", "s2")
        .mode(mode)
        .json(path)
    )


def stored_path(url: Column | str) -> Column:
    """Storage key of a URL: two levels of two hex digits, then the hash."""
    h = F.sha2(F.col(url) if isinstance(url, str) else url, 256)
    return F.concat_ws("/", F.substring(h, 1, 2), F.substring(h, 3, 2), F.concat(h, F.lit(".json")))


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def write_text_in_order(df: DataFrame, order: list[str], text: str, path: str) -> None:
    """One long text as range-sorted parts: concatenated files are the whole."""
    df.orderBy(*order).select(F.concat(F.col(text), F.lit("\n")).alias("value")).write.mode("overwrite").text(path)


def graph_json(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """JSON lines of nodes and edges, and the one-row statistics."""
    attributes = [c for c in nodes.columns if c != "url"]
    node_lines = nodes.select(F.to_json(F.struct(F.col("url").alias("id"), *attributes)).alias("value"))
    edge_lines = edges.select(F.to_json(F.struct("source", "target")).alias("value"))
    counted = nodes.agg(F.count("*").alias("nodes")).join(F.broadcast(edges.agg(F.count("*").alias("edges"))))
    return node_lines, edge_lines, counted.select("nodes", "edges", density("nodes", "edges").alias("density"))


def write_graph_json(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    node_lines, edge_lines, stats = graph_json(nodes, edges)
    node_lines.write.mode("overwrite").text(f"{path}/nodes")
    edge_lines.write.mode("overwrite").text(f"{path}/edges")
    stats.write.mode("overwrite").json(f"{path}/stats")


# The frame of a GraphML document.
GRAPHML_HEAD = [
    '<?xml version="1.0" encoding="UTF-8"?>',
    '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">',
    '  <graph edgedefault="directed">',
]
GRAPHML_TAIL = ["  </graph>", "</graphml>"]


def xml_escape(text: Column) -> Column:
    escaped = text
    for char, name in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")]:
        escaped = F.replace(escaped, F.lit(char), F.lit(name))
    return escaped


def graphml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, value): document lines, ordered by part."""
    spark = nodes.sparkSession
    frame = spark.createDataFrame(
        [(0, "\n".join(GRAPHML_HEAD)), (3, "\n".join(GRAPHML_TAIL))], "part int, value string"
    )
    node_lines = nodes.select(
        F.lit(1).alias("part"), F.concat(F.lit('    <node id="'), xml_escape(F.col("url")), F.lit('"/>')).alias("value")
    )
    edge_lines = edges.select(
        F.lit(2).alias("part"),
        F.concat(
            F.lit('    <edge source="'),
            xml_escape(F.col("source")),
            F.lit('" target="'),
            xml_escape(F.col("target")),
            F.lit('"/>'),
        ).alias("value"),
    )
    return frame.unionByName(node_lines).unionByName(edge_lines)


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """GraphML as range-sorted text files; in name order they are the document."""
    graphml_lines(nodes, edges).orderBy("part", "value").select("value").write.mode("overwrite").text(path)


def write_graph_csv(edges: DataFrame, path: str) -> None:
    edges.select("source", "target").write.mode("overwrite").option("header", True).csv(path)
