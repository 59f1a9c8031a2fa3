"""Crawl state snapshots: counters, visited URLs, pending frontier."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright import schemas

PUBLISHED = "_PUBLISHED"


@dataclass
class CrawlState:
    counters: DataFrame
    visited: DataFrame
    frontier: DataFrame
    has_frontier: bool


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def list_versions(spark: SparkSession, path: str, marker: str = PUBLISHED) -> list[int]:
    """Numbers of the ``v=<n>`` folders that hold the marker, ascending."""
    fs, Path = _fs(spark, path)
    if not fs.exists(Path(path)):
        return []
    found = []
    for status in fs.listStatus(Path(path)):
        match = re.fullmatch(r"v=(\d+)", status.getPath().getName())
        if match and fs.exists(Path(f"{path}/v={match[1]}/{marker}")):
            found.append(int(match[1]))
    return sorted(found)


def save_state(
    path: str, counters: DataFrame, visited: DataFrame, frontier: DataFrame | None = None
) -> int:
    """Write a new version whole, then publish it by a marker file."""
    spark = visited.sparkSession
    version = (list_versions(spark, path) or [0])[-1] + 1
    base = f"{path}/v={version}"
    counters.select("processed", "success", "errors").withColumn("saved_at", F.current_timestamp()).write.mode(
        "overwrite"
    ).parquet(f"{base}/counters")
    visited.select("url").distinct().write.mode("overwrite").parquet(f"{base}/visited")
    if frontier is not None:
        frontier.select("url", "depth", "priority").write.mode("overwrite").parquet(f"{base}/frontier")
    fs, Path = _fs(spark, path)
    fs.create(Path(f"{base}/{PUBLISHED}"), True).close()
    return version


def load_state(spark: SparkSession, path: str) -> CrawlState | None:
    """Latest published version; without a saved frontier that part is empty."""
    versions = list_versions(spark, path)
    if not versions:
        return None
    base = f"{path}/v={versions[-1]}"
    fs, Path = _fs(spark, path)
    has_frontier = fs.exists(Path(f"{base}/frontier"))
    frontier = (
        spark.read.schema(schemas.FRONTIER).parquet(f"{base}/frontier")
        if has_frontier
        else spark.createDataFrame([], schemas.FRONTIER)
    )
    return CrawlState(
        counters=spark.read.schema(schemas.COUNTERS).parquet(f"{base}/counters"),
        visited=spark.read.schema(schemas.VISITED).parquet(f"{base}/visited"),
        frontier=frontier,
        has_frontier=has_frontier,
    )


def resume_frontier(spark: SparkSession, path: str, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(frontier, visited) to go on with; seeds only when nothing is pending."""
    state = load_state(spark, path)
    if state is None:
        return seeds, spark.createDataFrame([], schemas.VISITED)
    if state.has_frontier and not state.frontier.isEmpty():
        return state.frontier, state.visited
    return seeds.join(state.visited, "url", "left_anti"), state.visited
