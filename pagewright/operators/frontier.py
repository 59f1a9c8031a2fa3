"""Crawl scope, limits and breadth-first waves over a known link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions.base import as_col
from pagewright.functions.urls import domain_of, should_follow, url_priority
from pagewright.operators.skew import broadcast_if_small, running_total, top_per_group
from pagewright.session import cut_lineage

SEED_PRIORITY = 1.0


def seed_frontier(urls: DataFrame, url: str = "url") -> DataFrame:
    return urls.select(F.col(url).alias("url")).distinct().select(
        "url", F.lit(0).alias("depth"), F.lit(SEED_PRIORITY).alias("priority")
    )


def scope_filter(edges: DataFrame, subdomains: bool = True, external: bool = False) -> DataFrame:
    return edges.filter(should_follow("source", "target", subdomains, external))


def visited_filter(frontier: DataFrame, visited: DataFrame) -> DataFrame:
    return frontier.join(visited.select("url"), "url", "left_anti")


def domain_cap(df: DataFrame, n: int) -> DataFrame:
    """At most ``n`` pages per ``scheme://netloc``: shallow and urgent first."""
    order = [F.col("depth"), F.desc("priority"), F.col("url")]
    return top_per_group(df.withColumn("domain", domain_of("url")), ["domain"], order, n)


def _first(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """First ``n`` rows, numbered over ranges: a large n never meets one task."""
    ranked = running_total(df.withColumn("_urgency", -F.col("priority")), order, F.lit(1), "_number")
    return ranked.filter(F.col("_number") <= n).drop("_urgency", "_number")


def max_urls(df: DataFrame, n: int) -> DataFrame:
    return _first(df, ["depth", "_urgency", "url"], n)


def next_batch(frontier: DataFrame, k: int) -> DataFrame:
    return _first(frontier, ["_urgency", "url"], k)


def enqueue(links: DataFrame, subdomains: bool = True, external: bool = False) -> DataFrame:
    """Frontier items of the in-scope targets of ``(source, target, depth)``."""
    return (
        scope_filter(links, subdomains, external)
        .groupBy(F.col("target").alias("url"))
        .agg((F.min("depth") + 1).alias("depth"))
        .withColumn("priority", url_priority("url"))
    )


def crawl_waves(
    links: DataFrame, seeds: DataFrame, max_depth: int | None = None, checkpoint_links: bool = True
) -> DataFrame:
    """(url, depth) of everything reachable, at its least depth.

    Each wave joins only the newly found URLs with the links; while a wave is
    small it is broadcast, and the edges are scanned without a shuffle.
    Parallel edges are folded first. Scope is the caller's filter.
    """
    edges = links.select("source", "target").distinct()
    if checkpoint_links:
        edges = cut_lineage(edges)
    wave = cut_lineage(seeds.select("url").distinct().withColumn("depth", F.lit(0)))
    visited, depth = wave, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        found = (
            edges.join(broadcast_if_small(wave.select(F.col("url").alias("source"))), "source", "left_semi")
            .select(F.col("target").alias("url"))
            .distinct()
        )
        wave = cut_lineage(visited_filter(found, visited).withColumn("depth", F.lit(depth)))
        if wave.isEmpty():
            break
        visited = visited.unionByName(wave)
        if depth % 10 == 0:
            visited = cut_lineage(visited)
    return visited


def crawl_stats(outcomes: DataFrame, status: str = "status", size: str = "bytes") -> DataFrame:
    """One row: attempts, full successes, raised errors, bytes of all bodies."""
    s = F.col(status)
    return outcomes.agg(
        F.count("*").alias("processed"),
        F.coalesce(F.sum((s == "success").cast("long")), F.lit(0)).alias("success"),
        F.coalesce(F.sum((s == "error").cast("long")), F.lit(0)).alias("errors"),
        F.coalesce(F.sum(as_col(size)), F.lit(0)).alias("bytes_downloaded"),
    )


def frontier_status(
    queued: DataFrame, in_progress: DataFrame, visited: DataFrame, processed: int | DataFrame
) -> DataFrame:
    """One row: ever queued, still pending, in progress, visited, processed."""
    ever = queued.agg(F.count("*").alias("queued"))
    pending = visited_filter(queued, visited).agg(F.count("*").alias("pending"))
    busy = in_progress.agg(F.count("*").alias("in_progress"))
    seen = visited.agg(F.count("*").alias("visited"))
    done = (
        processed.agg(F.count("*").alias("processed")) if isinstance(processed, DataFrame) else None
    )
    out = ever.join(F.broadcast(pending)).join(F.broadcast(busy)).join(F.broadcast(seen))
    if done is None:
        return out.withColumn("processed", F.lit(processed).cast("long"))
    return out.join(F.broadcast(done))
