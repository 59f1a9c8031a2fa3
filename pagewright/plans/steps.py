"""Named steps over tables, and the case summary."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.operators.frontier import crawl_stats, crawl_waves, scope_filter
from pagewright.plans.process import extract_text
from pagewright.sources.writers import write_jsonl, write_parquet

Transform = Callable[[DataFrame], DataFrame]


def _crawl(step: Mapping[str, Any], tables: Mapping[str, DataFrame]) -> DataFrame:
    cfg = step.get("config", {})
    links = tables[step.get("links", "links")]
    scoped = scope_filter(links, cfg.get("follow_subdomains", True), cfg.get("follow_external", False))
    spark = links.sparkSession
    seeds = spark.createDataFrame([(u,) for u in step.get("urls", [])], "url string")
    reached = crawl_waves(scoped, seeds, cfg.get("max_depth"))
    # Only the length of a page is shuffled, not the page.
    pages = tables[step.get("pages", "pages")].groupBy("url").agg(F.max(F.octet_length("html")).alias("size"))
    outcomes = reached.join(pages, "url", "left").select(
        F.when(F.col("size").isNotNull(), "success").otherwise("skipped").alias("status"),
        F.coalesce("size", F.lit(0)).alias("bytes"),
    )
    return crawl_stats(outcomes)


def _fetch(step: Mapping[str, Any], tables: Mapping[str, DataFrame]) -> DataFrame:
    pages = tables[step.get("pages", "pages")]
    status = F.col("status_code") if "status_code" in pages.columns else F.lit(200)
    wanted = pages if "urls" not in step else pages.filter(F.col("url").isin(list(step["urls"])))
    return wanted.select(
        "url", status.alias("status_code"), F.coalesce(F.length("html"), F.lit(0)).alias("html_length")
    )


def run_steps(
    spec: Mapping[str, Any],
    tables: Mapping[str, DataFrame],
    transforms: Mapping[str, Transform] | None = None,
) -> dict[str, DataFrame]:
    """Run the steps of a spec; each name becomes a table later steps can use.

    Step types: crawl, fetch, extract, transform. Steps only declare tables,
    so sequential and parallel execution give the same plan; failed tasks are
    retried by Spark. Unknown types warn and are skipped.
    """
    known: dict[str, DataFrame] = dict(tables)
    results: dict[str, DataFrame] = {}
    for step in spec.get("steps", []):
        kind, name = step.get("type"), step.get("name", "unnamed")
        source = known.get(step.get("input", "pages"))
        if kind == "crawl":
            out = _crawl(step, known)
        elif kind == "fetch":
            out = _fetch(step, known)
        elif kind == "extract":
            out = extract_text(source)
        elif kind == "transform":
            out = source.transform((transforms or {})[step["transform"]])
        else:
            warnings.warn(f"unknown step type: {kind}", stacklevel=2)
            continue
        known[name] = results[name] = out
    output = spec.get("output", {})
    if output:
        write = {"json": write_jsonl, "parquet": write_parquet}[output.get("format", "json")]
        for name, df in results.items():
            write(df, f"{output['path']}/{name}")
    return results


def case_scores(results: DataFrame) -> DataFrame:
    """Success flag and score of each test case."""
    ok = (
        (F.coalesce(F.col("exit_code"), F.lit(-1)) == 0)
        & (F.col("file_count") >= F.col("expected_min_files"))
        & (F.col("non_empty_files") > 0)
    )
    ratio = F.least(F.lit(1.0), F.col("file_count") / F.greatest("expected_min_files", F.lit(1)))
    return results.withColumn("success", ok).withColumn(
        "score",
        F.when(F.col("success"), F.round(6 + 4 * ratio, 1)).when(F.col("exit_code") == 0, 3.0).otherwise(1.0),
    )


def test_summary(results: DataFrame) -> DataFrame:
    """One row: totals, successes, failures and scores."""
    total = F.coalesce(F.sum("score"), F.lit(0.0))
    return case_scores(results).agg(
        F.count("*").alias("total_tests"),
        F.coalesce(F.sum(F.col("success").cast("long")), F.lit(0)).alias("successes"),
        F.coalesce(F.sum((~F.col("success")).cast("long")), F.lit(0)).alias("failures"),
        F.round(F.coalesce(F.avg("score"), F.lit(0.0)), 2).alias("average_score"),
        F.round(total, 2).alias("total_score"),
        (F.count("*") * 10.0).alias("max_score"),
    )


test_summary.__test__ = False
