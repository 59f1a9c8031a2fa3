"""Per-page entity and technology report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions.entities import entities_from
from pagewright.functions.html import anchor_hrefs, raw_text, script_srcs
from pagewright.functions.tech import (
    detect_cms,
    detect_languages_backend,
    detect_servers,
    frameworks_from,
    inline_scripts,
    libraries_from,
)
from pagewright.sources.readers import as_pages


def _prepared(pages: DataFrame) -> DataFrame:
    """Shared inputs, so text, links and scripts are taken out once."""
    return pages.withColumns(
        {
            "_text": raw_text("html"),
            "_hrefs": anchor_hrefs("html"),
            "_srcs": script_srcs("html"),
            "_inline": inline_scripts("html"),
        }
    )


def _entities():
    return entities_from(F.col("_text"), F.col("_hrefs"), F.col("url"))


def _tech():
    return F.struct(
        frameworks_from(F.col("html"), F.col("_srcs"), F.col("_inline")).alias("frameworks"),
        detect_cms("html", "url").alias("cms"),
        detect_servers("headers").alias("servers"),
        libraries_from(F.col("_srcs")).alias("libraries"),
        detect_languages_backend("html").alias("languages"),
    )


def extract_entities(pages: DataFrame) -> DataFrame:
    return _prepared(pages).select("url", _entities().alias("entities"))


def detect_tech(pages: DataFrame) -> DataFrame:
    return _prepared(as_pages(pages)).select("url", _tech().alias("tech_stack"))


def osint_report(pages: DataFrame) -> DataFrame:
    """Entities and technology side by side: one projection, no join."""
    return _prepared(as_pages(pages)).select(
        "url", _entities().alias("entities"), _tech().alias("tech_stack")
    )


def osint_summary(report: DataFrame) -> DataFrame:
    kinds = ["emails", "phones", "usernames", "domains"]
    return report.select(
        "url",
        *[F.size(f"entities.{k}").alias(k) for k in kinds],
        F.array_join("tech_stack.frameworks", ", ").alias("frameworks"),
    )
