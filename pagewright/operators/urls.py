"""URL tables: first-wins dedup, site rules, exclusions."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.base import as_col
from pagewright.functions.urls import normalize_url


def dedup_urls(df: DataFrame, url: str = "url", order: str = "pos") -> DataFrame:
    """Normalised URLs, each with the position of its first occurrence."""
    return df.groupBy(normalize_url(url).alias("url")).agg(F.min(order).alias(order))


@dataclass(frozen=True)
class SiteRule:
    """How to treat the pages whose URL starts with a match of ``pattern``."""

    pattern: str
    use_browser_directly: bool = False
    require_js: bool = False
    custom_user_agent: str | None = None
    custom_headers: dict[str, str] = field(default_factory=dict)
    link_extraction_strategy: str | None = None
    reason: str = ""
    priority: int = 0


def _compiles(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def ordered_rules(rules: Sequence[SiteRule]) -> list[SiteRule]:
    """Usable rules, highest priority first, list order among equals."""
    return sorted((r for r in rules if _compiles(r.pattern)), key=lambda r: -r.priority)


def rule_index(url: Column | str, rules: Sequence[SiteRule]) -> Column:
    """Index of the first ordered rule that matches, or null.

    Rules come from configuration, so each becomes one arm with a constant,
    once-compiled pattern rather than a row of a pattern join.
    """
    u, result = as_col(url), None
    for i, rule in enumerate(ordered_rules(rules)):
        test = u.rlike(f"(?i)^(?:{rule.pattern})")
        result = F.when(test, F.lit(i)) if result is None else result.when(test, F.lit(i))
    return F.lit(None).cast("int") if result is None else result


def rule_struct(url: Column | str, rules: Sequence[SiteRule]) -> Column:
    """Struct of the winning rule's settings; null fields without a match."""
    ordered = ordered_rules(rules)

    def setting(r: SiteRule) -> Column:
        headers = F.create_map(*[F.lit(x) for kv in sorted(r.custom_headers.items()) for x in kv])
        return F.struct(
            F.lit(r.pattern).alias("pattern"),
            F.lit(r.use_browser_directly).alias("use_browser_directly"),
            F.lit(r.require_js).alias("require_js"),
            F.lit(r.custom_user_agent).cast("string").alias("custom_user_agent"),
            headers.cast("map<string,string>").alias("custom_headers"),
            F.lit(r.link_extraction_strategy).cast("string").alias("link_extraction_strategy"),
            F.lit(r.reason).alias("reason"),
            F.lit(r.priority).alias("priority"),
        )

    if not ordered:
        return F.lit(None).cast(
            "struct<pattern:string,use_browser_directly:boolean,require_js:boolean,custom_user_agent:string,"
            "custom_headers:map<string,string>,link_extraction_strategy:string,reason:string,priority:int>"
        )
    return F.get(F.array(*[setting(r) for r in ordered]), rule_index(url, rules))


def site_rule_match(pages: DataFrame, rules: Sequence[SiteRule], url: str = "url") -> DataFrame:
    return pages.withColumn("rule", rule_struct(url, rules))


def exclude_urls(df: DataFrame, patterns: Sequence[str], url: str = "url") -> DataFrame:
    """Drop the URLs in which any pattern is found."""
    usable = [p for p in patterns if _compiles(p)]
    if not usable:
        return df
    return df.filter(~F.col(url).rlike("|".join(f"(?:{p})" for p in usable)))
