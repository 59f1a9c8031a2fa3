"""The per-page chain: gate, text, structured data, type, record and links."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import html as H
from pagewright.functions.base import let, strip
from pagewright.functions.pages import (
    content_route,
    needs_js_heuristic,
    needs_js_markers,
    reject_reason,
)
from pagewright.functions.scoring import page_type_scores, top_type
from pagewright.functions.urls import url_priority
from pagewright.operators.frontier import domain_cap, max_urls
from pagewright.operators.language import DEFAULT_LANGUAGE, detect_language
from pagewright.operators.links import link_targets
from pagewright.operators.urls import SiteRule, exclude_urls, rule_struct
from pagewright.sources.readers import as_pages


@dataclass
class CrawlConfig:
    """Parameters of the page chain; a limit that is None does not apply."""

    max_depth: int | None = None
    max_urls: int | None = None
    max_size_mb: float | None = None
    max_pages_per_domain: int | None = None
    enable_js: bool = True
    enable_trap_detection: bool = True
    enable_soft404_detection: bool = True
    enable_ml_extraction: bool = True
    site_rules: Sequence[SiteRule] = ()
    exclude_patterns: Sequence[str] = ()

    def __post_init__(self) -> None:
        for name in ("max_depth", "max_urls", "max_pages_per_domain"):
            if (getattr(self, name) or 0) < 0:
                raise ValueError(f"{name} must not be negative")


def crawlable(pages: DataFrame, cfg: CrawlConfig | None = None) -> DataFrame:
    """Add ``reject_reason``; null means the page passes the gate."""
    cfg = cfg or CrawlConfig()
    full = as_pages(pages)
    reason = reject_reason(
        F.col("url"), F.col("html"), F.col("status_code"), F.octet_length("content"), cfg.max_size_mb
    )
    if not cfg.enable_trap_detection:
        reason = F.when(~F.startswith(reason, F.lit("trap_")), reason)
    if not cfg.enable_soft404_detection:
        reason = F.when(reason != "soft_404", reason)
    return full.withColumn("reject_reason", reason)


def needs_js(pages: DataFrame, rules: Sequence[SiteRule] = ()) -> DataFrame:
    """Add ``needs_js``: a rule asks for it, or the page looks unrendered."""
    by_rule = F.coalesce(rule_struct("url", rules)["require_js"], F.lit(False))
    return pages.withColumn("needs_js", by_rule | needs_js_columns())


def needs_js_columns() -> Column:
    """Markers, the heuristic, or hardly any markup."""
    return needs_js_markers("html") | needs_js_heuristic("html") | (F.length(strip(F.col("html"))) < 500)


def text_info(html: Column | str = "html", language: Column | None = None, clean: bool = False) -> Column:
    """Title, text, meta, keywords, language, word count and description."""
    h = F.col(html) if isinstance(html, str) else html

    def build(page: Column) -> Column:
        fields = [
            page["title"].alias("title"),
            page["text"].alias("text"),
            H.meta_map_in(page["metas"]).alias("meta"),
            H.keywords_in(page["metas"]).alias("keywords"),
            (F.lit(DEFAULT_LANGUAGE) if language is None else language).alias("language"),
            H.word_count(page["text"]).alias("word_count"),
            H.description_in(page["metas"]).alias("description"),
        ]
        if clean:
            fields.append(H.main_content(h).alias("clean_text"))
        return F.struct(*fields)

    def parse(m: Column) -> Column:
        return F.struct(
            H.title_in(m).alias("title"),
            H.meta_entries(m).alias("metas"),
            H.visible_text(h).alias("text"),
        )

    return let(let(H.markup(h), parse), build)


def extract_text(pages: DataFrame, profiles: DataFrame | None = None, key: str = "page_id") -> DataFrame:
    """Add ``text_info``; with profiles the language is detected as well."""
    if profiles is None:
        return pages.withColumn("text_info", text_info())
    shown = pages.withColumn("_text", H.visible_text("html"))
    found = detect_language(shown.select(key, "_text"), profiles, key, "_text").select(key, "language")
    return (
        pages.join(found, key)
        .withColumn("text_info", text_info(language=F.col("language")))
        .drop("language")
    )


def structured(html: Column | str = "html") -> Column:
    def build(m: Column) -> Column:
        return let(
            H.tags(m, "meta"),
            lambda metas: F.struct(
                H.jsonld(html).alias("jsonld"),
                H.microdata_in(m).alias("microdata"),
                H.opengraph_in(metas).alias("opengraph"),
                H.twitter_in(metas).alias("twitter"),
            ),
        )

    return let(H.markup(html), build)


def extract_structured(pages: DataFrame) -> DataFrame:
    return pages.withColumn("structured", structured())


def microdata(pages: DataFrame) -> DataFrame:
    """Rows (url, itemtype, prop, value)."""
    return pages.select("url", F.inline(H.microdata_props("html")))


def custom_selectors(pages: DataFrame, rules: dict[str, str]) -> DataFrame:
    """One column per named rule: text of the first element it selects.

    A rule lists alternatives separated by commas; the first alternative that
    matches any element wins.
    """
    choices = {name: rule.split(",") for name, rule in rules.items()}
    wanted = H.selects(*[s for some in choices.values() for s in some])

    # Tokens are cut and elements matched once for all rules.
    def pick(toks: Column) -> Column:
        def texts(found: Column) -> Column:
            return F.struct(*[H.text_nodes(H.first_of(toks, found, some)).alias(name) for name, some in choices.items()])

        return let(H.elements(toks, wanted), texts)

    picked = F.transform(F.array(H.tokens(H.markup("html"))), pick)
    return pages.select("url", F.inline(picked))


def within_limits(pages: DataFrame, cfg: CrawlConfig) -> DataFrame:
    """Pages that depth limit, cap per domain and URL budget let through.

    Shallow pages come first, then those of high priority, then by URL. Without
    columns ``depth`` and ``priority`` all pages have depth 0 and the priority
    of their URL. The limits are decided on these columns alone; page bodies
    are joined to the admitted URLs.
    """
    if cfg.max_depth is not None and "depth" in pages.columns:
        pages = pages.filter(F.col("depth") <= cfg.max_depth)
    if cfg.max_pages_per_domain is None and cfg.max_urls is None:
        return pages
    depth = F.col("depth") if "depth" in pages.columns else F.lit(0)
    priority = F.col("priority") if "priority" in pages.columns else url_priority("url")
    queue = pages.groupBy("url").agg(F.min(depth).alias("depth"), F.max(priority).alias("priority"))
    if cfg.max_pages_per_domain is not None:
        queue = domain_cap(queue, cfg.max_pages_per_domain)
    if cfg.max_urls is not None:
        queue = max_urls(queue, cfg.max_urls)
    return pages.join(queue.select("url"), "url", "left_semi")


def process_pages(
    pages: DataFrame, cfg: CrawlConfig | None = None, profiles: DataFrame | None = None
) -> DataFrame:
    """Stored record and in-page links of every page that passes the gate.

    Without limits and profiles it is one projection over the scan: no
    shuffle, no Python, and the markup is dropped as soon as the columns made
    from it exist. ``profiles`` are those of ``language_profiles``; pages then
    get the language that fits their text best.
    """
    cfg = cfg or CrawlConfig()
    gated = crawlable(pages, cfg).filter(F.col("reject_reason").isNull())
    gated = within_limits(exclude_urls(gated, cfg.exclude_patterns), cfg)
    routed = gated.withColumn("route", content_route("headers", "url", F.col("html")))
    language = None
    if profiles is not None:
        shown = routed.select("url", H.visible_text("html").alias("_text")).groupBy("url").agg(F.max("_text").alias("_text"))
        found = detect_language(shown, profiles, "url", "_text").select("url", F.col("language").alias("_language"))
        routed, language = routed.join(found, "url", "left"), F.col("_language")
    rule = rule_struct("url", cfg.site_rules)
    by_rule = F.coalesce(rule["require_js"], F.lit(False))
    rendered = by_rule | needs_js_columns() if cfg.enable_js else by_rule
    return routed.select(
        *[c for c in ("page_id",) if c in routed.columns],
        "url",
        "status_code",
        "headers",
        "route",
        rule.alias("rule"),
        rendered.alias("needs_js"),
        F.when(F.col("route") == "text", text_info(language=language, clean=cfg.enable_ml_extraction)).alias("text_info"),
        structured().alias("structured"),
        page_type_scores("html", "url").alias("page_type_scores"),
        link_targets().alias("links"),
        "fetched_at",
    ).withColumn("page_type", top_type("page_type_scores"))
