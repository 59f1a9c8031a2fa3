"""Link tables extracted from pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import html as H
from pagewright.functions.base import let, occurrences
from pagewright.functions.urls import base_of, normalize_url, osint_normalize_url, resolve_against


def _explode(pages: DataFrame, kind: str, targets: Column) -> DataFrame:
    return pages.select(
        F.col("url").alias("source"), F.posexplode(targets).alias("pos", "target")
    ).select("source", "target", F.lit(kind).alias("kind"), "pos")


def links_anchor(pages: DataFrame) -> DataFrame:
    return _explode(pages, "anchor", H.resolve_all(H.anchor_hrefs("html"), "url"))


def links_link(pages: DataFrame) -> DataFrame:
    return _explode(pages, "link", H.resolve_all(H.link_hrefs("html"), "url"))


def links_script(pages: DataFrame) -> DataFrame:
    return _explode(pages, "script", H.resolve_all(H.script_srcs("html"), "url"))


def links_img(pages: DataFrame) -> DataFrame:
    return _explode(pages, "img", H.resolve_all(H.img_srcs("html"), "url"))


def links_srcset(pages: DataFrame) -> DataFrame:
    return _explode(pages, "srcset", H.resolve_all(H.srcset_urls("html"), "url"))


def links_js(pages: DataFrame) -> DataFrame:
    return _explode(pages, "js", H.resolve_unless_http(H.js_urls("html"), "url"))


def links_blob(pages: DataFrame) -> DataFrame:
    return _explode(pages, "blob", H.blob_urls("html"))


def _refresh() -> Column:
    return F.array_compact(F.array(H.meta_refresh_url("html")))


def links_meta_refresh(pages: DataFrame) -> DataFrame:
    return _explode(pages, "meta_refresh", H.resolve_all(_refresh(), "url"))


def links_api(pages: DataFrame) -> DataFrame:
    return _explode(
        pages, "api", F.array_distinct(H.resolve_unless_http(H.api_urls("html"), "url"))
    )


def page_targets() -> Column:
    """All link targets of a page, resolved, in extraction order.

    The base URL is split once and the comment-free markup is built once.
    """

    def gather(page: Column) -> Column:
        b, clean = page["base"], page["clean"]

        def plain(urls: Column) -> Column:
            return F.transform(urls, lambda u: resolve_against(b, u))

        def web_first(urls: Column) -> Column:
            return F.transform(
                urls, lambda u: F.when(F.startswith(u, F.lit("http")), u).otherwise(resolve_against(b, u))
            )

        return F.concat(
            plain(
                F.concat(
                    H.attr_values(clean, "a", "href"),
                    H.attr_values(clean, "link", "href"),
                    H.attr_values(clean, "script", "src"),
                    H.img_srcs_in(clean),
                    H.srcset_urls_in(clean),
                )
            ),
            web_first(H.js_urls("html")),
            H.blob_urls("html"),
            plain(F.array_compact(F.array(H.meta_refresh_in(clean)))),
            F.array_distinct(web_first(H.api_urls("html"))),
        )

    return let(F.struct(base_of("url").alias("base"), H.markup("html").alias("clean")), gather)


def link_targets() -> Column:
    """Normalised targets of a page without repeats, first position kept."""
    return F.array_distinct(F.transform(page_targets(), normalize_url))


def extract_links(pages: DataFrame) -> DataFrame:
    """Edge rows (source, target, pos). Dedup is within the page: no shuffle."""
    return pages.select(
        F.col("url").alias("source"), F.posexplode(link_targets()).alias("pos", "target")
    ).select("source", "target", "pos")


def osint_targets() -> Column:
    """Anchors only, fragments skipped, loosely normalised, http(s) kept."""
    hrefs = F.filter(H.anchor_hrefs("html"), lambda h: ~F.startswith(h, F.lit("#")))

    def absolute(b: Column) -> Column:
        return F.transform(
            hrefs,
            lambda h: osint_normalize_url(
                F.when(h.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]"), h).otherwise(resolve_against(b, h))
            ),
        )

    return F.filter(
        let(base_of("url"), absolute),
        lambda u: F.startswith(u, F.lit("http://")) | F.startswith(u, F.lit("https://")),
    )


def osint_links(pages: DataFrame) -> DataFrame:
    return pages.select(
        F.col("url").alias("source"), F.posexplode(osint_targets()).alias("pos", "target")
    ).select("source", "target", "pos")


def link_extraction_suspect(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Pages with many anchors in the markup but hardly any extracted link."""
    counts = links.groupBy(F.col("source").alias("url")).agg(F.count("*").alias("n_links"))
    anchors = pages.select("url", occurrences(F.lower("html"), "<a ").alias("n_anchors"))
    return (
        anchors.join(counts, "url", "left")
        .select("url", "n_anchors", F.coalesce("n_links", F.lit(0)).alias("n_links"))
        .withColumn("suspect", (F.col("n_anchors") > 10) & (F.col("n_links") < 2))
    )
