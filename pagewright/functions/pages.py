"""Page predicates: soft-404, script rendering, frameworks, routing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions.base import as_col, has, has_any, let, occurrences, strip
from pagewright.functions.html import page_title
from pagewright.functions.urls import trap_reason

# Phrases that reveal an error page.
NOT_FOUND_PHRASES = [
    "page not found", "404 error", "not found", "does not exist",
    "no longer available", "this page cannot be found",
    "the page you are looking for",
]
SHORT_PAGE_PHRASES = ["page not found", "404 error", "not found"]
TITLE_PHRASES = ["404", "not found", "page not found", "error"]
# Signs of client-side rendering.
JS_MARKERS = "react|vue|angular|next\\.js|nuxt|__next_data__"
JS_MARKER_PREFIX = 10000
SPA_PATTERNS = [
    ("react", "__react_devtools|react"),
    ("vue", "__vue__|vue"),
    ("angular", "ng-|angular"),
    ("next", "__next_data__|next"),
    ("nuxt", "__nuxt__|nuxt"),
]
# Content routes in test order.
OFFICE_TYPES = ["officedocument", "msword", "ms-excel", "ms-powerpoint"]
OFFICE_SUBTYPES = [
    ("docx", "wordprocessingml", ".docx"),
    ("pptx", "presentationml", ".pptx"),
    ("xlsx", "spreadsheetml", ".xlsx"),
]


def is_soft_404(html: Column | str, status_code: Column | None = None) -> Column:
    """Error page served with a success status."""
    h = as_col(html)

    def judge(text: Column) -> Column:
        hits = F.lit(0)
        for phrase in NOT_FOUND_PHRASES:
            hits = hits + has(text, phrase).cast("int")
        return let(
            hits,
            lambda n: F.when(F.coalesce(text, F.lit("")) == "", False)
            .when(F.length(text) < 200, has_any(text, SHORT_PAGE_PHRASES))
            .when((F.length(text) < 1000) & (n >= 2), True)
            .when(n >= 3, True)
            .otherwise(has_any(F.lower(page_title(h)), TITLE_PHRASES)),
        )

    by_text = let(F.lower(h), judge)
    if status_code is None:
        return by_text
    return F.when(F.coalesce(status_code.isin(404, 410), F.lit(False)), True).otherwise(by_text)


def needs_js_markers(html: Column | str) -> Column:
    # The marker test reads a fixed head of the page by definition.
    return F.lower(F.left(as_col(html), F.lit(JS_MARKER_PREFIX))).rlike(JS_MARKERS)


def needs_js_heuristic(html: Column | str) -> Column:

    def judge(h: Column) -> Column:
        size, anchors = F.length(strip(h)), occurrences(h, "<a")
        scripted = has(h, "<script")
        any_sign = (
            (size < 500)
            | has(h, "data-reactroot")
            | has(h, "ng-app")
            | has(h, "ng-controller")
            | (scripted & (occurrences(h, "react") > 2))
            | (scripted & (occurrences(h, "angular") > 2))
            | ((size < 2000) & (anchors > 0) & (occurrences(h, "<div") > anchors * 10))
        )
        return F.when(h == "", False).otherwise(any_sign)

    return let(F.lower(as_col(html)), judge)


def detect_spa(html: Column | str) -> Column:
    """First framework whose marks appear, or null."""
    h = F.lower(as_col(html))
    result = None
    for name, pattern in SPA_PATTERNS:
        result = F.when(h.rlike(pattern), name) if result is None else result.when(h.rlike(pattern), name)
    return result


def max_size_filter(content: Column | str, max_mib: float) -> Column:
    return F.octet_length(as_col(content)) <= F.lit(max_mib * 1048576)


def header(headers: Column | str, name: str) -> Column:
    """Header value by case-insensitive name; empty when absent."""
    wanted = F.map_filter(as_col(headers), lambda k, v: F.lower(k) == name.lower())
    return F.coalesce(F.get(F.map_values(wanted), F.lit(0)), F.lit(""))


def content_route(headers: Column | str, url: Column | str, html: Column | None = None) -> Column:
    """Extractor a response goes to, by content type and then URL suffix."""
    kind, u = F.lower(header(headers, "content-type")), as_col(url)

    def ends(*suffixes: str) -> Column:
        found = F.lit(False)
        for s in suffixes:
            found = found | F.endswith(u, F.lit(s))
        return found

    route = F.when(has(kind, "text/html"), "text")
    if html is not None:
        # A rendered page has no headers but is text all the same.
        route = route.when((kind == "") & html.isNotNull(), "text")
    return (
        route.when(has(kind, "application/pdf"), "pdf")
        .when(has_any(kind, OFFICE_TYPES), "office")
        .when(has(kind, "image/"), "image")
        .when(has(kind, "video/"), "video")
        .when(has(kind, "audio/"), "audio")
        .when(has(kind, "application/zip") | ends(".zip"), "zip")
        .when(has(kind, "application/x-tar") | ends(".tar", ".tar.gz"), "tar")
        .when(has(kind, "application/epub+zip") | ends(".epub"), "epub")
        .otherwise("none")
    )


def office_subtype(headers: Column | str, url: Column | str) -> Column:
    kind, u = F.lower(header(headers, "content-type")), as_col(url)
    result = None
    for name, mark, suffix in OFFICE_SUBTYPES:
        test = has(kind, mark) | F.endswith(u, F.lit(suffix))
        result = F.when(test, name) if result is None else result.when(test, name)
    return result


def reject_reason(
    url: Column, html: Column, status_code: Column, content_bytes: Column, max_mib: float | None
) -> Column:
    """Why a page leaves the crawl, or null: size, then trap, then soft-404."""
    too_big = F.lit(False) if max_mib is None else content_bytes > F.lit(max_mib * 1048576)
    trap = trap_reason(url)
    return (
        F.when(too_big, "size")
        .when(trap.isNotNull(), F.concat(F.lit("trap_"), trap))
        .when(is_soft_404(html, status_code), "soft_404")
    )
