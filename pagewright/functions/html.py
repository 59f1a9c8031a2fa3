"""HTML columns built from regular expressions and balanced elements.

Patterns use no back-references, no look-around but for one character, and
repeat only character classes, so they run in linear stack space on pages of any size.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions.base import as_col, find_all, has, has_any, is_json, let, strip
from pagewright.functions.elements import (
    element_html,
    elements,
    first_of,
    first_selected,
    selects,
    tokens,
    without,
)
from pagewright.functions.urls import base_of, resolve_against, resolve_url, url_parts

COMMENT = r"<!--.*?-->"


def block(tag: str, attrs: str = "") -> str:
    """Pattern of an element with its content."""
    opened = rf"<{tag}\s{attrs}[^>]*>" if attrs else rf"<{tag}(?:[\s/][^>]*)?>"
    return rf"{opened}.*?</{tag}\s*>"


def inner(tag: str, attrs: str = "") -> str:
    opened = rf"<{tag}\s{attrs}[^>]*>" if attrs else rf"<{tag}(?:[\s/][^>]*)?>"
    return rf"(?is){opened}(.*?)</{tag}\s*>"


def open_tag(tag: str) -> str:
    return rf"(?is)<{tag}(?:[\s/][^>]*)?>"


def attr_pattern(name: str) -> str:
    return rf"""(?is)[\s"'/]{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


HIDDEN = "|".join([COMMENT, block("script"), block("style")])
# Everything that is not a text node. A stray "<" is text.
NON_TEXT = rf"(?is){HIDDEN}|<[a-z/!?][^>]*>"
MARKUP_ONLY = (
    rf"(?is){COMMENT}|(<script(?:[\s/][^>]*)?>).*?</script\s*>|(<style(?:[\s/][^>]*)?>).*?</style\s*>"
)
# The same two for Spark: a character other than "<" is passed over by one
# comparison, not by one for each alternative.
FIND_NON_TEXT = (
    r"(?is)<(?:!--.*?-->|script(?:[\s/][^>]*)?>.*?</script\s*>|style(?:[\s/][^>]*)?>.*?</style\s*>|[a-z/!?][^>]*>)"
)
FIND_MARKUP_ONLY = rf"(?is)(?=<)(?:{MARKUP_ONLY.removeprefix('(?is)')})"
# Named character references that are decoded.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")]
MARK = "\x01"


def unescape(text: Column) -> Column:
    decoded = text
    for name, char in ENTITIES:
        decoded = F.replace(decoded, F.lit(name), F.lit(char))
    return F.when(has(text, "&"), decoded).otherwise(text)


def repair_html(html: Column | str) -> Column:
    """Drop NUL characters; broken markup is tolerated by the patterns."""
    return F.regexp_replace(as_col(html), r"\x00", "")


def markup(html: Column | str) -> Column:
    """Tags only: comments and the bodies of scripts and styles removed."""
    return F.regexp_replace(as_col(html), FIND_MARKUP_ONLY, "$1$2")


def tags(clean_markup: Column, tag: str) -> Column:
    return find_all(clean_markup, open_tag(tag))


def attr(tag: Column, name: str) -> Column:
    """Attribute value of an opening tag; empty when absent."""
    raw = F.regexp_extract(tag, attr_pattern(name), 1)
    return unescape(F.btrim(raw, F.lit("\"'")))


def has_attr(tag: Column, name: str) -> Column:
    return tag.rlike(attr_pattern(name)) | tag.rlike(rf"""(?is)[\s"'/]{name}\s*=""")


def attr_values(clean_markup: Column, tag: str, name: str) -> Column:
    """Values of one attribute over all tags that carry it, in page order."""
    carrying = F.filter(tags(clean_markup, tag), lambda t: t.rlike(rf"""(?is)[\s"'/]{name}\s*="""))
    return F.transform(carrying, lambda t: attr(t, name))


def text_nodes(html: Column) -> Column:
    """Text nodes joined by one space, each trimmed, empty ones skipped."""
    pieces = F.split(F.regexp_replace(html, FIND_NON_TEXT, MARK), MARK)
    kept = F.filter(F.transform(pieces, strip), lambda x: x != "")
    return unescape(F.array_join(kept, " "))


def visible_text(html: Column | str) -> Column:
    return text_nodes(as_col(html))


def raw_text(html: Column | str) -> Column:
    """Text nodes joined without separator, untrimmed."""
    return unescape(F.regexp_replace(as_col(html), FIND_NON_TEXT, ""))


def word_count(text: Column | str) -> Column:
    return F.size(find_all(as_col(text), r"\S+"))


# --- links -----------------------------------------------------------------

# URL shapes inside scripts and attributes.
JS_PATTERNS = [
    r"""["'](https?://[^"']+)["']""",
    r"""["'](/[^"']+)["']""",
    r"""url:\s*["']([^"']+)["']""",
    r"""href:\s*["']([^"']+)["']""",
    r"""src:\s*["']([^"']+)["']""",
]
BLOB_PATTERN = r"""blob:https?://[^\s"'<>]+"""
DATA_PATTERN = r"""data:[^;]+;base64,[^\s"'<>]+"""
API_QUOTED = r"""["']([^"']*(?:/api/|/v[0-9]+/|/graphql|/rest/)[^"']*)["']"""
API_FETCH = r"""fetch\(["']([^"']+)["']"""
API_XHR = r"""\.open\(["'](GET|POST)["'],\s*["']([^"']+)["']"""
REFRESH_URL = r"(?i)url=([^;]+)"


def anchor_hrefs(html: Column | str) -> Column:
    return attr_values(markup(html), "a", "href")


def link_hrefs(html: Column | str) -> Column:
    return attr_values(markup(html), "link", "href")


def script_srcs(html: Column | str) -> Column:
    return attr_values(markup(html), "script", "src")


def img_srcs_in(clean_markup: Column) -> Column:
    return F.filter(attr_values(clean_markup, "img", "src"), lambda x: x != "")


def img_srcs(html: Column | str) -> Column:
    return img_srcs_in(markup(html))


def _srcset_items(values: Column) -> Column:
    items = F.flatten(F.transform(values, lambda v: F.split(v, ",")))
    first = F.transform(items, lambda v: F.regexp_extract(v, r"(\S+)", 1))
    return F.filter(first, lambda v: v != "")


def srcset_urls_in(clean_markup: Column) -> Column:
    pictures = F.array_join(find_all(clean_markup, inner("picture"), 1), " ")
    return F.concat(
        _srcset_items(attr_values(clean_markup, "img", "srcset")),
        _srcset_items(attr_values(pictures, "source", "srcset")),
    )


def srcset_urls(html: Column | str) -> Column:
    """First token of every candidate of img and picture source sets."""
    return let(markup(html), srcset_urls_in)


def _find_if(h: Column, marks: list[str], pattern: str, group: int = 0) -> Column:
    """Matches of a costly pattern, tried only on pages with one of its marks."""
    none = F.array().cast("array<string>")
    return F.when(has_any(h, marks), find_all(h, pattern, group)).otherwise(none)


def js_urls(html: Column | str) -> Column:
    h = as_col(html)
    quoted = [find_all(h, p, 1) for p in JS_PATTERNS[:2]]
    keyed = [_find_if(h, [p.split(":")[0] + ":"], p, 1) for p in JS_PATTERNS[2:]]
    found = F.concat(*quoted, *keyed)
    return F.filter(found, lambda u: F.startswith(u, F.lit("http")) | F.startswith(u, F.lit("/")))


def blob_urls(html: Column | str) -> Column:
    h = as_col(html)
    return F.concat(_find_if(h, ["blob:http"], BLOB_PATTERN), _find_if(h, [";base64,"], DATA_PATTERN))


def meta_refresh_url(html: Column | str) -> Column:
    """Target of the first refresh tag, or null."""
    return meta_refresh_in(markup(html))


def meta_refresh_in(clean_markup: Column) -> Column:
    refreshing = F.filter(
        tags(clean_markup, "meta"), lambda t: F.lower(attr(t, "http-equiv")).contains("refresh")
    )
    target = F.regexp_extract(attr(F.get(refreshing, F.lit(0)), "content"), REFRESH_URL, 1)
    return F.nullif(target, F.lit(""))


def api_urls(html: Column | str) -> Column:
    h = as_col(html)
    versions = [f"/v{digit}" for digit in range(10)]
    return F.concat(
        _find_if(h, ["/api/", "/graphql", "/rest/", *versions], API_QUOTED, 1),
        _find_if(h, ["fetch("], API_FETCH, 1),
        _find_if(h, [".open("], API_XHR, 2),
    )


def resolve_all(urls: Column, base: Column | str) -> Column:
    return let(base_of(base), lambda b: F.transform(urls, lambda u: resolve_against(b, u)))


def resolve_unless_http(urls: Column, base: Column | str) -> Column:
    return let(
        base_of(base),
        lambda b: F.transform(
            urls, lambda u: F.when(F.startswith(u, F.lit("http")), u).otherwise(resolve_against(b, u))
        ),
    )


# --- metadata ---------------------------------------------------------------


def title_in(clean_markup: Column) -> Column:
    return strip(unescape(F.regexp_extract(clean_markup, inner("title"), 1)))


def page_title(html: Column | str) -> Column:
    return title_in(markup(html))


def meta_entries(clean_markup: Column) -> Column:
    """Array of (name, content) in page order, both non-empty."""

    def entry(t: Column) -> Column:
        name = attr(t, "name")
        return F.struct(
            F.when(name != "", name).otherwise(attr(t, "property")).alias("name"),
            attr(t, "content").alias("content"),
        )

    entries = F.transform(tags(clean_markup, "meta"), entry)
    return F.filter(entries, lambda e: (e["name"] != "") & (e["content"] != ""))


def _last_wins(entries: Column) -> Column:
    """Map from (name, content) structs where a later entry replaces earlier."""

    def build(es: Column) -> Column:
        names = F.array_distinct(F.transform(es, lambda e: e["name"]))
        return F.map_from_arrays(
            names,
            F.transform(
                names,
                lambda n: F.element_at(
                    F.transform(F.filter(es, lambda e: e["name"] == n), lambda e: e["content"]), -1
                ),
            ),
        )

    return let(entries, build)


def _named(entries: Column, name: str) -> Column:
    """Last content of a meta name in any letter case, or null."""
    named = F.filter(entries, lambda e: F.lower(e["name"]) == name)
    return F.try_element_at(F.transform(named, lambda e: e["content"]), F.lit(-1))


def meta_map_in(entries: Column) -> Column:
    return _last_wins(entries)


def description_in(entries: Column) -> Column:
    return F.coalesce(_named(entries, "description"), F.lit(""))


def keywords_in(entries: Column) -> Column:
    value = _named(entries, "keywords")
    return F.coalesce(F.transform(F.split(value, ","), strip), F.array().cast("array<string>"))


def page_meta(html: Column | str) -> Column:
    return meta_map_in(meta_entries(markup(html)))


def page_description(html: Column | str) -> Column:
    return description_in(meta_entries(markup(html)))


def page_keywords(html: Column | str) -> Column:
    return keywords_in(meta_entries(markup(html)))


def _prefixed(meta_tags: Column, attribute: str, prefix: str) -> Column:
    def entry(t: Column) -> Column:
        return F.struct(
            F.replace(attr(t, attribute), F.lit(prefix)).alias("name"), attr(t, "content").alias("content")
        )

    wanted = F.filter(meta_tags, lambda t: F.startswith(attr(t, attribute), F.lit(prefix)))
    return _last_wins(F.transform(wanted, entry))


def opengraph_in(meta_tags: Column) -> Column:
    return _prefixed(meta_tags, "property", "og:")


def twitter_in(meta_tags: Column) -> Column:
    return _prefixed(meta_tags, "name", "twitter:")


def opengraph(html: Column | str) -> Column:
    return opengraph_in(tags(markup(html), "meta"))


def twitter_card(html: Column | str) -> Column:
    return twitter_in(tags(markup(html), "meta"))


JSONLD = (
    r"""(?is)<script\s(?:[^>]*[\s"'])?type\s*=\s*["']?application/ld\+json["']?(?:[\s/][^>]*)?>(.*?)</script\s*>"""
)
NO_COMMENTS = rf"(?s){COMMENT}"


def jsonld_bodies(html: Column | str) -> Column:
    return find_all(F.regexp_replace(as_col(html), NO_COMMENTS, ""), JSONLD, 1)


def jsonld(html: Column | str) -> Column:
    """Bodies of the JSON-LD scripts that are valid JSON."""
    return F.filter(F.transform(jsonld_bodies(html), strip), is_json)


def canonical_url(html: Column | str, base: Column | str) -> Column:
    """Declared canonical URL, else the page itself when it looks canonical."""
    b = as_col(base)

    def json_target(j: Column) -> Column:
        own = F.coalesce(
            F.nullif(F.get_json_object(j, "$.@id"), F.lit("")),
            F.nullif(F.get_json_object(j, "$.url"), F.lit("")),
        )
        items = F.from_json(j, "array<struct<`@id`: string, url: string>>")
        first = F.get(
            F.filter(
                F.transform(
                    items,
                    lambda e: F.coalesce(F.nullif(e["@id"], F.lit("")), F.nullif(e["url"], F.lit(""))),
                ),
                lambda e: e.isNotNull(),
            ),
            F.lit(0),
        )
        main = F.nullif(F.get_json_object(j, "$.mainEntityOfPage.@id"), F.lit(""))
        return F.when(F.startswith(j, F.lit("[")), first).otherwise(F.coalesce(own, main))

    declaring = F.filter(tags(markup(html), "link"), lambda t: F.lower(attr(t, "rel")) == "canonical")
    declared = attr(F.get(declaring, F.lit(0)), "href")
    from_json = F.get(
        F.filter(F.transform(jsonld(html), json_target), lambda t: t.isNotNull()), F.lit(0)
    )
    chosen = F.coalesce(F.nullif(declared, F.lit("")), from_json)
    itself = let(
        url_parts(b),
        lambda p: (p["query"] == "") & (F.size(F.split(p["path"], "/")) <= 4),
    )
    return F.when(chosen.isNotNull(), resolve_url(b, chosen)).when(itself, b)


# --- blocks -------------------------------------------------------------------

# What counts as boilerplate, and where main content is sought.
BOILERPLATE_TAGS = ["header", "footer", "nav", "aside"]
BOILERPLATE_CLASSES = ["advertisement", "ad", "sidebar", "navigation", "menu", "footer"]
BOILERPLATE_IDS = ["header", "footer", "nav", "sidebar"]
MAIN_SELECTORS = ["main", "article", ".content", ".main-content", "#content", "#main"]
BLOCK_TAGS = ["article", "main", "div"]


def selected_html(html: Column, selector: str) -> Column:
    """Outer HTML of the first element a selector matches; null when none."""
    return let(tokens(html), lambda toks: first_selected(toks, [selector]))


def remove_boilerplate(html: Column | str) -> Column:
    """Text left after navigation, advertising and other frames are dropped."""
    frames = selects(
        *BOILERPLATE_TAGS, "noscript", *[f".{c}" for c in BOILERPLATE_CLASSES], *[f"#{i}" for i in BOILERPLATE_IDS]
    )
    body = let(tokens(as_col(html)), lambda toks: without(toks, elements(toks, frames)))
    return strip(F.regexp_replace(text_nodes(body), r"\s+", " "))


def main_content(html: Column | str) -> Column:
    """Text of the first main-content element, else of the page sans frames."""
    h = as_col(html)
    found = let(tokens(h), lambda toks: first_selected(toks, MAIN_SELECTORS))
    return let(found, lambda block: F.when(block.isNotNull(), text_nodes(block)).otherwise(remove_boilerplate(h)))


def largest_block(html: Column | str) -> Column:
    """Longest text among article, main and div elements; else all text.

    Nested blocks count with all they hold; of equal ones the first wins.
    """
    h = as_col(html)

    def longest(toks: Column) -> Column:
        blocks = F.transform(
            elements(toks, selects(*BLOCK_TAGS)),
            lambda e: F.struct((-e["i"]).alias("i"), raw_text(element_html(toks, e)).alias("t")),
        )
        sized = F.transform(blocks, lambda b: F.struct(F.length(b["t"]).alias("n"), b["i"].alias("i"), b["t"].alias("t")))
        return F.array_max(sized)

    return let(let(tokens(h), longest), lambda best: F.when(best["n"] > 0, best["t"]).otherwise(raw_text(h)))


# --- microdata ----------------------------------------------------------------

SCOPE_TAG = r"""(?is)(<[a-z][^>]*[\s"']itemscope[\s=/>])"""
PROP_WITH_TEXT = r"""(?is)<[a-z][a-z0-9]*\s[^>]*itemprop\s*=[^>]*>[^<]*"""
# Attribute that carries the value, by tag.
VALUE_ATTRS = [
    (["a", "area", "link"], "href"),
    (["audio", "embed", "iframe", "img", "source", "track", "video"], "src"),
    (["time"], "datetime"),
    (["data", "meter"], "value"),
]


def microdata_props(html: Column | str) -> Column:
    """Array of (itemtype, prop, value), one per itemprop, in page order."""
    return microdata_in(markup(html))


def microdata_in(clean_markup: Column) -> Column:
    # What comes before the first scope is no microdata.
    scopes = let(
        F.split(F.regexp_replace(clean_markup, SCOPE_TAG, MARK + "$1"), MARK),
        lambda parts: F.slice(parts, F.lit(2), F.size(parts)),
    )

    def prop(hit: Column, kind: Column) -> Column:
        tag = F.regexp_extract(hit, r"(?s)^(<[^>]*>)", 1)
        name = F.lower(F.regexp_extract(hit, r"(?i)^<([a-z][a-z0-9]*)", 1))
        text = strip(unescape(F.regexp_extract(hit, r"(?s)^<[^>]*>(.*)$", 1)))
        value = F.when(tag.rlike(attr_pattern("content")), attr(tag, "content"))
        for names, source in VALUE_ATTRS:
            value = value.when(name.isin(names) & tag.rlike(attr_pattern(source)), attr(tag, source))
        return F.struct(
            kind.alias("itemtype"), attr(tag, "itemprop").alias("prop"), value.otherwise(text).alias("value")
        )

    def scope(segment: Column) -> Column:
        kind = attr(F.regexp_extract(segment, r"(?s)^(<[^>]*>)", 1), "itemtype")
        return F.transform(find_all(segment, PROP_WITH_TEXT), lambda hit: prop(hit, kind))

    return F.flatten(F.transform(scopes, scope))
