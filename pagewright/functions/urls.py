"""URL columns: splitting, normalisation, resolution, scoring and trap tests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions.base import as_col, has, has_any, let, occurrences

# Generic URL grammar, one capture per part.
SPLIT = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"
PATH_HEAD = r"(?s)^((?:.*/)?[^/;]*)"
PATH_PARAMS = r"(?s)^(?:.*/)?[^/;]*;([^/]*)$"

# Schemes whose last path segment may carry ";params".
PARAM_SCHEMES = [
    "", "ftp", "hdl", "prospero", "http", "https", "shttp", "rtsp", "rtsps",
    "rtspu", "sip", "sips", "mms", "sftp", "tel",
]
# Schemes that a relative reference can be resolved against.
RELATIVE_SCHEMES = [
    "", "ftp", "http", "gopher", "nntp", "imap", "wais", "file", "https",
    "shttp", "mms", "prospero", "rtsp", "rtsps", "rtspu", "sftp", "svn",
    "svn+ssh", "ws", "wss",
]
# Schemes written with "//" even when the host is empty.
NETLOC_SCHEMES = RELATIVE_SCHEMES[1:] + ["telnet", "snews", "rsync", "nfs", "git", "git+ssh"]
# Query parameters that only carry tracking data.
TRACKING_PARAMS = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "fbclid", "gclid", "msclkid", "_ga", "_gl", "mc_cid", "mc_eid", "ref",
    "referrer", "source", "campaign",
]
# Limits and patterns of the crawler-trap tests.
SESSION_PARAMS = ["sessionid", "session", "sid", "jsessionid"]
SESSION_VALUE_LIMIT = 20
LENGTH_LIMIT = 500
PAGE_LIMIT = 100
FACET_LIMIT = 10
CALENDAR = r"/[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}/"
CALENDAR_RULES = r"/[0-9]{4}/[0-9]{2}/[0-9]{2}/|/archive/[0-9]{4}/|/date/[0-9]{4}/"
SESSION_RULES = r"[?&](?:sessionid|sid)=[a-zA-Z0-9]{20,}"
PAGE_NUMBER = r"[?&]page=([0-9]+)"
# Words that raise a URL's rank.
PRIORITY_PATHS = ["/about", "/contact", "/products", "/services"]
IMPORTANT_WORDS = ["product", "article", "blog", "news"]
IMPORTANT_WORDS_BASIC = ["product", "article", "blog"]
DOC_PATHS = ["/docs/", "/documentation/"]


MARK = "\x01"
ALL_PARTS = MARK.join(f"${i}" for i in range(1, 6))


def _clean(url: Column) -> Column:
    """Tabs and line breaks never belong to a URL; neither does leading space."""
    dirty = "[\\t\\r\\n\\x01]"
    return F.ltrim(F.when(url.rlike(dirty), F.regexp_replace(url, dirty, "")).otherwise(url))


def _split(url: Column) -> Column:
    """Scheme, netloc, path with params, query, fragment: one regex pass."""
    return F.split(F.regexp_replace(url, SPLIT, ALL_PARTS), MARK)


def _scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, SPLIT, 1))


def url_parts(url: Column | str) -> Column:
    """Struct of scheme, netloc, path, params, query and fragment."""

    def build(p: Column) -> Column:
        scheme, full_path = F.lower(p[0]), p[2]
        # Only the last path segment of some schemes carries ";params".
        split_off = F.contains(full_path, F.lit(";")) & scheme.isin(PARAM_SCHEMES)
        return F.struct(
            scheme.alias("scheme"),
            p[1].alias("netloc"),
            F.when(split_off, F.regexp_extract(full_path, PATH_HEAD, 1)).otherwise(full_path).alias("path"),
            F.when(split_off, F.regexp_extract(full_path, PATH_PARAMS, 1)).otherwise(F.lit("")).alias("params"),
            p[3].alias("query"),
            p[4].alias("fragment"),
        )

    return let(_split(_clean(as_col(url))), build)


def netloc_of(url: Column | str) -> Column:
    return F.regexp_extract(_clean(as_col(url)), SPLIT, 2)


def path_of(url: Column | str) -> Column:
    return F.regexp_extract(_clean(as_col(url)), SPLIT, 3)


def domain_of(url: Column | str) -> Column:
    """``scheme://netloc``, the key of the per-domain page cap."""
    u = _clean(as_col(url))
    return F.concat(_scheme(u), F.lit("://"), F.regexp_extract(u, SPLIT, 2))


def _decode(text: Column) -> Column:
    # A percent sign that starts no escape stands for itself.
    safe = F.regexp_replace(text, r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.when(text.rlike("[%+]"), F.coalesce(F.try_url_decode(safe), text)).otherwise(text)


def _encode(text: Column) -> Column:
    escaped = F.replace(F.replace(F.url_encode(text), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))
    return F.when(text.rlike(r"[^A-Za-z0-9_.\-]"), escaped).otherwise(text)


def query_pairs(url: Column | str) -> Column:
    """Decoded ``(k, pos, v)`` structs of the parameters with a non-blank value."""
    query = F.regexp_extract(_clean(as_col(url)), SPLIT, 4)
    return _pairs(query)


def _pairs(query: Column) -> Column:
    filled = F.filter(F.split(query, "&"), lambda p: p.rlike(r"(?s)^[^=]*=."))

    def pair(p: Column, i: Column) -> Column:
        key = F.substring_index(p, "=", 1)
        return F.struct(
            _decode(key).alias("k"),
            i.alias("pos"),
            _decode(F.substr(p, F.length(key) + 2)).alias("v"),
        )

    return F.transform(filled, pair)


def _join_url(scheme: Column, netloc: Column, path: Column, query: Column, fragment: Column) -> Column:
    rooted = F.when((path != "") & ~F.startswith(path, F.lit("/")), F.concat(F.lit("/"), path)).otherwise(path)
    has_authority = (netloc != "") | (scheme.isin(NETLOC_SCHEMES) & ~F.startswith(path, F.lit("//")))
    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(F.lit("")),
        F.when(has_authority, F.concat(F.lit("//"), netloc, rooted)).otherwise(path),
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")),
        F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(F.lit("")),
    )


def normalize_url(url: Column | str) -> Column:
    """Canonical spelling of a URL.

    Scheme and host are lowered, default ports, fragment, path parameters,
    blank and tracking query parameters go, slashes collapse, keys are sorted.
    """

    def rebuild(p: Column) -> Column:
        scheme, netloc, path = p["scheme"], F.lower(p["netloc"]), p["path"]
        host = (
            F.when(scheme == "http", F.regexp_replace(netloc, r":80$", ""))
            .when(scheme == "https", F.regexp_replace(netloc, r":443$", ""))
            .otherwise(netloc)
        )
        trimmed = F.when(path == "/", path).otherwise(F.rtrim(path, F.lit("/")))
        clean_path = F.when(F.contains(path, F.lit("//")), F.regexp_replace(trimmed, "/+", "/")).otherwise(trimmed)
        kept = F.filter(_pairs(p["query"]), lambda kv: ~kv["k"].isin(TRACKING_PARAMS))
        encoded = F.transform(
            F.array_sort(kept), lambda kv: F.concat(_encode(kv["k"]), F.lit("="), _encode(kv["v"]))
        )
        query = F.when(p["query"] == "", F.lit("")).otherwise(F.array_join(encoded, "&"))
        return F.array(scheme, host, clean_path, query)

    def join(r: Column) -> Column:
        return _join_url(r[0], r[1], r[2], r[3], F.lit(""))

    return let(let(url_parts(url), rebuild), join)


def url_fingerprint(url: Column | str) -> Column:
    return F.sha2(normalize_url(url), 256)


def url_hash(url: Column | str) -> Column:
    return F.sha2(as_col(url), 256)


def base_of(url: Column | str) -> Column:
    """What reference resolution needs to know of the base URL."""

    def build(b: Column) -> Column:
        p = b["parts"]
        dirs = F.split(p[2], "/")
        return F.struct(
            b["url"].alias("url"),
            F.lower(p[0]).alias("scheme"),
            p[1].alias("netloc"),
            p[2].alias("path"),
            p[3].alias("query"),
            # The last segment names the page itself unless it is empty.
            F.when(F.element_at(dirs, -1) != "", F.slice(dirs, F.lit(1), F.size(dirs) - 1))
            .otherwise(dirs)
            .alias("dirs"),
        )

    u = _clean(as_col(url))
    return let(F.struct(u.alias("url"), _split(u).alias("parts")), build)


def _remove_dots(segments: Column) -> Column:
    last = F.element_at(segments, -1)
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc)
        .otherwise(F.array_append(acc, s)),
    )
    closed = F.when(last.isin(".", ".."), F.array_append(kept, F.lit(""))).otherwise(kept)
    joined = F.array_join(closed, "/")
    return F.when(joined == "", F.lit("/")).otherwise(joined)


def _merge_path(base: Column, path: Column) -> Column:
    own = F.split(path, "/")
    rooted = F.startswith(path, F.lit("/"))

    def squeeze(segs: Column) -> Column:
        return F.filter(segs, lambda s, i: (i == 0) | (i == F.size(segs) - 1) | (s != ""))

    # Only a path merged with the base loses its empty inner segments.
    segments = F.when(rooted, own).otherwise(let(F.concat(base["dirs"], own), squeeze))
    simple = rooted & ~path.rlike(r"/\.{1,2}(?:/|$)")
    return F.when(simple, path).otherwise(let(segments, _remove_dots))


def resolve_against(base: Column, href: Column) -> Column:
    """Resolve ``href`` against a struct made by :func:`base_of`."""

    def build(h: Column) -> Column:
        u, p = h["u"], h["p"]
        scheme = F.when(p[0] == "", base["scheme"]).otherwise(F.lower(p[0]))
        netloc, path, query, fragment = p[1], p[2], p[3], p[4]
        same_scheme = (p[0] == "") | (F.lower(p[0]) == base["scheme"])
        relative = same_scheme & base["scheme"].isin(RELATIVE_SCHEMES)
        return (
            F.when((base["url"] == "") | ((u != "") & ~relative), u)
            .when(u == "", base["url"])
            .when(netloc != "", _join_url(scheme, netloc, path, query, fragment))
            .when(
                path == "",
                _join_url(
                    scheme,
                    base["netloc"],
                    base["path"],
                    F.when(query == "", base["query"]).otherwise(query),
                    fragment,
                ),
            )
            .otherwise(
                let(
                    _merge_path(base, path),
                    lambda merged: _join_url(scheme, base["netloc"], merged, query, fragment),
                )
            )
        )

    def split(u: Column) -> Column:
        return F.struct(u.alias("u"), _split(u).alias("p"))

    return let(let(_clean(href), split), build)


def resolve_url(base: Column | str, href: Column | str) -> Column:
    """Absolute form of a reference found on the page ``base``."""
    target = as_col(href)
    return let(base_of(base), lambda b: resolve_against(b, target))


def osint_normalize_url(url: Column | str) -> Column:
    """Drop fragment, path parameters and trailing slashes; keep the rest."""

    def build(p: Column) -> Column:
        query = F.when(p["query"] != "", F.concat(F.lit("?"), p["query"])).otherwise(F.lit(""))
        full = F.concat(p["scheme"], F.lit("://"), p["netloc"], p["path"], query)
        return F.rtrim(full, F.lit("/"))

    return let(url_parts(url), build)


def should_follow(
    source: Column | str, target: Column | str, subdomains: bool = True, external: bool = False
) -> Column:
    """Scope test of an edge between two URLs."""
    src, dst = netloc_of(source), netloc_of(target)
    rule = src == dst
    if subdomains:
        rule = (
            rule
            | F.endswith(dst, F.concat(F.lit("."), src))
            | F.endswith(src, F.concat(F.lit("."), dst))
        )
    return rule | F.lit(external)


def _importance(url: Column, words: list[str], docs: bool) -> Column:
    lowered = F.lower(url)
    score = (
        F.lit(0.5)
        + F.when(has_any(lowered, words), 0.2).otherwise(0.0)
        + F.when(occurrences(url, "/") <= 4, 0.2).otherwise(0.0)
    )
    if docs:
        score = score + F.when(has_any(lowered, DOC_PATHS), 0.1).otherwise(0.0)
    return F.least(score, F.lit(1.0))


def url_importance(url: Column | str) -> Column:
    return _importance(as_col(url), IMPORTANT_WORDS, docs=True)


def url_importance_basic(url: Column | str) -> Column:
    return _importance(as_col(url), IMPORTANT_WORDS_BASIC, docs=False)


def url_priority(url: Column | str) -> Column:
    """Frontier rank: path bonus averaged with the importance of the URL."""
    u = as_col(url)
    bonus = F.when(has_any(F.lower(path_of(u)), PRIORITY_PATHS), 0.2).otherwise(0.0)
    return (F.lit(0.5) + bonus + url_importance(u)) / 2


def trap_calendar(url: Column | str) -> Column:
    return as_col(url).rlike(CALENDAR)


def trap_session(url: Column | str) -> Column:
    def build(pairs: Column) -> Column:
        def long_value(name: str) -> Column:
            first = F.get(F.filter(pairs, lambda kv: kv["k"] == name), F.lit(0))
            return F.coalesce(F.length(first["v"]) > SESSION_VALUE_LIMIT, F.lit(False))

        return reduce(Column.__or__, [long_value(name) for name in SESSION_PARAMS])

    u = as_col(url)
    # A URL without any key needs no splitting.
    return F.when(has(u, "="), let(query_pairs(u), build)).otherwise(False)


def trap_length(url: Column | str) -> Column:
    return F.length(as_col(url)) > LENGTH_LIMIT


def trap_pagination(url: Column | str) -> Column:
    # Leading zeros aside, more than three digits is always past the limit.
    digits = F.ltrim(F.regexp_extract(as_col(url), PAGE_NUMBER, 1), F.lit("0"))
    number = F.substring(digits, 1, 3).try_cast("int")
    return (F.length(digits) > 3) | F.coalesce(number > PAGE_LIMIT, F.lit(False))


def trap_facets(url: Column | str) -> Column:
    keys = F.transform(query_pairs(url), lambda kv: kv["k"])
    return F.size(F.array_distinct(keys)) > FACET_LIMIT


def trap_reason(url: Column | str) -> Column:
    """First trap that applies, or null."""
    u = as_col(url)
    return (
        F.when(trap_calendar(u), F.lit("calendar"))
        .when(trap_session(u), F.lit("session"))
        .when(trap_length(u), F.lit("length"))
        .when(trap_pagination(u), F.lit("pagination"))
        .when(trap_facets(u), F.lit("facets"))
    )


def is_trap(url: Column | str) -> Column:
    return trap_reason(url).isNotNull()


def trap_calendar_rules(url: Column | str) -> Column:
    return as_col(url).rlike(CALENDAR_RULES)


def trap_session_rules(url: Column | str) -> Column:
    return as_col(url).rlike(SESSION_RULES)
