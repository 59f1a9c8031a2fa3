"""URL, trap, site-rule and link queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sqlkit as S
from checks.registry import check, enriched, pages
from pagewright.functions import html as H
from pagewright.functions import urls as U
from pagewright.operators import links as L
from pagewright.operators import urls as OU

E = S.E


@check("read_pages", "SELECT page_id, url, length(html) AS n FROM pages")
def read_pages(spark, d):
    from pagewright.sources.readers import read_pages as read

    return read(spark, f"{d}/pages.parquet").select("page_id", "url", F.length("html").alias("n"))


@check(
    "url_parts",
    f"""{E} SELECT page_id, _u_scheme AS scheme, _u_netloc AS netloc, _u_path AS path, _u_params AS params,
 _u_query AS query, _u_frag AS fragment FROM ({S.with_parts('SELECT page_id, url2 FROM p', 'url2')})""",
)
def url_parts(spark, d):
    return enriched(spark, d).select("page_id", U.url_parts("url2").alias("p")).select("page_id", "p.*")


NORM = S.with_norm("SELECT page_id, url2 FROM p", "url2", "norm")


@check("normalize_url", f"{E} SELECT page_id, norm FROM ({NORM})")
def normalize_url(spark, d):
    return enriched(spark, d).select("page_id", U.normalize_url("url2").alias("norm"))


@check("url_fingerprint", f"{E} SELECT page_id, sha256(norm) AS fp FROM ({NORM})")
def url_fingerprint(spark, d):
    return enriched(spark, d).select("page_id", U.url_fingerprint("url2").alias("fp"))


@check("url_hash", "SELECT page_id, sha256(url) AS h FROM pages")
def url_hash(spark, d):
    return pages(spark, d).select("page_id", U.url_hash("url").alias("h"))


@check("dedup_urls", f"{E} SELECT norm AS url, min(page_id) AS pos FROM ({NORM}) GROUP BY norm")
def dedup_urls(spark, d):
    return OU.dedup_urls(enriched(spark, d).select("url2", F.col("page_id").alias("pos")), "url2")


ANCHORS = S.exploded(S.attrs(S.markup(), "a", "href"))


@check(
    "resolve_url",
    f"{E} SELECT source, pos, href, target FROM ({S.with_resolved(ANCHORS, 'source', 'href', 'target')})",
)
def resolve_url(spark, d):
    return (
        enriched(spark, d)
        .select(F.col("url").alias("source"), F.posexplode(H.anchor_hrefs("html")).alias("pos", "href"))
        .withColumn("target", U.resolve_url("source", "href"))
    )


OSINT_NORM = "rtrim(_u_scheme || '://' || _u_netloc || _u_path || CASE WHEN _u_query <> '' THEN '?' || _u_query ELSE '' END, '/')"


@check(
    "osint_normalize_url",
    f"{E} SELECT page_id, {OSINT_NORM} AS norm FROM ({S.with_parts('SELECT page_id, url2 FROM p', 'url2')})",
)
def osint_normalize_url(spark, d):
    return enriched(spark, d).select("page_id", U.osint_normalize_url("url2").alias("norm"))


@check(
    "domain_of",
    f"""SELECT page_id, _u_scheme || '://' || _u_netloc AS domain, _u_netloc AS netloc
 FROM ({S.with_parts('SELECT page_id, url FROM pages', 'url')})""",
)
def domain_of(spark, d):
    return pages(spark, d).select(
        "page_id", U.domain_of("url").alias("domain"), U.netloc_of("url").alias("netloc")
    )


# Every page against the first page of its parent domain and of its host.
HOSTS = f"""SELECT page_id, _u_netloc AS host, regexp_extract(_u_netloc, '([^.]+\\.[^.]+)$', 1) AS parent
 FROM ({S.with_parts('SELECT page_id, url FROM pages', 'url')})"""


def follow_sql(src: str, dst: str) -> str:
    return f"({src} = {dst} OR ends_with({dst}, '.' || {src}) OR ends_with({src}, '.' || {dst}))"


@check(
    "should_follow",
    f"""SELECT page_id, {follow_sql('host', 'parent')} AS up, {follow_sql('parent', 'host')} AS down,
 host = parent AS same_only, {follow_sql('host', "'www.python.org'")} OR true AS anywhere FROM ({HOSTS})""",
)
def should_follow(spark, d):
    src = F.col("url")
    parent = F.concat(F.lit("http://"), F.regexp_extract(U.netloc_of("url"), r"([^.]+\.[^.]+)$", 1), F.lit("/"))
    return pages(spark, d).select(
        "page_id",
        U.should_follow(src, parent).alias("up"),
        U.should_follow(parent, src).alias("down"),
        U.should_follow(src, parent, subdomains=False).alias("same_only"),
        U.should_follow(src, F.lit("http://www.python.org"), external=True).alias("anywhere"),
    )


def importance_sql(col: str, words, docs: bool) -> str:
    tail = f" + CASE WHEN {S.any_of(f'lower({col})', U.DOC_PATHS)} THEN 0.1::DOUBLE ELSE 0::DOUBLE END" if docs else ""
    return (
        f"least(0.5::DOUBLE + CASE WHEN {S.any_of(f'lower({col})', words)} THEN 0.2::DOUBLE ELSE 0::DOUBLE END"
        f" + CASE WHEN {S.occ(col, '/')} <= 4 THEN 0.2::DOUBLE ELSE 0::DOUBLE END{tail}, 1::DOUBLE)"
    )


IMPORTANCE = importance_sql("url2", ["product", "article", "blog", "news"], True)
PRIORITY = (
    f"(0.5::DOUBLE + CASE WHEN {S.any_of('lower(_u_full)', U.PRIORITY_PATHS)} THEN 0.2::DOUBLE ELSE 0::DOUBLE END"
    f" + {IMPORTANCE}) / 2"
)


@check(
    "url_priority",
    f"{E} SELECT page_id, round({PRIORITY}, 9) AS priority FROM ({S.with_parts('SELECT page_id, url2 FROM p', 'url2')})",
)
def url_priority(spark, d):
    return enriched(spark, d).select("page_id", F.round(U.url_priority("url2"), 9).alias("priority"))


@check("url_importance", f"{E} SELECT page_id, round({IMPORTANCE}, 9) AS importance FROM p")
def url_importance(spark, d):
    return enriched(spark, d).select("page_id", F.round(U.url_importance("url2"), 9).alias("importance"))


@check(
    "url_importance_basic",
    f"{E} SELECT page_id, round({importance_sql('url2', ['product', 'article', 'blog'], False)}, 9) AS importance FROM p",
)
def url_importance_basic(spark, d):
    return enriched(spark, d).select("page_id", F.round(U.url_importance_basic("url2"), 9).alias("importance"))


CANON_SRC = f"""SELECT page_id, url, html,
 {S.attr(S.tfilter(S.tags(S.markup(), 'link'), 'lower(' + S.attr('t', 'rel') + ") = 'canonical'", 't') + '[1]', 'href')} AS declared,
 {S.tfilter(S.tmap(S.rxall(S.rm('html', H.NO_COMMENTS), H.JSONLD, 1), S.strip('x')), 'json_valid(x)')} AS ld,
 CASE WHEN declared IS NULL OR declared = '' THEN
  list_filter(list_transform(ld, lambda j: CASE WHEN j LIKE '[%' THEN
    list_filter(list_transform(from_json(j, '["JSON"]'), lambda e: coalesce(nullif(e->>'$."@id"', ''), nullif(e->>'$.url', ''))), lambda v: v IS NOT NULL)[1]
   ELSE coalesce(nullif(j->>'$."@id"', ''), nullif(j->>'$.url', ''), nullif(j->>'$.mainEntityOfPage."@id"', '')) END), lambda v: v IS NOT NULL)[1]
 ELSE declared END AS chosen FROM p"""


@check(
    "canonical_url",
    f"""{E} SELECT page_id, CASE WHEN chosen IS NOT NULL THEN target
 WHEN _u_query = '' AND len(string_split(_u_path, '/')) <= 4 THEN url END AS canonical
 FROM ({S.with_parts(S.with_resolved(CANON_SRC, 'url', "coalesce(chosen, '')", 'target'), 'url')})""",
)
def canonical_url(spark, d):
    return enriched(spark, d).select("page_id", H.canonical_url("html", "url").alias("canonical"))


RULES = [
    OU.SiteRule(r".*/docs/.*", require_js=True, reason="docs", priority=5),
    OU.SiteRule(r"https?://m\.", use_browser_directly=True, custom_user_agent="mobile", reason="mobile", priority=10),
    OU.SiteRule(r".*\.(spa|app)$|.*/SPA/|.*/app/", require_js=True, reason="spa", priority=5),
    OU.SiteRule(r"[broken", priority=99),
    OU.SiteRule(r"https", reason="secure", custom_headers={"Accept": "text/html"}, priority=1),
    OU.SiteRule(r"ttp", reason="never at the start", priority=50),
    OU.SiteRule(r".*", reason="default"),
]


def rule_sql(value) -> str:
    arms = [
        (r".*/docs/.*", 5, 0), (r"https?://m\.", 10, 1), (r".*\.(spa|app)$|.*/SPA/|.*/app/", 5, 2),
        (r"https", 1, 4), (r"ttp", 50, 5), (r".*", 0, 6),
    ]
    rows = ", ".join(f"({S.q(p)}, {pr}, {i}, {S.q(value(i))})" for p, pr, i in arms)
    return f"(SELECT * FROM (VALUES {rows}) r(pat, prio, idx, val))"


@check(
    "site_rule_match",
    f"""{E}, m AS (SELECT page_id, val, row_number() OVER (PARTITION BY page_id ORDER BY prio DESC, idx) AS rn
 FROM p JOIN {rule_sql(lambda i: f"{RULES[i].reason}/{str(RULES[i].require_js).lower()}/{str(RULES[i].use_browser_directly).lower()}/{RULES[i].custom_user_agent or ''}")}
 ON regexp_matches(url2, '(?i)^(?:' || pat || ')'))
 SELECT page_id, val AS rule FROM m WHERE rn = 1""",
)
def site_rule_match(spark, d):
    r = F.col("rule")
    return OU.site_rule_match(enriched(spark, d), RULES, "url2").select(
        "page_id",
        F.concat_ws(
            "/",
            r["reason"],
            r["require_js"].cast("string"),
            r["use_browser_directly"].cast("string"),
            F.coalesce(r["custom_user_agent"], F.lit("")),
        ).alias("rule"),
    )


EXCLUDES = [r".*\.pdf$", r".*\.zip$", r"/fr/.*", r"/index.*", r"[broken"]


@check(
    "exclude_urls",
    f"{E} SELECT page_id, url2 FROM p WHERE NOT ("
    + " OR ".join(S.like("url2", p) for p in EXCLUDES[:-1])
    + ")",
)
def exclude_urls(spark, d):
    return OU.exclude_urls(enriched(spark, d), EXCLUDES, "url2").select("page_id", "url2")


# --- traps ----------------------------------------------------------------------

PAIRS = S.pairs(S.url_query("url2"))
T_CAL = S.like("url2", r"/\d{4}/\d{1,2}/\d{1,2}/")
T_SES = (
    "("
    + " OR ".join(
        f"coalesce(length({S.tfilter(PAIRS, f'x.k = {S.q(n)}')}[1].v) > 20, false)"
        for n in ("sessionid", "session", "sid", "jsessionid")
    )
    + ")"
)
T_LEN = "length(url2) > 500"
T_PAG = f"coalesce(TRY_CAST({S.rx('url2', '[?&]page=([0-9]+)')} AS DECIMAL(38,0)) > 100, false)"
T_FAC = f"len(list_distinct({S.tmap(PAIRS, 'x.k')})) > 10"
TRAP = (
    f"CASE WHEN {T_CAL} THEN 'calendar' WHEN {T_SES} THEN 'session' WHEN {T_LEN} THEN 'length' "
    f"WHEN {T_PAG} THEN 'pagination' WHEN {T_FAC} THEN 'facets' END"
)


def _flag(name: str, sql: str, column) -> None:
    @check(name, f"{E} SELECT page_id, {sql} AS hit FROM p")
    def query(spark, d):
        return enriched(spark, d).select("page_id", column().alias("hit"))


_flag("trap_calendar", T_CAL, lambda: U.trap_calendar("url2"))
_flag("trap_session", T_SES, lambda: U.trap_session("url2"))
_flag("trap_length", T_LEN, lambda: U.trap_length("url2"))
_flag("trap_pagination", T_PAG, lambda: U.trap_pagination("url2"))
_flag("trap_facets", T_FAC, lambda: U.trap_facets("url2"))
_flag("trap_reason", TRAP, lambda: U.trap_reason("url2"))
_flag(
    "trap_calendar_rules",
    "(" + " OR ".join(S.like("url2", p) for p in (r"/\d{4}/\d{2}/\d{2}/", r"/archive/\d{4}/", r"/date/\d{4}/")) + ")",
    lambda: U.trap_calendar_rules("url2"),
)
_flag(
    "trap_session_rules",
    "("
    + " OR ".join(S.like("url2", p) for p in (r"[?&]sessionid=[a-zA-Z0-9]{20,}", r"[?&]sid=[a-zA-Z0-9]{20,}"))
    + ")",
    lambda: U.trap_session_rules("url2"),
)


# --- links -----------------------------------------------------------------------

NONEMPTY = "x <> ''"


def srcset_list(lst: str) -> str:
    items = f"flatten({S.tmap(lst, 'string_split(x, ' + S.q(',') + ')')})"
    return S.tfilter(S.tmap(items, S.rx("x", r"(\S+)")), NONEMPTY)


PICTURES = f"array_to_string({S.rxall(S.markup(), H.inner('picture'), 1)}, ' ')"
SRCSET = (
    f"list_concat({srcset_list(S.attrs(S.markup(), 'img', 'srcset'))}, "
    f"{srcset_list(S.attrs(PICTURES, 'source', 'srcset'))})"
)
JS = S.tfilter(
    "list_concat(" * 4
    + S.rxall("html", H.JS_PATTERNS[0], 1)
    + "".join(f", {S.rxall('html', p, 1)})" for p in H.JS_PATTERNS[1:]),
    "x LIKE 'http%' OR x LIKE '/%'",
)
BLOB = f"list_concat({S.rxall('html', H.BLOB_PATTERN)}, {S.rxall('html', H.DATA_PATTERN)})"
REFRESH_TAG = S.tfilter(S.tags(S.markup(), "meta"), f"contains(lower({S.attr('t', 'http-equiv')}), 'refresh')", "t")
REFRESH = S.tfilter(f"[{S.rx(S.attr(REFRESH_TAG + '[1]', 'content'), '(?i)url=([^;]+)')}]", "coalesce(x, '') <> ''")
API = (
    f"list_concat(list_concat({S.rxall('html', H.API_QUOTED, 1)}, {S.rxall('html', H.API_FETCH, 1)}), "
    f"{S.rxall('html', H.API_XHR, 2)})"
)
IMG = S.tfilter(S.attrs(S.markup(), "img", "src"), NONEMPTY)


def resolved_rows(lst: str, web_first: bool = False) -> str:
    inner = S.with_resolved(S.exploded(lst), "source", "href", "target")
    target = "CASE WHEN href LIKE 'http%' THEN href ELSE target END" if web_first else "target"
    return f"SELECT source, {target} AS target, pos FROM ({inner})"


KIND_ROWS = {
    "anchor": resolved_rows(S.attrs(S.markup(), "a", "href")),
    "link": resolved_rows(S.attrs(S.markup(), "link", "href")),
    "script": resolved_rows(S.attrs(S.markup(), "script", "src")),
    "img": resolved_rows(IMG),
    "srcset": resolved_rows(SRCSET),
    "js": resolved_rows(JS, web_first=True),
    "blob": f"SELECT source, href AS target, pos FROM ({S.exploded(BLOB)})",
    "meta_refresh": resolved_rows(REFRESH),
}
API_ROWS = f"SELECT DISTINCT source, target FROM ({resolved_rows(API, web_first=True)})"


def _links(kind: str) -> None:
    @check(f"links_{kind}", f"{E} SELECT source, target, '{kind}' AS kind, pos FROM ({KIND_ROWS[kind]})")
    def query(spark, d):
        return getattr(L, f"links_{kind}")(enriched(spark, d))


for _kind in KIND_ROWS:
    _links(_kind)


@check("links_api", f"{E} SELECT source, target FROM ({API_ROWS})")
def links_api(spark, d):
    return L.links_api(enriched(spark, d)).select("source", "target")


ALL_ROWS = " UNION ALL ".join([f"SELECT source, target FROM ({s})" for s in KIND_ROWS.values()] + [API_ROWS])
LINKS = f"SELECT DISTINCT source, norm AS target FROM ({S.with_norm(ALL_ROWS, 'target', 'norm')})"


@check("extract_links", f"{E} {LINKS}")
def extract_links(spark, d):
    return L.extract_links(enriched(spark, d)).select("source", "target").distinct()


ABSOLUTE = S.like("href", r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]")
OSINT_ROWS = f"""SELECT source, pos, {OSINT_NORM} AS target FROM ({S.with_parts(
    "SELECT source, pos, CASE WHEN " + ABSOLUTE + " THEN href ELSE target END AS t2 FROM ("
    + S.with_resolved(S.exploded(S.attrs(S.markup(), 'a', 'href')), 'source', 'href', 'target')
    + ") WHERE href NOT LIKE '#%'", 't2')})"""
OSINT = f"SELECT source, target FROM ({OSINT_ROWS}) WHERE target LIKE 'http://%' OR target LIKE 'https://%'"


@check("osint_links", f"{E} {OSINT}")
def osint_links(spark, d):
    return L.osint_links(enriched(spark, d)).select("source", "target")


@check(
    "link_extraction_suspect",
    f"""{E}, l AS (SELECT source, count(*) AS n FROM ({KIND_ROWS['link']}) GROUP BY source)
 SELECT p.url, {S.occ('lower(html)', '<a ')} AS n_anchors, coalesce(n, 0) AS n_links,
 {S.occ('lower(html)', '<a ')} > 10 AND coalesce(n, 0) < 2 AS suspect FROM p LEFT JOIN l ON p.url = l.source""",
)
def link_extraction_suspect(spark, d):
    # Counted against <link> tags only, so that some pages are suspect.
    p = enriched(spark, d)
    return L.link_extraction_suspect(p, L.links_link(p))
