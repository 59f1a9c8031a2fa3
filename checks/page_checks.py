"""Filters, text, metadata, structured data, scoring, entities, technology."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sqlkit as S
from checks.registry import check, enriched, joined, map_text, pages, table
from checks.url_checks import LINKS, TRAP
from pagewright.functions import elements as EL
from pagewright.functions import entities as EN
from pagewright.functions import html as H
from pagewright.functions import language as LG
from pagewright.functions import pages as P
from pagewright.functions import scoring as SC
from pagewright.functions import tech as T
from pagewright.operators import language as OL
from pagewright.operators.urls import SiteRule
from pagewright.plans import osint, process
from pagewright.session import cut_lineage

E = S.E


def per_page(name: str, sql: str, build, base=enriched, out: str = "v") -> None:
    """Register one column over the enriched pages."""
    sql_text = f"{E} SELECT page_id, {sql} AS {out} FROM p"

    @check(name, sql_text)
    def query(spark, d):
        return base(spark, d).select("page_id", build().alias(out))


def arr(sql: str) -> str:
    return f"array_to_string({sql}, '|')"


def arr_sorted(sql: str) -> str:
    return f"array_to_string(list_sort(list_distinct({sql})), '|')"


# --- filters ------------------------------------------------------------------

TITLE = S.strip(S.unesc(S.rx(S.markup(), H.inner("title"))))
HITS = " + ".join(f"contains(lower(html), {S.q(x)})::INT" for x in P.NOT_FOUND_PHRASES)
SOFT = f"""CASE WHEN status_code IN (404, 410) THEN true WHEN html = '' THEN false
 WHEN length(html) < 200 THEN {S.any_of('lower(html)', ['page not found', '404 error', 'not found'])}
 WHEN length(html) < 1000 AND ({HITS}) >= 2 THEN true WHEN ({HITS}) >= 3 THEN true
 ELSE {S.any_of(f'lower({TITLE})', ['404', 'not found', 'page not found', 'error'])} END"""

per_page("is_soft_404", SOFT, lambda: P.is_soft_404("html", F.col("status_code")))
MARKERS = S.any_of("lower(html[1:10000])", ["react", "vue", "angular", "next.js", "nuxt", "__next_data__"])
per_page("needs_js_markers", MARKERS, lambda: P.needs_js_markers("html"))
LH = "lower(html)"
HEUR = f"""(length({S.strip(LH)}) < 500 OR {S.any_of(LH, ['data-reactroot', 'ng-app', 'ng-controller'])}
 OR (contains({LH}, '<script') AND {S.occ(LH, 'react')} > 2) OR (contains({LH}, '<script') AND {S.occ(LH, 'angular')} > 2)
 OR ({S.occ(LH, '<div')} > 10 * {S.occ(LH, '<a')} AND {S.occ(LH, '<a')} > 0 AND length({S.strip(LH)}) < 2000))"""
per_page("needs_js_heuristic", HEUR, lambda: P.needs_js_heuristic("html"))


@check(
    "needs_js",
    f"""{E} SELECT page_id, (contains(lower(url2), '/spa/') OR {MARKERS} OR {HEUR} OR length({S.strip('html')}) < 500) AS v
 FROM p""",
)
def needs_js(spark, d):
    from pagewright.operators.urls import SiteRule

    rules = [SiteRule(".*/spa/", require_js=True, priority=1), SiteRule(".*")]
    p = enriched(spark, d).drop("url").withColumnRenamed("url2", "url")
    return process.needs_js(p, rules).select("page_id", F.col("needs_js").alias("v"))


def spa(*arms) -> str:
    return "CASE " + " ".join(f"WHEN {S.any_of(LH, w)} THEN '{n}'" for n, w in arms) + " END"


per_page(
    "detect_spa",
    spa(
        ("react", ["react"]), ("vue", ["vue"]), ("angular", ["ng-", "angular"]), ("next", ["next"]), ("nuxt", ["nuxt"])
    ),
    lambda: P.detect_spa("html"),
)


@check("max_size_filter", f"{E} SELECT page_id FROM p WHERE strlen(html) <= 0.004 * 1048576")
def max_size_filter(spark, d):
    return enriched(spark, d).filter(P.max_size_filter("content", 0.004)).select("page_id")


ROUTE = f"""CASE WHEN contains(ctype, 'text/html') THEN 'text' WHEN contains(ctype, 'application/pdf') THEN 'pdf'
 WHEN contains(ctype, 'officedocument') THEN 'office' WHEN contains(ctype, 'image/') THEN 'image'
 WHEN contains(ctype, 'video/') THEN 'video' WHEN contains(ctype, 'audio/') THEN 'audio'
 WHEN contains(ctype, 'application/zip') OR ends_with(url2, '.zip') THEN 'zip'
 WHEN contains(ctype, 'application/x-tar') THEN 'tar' WHEN contains(ctype, 'application/epub+zip') THEN 'epub' ELSE 'none' END"""
per_page("content_route", ROUTE, lambda: P.content_route("headers", "url2"))
per_page(
    "office_subtype",
    "CASE WHEN contains(ctype, 'wordprocessingml') THEN 'docx' END",
    lambda: P.office_subtype("headers", "url2"),
)
REASON = f"CASE WHEN strlen(html) > 0.005 * 1048576 THEN 'size' WHEN {TRAP} IS NOT NULL THEN 'trap_' || {TRAP} WHEN {SOFT} THEN 'soft_404' END"


@check("crawlable", f"{E} SELECT page_id, {REASON} AS reject_reason FROM p")
def crawlable(spark, d):
    p = enriched(spark, d).drop("url").withColumnRenamed("url2", "url")
    return process.crawlable(p, process.CrawlConfig(max_size_mb=0.005)).select("page_id", "reject_reason")


# --- text and metadata ----------------------------------------------------------

METAS = f"""list_filter(list_transform({S.tags(S.markup(), 'meta')}, lambda t: {{'n': CASE WHEN {S.attr('t', 'name')} <> ''
 THEN {S.attr('t', 'name')} ELSE {S.attr('t', 'property')} END, 'c': {S.attr('t', 'content')}}}), lambda e: e.n <> '' AND e.c <> '')"""
VISIBLE = S.visible()
WORDS = f"len({S.rxall(VISIBLE, chr(92) + 'S+')})"
per_page("page_title", TITLE, lambda: H.page_title("html"))
per_page("page_meta", S.last_wins(METAS), lambda: map_text(H.page_meta("html")))


def named(name: str) -> str:
    return f"list_filter({METAS}, lambda e: lower(e.n) = '{name}')[-1].c"


DESCRIPTION = f"coalesce({named('description')}, '')"
KEYWORDS = f"coalesce({arr(S.tmap('string_split(' + named('keywords') + ', ' + S.q(',') + ')', S.strip('x')))}, '')"
per_page("page_description", DESCRIPTION, lambda: H.page_description("html"))
per_page("page_keywords", KEYWORDS, lambda: joined(H.page_keywords("html")))
per_page("visible_text", VISIBLE, lambda: H.visible_text("html"))
per_page("word_count", WORDS, lambda: H.word_count(H.visible_text("html")))


def element_sql(name: str, source: str) -> str:
    """CTEs {name}_toks (page_id, i, tok) and {name}_els (page_id, i, j, tok).

    Depth is counted for each tag name of a page on its own, as a running sum;
    an element goes from an open tag to the next close tag at its depth.
    """
    return f"""{name}_toks AS (SELECT page_id, i, l[i] AS tok FROM (SELECT page_id, {S.rxall(source, EL.TOKEN)} AS l FROM p) s,
  LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i)),
 {name}_depth AS (SELECT *, sum(step) OVER (PARTITION BY page_id, name ORDER BY i) AS depth FROM (
  SELECT *, lower({S.rx('tok', EL.TAG, 2)}) AS name, CASE WHEN tok LIKE '</%' THEN -1 ELSE 1 END AS step FROM {name}_toks
  WHERE {S.like('tok', EL.TAG)}) WHERE name NOT IN {S.inlist(EL.VOID)} AND NOT (step = 1 AND tok LIKE '%/>')),
 {name}_els AS (SELECT o.page_id, o.i, o.tok, min(c.i) AS j FROM {name}_depth o JOIN {name}_depth c ON c.page_id = o.page_id
  AND c.name = o.name AND c.step = -1 AND c.i > o.i AND c.depth = o.depth - 1 WHERE o.step = 1 GROUP BY ALL)"""


def inside(name: str, element: str) -> str:
    """Markup of an element of ``{name}_els``."""
    return f"(SELECT string_agg(t.tok, '' ORDER BY t.i) FROM {name}_toks t WHERE t.page_id = {element}.page_id AND t.i BETWEEN {element}.i AND {element}.j)"


def matching(selectors: list[str], tag: str = "tok") -> str:
    return "(" + " OR ".join(S.like(tag, EL.open_tag_pattern(s)) for s in selectors) + ")"


def first_of(name: str, selectors: list[str]) -> str:
    """Markup of the first element of the first selector that has one."""
    rank = " ".join(f"WHEN {S.like('tok', EL.open_tag_pattern(s))} THEN {n}" for n, s in enumerate(selectors))
    return f"""(SELECT {inside(name, 'e')} FROM (SELECT *, CASE {rank} END AS r FROM {name}_els) e
 WHERE e.page_id = p.page_id AND r IS NOT NULL ORDER BY r, i LIMIT 1)"""


FRAMES = [*H.BOILERPLATE_TAGS, "noscript", *["." + c for c in H.BOILERPLATE_CLASSES], *["#" + c for c in H.BOILERPLATE_IDS]]
BLOCK_SQL = f"""{element_sql('b', 'html')},
 cut AS (SELECT * FROM b_els WHERE {matching(FRAMES)}),
 rest AS (SELECT page_id, string_agg(CASE WHEN EXISTS (SELECT 1 FROM cut WHERE cut.page_id = t.page_id AND t.i BETWEEN cut.i AND cut.j)
  THEN '<!---->' ELSE tok END, '' ORDER BY i) AS body FROM b_toks t GROUP BY page_id),
 clean_of AS (SELECT page_id, {S.strip(S.rm(S.visible('body'), r"\s+", " "))} AS v
  FROM (SELECT page_id, coalesce(body, '') AS body FROM p LEFT JOIN rest USING (page_id))),
 main_of AS (SELECT page_id, CASE WHEN hit IS NOT NULL THEN {S.visible('hit')} ELSE clean_of.v END AS v
  FROM (SELECT page_id, {first_of('b', H.MAIN_SELECTORS)} AS hit FROM p) JOIN clean_of USING (page_id))"""


@check("remove_boilerplate", f"{E}, {BLOCK_SQL} SELECT page_id, v FROM clean_of")
def remove_boilerplate(spark, d):
    return enriched(spark, d).select("page_id", H.remove_boilerplate("html").alias("v"))


@check("main_content", f"{E}, {BLOCK_SQL} SELECT page_id, v FROM main_of")
def main_content(spark, d):
    return enriched(spark, d).select("page_id", H.main_content("html").alias("v"))


@check(
    "largest_block",
    f"""{E}, {element_sql('b', 'html')},
 blocks AS (SELECT page_id, i, {S.rawtext('body')} AS t FROM (SELECT page_id, i, {inside('b', 'e')} AS body FROM b_els e WHERE {matching(H.BLOCK_TAGS)})),
 best AS (SELECT * FROM blocks WHERE t <> '' QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(t) DESC, i) = 1)
 SELECT page_id, coalesce(best.t, {S.rawtext()}) AS v FROM p LEFT JOIN best USING (page_id)""",
)
def largest_block(spark, d):
    return enriched(spark, d).select("page_id", H.largest_block("html").alias("v"))


LD = S.tfilter(S.tmap(S.rxall(S.rm("html", H.NO_COMMENTS), H.JSONLD, 1), S.strip("x")), "json_valid(x)")
per_page("jsonld", arr(LD), lambda: joined(H.jsonld("html")))


def prefixed(attribute: str, prefix: str) -> str:
    return (
        f"list_transform(list_filter({S.tags(S.markup(), 'meta')}, lambda t: {S.attr('t', attribute)} LIKE '{prefix}%'), "
        f"lambda t: {{'n': replace({S.attr('t', attribute)}, '{prefix}', ''), 'c': {S.attr('t', 'content')}}})"
    )


OG = S.last_wins(prefixed("property", "og:"))
TW = S.last_wins(prefixed("name", "twitter:"))
per_page("opengraph", OG, lambda: map_text(H.opengraph("html")))
per_page("twitter_card", TW, lambda: map_text(H.twitter_card("html")))

# One row per scope, then one per property.
MICRO = f"""scopes AS (SELECT page_id, url, unnest(string_split(regexp_replace({S.markup()}, {S.q(H.SCOPE_TAG)}, chr(1) || '\\1', 'g'), chr(1))[2:]) AS seg FROM p),
 props AS (SELECT page_id, url, {S.attr(S.rx('seg', '(?s)^(<[^>]*>)'), 'itemtype')} AS itemtype, unnest({S.rxall('seg', H.PROP_WITH_TEXT)}) AS hit FROM scopes),
 parts AS (SELECT *, {S.rx('hit', '(?s)^(<[^>]*>)')} AS tag, lower({S.rx('hit', '(?i)^<([a-z][a-z0-9]*)')}) AS el,
  {S.strip(S.unesc(S.rx('hit', '(?s)^<[^>]*>(.*)$')))} AS txt FROM props)
 SELECT url, itemtype, {S.attr('tag', 'itemprop')} AS prop, CASE WHEN {S.like('tag', H.attr_pattern('content'))} THEN {S.attr('tag', 'content')}
  WHEN el IN ('a', 'area', 'link') AND {S.like('tag', H.attr_pattern('href'))} THEN {S.attr('tag', 'href')}
  WHEN el = 'time' AND {S.like('tag', H.attr_pattern('datetime'))} THEN {S.attr('tag', 'datetime')} ELSE txt END AS value FROM parts"""


@check("microdata", f"{E}, {MICRO}")
def microdata(spark, d):
    return process.microdata(enriched(spark, d))


@check(
    "extract_text",
    f"""{E} SELECT page_id, {TITLE} AS title, md5({VISIBLE}) AS text, {S.last_wins(METAS)} AS meta, {KEYWORDS} AS keywords,
 'en' AS language, {WORDS} AS word_count, {DESCRIPTION} AS description FROM p""",
)
def extract_text(spark, d):
    return (
        process.extract_text(enriched(spark, d))
        .select("page_id", "text_info.*")
        .withColumn("text", F.md5(F.col("text").cast("binary")))
        .withColumn("meta", map_text(F.col("meta")))
        .withColumn("keywords", joined(F.col("keywords")))
    )


@check("extract_structured", f"{E} SELECT page_id, {arr(LD)} AS jsonld, {OG} AS opengraph, {TW} AS twitter FROM p")
def extract_structured(spark, d):
    s = F.col("structured")
    return process.extract_structured(enriched(spark, d)).select(
        "page_id",
        joined(s["jsonld"]).alias("jsonld"),
        map_text(s["opengraph"]).alias("opengraph"),
        map_text(s["twitter"]).alias("twitter"),
    )


@check("repair_html", "SELECT page_id, length(html) AS n FROM pages")
def repair_html(spark, d):
    # NUL characters are put in first; the repaired page has none of them.
    broken = F.concat(F.lit("\x00"), F.replace(F.col("html"), F.lit("<p>"), F.lit("<p>\x00")))
    return pages(spark, d).select("page_id", F.length(H.repair_html(broken)).alias("n"))


SELECTORS = {
    "title": "h1.title, .article-title, //h1[@class='title']",
    "author": ".author-name, .byline",
    "date": ".publish-date, time[datetime]",
    "side": "#sidebar, aside",
}


def sel(*choices: str) -> str:
    return S.visible(first_of("m", list(choices)))


@check(
    "custom_selectors",
    f"""{E}, {element_sql('m', S.markup())} SELECT url, {sel('h1.title', '.article-title')} AS title, {sel('.author-name', '.byline')} AS author,
 {sel('.publish-date', 'time[datetime]')} AS date, {sel('#sidebar', 'aside')} AS side FROM p""",
)
def custom_selectors(spark, d):
    return process.custom_selectors(enriched(spark, d), SELECTORS)


# --- languages ------------------------------------------------------------------


def doc_flag(name: str, sql: str, build) -> None:
    @check(name, f"SELECT doc_id, {sql} AS v FROM documents")
    def query(spark, d):
        return table(spark, d, "documents").select("doc_id", build().alias("v"))


MIXED = "CASE doc_id % 5 WHEN 0 THEN text || '漢字' WHEN 1 THEN text || 'かな' WHEN 2 THEN text || 'שלום' WHEN 3 THEN text || 'سلام' ELSE text END"


def mixed():
    return F.expr(MIXED)


doc_flag("is_cjk", f"regexp_matches({MIXED}, '[\\x{{4e00}}-\\x{{9fff}}\\x{{3400}}-\\x{{4dbf}}\\x{{3040}}-\\x{{30ff}}\\x{{ff00}}-\\x{{ffef}}]')", lambda: LG.is_cjk(mixed()))
doc_flag("is_rtl", f"regexp_matches({MIXED}, '[\\x{{0590}}-\\x{{074f}}]')", lambda: LG.is_rtl(mixed()))
doc_flag(
    "segment_cjk",
    "md5(array_to_string(regexp_extract_all(text, '(?s).'), '|'))",
    lambda: F.md5(joined(LG.segment_cjk("text")).cast("binary")),
)
doc_flag(
    "fix_mojibake",
    "md5(text)",
    lambda: F.md5(
        # The UTF-8 bytes read as Latin-1, then repaired.
        LG.fix_mojibake(F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")).cast("binary")
    ),
)
doc_flag(
    "decode_content",
    "md5(text)",
    lambda: F.md5(
        LG.decode_content(
            F.when(F.col("doc_id") % 2 == 0, F.encode("text", "UTF-8")).otherwise(F.encode("text", "UTF-16")),
            F.create_map(
                F.lit("Content-Type"),
                F.when(F.col("doc_id") % 2 == 0, "text/html").otherwise("text/html; charset=UTF-16"),
            ),
        ).cast("binary")
    ),
)

GRAMS = """g AS (SELECT doc_id, lang, unnest(list_concat(list_concat(regexp_extract_all(lower(text), '(?s).{3}'),
 regexp_extract_all(lower(text)[2:], '(?s).{3}')), regexp_extract_all(lower(text)[3:], '(?s).{3}'))) AS gram FROM documents),
 prof AS (SELECT lang, gram, count(*) AS n FROM g GROUP BY ALL),
 tot AS (SELECT lang, sum(n) AS total, count(*) AS kinds FROM prof GROUP BY lang)"""


@check(
    "language_profiles",
    f"WITH {GRAMS} SELECT lang, gram, n, round(ln((n + 1.0::DOUBLE) / (total + kinds + 1.0::DOUBLE)), 6) AS logp FROM prof JOIN tot USING (lang)",
)
def language_profiles(spark, d):
    return OL.language_profiles(table(spark, d, "documents")).select(
        "lang", "gram", "n", F.round("logp", 6).alias("logp")
    )


SCORES = f"""{GRAMS}, c AS (SELECT doc_id, gram, count(*) AS c FROM g GROUP BY ALL),
 sz AS (SELECT doc_id, sum(c) AS m FROM c GROUP BY doc_id),
 s AS (SELECT c.doc_id, t.lang, sum(c.c * ln((coalesce(p.n, 0) + 1.0::DOUBLE) / (t.total + t.kinds + 1.0::DOUBLE))) / any_value(m) AS score
  FROM c CROSS JOIN tot t LEFT JOIN prof p ON p.lang = t.lang AND p.gram = c.gram JOIN sz ON sz.doc_id = c.doc_id GROUP BY c.doc_id, t.lang)"""


@check(
    "detect_language",
    f"""WITH {SCORES}, b AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang) AS rn FROM s)
 SELECT d.doc_id, coalesce(b.lang, 'en') AS language FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id AND b.rn = 1""",
)
def detect_language(spark, d):
    docs = table(spark, d, "documents")
    return OL.detect_language(docs, cut_lineage(OL.language_profiles(docs)), "doc_id").select("doc_id", "language")


@check(
    "detect_languages",
    f"""WITH {SCORES}, w AS (SELECT doc_id, lang, exp((score - max(score) OVER (PARTITION BY doc_id)) * 20) AS w FROM s)
 SELECT doc_id, lang, round(w / sum(w) OVER (PARTITION BY doc_id), 4) AS prob FROM w
 UNION ALL SELECT doc_id, 'en', 1.0 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM s)""",
)
def detect_languages(spark, d):
    docs = table(spark, d, "documents")
    out = OL.detect_languages(docs, cut_lineage(OL.language_profiles(docs)), "doc_id")
    return out.withColumn("prob", F.round("prob", 4))


# --- scores -----------------------------------------------------------------------

RAW = S.rawtext()
ALTS = f"len({S.tfilter(S.tags(S.markup(), 'img'), S.attr('t', 'alt') + S.q('').join([' <> ', '']), 't')}) > 0"


def add(cond: str, value: str) -> str:
    return f"CASE WHEN {cond} THEN {value}::DOUBLE ELSE 0::DOUBLE END"


QUALITY = f"""greatest(0::DOUBLE, least(1::DOUBLE, 0.5::DOUBLE + {add(f"len({S.rxall(RAW, chr(92) + 'S+')}) > 300", '0.1')}
 + {add(f"len({S.rxall(RAW, chr(92) + 'S+')}) > 1000", '0.1')} + {add(S.like(S.markup(), r'(?i)<h[123](?:[\s/][^>]*)?>'), '0.1')}
 + {add(ALTS, '0.1')} + {add(f"len({S.rxall(S.rm('html', H.NO_COMMENTS), H.JSONLD, 1)}) > 0", '0.1')}
 - {add(f"{S.occ(f'lower({RAW})', 'advertisement')} + {S.occ(f'lower({RAW})', 'sponsored')} > 5", '0.2')}))"""


@check("quality_score", f"{E} SELECT page_id, round({QUALITY}, 9) AS v FROM p")
def quality_score(spark, d):
    return enriched(spark, d).select("page_id", F.round(SC.quality_score("html"), 9).alias("v"))


LU = "lower(url2)"
LADDER = f"""CASE WHEN {S.any_of(LU, ['/news/', '/article/', '/newsroom/'])} THEN 'news'
 WHEN {S.any_of(LU, ['/blog/', '/post/', '/entry/'])} THEN 'blog' WHEN {S.any_of(LU, ['/product/', '/item/', '/shop/', '/buy/'])} THEN 'product'
 WHEN {S.any_of(LU, ['/docs/', '/documentation/', '/guide/'])} THEN 'documentation'
 WHEN {S.any_of(LU, ['/category/', '/categories/', '/catalog/'])} THEN 'category'
 WHEN {S.occ('url2', '/')} <= 2 OR ends_with(url2, '/') OR contains({LU}, 'index') THEN 'homepage' ELSE 'generic' END"""
TYPED = f"""t AS (SELECT page_id, {LADDER} AS k, lower({RAW}) AS tx, {S.like(S.markup(), H.open_tag('article'))} AS art FROM p),
 s AS (SELECT page_id,
  greatest({add("k = 'news'", '0.8')}, {add(S.any_of('tx', ['published', 'author', 'posted on']), '0.5')}, {add('art', '0.4')}) AS news,
  greatest({add("k = 'blog'", '0.8')}, {add(S.any_of('tx', ['published', 'author', 'posted on']), '0.6')}, {add('art', '0.5')}) AS blog,
  greatest({add("k = 'product'", '0.8')}, {add(S.any_of('tx', ['price', '$', 'add to cart', 'buy now']), '0.6')}) AS product,
  {add("k = 'homepage'", '0.7')} AS homepage, {add("k = 'category'", '0.8')} AS category,
  greatest({add("k = 'documentation'", '0.8')}, {add(S.any_of('tx', ['api', 'function', 'parameter', 'example']), '0.6')}) AS documentation,
  {add("k = 'generic'", '0.5')} AS generic FROM t),
 z AS (SELECT *, news + blog + product + homepage + category + documentation + generic AS total FROM s)"""


@check(
    "page_type_scores",
    f"{E}, {TYPED} SELECT page_id, " + ", ".join(f"round({t} / total, 6) AS {t}" for t in SC.PAGE_TYPES) + " FROM z",
)
def page_type_scores(spark, d):
    scored = enriched(spark, d).select("page_id", SC.page_type_scores("html", "url2").alias("m"))
    return scored.select("page_id", *[F.round(F.col("m")[t], 6).alias(t) for t in SC.PAGE_TYPES])


BEST = "CASE " + " ".join(
    f"WHEN {t} >= greatest({', '.join(SC.PAGE_TYPES)}) THEN '{t}'" for t in SC.PAGE_TYPES
) + " END"


@check("page_type", f"{E}, {TYPED} SELECT page_id, {BEST} AS v FROM z")
def page_type(spark, d):
    return enriched(spark, d).select("page_id", SC.page_type("html", "url2").alias("v"))


BASIC = f"""CASE WHEN {S.any_of('url2', ['/product/', '/item/'])} THEN 'product' WHEN {S.any_of('url2', ['/article/', '/post/', '/blog/'])} THEN 'article'
 WHEN {S.occ('url2', '/')} <= 3 THEN 'homepage' WHEN contains(url2, 'search') THEN 'search_results' ELSE 'other' END"""


@check(
    "page_type_scores_basic",
    f"""{E} SELECT page_id, {BASIC} AS best, CASE WHEN {BASIC} IN ('product', 'article') THEN 0.8::DOUBLE
 WHEN {BASIC} IN ('homepage', 'search_results') THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END AS score, 10 AS classes FROM p""",
)
def page_type_scores_basic(spark, d):
    m = SC.page_type_scores_basic("url2")
    return enriched(spark, d).select("page_id", m.alias("m")).select(
        "page_id",
        SC.top_type("m", SC.PAGE_TYPES_BASIC).alias("best"),
        F.array_max(F.map_values("m")).alias("score"),
        F.size("m").alias("classes"),
    )


def n_tags(tag: str) -> str:
    return f"len({S.tags(S.markup(), tag)})::DOUBLE"


def n_class(tag: str, pattern: str) -> str:
    return f"len({S.tfilter(S.tags(S.markup(), tag), S.like(S.attr('t', 'class'), '(?i)' + pattern), 't')})::DOUBLE"


LT = f"lower({TITLE})"
FEATURES = [
    add(S.any_of(LU, ["/news/", "/article/"]), "1"), add(S.any_of(LU, ["/blog/", "/post/"]), "1"),
    add(S.any_of(LU, ["/product/", "/item/", "/shop/"]), "1"), add(S.any_of(LU, ["/docs/", "/documentation/"]), "1"),
    add(S.any_of(LU, ["/category/", "/categories/"]), "1"), f"{S.occ('url2', '/')}::DOUBLE",
    add(f"{S.occ('url2', '/')} <= 2", "1"), n_tags("article"), n_tags("section"), n_class("div", "product|item"),
    n_class("div", "article|post|entry"), n_tags("nav"), n_tags("aside"), f"length({RAW})::DOUBLE",
    f"(CASE WHEN {S.occ(RAW, '$')} > 0 THEN {S.occ(RAW, '$')} WHEN {S.occ(RAW, '€')} > 0 THEN {S.occ(RAW, '€')} ELSE {S.occ(RAW, '£')} END)::DOUBLE",
    n_tags("img"), n_tags("a"), add(f"contains({LT}, 'home')", "1"), add(f"contains({LT}, 'product')", "1"),
    add(f"contains({LT}, 'blog')", "1"),
]
FEATURES_BASIC = [
    add(S.any_of("url2", ["/product/", "/item/"]), "1"), add(S.any_of("url2", ["/article/", "/post/"]), "1"),
    add(S.any_of("url2", ["/category/", "/catalog/"]), "1"), add(S.any_of("url2", ["search", "query"]), "1"),
    add(f"{S.occ('url2', '/')} <= 3", "1"), n_tags("article"),
    f"len({S.tfilter(S.rxall(S.markup(), '(?is)<[a-z][a-z0-9]*' + chr(92) + 's[^>]*>'), 'list_contains(string_split(' + S.attr('t', 'class') + ', ' + S.q(' ') + '), ' + S.q('product') + ')', 't')})::DOUBLE",
    n_tags("form"), n_tags("table"),
    add(f"len({S.tfilter(S.rxall(S.markup(), '(?is)<[a-z][^>]*>'), S.attr('t', 'itemprop') + ' = ' + S.q('price'), 't')}) > 0", "1"),
    f"length({RAW}) / 1000::DOUBLE", *[f"{S.occ(f'lower({RAW})', w)} / 100::DOUBLE" for w in ("article", "product", "search")],
]


def features(name: str, sqls: list[str], build) -> None:
    @check(name, f"{E} SELECT page_id, " + ", ".join(f"{s} AS f{i}" for i, s in enumerate(sqls)) + " FROM p")
    def query(spark, d):
        f = enriched(spark, d).select("page_id", build().alias("f"))
        return f.select("page_id", *[F.col("f")[i].alias(f"f{i}") for i in range(len(sqls))])


features("page_features", FEATURES, lambda: SC.page_features("html", "url2"))
features("page_features_basic", FEATURES_BASIC, lambda: SC.page_features_basic("html", "url2"))


@check(
    "extraction_quality",
    "SELECT source, count(*) AS n, round(avg(least(length(text) / 1000.0, 1.0)), 6) AS quality FROM documents GROUP BY source",
)
def extraction_quality(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(
        F.count("*").alias("n"), F.round(F.avg(SC.extraction_quality("text")), 6).alias("quality")
    )


# --- entities and technology --------------------------------------------------------

HREFS = S.attrs(S.markup(), "a", "href")


def skip(var: str, words) -> str:
    return f"NOT {S.any_of(var, words)}"


# The entity patterns as plain regular expressions.
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
LABEL = r"[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?"
DOMAIN = rf"(?:https?://)?(?:www\.)?({LABEL}(?:\.{LABEL})*)"

EMAILS = arr_sorted(
    f"list_concat({S.tfilter(S.tmap(S.rxall(RAW, EMAIL), 'lower(x)'), skip('x', EN.EMAIL_SKIP))}, "
    + S.tfilter(
        S.tmap(
            S.tfilter(HREFS, "x LIKE 'mailto:%'"), "lower(split_part(replace(x, 'mailto:', ''), '?', 1))"
        ),
        "contains(x, '@')",
    )
    + ")"
)


def cat(parts: list[str]) -> str:
    out = parts[0]
    for p in parts[1:]:
        out = f"list_concat({out}, {p})"
    return out


PHONES = arr_sorted(
    S.tfilter(
        S.tmap(cat([S.rxall(RAW, p) for p in EN.PHONES]), S.strip("x")),
        f"length({S.rm('x', '[^0-9]')}) >= 10",
    )
)
NAMES = S.tfilter(cat([S.rxall(RAW, p, 1) for p in EN.USERNAMES]), "length(x) BETWEEN 2 AND 30")
PROFILES = cat(
    [
        S.tmap(S.tfilter(S.tmap(HREFS, S.rx("x", p)), "x <> ''"), f"'{site}:' || x")
        for site, p in EN.PROFILE_LINKS
    ]
)
USERNAMES = arr_sorted(f"list_concat({NAMES}, {PROFILES})")
TEXT_DOMAINS = S.tfilter(
    S.tmap(S.rxall(RAW, DOMAIN, 1), "lower(x)"), f"contains(x, '.') AND {skip('x', EN.DOMAIN_SKIP)}"
)
OWN = S.rx("url", r"(?s)^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://([^/?#]*))?")
LINK_DOMAINS = S.tfilter(
    S.tmap(HREFS, "lower(" + S.rx("x", r"(?s)^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://([^/?#]*))?") + ")"),
    f"contains(x, '.') AND x <> {OWN}",
)
DOMAINS = arr_sorted(f"list_concat({TEXT_DOMAINS}, {LINK_DOMAINS})")

per_page("extract_emails", EMAILS, lambda: joined(EN.extract_emails("html")))
per_page("extract_phones", PHONES, lambda: joined(EN.extract_phones("html")))
per_page("extract_usernames", USERNAMES, lambda: joined(EN.extract_usernames("html")))
per_page("extract_domains", DOMAINS, lambda: joined(EN.extract_domains("html", "url")))


@check(
    "document_entities",
    f"""SELECT doc_id, {EMAILS.replace(RAW, 'text').replace(HREFS, '[]::VARCHAR[]')} AS emails,
 {PHONES.replace(RAW, 'text')} AS phones FROM documents""",
)
def document_entities(spark, d):
    return table(spark, d, "documents").select(
        "doc_id",
        joined(F.array_sort(F.array_distinct(EN.emails_in("text")))).alias("emails"),
        joined(F.array_sort(F.array_distinct(EN.phones_in("text")))).alias("phones"),
    )


ENTITIES = f"{EMAILS} AS emails, {PHONES} AS phones, {USERNAMES} AS usernames, {DOMAINS} AS domains"


@check("extract_entities", f"{E} SELECT url, {ENTITIES} FROM p")
def extract_entities(spark, d):
    e = F.col("entities")
    return osint.extract_entities(enriched(spark, d)).select(
        "url", *[joined(e[k]).alias(k) for k in ("emails", "phones", "usernames", "domains")]
    )


def names(tests: dict[str, str]) -> str:
    items = ", ".join(f"CASE WHEN {sql} THEN '{n}' END" for n, sql in sorted(tests.items()))
    return f"array_to_string(list_filter([{items}], lambda x: x IS NOT NULL), '|')"


SRCS = S.attrs(S.markup(), "script", "src")
INLINE = S.tfilter(S.rxall(S.rm("html", H.NO_COMMENTS), H.inner("script"), 1), S.strip("x") + " <> ''")
SCRIPTS = f"list_concat({SRCS}, {INLINE})"


def script_hit(lst: str, *patterns: str) -> str:
    tests = " OR ".join(S.like("x", f"(?i){p}") for p in patterns)
    return f"len({S.tfilter(lst, tests)}) > 0"


FRAMEWORKS = names({
    "react": f"{S.any_of('html', ['data-reactroot', 'react-'])} OR {script_hit(SCRIPTS, 'react', '__REACT_DEVTOOLS', 'ReactDOM')}",
    "vue": f"{S.any_of('html', ['v-', 'vue-'])} OR {script_hit(SCRIPTS, 'vue', '__VUE__')}",
    "angular": f"{S.any_of('html', ['ng-'])} OR {script_hit(SCRIPTS, 'angular', 'ng' + chr(92) + '.')}",
    "jquery": script_hit(SCRIPTS, "jquery", r"\$\(\)"),
    "bootstrap": script_hit(SCRIPTS, "bootstrap", "data-bs-", r"\.navbar"),
})


def both(*patterns: str) -> str:
    return "(" + " OR ".join(S.like(c, f"(?i){p}") for p in patterns for c in ("url", "html")) + ")"


CMS = names({
    "wordpress": both("/wp-content/", "/wp-includes/", "wp-json", "WordPress"),
    "drupal": both("/sites/default/", r"Drupal\.settings", r"misc/drupal\.js"),
    "joomla": both("/media/jui/", r"Joomla\.", "/administrator/"),
    "shopify": both(r"shopify\.com", r"Shopify\.themes"),
})
SERVERS = names({s: f"contains(lower(server), '{s}')" for s in T.SERVERS})
LIBRARIES = names({
    "lodash": script_hit(SRCS, "lodash"), "underscore": script_hit(SRCS, "underscore"), "moment": script_hit(SRCS, "moment"),
    "axios": script_hit(SRCS, "axios"), "chart": script_hit(SRCS, r"chart\.js"), "d3": script_hit(SRCS, r"d3\.js"),
    "three": script_hit(SRCS, r"three\.js"),
})
GENERATOR_TAG = S.tfilter(S.tags(S.markup(), "meta"), S.attr("t", "name") + " = 'generator'", "t")
GENERATOR = f"coalesce(lower({S.attr(GENERATOR_TAG + '[1]', 'content')}), '')"


def linked(suffix: str) -> str:
    return f"len({S.tfilter(HREFS, f'ends_with(x, {S.q(suffix)})')}) > 0"


LANGUAGES = names({
    "php": f"contains({GENERATOR}, 'php') OR {linked('.php')} OR (contains(html, '<!--') AND contains(lower(html), 'php'))",
    "python": f"contains({GENERATOR}, 'python')", "ruby": f"contains({GENERATOR}, 'ruby')",
    "asp.net": linked(".aspx"), "java": linked(".jsp"),
})
per_page("detect_servers", SERVERS, lambda: joined(T.detect_servers("headers")))
per_page("detect_frameworks", FRAMEWORKS, lambda: joined(T.detect_frameworks("html")))
per_page("detect_cms", CMS, lambda: joined(T.detect_cms("html", "url")))
per_page("detect_libraries", LIBRARIES, lambda: joined(T.detect_libraries("html")))
per_page("detect_languages_backend", LANGUAGES, lambda: joined(T.detect_languages_backend("html")))
TECH = f"{FRAMEWORKS} AS frameworks, {CMS} AS cms, {SERVERS} AS servers, {LIBRARIES} AS libraries, {LANGUAGES} AS languages"
TECH_KEYS = ("frameworks", "cms", "servers", "libraries", "languages")


@check("detect_tech", f"{E} SELECT url, {TECH} FROM p")
def detect_tech(spark, d):
    t = F.col("tech_stack")
    return osint.detect_tech(enriched(spark, d)).select("url", *[joined(t[k]).alias(k) for k in TECH_KEYS])


@check("osint_report", f"{E} SELECT url, {ENTITIES}, {TECH} FROM p")
def osint_report(spark, d):
    e, t = F.col("entities"), F.col("tech_stack")
    return osint.osint_report(enriched(spark, d)).select(
        "url",
        *[joined(e[k]).alias(k) for k in ("emails", "phones", "usernames", "domains")],
        *[joined(t[k]).alias(k) for k in TECH_KEYS],
    )


@check(
    "osint_summary",
    f"""{E}, r AS (SELECT url, {ENTITIES}, {FRAMEWORKS} AS fw FROM p)
 SELECT url, """
    + ", ".join(
        f"CASE WHEN {k} = '' THEN 0 ELSE len(string_split({k}, '|')) END AS {k}"
        for k in ("emails", "phones", "usernames", "domains")
    )
    + ", replace(fw, '|', ', ') AS frameworks FROM r",
)
def osint_summary(spark, d):
    return osint.osint_summary(osint.osint_report(enriched(spark, d)))


REASON_OF_PAGES = REASON.replace("strlen(html) > 0.005 * 1048576", "false").replace("url2", "url")
GATED = f"g AS (SELECT page_id FROM (SELECT page_id, {REASON_OF_PAGES} AS reason FROM p) WHERE reason IS NULL)"
ROUTE_OF_PAGES = "CASE WHEN ctype = '' THEN 'text' ELSE " + ROUTE.replace("url2", "url") + " END"
TYPED_OF_PAGES = TYPED.replace("url2", "url")


@check(
    "process_pages",
    f"""{E}, {BLOCK_SQL}, {TYPED_OF_PAGES}, {GATED}, r AS (SELECT page_id, {ROUTE_OF_PAGES} AS route FROM p),
 k AS (SELECT source AS url, md5(string_agg(target, '|' ORDER BY target)) AS links FROM ({LINKS}) GROUP BY source),
 b AS (SELECT page_id, {BEST} AS page_type, round(greatest({', '.join(SC.PAGE_TYPES)}) / total, 6) AS type_score FROM z)
 SELECT p.page_id, r.route, CASE WHEN r.route = 'text' THEN {TITLE} END AS title, CASE WHEN r.route = 'text' THEN {WORDS} END AS words,
 CASE WHEN r.route = 'text' THEN md5({VISIBLE}) END AS text, CASE WHEN r.route = 'text' THEN md5((SELECT v FROM main_of WHERE main_of.page_id = p.page_id)) END AS main,
 CASE WHEN r.route = 'text' THEN {DESCRIPTION} END AS description, {arr(LD)} AS jsonld, {OG} AS opengraph, {TW} AS twitter,
 b.page_type, b.type_score, coalesce(k.links, md5('')) AS links
 FROM p JOIN g USING (page_id) JOIN r USING (page_id) JOIN b USING (page_id) LEFT JOIN k ON k.url = p.url""",
)
def process_pages(spark, d):
    out = process.process_pages(enriched(spark, d))
    info, parts = F.col("text_info"), F.col("structured")
    return out.select(
        "page_id",
        "route",
        info["title"].alias("title"),
        info["word_count"].alias("words"),
        F.md5(info["text"].cast("binary")).alias("text"),
        F.md5(info["clean_text"].cast("binary")).alias("main"),
        info["description"].alias("description"),
        joined(parts["jsonld"]).alias("jsonld"),
        map_text(parts["opengraph"]).alias("opengraph"),
        map_text(parts["twitter"]).alias("twitter"),
        "page_type",
        F.round(F.array_max(F.map_values("page_type_scores")), 6).alias("type_score"),
        F.md5(F.array_join(F.sort_array("links"), "|").cast("binary")).alias("links"),
    )


DOMAIN = "regexp_extract(url, '^[^:]*://[^/?#]*')"


@check(
    "process_pages_limits",
    f"""{E}, {GATED}, q AS (SELECT url, min(page_id % 4) AS depth, max(page_id % 5) AS priority FROM p JOIN g USING (page_id) WHERE page_id % 4 <= 2 GROUP BY url),
 c AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY {DOMAIN} ORDER BY depth, priority DESC, url) <= 2),
 m AS (SELECT * FROM c QUALIFY row_number() OVER (ORDER BY depth, priority DESC, url) <= 60)
 SELECT page_id, url, contains(url, 'blog') AS needs_js, CASE WHEN contains(url, 'blog') THEN 'blogs' END AS reason
 FROM p JOIN g USING (page_id) WHERE page_id % 4 <= 2 AND url IN (SELECT url FROM m)""",
)
def process_pages_limits(spark, d):
    rules = [SiteRule(pattern=".*blog", require_js=True, reason="blogs")]
    cfg = process.CrawlConfig(max_depth=2, max_pages_per_domain=2, max_urls=60, enable_js=False, site_rules=rules)
    queued = enriched(spark, d).withColumns({"depth": F.col("page_id") % 4, "priority": F.col("page_id") % 5})
    return process.process_pages(queued, cfg).select("page_id", "url", "needs_js", F.col("rule.reason").alias("reason"))
