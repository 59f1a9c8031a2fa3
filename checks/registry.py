"""Registry of queries, table access, and the enriched page view.

The page table has plain markup: no head links, scripts with sources, images,
structured data or contact links. The enriched view adds such markup to every
page from its id with one SQL text that both engines run, so the operators
meet it at the scale of the table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.session import ensure_checkpoint_dir
from pagewright.sources.readers import spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
# Bytes of page files for a task: minutes of work for the slowest queries.
PAGE_TASK_BYTES = 16 << 20


def check(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name, with its comparison SQL if it has one."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the session's shared checkpoint space."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


HEAD_SQL = """
'<meta name="description" content="Page ' || page_id || ' &amp; more">' ||
'<meta name="Keywords" content="alpha, beta ,k' || (page_id % 7) || '">' ||
'<meta property="og:title" content="OG ' || page_id || '"><meta property="og:type" content="article">' ||
'<meta name="twitter:card" content="summary"><meta name="twitter:site" content="@s' || (page_id % 9) || '">' ||
CASE WHEN page_id % 9 = 0 THEN '<meta http-equiv="Refresh" content="5; url=/next/' || page_id || '">' ELSE '' END ||
CASE WHEN page_id % 4 = 0 THEN '<link rel="canonical" href="/canon/' || page_id || '">' ELSE '' END ||
'<link rel=stylesheet href=/css/' || (page_id % 5) || '.css>' ||
CASE WHEN page_id % 3 = 0 THEN '<script type="application/ld+json">{"@type": "Thing", "@id": "https://ld.example.org/' || page_id || '", "url": "/u/' || page_id || '"}</script>'
     WHEN page_id % 3 = 1 THEN '<script type="application/ld+json">[{"name": "a"}, {"url": "/list/' || page_id || '"}]</script>'
     ELSE '<script type="application/ld+json">{broken ' || page_id || '</script>' END ||
CASE WHEN page_id % 4 = 1 THEN '<script src="/static/jquery-3.6.0.min.js"></script>'
     WHEN page_id % 4 = 2 THEN '<script src="https://cdn.shopify.com/lodash.min.js"></script>'
     WHEN page_id % 4 = 3 THEN '<script src="/js/react.production.js"></script><script src="/js/d3.js"></script>'
     ELSE '' END ||
CASE WHEN page_id % 11 = 5 THEN '<meta name="generator" content="PHP Site 1.0">'
     WHEN page_id % 11 = 6 THEN '<meta name="generator" content="Python Pages">' ELSE '' END ||
'</head>'
"""

TAIL_SQL = """
CASE WHEN page_id % 2 = 1 THEN '<IMG src="/img/' || page_id || '.png" alt="pic" srcset="/img/' || page_id || '-1.png 1x, /img/' || page_id || '-2.png 2x">' ELSE '<img src="plain.gif">' END ||
'<picture><source srcset="/p/' || page_id || '.webp 480w, //img.example.net/q.webp"></picture>' ||
'<a href="mailto:team' || (page_id % 13) || '@Corp' || (page_id % 5) || '.org?subject=hi">mail</a>' ||
'<a href="https://github.com/user' || (page_id % 17) || '/repo">gh</a><a href="https://x.com/tw_' || (page_id % 11) || '">x</a>' ||
'<a href="https://www.linkedin.com/in/person-' || (page_id % 23) || '">in</a><a href="https://instagram.com/in.sta' || (page_id % 7) || '">ig</a>' ||
'<a href="../up/' || page_id || '?b=2&amp;a=1&amp;utm_source=z#frag">rel</a><a href="?q=' || page_id || '">q</a><a href="#frag">f</a><a href="">self</a>' ||
'<a href="//cdn.example.net/x/./y/../z//w/">n</a><a class=plain href=old/page' || (page_id % 6) || '.php>p</a><a href="HTTP://WWW.Example.com:80/A%20b/?z=%C3%A9&y=a+b">abs</a>' ||
'<a href="/deep/../../top.jsp?x=1&x=0&empty=&c=%7e*">d</a><a href=".">dot</a><a href="..">dd</a>' ||
'<script>fetch("/api/v1/items/' || page_id || '"); xhr.open("GET", "rest/data"); var o = { url: "/ajax/' || (page_id % 3) || '", src: "x.js" }; var g = "https://api.example.com/graphql";</script>' ||
'<div class="big product"><div itemscope itemtype="https://schema.org/Product"><span itemprop="name">Thing &lt;' || page_id || '&gt;</span><meta itemprop="sku" content="S' || page_id || '"><a itemprop="link" href="/buy/' || page_id || '">buy</a><time itemprop=when datetime="2024-01-02">Jan</time></div></div>' ||
'<p>Call +1 555 123 ' || (1000 + page_id % 9000) || ' or (555) 987-6543, mail sales' || (page_id % 29) || '@Shop.org or noreply@shop.org, follow @handle' || (page_id % 19) || ' at www.portal' || (page_id % 8) || '.net.</p>' ||
CASE WHEN page_id % 8 = 3 THEN '<p>Page not found. 404 error: it does not exist.</p>' ELSE '' END ||
CASE WHEN page_id % 3 = 0 THEN '<div class="content wrap"><div class="intro">intro ' || page_id || '</div><p>the real body</p><div><div>deep</div> tail<br></div></div>' ELSE '' END ||
CASE WHEN page_id % 4 = 1 THEN '<div class="menu"><div>inner <div class="ad">ad</div> menu</div> end of menu</div><section><nav><nav>twice</nav> outer</nav>kept ' || page_id || '</section>' ELSE '' END ||
CASE WHEN page_id % 7 = 5 THEN '<main><div>first <main>nested main</main></div><aside>beside <aside>more</aside></aside> last words</main>' ELSE '' END ||
CASE WHEN page_id % 6 = 0 THEN '<p>advertisement sponsored advertisement sponsored advertisement sponsored</p>' ELSE '' END ||
CASE WHEN page_id % 5 = 0 THEN '<section id="sidebar">side ' || page_id || '</section><div class="x menu">menu</div>' ELSE '' END ||
CASE WHEN page_id % 5 = 1 THEN '<p>Price $' || page_id || ', add to cart. Published by the author.</p>' ELSE '' END ||
CASE WHEN page_id % 5 = 2 THEN '<h1 class="title">Title ' || page_id || '</h1><span class="byline author-name">Ann ' || page_id || '</span><time datetime="2024-02-03">3 Feb</time>' ELSE '' END ||
CASE WHEN page_id % 7 = 0 THEN '<img src="data:image/png;base64,QUJD' || page_id || '"><a href="blob:https://b.example.org/' || page_id || '">b</a>' ELSE '' END ||
CASE WHEN page_id % 7 = 1 THEN '<div data-reactroot ng-app=x v-bind=y></div><!-- php ' || page_id || ' --><img src="/wp-content/a.png">' ELSE '' END ||
CASE WHEN page_id % 10 = 4 THEN '<aside>Related <b>things</b></aside><form><table><tr><td>1</td></tr></table></form>' ELSE '' END
"""

HTML_SQL = f"replace(html, '</head>', {HEAD_SQL}) || {TAIL_SQL}"
STATUS_SQL = "CASE page_id % 20 WHEN 7 THEN 404 WHEN 9 THEN 410 ELSE 200 END"
CTYPE_SQL = """CASE page_id % 16 WHEN 2 THEN 'application/pdf' WHEN 3 THEN 'image/png' WHEN 4 THEN 'video/mp4'
WHEN 5 THEN 'audio/mpeg' WHEN 6 THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document'
WHEN 7 THEN 'application/zip' WHEN 8 THEN 'application/x-tar' WHEN 9 THEN 'application/epub+zip'
WHEN 10 THEN '' WHEN 11 THEN 'application/octet-stream' ELSE 'text/html; charset=utf-8' END"""
SERVER_SQL = """CASE page_id % 5 WHEN 0 THEN 'nginx/1.25' WHEN 1 THEN 'Apache/2.4' WHEN 2 THEN 'cloudflare'
WHEN 3 THEN 'CloudFront' ELSE 'gws' END"""
# URLs with the marks of crawler traps and of page classes.
URL_SQL = """regexp_replace(url, '#.*', '') || CASE page_id % 24
WHEN 1 THEN '/2024/01/15/' WHEN 2 THEN '&sessionid=' || repeat('a', 24) WHEN 3 THEN '&sid=abc123'
WHEN 4 THEN '/' || repeat('b', 500) WHEN 5 THEN '&page=' || (95 + page_id % 10)
WHEN 6 THEN '?a=1&b=2&c=3&d=4&e=5&f=6&g=7&h=8&i=9&j=10&k=11' WHEN 7 THEN '/archive/2024/x' WHEN 8 THEN '?page=0100'
WHEN 9 THEN '/news/x' WHEN 10 THEN '/Blog/y' WHEN 11 THEN '/product/' || page_id WHEN 12 THEN '/docs/guide/z'
WHEN 13 THEN '/category/' WHEN 14 THEN '/index.html' WHEN 15 THEN '/search?query=1' WHEN 16 THEN '/about/us'
WHEN 17 THEN '/item/1?sid=' || repeat('Z', 21) WHEN 18 THEN ';v=1?utm_campaign=c&b=2&a=1&a=0' WHEN 19 THEN '//x///y/'
WHEN 20 THEN '?q=a+b%20c&lang=%C3%A9&blank=&flag#top' WHEN 21 THEN '/files/a.zip' WHEN 22 THEN '/spa/' WHEN 23 THEN '/p/article/1'
ELSE '' END"""

ENRICHED_SQL = (
    f"SELECT page_id, url, {URL_SQL} AS url2, {HTML_SQL} AS html, {STATUS_SQL} AS status_code, "
    f"{CTYPE_SQL} AS ctype, {SERVER_SQL} AS server FROM pages"
)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/pages.parquet"), PAGE_TASK_BYTES)


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, url2, html, status_code, ctype, server and headers."""
    return (
        pages(spark, sf_dir)
        .selectExpr(
            "page_id",
            "url",
            f"{URL_SQL} AS url2",
            f"{HTML_SQL} AS html",
            f"{STATUS_SQL} AS status_code",
            f"{CTYPE_SQL} AS ctype",
            f"{SERVER_SQL} AS server",
        )
        .withColumn(
            "headers",
            F.create_map(F.lit("Content-Type"), F.col("ctype"), F.lit("Server"), F.col("server")),
        )
        .withColumn("content", F.encode("html", "UTF-8"))
    )


def joined(column: Column) -> Column:
    """Array shown as one string, so both engines compare plain values."""
    return F.array_join(column, "|")


def map_text(column: Column) -> Column:
    """Map shown as sorted ``k=v`` pairs."""
    entries = F.array_sort(F.map_entries(column))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")
