"""Similarity, graph, frontier, storage and streaming queries."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from checks import sqlkit as S
from checks.registry import check, enriched, joined, pages, scratch, table
from checks.page_checks import DESCRIPTION, TITLE, VISIBLE, WORDS
from checks.url_checks import LINKS, OSINT, PRIORITY, follow_sql
from pagewright.functions import fingerprints as FP
from pagewright.functions import scoring as SC
from pagewright.operators import frontier as FR
from pagewright.operators import graph as G
from pagewright.operators import links as L
from pagewright.operators import similarity as D
from pagewright.plans import classifier, plugins, process, steps
from pagewright.session import cut_lineage
from pagewright.sources import readers, records, state, writers
from pagewright.streaming import streams as R

E = S.E


def docs(spark, d):
    return table(spark, d, "documents")


# --- similarity ------------------------------------------------------------------


@check(
    "content_hash_dedup",
    """SELECT doc_id, source AS url, sha256(text) AS content_hash,
 first_value(source) OVER w AS first_url, first_value(doc_id) OVER w = doc_id AS is_unique
 FROM documents WINDOW w AS (PARTITION BY text ORDER BY doc_id)""",
)
def content_hash_dedup(spark, d):
    return D.content_hash_dedup(
        docs(spark, d).select("doc_id", F.col("source").alias("url"), F.encode("text", "UTF-8").alias("content")), "doc_id"
    )


CLEAN = "regexp_replace(lower(text), '[^\\p{L}\\p{N}_]+', '', 'g')"
# Shingles by four non-overlapping passes; every distinct one is hashed once.
PASSES = "list_concat(list_concat(regexp_extract_all(t, '(?s).{4}'), regexp_extract_all(t[2:], '(?s).{4}')), list_concat(regexp_extract_all(t[3:], '(?s).{4}'), regexp_extract_all(t[4:], '(?s).{4}')))"


def vote(word: str, i: int) -> str:
    return f"sum(CASE WHEN ({word} >> {i}) & 1 = 1 THEN k ELSE -k END) AS {word[0]}{i}"


SIM = f"""c AS (SELECT doc_id, {CLEAN} AS t FROM documents),
 sh AS (SELECT doc_id, s, count(*) AS k FROM (SELECT doc_id, unnest(CASE WHEN length(t) < 4 THEN [t] ELSE {PASSES} END) AS s FROM c) GROUP BY ALL),
 hx AS (SELECT s, ('0x' || md5(s)[17:24])::BIGINT AS hi, ('0x' || md5(s)[25:32])::BIGINT AS lo FROM (SELECT DISTINCT s FROM sh)),
 v AS (SELECT doc_id, {', '.join(vote(w, i) for w in ('lo', 'hi') for i in range(32))} FROM sh JOIN hx USING (s) GROUP BY doc_id),
 sim AS (SELECT doc_id, ({' + '.join(f'CASE WHEN l{i} > 0 THEN {1 << i}::BIGINT ELSE 0 END' for i in range(32))}) AS lo,
  ({' + '.join(f'CASE WHEN h{i} > 0 THEN {1 << i}::BIGINT ELSE 0 END' for i in range(32))}) AS hi FROM v)"""


@check("simhash", f"WITH {SIM} SELECT doc_id, hi, lo FROM sim")
def simhash(spark, d):
    h = D.simhash(docs(spark, d), "doc_id")
    return h.select(
        "doc_id",
        F.shiftrightunsigned("simhash", 32).alias("hi"),
        F.col("simhash").bitwiseAND(F.lit(0xFFFFFFFF)).alias("lo"),
    )


PARAMS = FP.permutation_params()
MINHASH = f"""tok AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '\\S+')) AS w FROM documents),
 base AS (SELECT doc_id, ('0x' || md5(w)[1:8])::BIGINT & {FP.PRIME} AS h FROM tok),
 mh AS (SELECT doc_id, {', '.join(f'min(({a} * h + {b}) % {FP.PRIME}) AS m{i}' for i, (a, b) in enumerate(PARAMS))} FROM base GROUP BY doc_id)"""
ALL_M = "[" + ", ".join(f"m{i}" for i in range(FP.PERMUTATIONS)) + "]"


@check("minhash", f"WITH {MINHASH} SELECT doc_id, array_to_string({ALL_M}, ',') AS sig FROM mh")
def minhash(spark, d):
    return D.minhash(docs(spark, d), "doc_id").select("doc_id", F.array_join("minhash", ",").alias("sig"))


PAIRED = f"""{SIM}, n AS (SELECT hi, lo, min(doc_id) AS f FROM sim GROUP BY ALL),
 pr AS (SELECT least(a.f, b.f) AS id_a, greatest(a.f, b.f) AS id_b,
  1 - (bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo))) / 64.0::DOUBLE AS similarity FROM n a JOIN n b ON a.f < b.f)"""


@check(
    "hamming_similarity",
    f"""WITH {SIM}, o AS (SELECT doc_id, hi, lo, lag(hi) OVER w AS phi, lag(lo) OVER w AS plo FROM sim WINDOW w AS (ORDER BY doc_id)),
 s AS (SELECT doc_id, 1 - (bit_count(xor(hi, phi)) + bit_count(xor(lo, plo))) / 64.0::DOUBLE AS similarity FROM o WHERE phi IS NOT NULL)
 SELECT doc_id, similarity, similarity < 0.9 AS different FROM s""",
)
def hamming_similarity(spark, d):
    # Every document against the one before it: ids are dense, so the pairs are an equi-join.
    h = D.simhash(docs(spark, d), "doc_id")
    before = h.select((F.col("doc_id") + 1).alias("doc_id"), F.col("simhash").alias("prev"))
    return h.join(before, "doc_id").select(
        "doc_id",
        D.hamming_similarity("simhash", "prev").alias("similarity"),
        D.meaningfully_different("simhash", "prev").alias("different"),
    )


@check("meaningfully_different", f"WITH {PAIRED} SELECT count(*) AS pairs FROM pr WHERE NOT similarity < 0.9")
def meaningfully_different(spark, d):
    h = D.simhash(docs(spark, d), "doc_id")
    close = D.hamming_pairs(h.select("simhash").distinct(), D.max_distance(0.9))
    return close.filter(~D.meaningfully_different("a", "b")).agg(F.count("*").alias("pairs"))


@check("simhash_pairs", f"WITH {PAIRED} SELECT * FROM pr WHERE similarity >= 0.9")
def simhash_pairs(spark, d):
    return D.simhash_pairs(D.simhash(docs(spark, d), "doc_id"), "doc_id", 0.9)


@check("site_duplicates", f"WITH {PAIRED} SELECT * FROM pr WHERE similarity >= 0.8")
def site_duplicates(spark, d):
    return D.simhash_pairs(D.simhash(docs(spark, d), "doc_id"), "doc_id", 0.8)


@check(
    "fingerprint_groups",
    f"WITH {SIM} SELECT doc_id, min(doc_id) OVER w AS first, count(*) OVER w AS copies FROM sim WINDOW w AS (PARTITION BY hi, lo)",
)
def fingerprint_groups(spark, d):
    return D.fingerprint_groups(D.simhash(docs(spark, d), "doc_id"), "doc_id").drop("simhash")


BANDS = " UNION ALL ".join(
    f"SELECT doc_id, {b} AS band, "
    + " || ',' || ".join(f"m{i}" for i in range(b * D.BAND_ROWS, (b + 1) * D.BAND_ROWS))
    + " AS bucket FROM sg"
    for b in range(D.BANDS)
)
EQUAL = f"({' + '.join(f'(x.m{i} = y.m{i})::INT' for i in range(FP.PERMUTATIONS))}) / 128.0::DOUBLE"
LSH = f"""{MINHASH}, sg AS (SELECT min(doc_id) AS doc_id, * EXCLUDE (doc_id) FROM mh GROUP BY ALL), bk AS ({BANDS}),
 c AS (SELECT DISTINCT a.doc_id AS id_a, b.doc_id AS id_b FROM bk a JOIN bk b ON a.band = b.band AND a.bucket = b.bucket AND a.doc_id < b.doc_id),
 jv AS (SELECT id_a, id_b, {EQUAL} AS jaccard FROM c JOIN mh x ON x.doc_id = c.id_a JOIN mh y ON y.doc_id = c.id_b)"""


@check("minhash_lsh_pairs", f"WITH {LSH} SELECT id_a, id_b FROM jv WHERE jaccard >= 0.8")
def minhash_lsh_pairs(spark, d):
    return D.minhash_lsh_pairs(D.minhash(docs(spark, d), "doc_id"), "doc_id")


@check("jaccard_verify", f"WITH {LSH} SELECT * FROM jv WHERE jaccard >= 0.8")
def jaccard_verify(spark, d):
    sig = D.minhash(docs(spark, d), "doc_id")
    return D.jaccard_verify(D.minhash_lsh_pairs(sig, "doc_id"), sig, "doc_id")


@check(
    "signature_groups",
    f"WITH {MINHASH} SELECT doc_id, min(doc_id) OVER w AS first, count(*) OVER w AS copies FROM mh WINDOW w AS (PARTITION BY {ALL_M})",
)
def signature_groups(spark, d):
    return D.signature_groups(D.minhash(docs(spark, d), "doc_id"), "doc_id")


# Kept rows are carried along the documents in order, one at a time.
BAND_TEXTS = ", ".join(
    f"'{b}:' || array_to_string(m[{b * D.BAND_ROWS + 1}:{(b + 1) * D.BAND_ROWS}], ',')" for b in range(D.BANDS)
)
KEPT = "STRUCT(d BIGINT, hi BIGINT, lo BIGINT, b VARCHAR[])"


def first_wins(distance: int, bands: str = "[]::VARCHAR[]") -> str:
    far = "bit_count(xor(k.hi, o.hi)) + bit_count(xor(k.lo, o.lo))"
    return f"""o AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id) AS i, doc_id, hi, lo, {bands} AS b FROM sim LEFT JOIN mm USING (doc_id)),
 r AS (SELECT 0::BIGINT AS i, []::{KEPT}[] AS kept UNION ALL
  SELECT o.i, CASE WHEN len(list_filter(r.kept, lambda k: {far} <= {distance} OR list_has_any(k.b, o.b))) = 0
   THEN list_append(r.kept, {{'d': o.doc_id, 'hi': o.hi, 'lo': o.lo, 'b': o.b}}) ELSE r.kept END FROM r JOIN o ON o.i = r.i + 1),
 fw AS (SELECT k.d, k.hi, k.lo FROM (SELECT unnest(kept) AS k FROM (SELECT kept FROM r ORDER BY i DESC LIMIT 1)))"""


@check(
    "near_duplicates",
    f"""WITH RECURSIVE {SIM}, {MINHASH}, mm AS (SELECT doc_id, {ALL_M} AS m FROM mh),
 {first_wins(D.max_distance(D.DUPLICATE_THRESHOLD), f"CASE WHEN m IS NULL THEN []::VARCHAR[] ELSE [{BAND_TEXTS}] END")}
 SELECT d AS doc_id FROM fw""",
)
def near_duplicates(spark, d):
    return D.near_duplicates(D.signatures(docs(spark, d), "doc_id"), "doc_id")


CLUSTERS = f"""WITH RECURSIVE {SIM}, mm AS (SELECT doc_id FROM sim), {first_wins(D.max_distance(D.CLUSTER_THRESHOLD))},
 lc AS (SELECT *, row_number() OVER (ORDER BY d) - 1 AS cluster FROM fw),
 cl AS (SELECT doc_id, (CASE WHEN s.hi >= 2147483648 THEN s.hi - 4294967296 ELSE s.hi END) * 4294967296 + s.lo AS simhash, lc.d AS leader, cluster
  FROM sim s JOIN lc ON lc.d <= s.doc_id AND bit_count(xor(s.hi, lc.hi)) + bit_count(xor(s.lo, lc.lo)) <= {D.max_distance(D.CLUSTER_THRESHOLD)}
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY bit_count(xor(s.hi, lc.hi)) + bit_count(xor(s.lo, lc.lo)), lc.d) = 1)"""


@check("leader_clusters", f"{CLUSTERS} SELECT doc_id, simhash, leader, cluster FROM cl")
def leader_clusters(spark, d):
    return D.leader_clusters(D.simhash(docs(spark, d), "doc_id"), "doc_id")


@check("cluster_members", f"{CLUSTERS} SELECT cluster, doc_id FROM cl")
def cluster_members(spark, d):
    return D.cluster_members(D.leader_clusters(D.simhash(docs(spark, d), "doc_id"), "doc_id"), "doc_id")


@check("cluster_sizes", f"{CLUSTERS} SELECT cluster, count(*) AS size FROM cl GROUP BY cluster")
def cluster_sizes(spark, d):
    return D.cluster_sizes(D.leader_clusters(D.simhash(docs(spark, d), "doc_id"), "doc_id"))


# --- graph -------------------------------------------------------------------------


def graph(spark, d):
    return G.osint_graph(enriched(spark, d))


GRAPH = f"e AS (SELECT DISTINCT source, target FROM ({OSINT})), n AS (SELECT url FROM p UNION SELECT source FROM e UNION SELECT target FROM e)"


@check(
    "site_graph",
    f"""{E}, l AS ({LINKS}), n AS (SELECT url, arg_max(status_code, page_id) AS metadata FROM p GROUP BY url)
 SELECT 'node' AS kind, url AS a, metadata::VARCHAR AS b FROM n UNION ALL SELECT 'edge', source, target FROM l""",
)
def site_graph(spark, d):
    p = enriched(spark, d).withColumn("metadata", F.col("status_code").cast("string"))
    nodes, edges = G.site_graph(p, L.extract_links(p))
    return nodes.select(F.lit("node").alias("kind"), F.col("url").alias("a"), F.col("metadata").alias("b")).unionByName(
        edges.distinct().select(F.lit("edge").alias("kind"), F.col("source").alias("a"), F.col("target").alias("b"))
    )


@check("osint_graph", f"{E}, {GRAPH} SELECT url AS a, NULL AS b FROM n UNION ALL SELECT source, target FROM e")
def osint_graph(spark, d):
    nodes, edges = graph(spark, d)
    return nodes.select(F.col("url").alias("a"), F.lit(None).cast("string").alias("b")).union(
        edges.select("source", "target")
    )


@check(
    "graph_metrics",
    f"""{E}, {GRAPH} SELECT (SELECT count(*) FROM n) AS num_nodes, (SELECT count(*) FROM e) AS num_edges,
 2.0::DOUBLE * (SELECT count(*) FROM e) / (SELECT count(*) FROM n) AS avg_degree""",
)
def graph_metrics(spark, d):
    return G.graph_metrics(*graph(spark, d))


@check(
    "inlink_score",
    f"""{E}, {GRAPH}, c AS (SELECT target, count(*) AS k FROM e GROUP BY target)
 SELECT url, coalesce(k, 0) AS inlinks, round(coalesce(k, 0) / (SELECT count(*) FROM n)::DOUBLE, 9) AS score
 FROM n LEFT JOIN c ON c.target = n.url""",
)
def inlink_score(spark, d):
    return G.inlink_score(*graph(spark, d)).withColumn("score", F.round("score", 9))


RANK_STEP = """r{k} AS (SELECT v.url, v.deg, 0.15::DOUBLE / c.n + 0.85::DOUBLE * (coalesce(g.got, 0) + s.lost / c.n) AS rank
 FROM v CROSS JOIN (SELECT count(*) AS n FROM n) c CROSS JOIN (SELECT coalesce(sum(rank), 0) AS lost FROM r{j} WHERE deg = 0) s
 LEFT JOIN (SELECT e.target, sum(r.rank / r.deg) AS got FROM e JOIN r{j} r ON r.url = e.source GROUP BY e.target) g ON g.target = v.url)"""


@check(
    "pagerank",
    f"""{E}, {GRAPH}, v AS (SELECT n.url, coalesce(d.deg, 0) AS deg FROM n LEFT JOIN (SELECT source, count(*) AS deg FROM e GROUP BY source) d ON d.source = n.url),
 r0 AS (SELECT url, deg, 1.0::DOUBLE / (SELECT count(*) FROM n) AS rank FROM v), """
    + ", ".join(RANK_STEP.format(k=k, j=k - 1) for k in range(1, 11))
    + " SELECT url, round(rank, 9) AS rank FROM r10",
)
def pagerank(spark, d):
    return G.pagerank(*graph(spark, d)).withColumn("rank", F.round("rank", 9))


# Weak components of the page link graph: every node takes the least name it can reach.
COMPONENTS = f"""{GRAPH}, b AS (SELECT source AS x, target AS y FROM e UNION SELECT target, source FROM e),
 reach AS (SELECT url, url AS c FROM n UNION SELECT reach.url, b.y FROM reach JOIN b ON b.x = reach.c),
 comp AS (SELECT url, min(c) AS component FROM reach GROUP BY url)"""
RECURSIVE = E.replace("WITH p", "WITH RECURSIVE p", 1)


@check("connected_components", f"{RECURSIVE}, {COMPONENTS} SELECT url, component FROM comp")
def connected_components(spark, d):
    return G.connected_components(*graph(spark, d))


@check(
    "graph_statistics",
    f"""{RECURSIVE}, {COMPONENTS}, k AS (SELECT (SELECT count(*) FROM n) AS nn, (SELECT count(*) FROM e) AS ee, (SELECT count(DISTINCT component) FROM comp) AS cc)
 SELECT nn AS nodes, ee AS edges, round(ee / (nn * (nn - 1))::DOUBLE, 9) AS density, cc = 1 AS is_connected, cc AS components FROM k""",
)
def graph_statistics(spark, d):
    return G.graph_statistics(*graph(spark, d)).withColumn("density", F.round("density", 9))


def json_line(*fields: tuple[str, str]) -> str:
    return "'{' || " + " || ',' || ".join(f"'\"{k}\":' || to_json({v})::VARCHAR" for k, v in fields) + " || '}'"


@check(
    "graph_json",
    f"{E}, {GRAPH} SELECT {json_line(('id', 'url'))} AS value FROM n UNION ALL SELECT {json_line(('source', 'source'), ('target', 'target'))} FROM e",
)
def graph_json(spark, d):
    nodes, edges = graph(spark, d)
    path = scratch(spark, "graph-json")
    writers.write_graph_json(nodes, edges, path)
    return spark.read.text([f"{path}/nodes", f"{path}/edges"])


def xml(expr: str) -> str:
    for char, name in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")]:
        expr = f"replace({expr}, '{char}', '{name}')"
    return expr


@check(
    "graph_graphml",
    f"""{E}, {GRAPH} SELECT '    <node id="' || {xml('url')} || '"/>' AS value FROM n
 UNION ALL SELECT '    <edge source="' || {xml('source')} || '" target="' || {xml('target')} || '"/>' FROM e
 UNION ALL SELECT unnest([{', '.join(S.q(x) for x in writers.GRAPHML_HEAD + writers.GRAPHML_TAIL)}])""",
)
def graph_graphml(spark, d):
    path = scratch(spark, "graphml")
    writers.write_graphml(*graph(spark, d), path)
    return spark.read.text(path)


@check("graph_csv", f"{E}, {GRAPH} SELECT source, target FROM e")
def graph_csv(spark, d):
    path = scratch(spark, "graph-csv")
    writers.write_graph_csv(graph(spark, d)[1], path)
    return spark.read.schema("source STRING, target STRING").option("header", True).csv(path)


# --- frontier ------------------------------------------------------------------------


def seeds_sql() -> str:
    return "SELECT DISTINCT url FROM pages"


@check("seed_frontier", "SELECT DISTINCT url, 0 AS depth, 1.0::DOUBLE AS priority FROM pages")
def seed_frontier(spark, d):
    return FR.seed_frontier(pages(spark, d))


HOST = "regexp_extract({}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://([^/?#]*))?', 1)"
SCOPED = f"""SELECT source, target FROM ({LINKS}) WHERE {follow_sql(HOST.format('source'), HOST.format('target'))}"""


# The first page of every host is a seed; waves follow the in-scope links of pages.
SEED_HOST = "regexp_extract(url, '://([^/?#]*)', 1)"
SEEDS = f"SELECT min(url) AS url FROM pages GROUP BY {SEED_HOST}"
SCOPED_LINKS = f"l AS (SELECT DISTINCT source, target FROM ({SCOPED}))"


def scoped_links(spark, d):
    return FR.scope_filter(L.extract_links(enriched(spark, d)).select("source", "target"))


def host_seeds(spark, d):
    return pages(spark, d).groupBy(F.expr(SEED_HOST).alias("host")).agg(F.min("url").alias("url")).select("url")


@check(
    "crawl_waves",
    f"""{RECURSIVE}, {SCOPED_LINKS}, r AS (SELECT url, 0 AS depth FROM ({SEEDS})
 UNION SELECT l.target, r.depth + 1 FROM r JOIN l ON l.source = r.url WHERE r.depth < 3)
 SELECT url, min(depth) AS depth FROM r GROUP BY url""",
)
def crawl_waves(spark, d):
    return FR.crawl_waves(scoped_links(spark, d), host_seeds(spark, d), max_depth=3)


@check(
    "crawl_waves_exhaustive",
    f"{RECURSIVE}, {SCOPED_LINKS}, r AS (SELECT url FROM ({SEEDS}) UNION SELECT l.target FROM r JOIN l ON l.source = r.url) SELECT url FROM r",
)
def crawl_waves_exhaustive(spark, d):
    return FR.crawl_waves(scoped_links(spark, d), host_seeds(spark, d)).select("url")


@check("scope_filter", f"{E} {SCOPED}")
def scope_filter(spark, d):
    return FR.scope_filter(L.extract_links(enriched(spark, d)).select("source", "target")).distinct()


@check("visited_filter", f"{E} SELECT target AS url FROM (SELECT DISTINCT target FROM ({OSINT})) WHERE target NOT IN (SELECT url FROM p)")
def visited_filter(spark, d):
    p = enriched(spark, d)
    return FR.visited_filter(L.osint_links(p).select(F.col("target").alias("url")).distinct(), p)


FRONT = f"SELECT page_id, url2 AS url, page_id % 4 AS depth, round({PRIORITY}, 9) AS priority FROM ({S.with_parts('SELECT page_id, url2 FROM p', 'url2')})"


def front(spark, d):
    from pagewright.functions.urls import url_priority

    return enriched(spark, d).select(
        "page_id", F.col("url2").alias("url"), (F.col("page_id") % 4).alias("depth"),
        F.round(url_priority("url2"), 9).alias("priority"),
    )


@check(
    "domain_cap",
    f"""{E}, f AS ({FRONT}), r AS (SELECT *, {HOST.format('url')} AS h,
 row_number() OVER (PARTITION BY regexp_extract(url, '^[^/]*//[^/?#]*') ORDER BY depth, priority DESC, url) AS rn FROM f)
 SELECT page_id, url FROM r WHERE rn <= 3""",
)
def domain_cap(spark, d):
    return FR.domain_cap(front(spark, d), 3).select("page_id", "url")


@check("max_urls", f"{E}, f AS ({FRONT}) SELECT url, depth FROM f ORDER BY depth, priority DESC, url LIMIT 40")
def max_urls(spark, d):
    return FR.max_urls(front(spark, d), 40).select("url", "depth")


@check("next_batch", f"{E}, f AS ({FRONT}) SELECT url, priority FROM f ORDER BY priority DESC, url LIMIT 25")
def next_batch(spark, d):
    return FR.next_batch(front(spark, d), 25).select("url", "priority")


@check(
    "enqueue",
    f"""{E}, l AS (SELECT target AS url2, min(p.page_id % 4) + 1 AS depth FROM ({SCOPED}) s JOIN p ON p.url = s.source GROUP BY target)
 SELECT url2 AS url, depth, round({PRIORITY}, 9) AS priority FROM ({S.with_parts('SELECT * FROM l', 'url2')})""",
)
def enqueue(spark, d):
    p = enriched(spark, d)
    links = p.select(
        F.col("url").alias("source"), (F.col("page_id") % 4).alias("depth"), F.explode(L.link_targets()).alias("target")
    )
    return FR.enqueue(links).withColumn("priority", F.round("priority", 9))


@check(
    "crawl_stats",
    """SELECT count(*) AS processed, sum((event_type IN ('view', 'click'))::INT) AS success,
 sum((event_type = 'error')::INT) AS errors, sum(octet_length(encode(props))) AS bytes_downloaded FROM events""",
)
def crawl_stats(spark, d):
    status = F.when(F.col("event_type") == "error", "error").when(
        F.col("event_type").isin("view", "click"), "success"
    ).otherwise("skipped")
    outcomes = table(spark, d, "events").select(status.alias("status"), F.octet_length("props").alias("bytes"))
    return FR.crawl_stats(outcomes)


@check(
    "frontier_status",
    f"""{E}, t AS (SELECT DISTINCT target AS url FROM ({OSINT})) SELECT (SELECT count(*) FROM t) AS queued,
 (SELECT count(*) FROM t WHERE url NOT IN (SELECT url FROM pages)) AS pending,
 (SELECT count(*) FROM pages WHERE lower(url) LIKE '%/en/%') AS in_progress, (SELECT count(*) FROM pages) AS visited,
 (SELECT count(*) FROM pages) AS processed""",
)
def frontier_status(spark, d):
    p = enriched(spark, d)
    queued = L.osint_links(p).select(F.col("target").alias("url")).distinct()
    return FR.frontier_status(queued, p.filter(F.lower("url").contains("/en/")), p.select("url"), p)


# --- storage ---------------------------------------------------------------------------


def stored(spark, d):
    p = process.extract_text(enriched(spark, d))
    return p.select(
        "url",
        F.struct(F.col("text_info").alias("text")).alias("content"),
        F.struct(F.array(F.lit("{}")).alias("jsonld")).alias("metadata"),
        F.lit("2024-01-01T00:00:00").alias("timestamp"),
    )


@check(
    "crawl_store",
    f"{E} SELECT url, {TITLE} AS title, {WORDS} AS words, md5({VISIBLE}) AS text, {DESCRIPTION} AS description, "
    "'{}' AS jsonld, '2024-01-01T00:00:00' AS at FROM p",
)
def crawl_store(spark, d):
    path = scratch(spark, "store")
    writers.write_crawl_store(stored(spark, d), path)
    return readers.read_crawl_store(spark, path).select(
        "url",
        F.col("content.text.title").alias("title"),
        F.col("content.text.word_count").alias("words"),
        F.md5(F.col("content.text.text").cast("binary")).alias("text"),
        F.col("content.text.description").alias("description"),
        F.array_join("metadata.jsonld", "|").alias("jsonld"),
        F.col("timestamp").alias("at"),
    )


@check("stored_path", "SELECT url, sha256(url)[1:2] || '/' || sha256(url)[3:4] || '/' || sha256(url) || '.json' AS path FROM pages")
def stored_path(spark, d):
    return pages(spark, d).select("url", writers.stored_path("url").alias("path"))


@check("write_jsonl", "SELECT doc_id, text, lang FROM documents")
def write_jsonl(spark, d):
    path = scratch(spark, "jsonl")
    writers.write_jsonl(docs(spark, d).select("doc_id", "text", "lang"), path)
    return spark.read.schema("doc_id BIGINT, text STRING, lang STRING").json(path)


@check("write_parquet", "SELECT doc_id, text, lang FROM documents")
def write_parquet(spark, d):
    path = scratch(spark, "parquet")
    writers.write_parquet(docs(spark, d).select("doc_id", "text", "lang"), path)
    return spark.read.schema("doc_id BIGINT, text STRING, lang STRING").parquet(path)


UPSERTS = """SELECT user_id, event_id, ts, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1"""


def event_rows(spark, d):
    return table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")


@check("upsert_latest", UPSERTS)
def upsert_latest(spark, d):
    rows = event_rows(spark, d)
    old, new = rows.filter("event_type IN ('view', 'click')"), rows.filter("event_type NOT IN ('view', 'click')")
    return records.upsert_latest(old, new, "user_id", "ts")


TRIMMED = S.strip("text")


@check(
    "collect_text",
    f"""SELECT conv_id, turn // 1000 AS part, string_agg({TRIMMED}, chr(10) || chr(10) ORDER BY turn) AS text
 FROM conversations WHERE coalesce(text, '') <> '' GROUP BY ALL""",
)
def collect_text(spark, d):
    return records.collect_text(table(spark, d, "conversations"), "conv_id", "turn")


@check("vector_table", "SELECT vec_id::VARCHAR AS id, '{\"vec_id\":' || vec_id || ',\"label\":' || label || '}' AS document, 'vec_id=' || vec_id AS metadata, len(embedding) AS dims FROM embeddings")
def vector_table(spark, d):
    v = table(spark, d, "embeddings")
    out = records.vector_table(v.select("vec_id", "label"), v, "vec_id")
    return out.select(
        "id", "document", F.concat(F.lit("vec_id="), F.col("metadata")["vec_id"]).alias("metadata"), F.size("embedding").alias("dims")
    )


@check(
    "knn_l2",
    """WITH x AS (SELECT a.vec_id AS query_id, b.vec_id,
  list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))) AS distance
  FROM embeddings a CROSS JOIN embeddings b),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM x)
 SELECT query_id, vec_id, rank, round(distance, 6) AS distance FROM r WHERE rank <= 5""",
)
def knn_l2(spark, d):
    v = table(spark, d, "embeddings")
    return records.knn_l2(v, v, 5).withColumn("distance", F.round("distance", 6))


def _zip_pages(batches):
    for batch in batches:
        # Archives go out in small batches, not all of a batch of pages at once.
        rows, size = [], 0
        for page_id, url, html in zip(batch["page_id"], batch["url"], batch["html"]):
            box = io.BytesIO()
            with zipfile.ZipFile(box, "w") as z:
                z.writestr("a/page.html", html)
                z.writestr("b.bin", b"\x00\x01")
                z.writestr("c.txt", url)
            rows.append((f"p{page_id}.zip", box.getvalue()))
            rows.append((f"p{page_id}.broken.zip", b"PK\x03\x04 no archive"))
            size += box.tell()
            if size >= readers.BATCH_CHARS:
                yield pd.DataFrame(rows, columns=["path", "content"])
                rows, size = [], 0
        yield pd.DataFrame(rows, columns=["path", "content"])


def members(spark, d):
    files = pages(spark, d).mapInPandas(_zip_pages, "path string, content binary")
    return readers.explode_archive(files)


@check(
    "explode_archive",
    """SELECT 'p' || page_id || '.zip' AS path, 'zip' AS kind, 0 AS ordinal, 'a/page.html' AS member, md5(html) AS text FROM pages
 UNION ALL SELECT 'p' || page_id || '.zip', 'zip', 1, 'c.txt', md5(url) FROM pages""",
)
def explode_archive(spark, d):
    return members(spark, d).withColumn("text", F.md5(F.col("text").cast("binary")))


@check("archive_text", "SELECT 'p' || page_id || '.zip' AS path, md5(html || chr(10) || chr(10) || url || chr(10) || chr(10)) AS text FROM pages")
def archive_text(spark, d):
    return readers.archive_text(members(spark, d)).withColumn("text", F.md5(F.col("text").cast("binary")))


@check(
    "chunk_binary",
    """SELECT page_id, i AS chunk, least(1000, strlen(html) - i * 1000) AS n FROM pages,
 LATERAL (SELECT unnest(range(0, (strlen(html) + 999) // 1000)) AS i)""",
)
def chunk_binary(spark, d):
    p = pages(spark, d).select("page_id", F.encode("html", "UTF-8").alias("content"))
    return readers.chunk_binary(p, size=1000).select("page_id", "chunk", F.octet_length("piece").alias("n"))


@check(
    "media_profile",
    f"""{E} SELECT url, split_part(ctype, '/', 1) AS media, strlen(html) + 8 AS size, ctype AS content_type,
 CASE WHEN ctype = 'image/png' THEN 'PNG' END AS format FROM p WHERE split_part(ctype, '/', 1) IN ('image', 'video', 'audio')""",
)
def media_profile(spark, d):
    # The body is the page behind the signature of an image file.
    magic = F.unhex(F.lit("89504E470D0A1A0A"))
    p = enriched(spark, d).withColumn("content", F.concat(magic, F.encode("html", "UTF-8")))
    return records.media_profile(p)


@check(
    "json_profile",
    """WITH j AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '[' || props || ']' WHEN 1 THEN props || '}' ELSE props END AS v FROM events)
 SELECT event_id, CASE WHEN NOT json_valid(v) THEN NULL WHEN json_type(v) = 'ARRAY' THEN 'list' ELSE 'dict' END AS type,
 CASE WHEN json_valid(v) THEN coalesce(array_to_string(CASE WHEN json_type(v) = 'OBJECT' THEN json_keys(v) ELSE []::VARCHAR[] END, '|'), '') END AS keys,
 CASE WHEN json_valid(v) THEN v[1:500] END AS sample FROM j""",
)
def json_profile(spark, d):
    v = F.expr("CASE event_id % 4 WHEN 0 THEN '[' || props || ']' WHEN 1 THEN props || '}' ELSE props END")
    p = table(spark, d, "events").select("event_id", records.json_profile(v).alias("j"))
    return p.select("event_id", F.col("j.type").alias("type"), joined(F.col("j.keys")).alias("keys"), F.col("j.sample").alias("sample"))


@check(
    "export_records",
    f"{E} SELECT url, status_code, md5({S.visible()}) AS text, ctype AS content_type FROM p",
)
def export_records(spark, d):
    p = process.extract_structured(process.extract_text(enriched(spark, d)))
    return records.export_records(p).select(
        "url", "status_code", F.md5(F.col("text").cast("binary")).alias("text"), F.col("headers")["Content-Type"].alias("content_type")
    )


@check(
    "crawl_state",
    "SELECT DISTINCT 'visited' AS kind, url, NULL::INT AS depth, NULL::BIGINT AS processed FROM pages UNION ALL "
    "SELECT DISTINCT 'frontier', url || '/next', 1, NULL FROM pages UNION ALL SELECT 'counters', NULL, NULL, count(*) FROM pages",
)
def crawl_state(spark, d):
    p, path = pages(spark, d), scratch(spark, "state")
    n = p.agg(F.count("*").alias("processed"), F.count("*").alias("success"), F.lit(0).alias("errors"))
    nxt = p.select(F.concat("url", F.lit("/next")).alias("url"), F.lit(1).alias("depth"), F.lit(0.5).alias("priority")).distinct()
    state.save_state(path, n, p, nxt)
    s = state.load_state(spark, path)
    none = F.lit(None)
    return (
        s.visited.select(F.lit("visited").alias("kind"), "url", none.cast("int").alias("depth"), none.cast("long").alias("processed"))
        .union(s.frontier.select(F.lit("frontier"), "url", "depth", none.cast("long")))
        .union(s.counters.select(F.lit("counters"), none.cast("string"), none.cast("int"), "processed"))
    )


@check(
    "crawl_resume",
    f"""{RECURSIVE}, {SCOPED_LINKS}, r AS (SELECT url, 0 AS depth FROM ({SEEDS})
 UNION SELECT l.target, r.depth + 1 FROM r JOIN l ON l.source = r.url WHERE r.depth < 3)
 SELECT url, min(depth) AS depth FROM r GROUP BY url""",
)
def crawl_resume(spark, d):
    """A crawl stopped after its first wave and taken up from its stored state."""
    links, path = cut_lineage(scoped_links(spark, d).distinct()), scratch(spark, "resume")
    begun = FR.crawl_waves(links, host_seeds(spark, d), max_depth=1, checkpoint_links=False)
    n = begun.agg(F.count_if(F.col("depth") == 0).alias("processed"), F.count("*").alias("success"), F.lit(0).alias("errors"))
    pending = begun.where("depth = 1").withColumn("priority", F.lit(0.5))
    state.save_state(path, n, begun.where("depth = 0"), pending)
    frontier, visited = state.resume_frontier(spark, path, host_seeds(spark, d))
    rest = FR.crawl_waves(links, frontier, max_depth=2, checkpoint_links=False).withColumn("depth", F.col("depth") + 1)
    both = visited.select("url", F.lit(0).alias("depth")).unionByName(rest)
    return both.groupBy("url").agg(F.min("depth").alias("depth"))


# --- plugins, steps, learning -------------------------------------------------------------


class WordPlugin(plugins.Plugin):
    """Words of the markup, as an example of a user's class."""

    schema = "url string, words long"

    def process(self, url, page):
        return {"url": url, "words": len(page["html"].split(" "))}


plugins.register("words", WordPlugin)


@check("apply_plugin", "SELECT url, len(string_split(html, ' ')) AS words FROM pages")
def apply_plugin(spark, d):
    return plugins.apply_plugin(pages(spark, d).select("url", "html"), "words")


@check("plugin_custom_fields", "SELECT 'custom_value' AS custom_field, url, length(html) AS content_length FROM pages")
def plugin_custom_fields(spark, d):
    return pages(spark, d).select(plugins.plugin_custom_fields("url", "html").alias("o")).select("o.*")


@check(
    "plugin_summary",
    "SELECT url, CASE WHEN length(html) > 200 THEN html[1:200] || '...' ELSE html END AS summary, least(length(html), 203) AS summary_length FROM pages",
)
def plugin_summary(spark, d):
    return pages(spark, d).select(plugins.plugin_summary("url", "html").alias("o")).select("o.*")


@check("plugin_file_size", "SELECT url, strlen(html) AS file_size, true AS downloaded FROM pages")
def plugin_file_size(spark, d):
    p = pages(spark, d).withColumn("content", F.encode("html", "UTF-8"))
    return p.select(plugins.plugin_file_size("url", "content").alias("o")).select("o.*")


@check(
    "named_steps",
    f"{E} SELECT 'fetch' AS step, url, length(html) AS n FROM p UNION ALL SELECT 'long', url, {WORDS} FROM p WHERE {WORDS} > 100",
)
def named_steps(spark, d):
    spec = {
        "steps": [
            {"type": "fetch", "name": "got"},
            {"type": "extract", "name": "text", "input": "pages"},
            {"type": "transform", "name": "long", "input": "text", "transform": "long"},
        ]
    }
    out = steps.run_steps(
        spec, {"pages": enriched(spark, d)}, {"long": lambda df: df.filter(F.col("text_info.word_count") > 100)}
    )
    return out["got"].select(F.lit("fetch").alias("step"), "url", F.col("html_length").alias("n")).unionByName(
        out["long"].select(F.lit("long").alias("step"), "url", F.col("text_info.word_count").alias("n"))
    )


CASES = """SELECT source AS name, (min(doc_id) % 2)::INT AS exit_code, count(*) AS file_count,
 sum((n_chars > 0)::INT) AS non_empty_files, 150 AS expected_min_files FROM documents GROUP BY source"""


@check(
    "test_summary",
    f"""WITH c AS ({CASES}), s AS (SELECT *, exit_code = 0 AND file_count >= expected_min_files AND non_empty_files > 0 AS ok FROM c),
 g AS (SELECT ok, CASE WHEN ok THEN round(6 + 4 * least(1.0::DOUBLE, file_count / expected_min_files::DOUBLE), 1)
  WHEN exit_code = 0 THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END AS score FROM s)
 SELECT count(*) AS total_tests, sum(ok::INT) AS successes, sum((NOT ok)::INT) AS failures, round(avg(score), 2) AS average_score,
 round(sum(score), 2) AS total_score, count(*) * 10.0::DOUBLE AS max_score FROM g""",
)
def test_summary(spark, d):
    cases = docs(spark, d).groupBy(F.col("source").alias("name")).agg(
        (F.min("doc_id") % 2).cast("int").alias("exit_code"),
        F.count("*").alias("file_count"),
        F.sum((F.col("n_chars") > 0).cast("int")).alias("non_empty_files"),
        F.lit(150).alias("expected_min_files"),
    )
    return steps.test_summary(cases)


test_summary.__test__ = False


@check("train_and_predict")
def train_and_predict(spark, d):
    # Labels are the heuristic types.
    p = enriched(spark, d).select("page_id", F.col("url2").alias("url"), "html").withColumn("label", SC.page_type("html", "url"))
    model = classifier.train_page_classifier(p, "label")
    return classifier.predict_page_type(model, p).select("page_id", "label", "page_type")


# --- streams -------------------------------------------------------------------------------


def stream_events(spark, d):
    from pagewright import schemas

    return R.stream_pages(spark, f"{d}/events.parquet", schemas.EVENTS, recursive=True)


HOURS = f"""SELECT date_trunc('hour', ts) AS start, sum((event_type <> 'error')::INT) AS pages_crawled,
 sum((event_type = 'error')::INT) AS pages_failed, sum(strlen(props)) AS bandwidth_bytes, count(*) AS le_inf,
 {', '.join(f'sum((value <= {b})::INT) AS le_{str(b).replace(".", "_")}' for b in R.LATENCY_BOUNDS)} FROM events GROUP BY 1"""


def how():
    return {"failed": F.col("event_type") == "error", "seconds": "value", "size": F.octet_length("props")}


@check("crawl_metrics", HOURS)
def crawl_metrics(spark, d):
    return R.crawl_metrics(table(spark, d, "events"), **how()).drop("end")


@check("stream_crawl_metrics", HOURS)
def stream_crawl_metrics(spark, d):
    path = scratch(spark, "metrics")

    def save(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{path}/out")

    writer = R.stream_crawl_metrics(stream_events(spark, d), **how()).writeStream.outputMode("complete").foreachBatch(save)
    R.run_once(writer, f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/out").drop("end")


DELTA = "CASE WHEN event_type IN ('view', 'signup') THEN 1 ELSE -1 END"


@check("queue_size", f"SELECT event_id, sum({DELTA}) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS queue_size FROM events")
def queue_size(spark, d):
    changes = table(spark, d, "events").select("ts", "event_id", F.expr(DELTA).alias("delta"))
    return R.queue_size(changes, ["ts", "event_id"]).select("event_id", "queue_size")


@check("stream_queue_size", f"SELECT user_id % 5 AS queue, sum({DELTA}) AS queue_size FROM events GROUP BY 1")
def stream_queue_size(spark, d):
    path = scratch(spark, "queue")
    changes = stream_events(spark, d).select((F.col("user_id") % 5).alias("queue"), F.expr(DELTA).alias("delta"))

    def save(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{path}/out")

    R.run_once(R.stream_queue_size(changes).writeStream.outputMode("complete").foreachBatch(save), f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/out")


@check("stream_pages", "SELECT page_id, url FROM pages")
def stream_pages(spark, d):
    path = scratch(spark, "stream-pages")
    source = R.stream_pages(spark, f"{d}/pages.parquet", recursive=True).select("page_id", "url")
    R.run_once(source.writeStream.format("parquet").option("path", f"{path}/out"), f"{path}/checkpoint")
    return spark.read.schema("page_id BIGINT, url STRING").parquet(f"{path}/out")


@check("stream_dedup_urls", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup_urls(spark, d):
    path = scratch(spark, "dedup-urls")
    source = stream_events(spark, d).withColumn("url", F.concat_ws("/", "user_id", "event_type"))
    out = R.stream_dedup_urls(source, "ts", "60 days").select("user_id", "event_type")
    R.run_once(out.writeStream.format("parquet").option("path", f"{path}/out"), f"{path}/checkpoint")
    return spark.read.schema("user_id BIGINT, event_type STRING").parquet(f"{path}/out")


@check("stream_dedup_content", "SELECT DISTINCT sha256(props) AS content_hash FROM events")
def stream_dedup_content(spark, d):
    path = scratch(spark, "dedup-content")
    source = stream_events(spark, d).withColumn("content", F.encode("props", "UTF-8"))
    out = R.stream_dedup_content(source, "ts", "60 days").select("content_hash")
    R.run_once(out.writeStream.format("parquet").option("path", f"{path}/out"), f"{path}/checkpoint")
    return spark.read.schema("content_hash STRING").parquet(f"{path}/out")


@check("stream_upsert", UPSERTS)
def stream_upsert(spark, d):
    path = scratch(spark, "upsert")
    rows = stream_events(spark, d).select("user_id", "ts", "event_id", "event_type")
    R.run_once(R.stream_upsert(rows, f"{path}/out", "user_id"), f"{path}/checkpoint")
    return R.read_upserts(
        spark, f"{path}/out", "user_id BIGINT, ts TIMESTAMP, event_id BIGINT, event_type STRING", "user_id"
    )


@check(
    "stream_domain_cap",
    """SELECT page_id FROM (SELECT page_id, row_number() OVER (PARTITION BY regexp_extract(url, '^[^/]*//[^/?#]*') ORDER BY page_id) AS rn FROM pages) WHERE rn <= 2""",
)
def stream_domain_cap(spark, d):
    path = scratch(spark, "cap")
    source = R.stream_pages(spark, f"{d}/pages.parquet", recursive=True)
    R.run_once(R.stream_domain_cap(source, path, 2, ["page_id"]), f"{path}/checkpoint")
    return R.read_accepted(spark, path, "page_id BIGINT")


@check("log_events", "SELECT event_type AS level, CASE WHEN event_type = 'error' THEN 'E' || user_id % 3 END AS error_type, count(*) AS n FROM events GROUP BY ALL")
def log_events(spark, d):
    line = F.to_json(
        F.struct(
            F.col("ts").cast("string").alias("timestamp"),
            F.col("event_type").alias("level"),
            F.lit("m").alias("message"),
            F.expr("CASE WHEN event_type = 'error' THEN 'E' || user_id % 3 END").alias("error_type"),
        )
    )
    return R.log_events(table(spark, d, "events").select(line.alias("value")))
