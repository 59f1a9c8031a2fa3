"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import bpe, ego, lines, mixing, phrases, pieces, pii, runs, secrets, simhash, topk, toxicity, warc
from pagewright.llm.common import stored, word_count

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql.strip()
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op10_secret_scan")
def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(secrets.secret_spans(table(spark, sf_dir, "documents")))


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 3.0::DOUBLE * sum(size)::DOUBLE AS cap,
         (1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::DOUBLE AS w
  FROM d GROUP BY source),
t AS (
  SELECT *, sum(source_size) OVER ()::DOUBLE AS total,
         sum(w) OVER () - sum(w) OVER o + w AS w_rest, sum(cap) OVER o - cap AS caps_before
  FROM s WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
f AS (SELECT *, cap * w_rest <= w * (total - caps_before) AS is_full FROM t),
g AS (
  SELECT source, source_size,
         CASE WHEN is_full THEN cap ELSE w * (total - coalesce(sum(cap) FILTER (is_full) OVER (), 0))
              / (sum(w) FILTER (NOT is_full) OVER ()) END AS target
  FROM f),
p AS (
  SELECT d.doc_id, d.size, g.source_size, g.target,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
           - d.size AS before,
         CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size) ELSE 0 END AS passes
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       (size * (passes + CASE WHEN 2 * before + size < 2 * (target - passes * source_size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM p
"""


@query("op6_curriculum_mix", MIX_SQL)
def op6_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # The words are counted once; what follows works on the small table.
    sized = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("words")), "sizes")
    return mixing.mix_report(mixing.plan_mix(sized, F.col("words"))).drop("position")


@query("op2_simhash_near_dedup")
def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_digest(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def multilingual_bytes() -> bpe.Vocabulary:
    return bpe.Vocabulary.read(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op4_byte_bpe")
def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), multilingual_bytes(), digests=True)


DIGEST_SQL = "sha1(coalesce(html, ''))"
BASE32_SQL = " || ".join(
    f"lpad(translate(to_base(('0x' || substr(hex, {1 + 10 * i}, 10))::BIGINT, 32), "
    "'0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'), 8, 'A')"
    for i in range(4)
)
WARC_SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, {DIGEST_SQL} AS hex FROM pages),
r AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS last FROM p)
SELECT page_id, payload_bytes, {BASE32_SQL} AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to
FROM r
"""


@query("op5_warc_round_trip", WARC_SQL)
def op5_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.archive_folder(spark)
    warc.make_folder(spark, folder)
    archives = warc.write_archives(table(spark, sf_dir, "pages"), folder)
    return warc.read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS p FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         coalesce(list_sum(list_transform(list_zip(q.p, c.p), lambda z: z[1] * z[2])), 0)::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.p) = len(q.p) WHERE q.vec_id % 20 = 0)
SELECT query_id, rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
WHERE rank <= 20
"""


@query("op3_exact_top_k", TOP_K_SQL)
def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


EGO_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id, vec_id AS c FROM embeddings UNION SELECT p.b, r.c FROM r JOIN p ON p.a = r.vec_id),
g AS (SELECT vec_id, min(c) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM p GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM g LEFT JOIN n USING (vec_id)
"""


@query("op7_ego_near_dedup", EGO_SQL)
def op7_ego_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ego.vector_groups(table(spark, sf_dir, "embeddings"))


# For a real corpus the key comes from the caller and is kept secret.
PII_KEY = "demonstration key"


@query("op8_feistel_pseudonyms")
def op8_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)
    return done.select("doc_id", "pii.*", "text")


LINES_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(len(string_split(text, chr(10))), 0)::BIGINT AS n_lines, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, i - 1 AS line_no, lower(lines[i]) AS line FROM (SELECT doc_id, lines, unnest(range(1, n_lines + 1)) AS i FROM d)),
w AS (SELECT doc_id, line_no, list_distinct(list_transform(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), lambda t: hash(t))) AS words FROM l),
s AS (SELECT list_sort(words) AS words, min((doc_id, line_no)) AS first FROM w WHERE len(words) >= 1 GROUP BY 1),
x AS (SELECT a.words FROM s a JOIN s b ON a.first > b.first AND 5 * len(a.words) >= 4 * len(b.words) AND 5 * len(b.words) >= 4 * len(a.words)
      WHERE 9 * len(list_intersect(a.words, b.words)) >= 4 * (len(a.words) + len(b.words)) GROUP BY a.words),
r AS (SELECT w.doc_id, list_sort(list(w.line_no)) AS removed
      FROM w JOIN s ON list_sort(w.words) = s.words LEFT JOIN x ON x.words = s.words
      WHERE x.words IS NOT NULL OR (w.doc_id, w.line_no) <> s.first GROUP BY w.doc_id)
SELECT doc_id, n_lines, coalesce(len(removed), 0)::BIGINT AS n_removed, coalesce(array_to_string(removed, ','), '') AS removed
FROM d LEFT JOIN r USING (doc_id)
"""


@query("op9_line_dedup", LINES_SQL)
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(table(spark, sf_dir, "documents"))


def piece_model() -> bytes:
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        return file.read()


@query("op11_sentencepiece")
def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), piece_model(), digests=True)


def planted_run(doc_id: int | None, n: int) -> np.ndarray | None:
    """Places of the words of a document whose end is made periodic, if it is."""
    if doc_id is None or not n or (h := zlib.crc32(str(doc_id).encode())) % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    places[a:] = a + (places[a:] - a) % p
    return places


@query("op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_digest(runs.periodic_runs(table(spark, sf_dir, "documents"), rewrite=planted_run))


PHRASES_SQL = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(words) - k + 2), lambda i: array_to_string(words[i:i + k - 1], ' '))) AS phrase
      FROM w, (SELECT unnest(range(1, 6)) AS k) WHERE len(words) >= k),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, sum(a)::HUGEINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k > 1 AND a >= 100),
x AS (SELECT c.lang, c.phrase, c.k, c.a, unnest(range(1, c.k)) AS cut, string_split(c.phrase, ' ') AS words FROM c),
s AS (SELECT x.lang, x.phrase, x.a, x.cut, l.a AS l, r.a AS r, n.n, 1000 * x.a::HUGEINT * n.n // (l.a::HUGEINT * r.a) AS score
      FROM x JOIN n ON n.lang = x.lang
      JOIN f l ON l.lang = x.lang AND l.k = x.cut AND l.phrase = array_to_string(x.words[:x.cut], ' ')
      JOIN f r ON r.lang = x.lang AND r.k = x.k - x.cut AND r.phrase = array_to_string(x.words[x.cut + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
o AS (SELECT * FROM b WHERE NOT EXISTS (
        SELECT 1 FROM c WHERE c.lang = b.lang AND c.a >= b.a AND c.k > len(string_split(b.phrase, ' '))
        AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ')))
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o) WHERE rank <= 2000
"""


@query("op13_phrase_collocations", PHRASES_SQL)
def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))
