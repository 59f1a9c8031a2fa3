"""Skew helpers, graph, frontier, storage, plugins and steps."""

from __future__ import annotations

import io
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from pagewright.operators import frontier as FR
from pagewright.operators import graph as G
from pagewright.operators import skew
from pagewright.operators import urls as OU
from pagewright.plans import plugins, steps
from pagewright.plans.process import CrawlConfig, process_pages
from pagewright.session import ensure_checkpoint_dir
from pagewright.sources import readers, records, state, writers


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_running_total_is_distributed_and_exact(spark):
    df = spark.range(500).select("id", (F.col("id") % 7 - 3).alias("v"))
    got = {r.id: r.t for r in skew.running_total(df, ["id"], "v", "t").collect()}
    total, want = 0, {}
    for i in range(500):
        total += i % 7 - 3
        want[i] = total
    assert got == want


def test_top_per_group_on_a_hot_key(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 3 < 2, "hot").otherwise("cold").alias("k"))
    rows = skew.top_per_group(df, ["k"], [F.col("id")], 3, rank="r").orderBy("k", "r").collect()
    assert [(r.k, r.id, r.r) for r in rows] == [("cold", 2, 1), ("cold", 5, 2), ("cold", 8, 3), ("hot", 0, 1), ("hot", 1, 2), ("hot", 3, 3)]


def test_lookup_salts_hot_keys(spark):
    big = spark.range(300).select("id", F.when(F.col("id") < 200, 1).otherwise(F.col("id")).alias("k"))
    small = big.groupBy("k").agg(F.count("*").alias("n"))
    out = skew.lookup(big, small, ["k"], "n", hot_rows=50)
    assert out.count() == 300 and out.filter("n = 200").count() == 200


def test_dedup_urls(spark):
    rows = [(0, "https://e.org/page"), (1, "https://e.org/page/"), (2, "https://e.org/page?utm_source=test")]
    out = OU.dedup_urls(spark.createDataFrame(rows, "pos long, url string")).collect()
    assert [(r.url, r.pos) for r in out] == [("https://e.org/page", 0)]


CHAIN = [("a", "b"), ("b", "c"), ("c", "d"), ("a", "c"), ("x", "y"), ("y", "x"), ("z", "z")]


def edges_of(spark, rows):
    return spark.createDataFrame(rows, "source string, target string")


def nodes_of(edges):
    return edges.select(F.col("source").alias("url")).union(edges.select("target")).distinct()


def test_components(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 3)
    star = [(f"s{i}", "s0") for i in range(1, 60)] + [(f"p{i}", f"p{i + 1}") for i in range(40)]
    edges = edges_of(spark, CHAIN + star)
    nodes = nodes_of(edges).union(spark.createDataFrame([("lonely",)], "url string"))
    got = {}
    for r in G.connected_components(nodes, edges).collect():
        got.setdefault(r.component, set()).add(r.url)
    sizes = sorted(len(v) for v in got.values())
    assert sizes == [1, 1, 2, 4, 41, 60]
    assert all(min(v) == k for k, v in got.items())
    stats = G.graph_statistics(nodes, edges).first()
    assert stats.components == 6 and not stats.is_connected


def test_graph_metrics_on_nothing(spark):
    edges = edges_of(spark, [])
    assert G.graph_metrics(nodes_of(edges), edges).first().avg_degree == 0.0
    assert G.graph_statistics(nodes_of(edges), edges).first().density == 0.0


def test_pagerank_sums_to_one(spark):
    edges = edges_of(spark, CHAIN)
    ranks = {r.url: r["rank"] for r in G.pagerank(nodes_of(edges), edges, iterations=20).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-9 and ranks["d"] > ranks["a"]


def test_crawl_waves(spark):
    edges = edges_of(spark, CHAIN)
    seeds = spark.createDataFrame([("a",)], "url string")
    assert {(r.url, r.depth) for r in FR.crawl_waves(edges, seeds).collect()} == {("a", 0), ("b", 1), ("c", 1), ("d", 2)}
    assert FR.crawl_waves(edges, seeds, max_depth=1).count() == 3


def test_site_rules_order(spark):
    rules = [OU.SiteRule(".*", reason="any"), OU.SiteRule("HTTPS://A", reason="a", priority=2), OU.SiteRule("(", priority=9)]
    df = spark.createDataFrame([("https://a.org",), ("x https://a.org",)], "url string")
    assert [r.rule.reason for r in OU.site_rule_match(df, rules).collect()] == ["a", "any"]
    assert OU.site_rule_match(df, []).first().rule is None


def test_state_round_trip(spark, tmp_path):
    path = str(tmp_path / "state")
    counters = spark.createDataFrame([(5, 4, 1)], "processed long, success long, errors long")
    visited = spark.createDataFrame([("u1",), ("u2",)], "url string")
    pending = spark.createDataFrame([("p1", 1, 0.8), ("p2", 1, 0.9)], "url string, depth int, priority double")
    seeds = spark.createDataFrame([("u1", 0, 1.0), ("new", 0, 1.0)], "url string, depth int, priority double")
    assert state.load_state(spark, path) is None
    state.save_state(path, counters, visited)
    old = state.load_state(spark, path)
    assert not old.has_frontier and old.frontier.isEmpty() and old.visited.count() == 2
    assert [r.url for r in state.resume_frontier(spark, path, seeds)[0].collect()] == ["new"]
    state.save_state(path, counters, visited, pending)
    now = state.load_state(spark, path)
    assert {tuple(r) for r in now.frontier.collect()} == {("p1", 1, 0.8), ("p2", 1, 0.9)}
    row = now.counters.first()
    assert (row.processed, row.success, row.errors) == (5, 4, 1)
    frontier, _ = state.resume_frontier(spark, path, seeds)
    assert {r.url for r in frontier.collect()} == {"p1", "p2"}


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x.txt", "one")
        z.writestr("y.png", b"\x00")
        z.writestr("z.html", b"caf\xff\xc3\xa9")
    with tarfile.open(tmp_path / "b.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("t.xml")
        info.size = 3
        t.addfile(info, io.BytesIO(b"two"))
    with zipfile.ZipFile(tmp_path / "c.epub", "w") as z:
        z.writestr("ch1.xhtml", "ch")
        z.writestr("n.txt", "no")
    (tmp_path / "bad.zip").write_bytes(b"PK broken")
    members = readers.explode_archive(readers.read_binary(spark, str(tmp_path))).cache()
    assert {(r.member, r.text) for r in members.collect()} == {("x.txt", "one"), ("z.html", "café"), ("t.xml", "two"), ("ch1.xhtml", "ch")}
    joined = {r.path.rsplit("/", 1)[1]: r.text for r in readers.archive_text(members).collect()}
    assert joined["a.zip"] == "one\n\ncafé\n\n"


def test_upsert_prefers_the_update_on_equal_times(spark):
    old = spark.createDataFrame([("u", 1, "old"), ("k", 5, "kept")], "url string, ts int, v string")
    new = spark.createDataFrame([("u", 1, "new"), ("k", 4, "late")], "url string, ts int, v string")
    assert {(r.url, r.v) for r in records.upsert_latest(old, new).collect()} == {("u", "new"), ("k", "kept")}


def test_vector_table_rejects_missing_vectors(spark):
    recs = spark.createDataFrame([("a",), ("b",)], "url string")
    vecs = spark.createDataFrame([("a", [1.0])], "url string, embedding array<float>")
    with pytest.raises(Exception, match="record without vector"):
        records.vector_table(recs, vecs).collect()


def test_knn_in_query_chunks(spark):
    vecs = spark.range(60).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("float")).alias("embedding"))
    got = {(r.query_id, r.vec_id) for r in records.knn_l2(vecs, vecs, 2, block_rows=7, shard_rows=9).collect()}
    assert len(got) == 120 and (0, 0) in got and (0, 1) in got and (30, 29) in got


def clustered(spark, per=100):
    """Twenty far clusters of vectors, and a few exact copies."""
    import numpy as np

    rng = np.random.default_rng(4)
    centres = rng.normal(0, 50, (20, 8))
    rows = [(i, [float(x) for x in centres[i % 20] + rng.normal(0, 1, 8)]) for i in range(20 * per)]
    rows += [(len(rows) + i, rows[0][1]) for i in range(15)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_knn_equals_brute_force(spark):
    import numpy as np

    rows, vecs = clustered(spark, 20)
    points = np.array([r.embedding for r in vecs.orderBy("vec_id").collect()], dtype=np.float64)
    got = {}
    for r in records.knn_l2(vecs, vecs.where("vec_id % 3 = 0"), 6, block_rows=11, shard_rows=16).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, round(r.distance, 6))
    assert len(got) == -(-len(rows) // 3)
    for query, found in got.items():
        distance = np.square(points - points[query]).sum(axis=1)
        best = np.lexsort((np.arange(len(points)), distance))[:6]
        assert [found[i + 1] for i in range(6)] == [(int(b), round(float(distance[b]), 6)) for b in best]
    few = records.knn_l2(vecs.limit(3), vecs.limit(3), 10).collect()
    assert len(few) == 9
    assert records.knn_l2(vecs.limit(0), vecs, 3).count() == 0


def test_knn_sends_few_shards(spark):
    """A query goes to its own shard and to those its bound reaches, not to all."""
    rows, vecs = clustered(spark)
    placed, centres, sizes = records.space_shards(vecs, "vec_id", 50)
    assert len(centres) > 60
    asked = vecs.selectExpr("vec_id AS query_id", "embedding", "CAST(60 AS DOUBLE) AS bound")
    others = records.routed_queries(asked, centres, sizes, 5, home=False).count()
    assert others < 0.15 * len(rows) * (len(centres) - 1)


def test_collect_text_parts(spark):
    df = spark.range(25).select(F.lit("g").alias("g"), "id", F.concat(F.lit(" t"), "id").alias("text"))
    parts = {r.part: r.text for r in records.collect_text(df, "g", "id", part_span=10).collect()}
    assert "\n\n".join(parts[p] for p in sorted(parts)) == "\n\n".join(f"t{i}" for i in range(25))


def test_graphml_is_xml(spark, tmp_path):
    import xml.etree.ElementTree as ET

    edges = edges_of(spark, [('a"<&>', "b")])
    writers.write_graphml(nodes_of(edges), edges, str(tmp_path / "g"))
    parts = sorted(p for p in (tmp_path / "g").glob("part-*"))
    root = ET.fromstring("".join(p.read_text() for p in parts))
    assert sorted(n.get("id") for n in root.iter("{http://graphml.graphdrawing.org/xmlns}node")) == ['a"<&>', "b"]


def test_store_layout(spark, tmp_path):
    df = spark.createDataFrame([("http://a/",)], "url string")
    writers.write_crawl_store(df, str(tmp_path / "s"))
    import hashlib

    h = hashlib.sha256(b"http://a/").hexdigest()
    assert list((tmp_path / "s" / f"s1={h[:2]}" / f"s2={h[2:4]}").glob("*.json"))


def test_store_keeps_every_record_of_a_shard(spark, tmp_path):
    """Several records in each of some folders."""
    import hashlib
    from collections import defaultdict

    shards = defaultdict(list)
    for i in range(150_000):
        shards[hashlib.sha256(f"http://a/{i}".encode()).hexdigest()[:4]].append(i)
    wanted = [i for ids in sorted(shards.values(), key=len)[-4:] for i in ids]
    assert len(wanted) >= 20
    info = "named_struct('title', concat('t', id), 'text', concat('line\\n', id))"
    rows = spark.createDataFrame([(i,) for i in wanted], "id long").selectExpr(
        "concat('http://a/', id) AS url", f"named_struct('text', {info}) AS content"
    )
    writers.write_crawl_store(rows, str(tmp_path / "many"))
    read = readers.read_crawl_store(spark, str(tmp_path / "many")).collect()
    assert sorted(r.url for r in read) == sorted(f"http://a/{i}" for i in wanted)
    assert all(r.content.text.text == f"line\n{r.url[9:]}" for r in read)
    one = tmp_path / "files"
    one.mkdir()
    (one / "a.json").write_text('{\n "url": "http://a/",\n "timestamp": "x"\n}')
    assert readers.read_crawl_store(spark, str(one), layout="files").first().url == "http://a/"
    with pytest.raises(ValueError, match="layout"):
        readers.read_crawl_store(spark, str(one), layout="other")


def test_plugins(spark):
    class Failing(plugins.Plugin):
        schema = "nonsense ("

        def process(self, url, page):
            return {}

    class Counting(plugins.Plugin):
        schema = "url string, n long, bonus long"

        def __init__(self, bonus=0):
            self.bonus = bonus

        def initialize(self):
            self.n = 0

        def process(self, url, page):
            self.n += 1
            return {"url": url, "n": self.n, "bonus": self.bonus}

    plugins.register("counting", Counting)
    plugins.register("failing", Failing)
    df = spark.createDataFrame([("u1",), ("u2",)], "url string").coalesce(1)
    assert [(r.url, r.n, r.bonus) for r in plugins.apply_plugin(df, "counting", bonus=7).collect()] == [("u1", 1, 7), ("u2", 2, 7)]
    with pytest.raises(plugins.PluginError):
        plugins.apply_plugin(df, "missing")
    outputs, failed = plugins.apply_all(df)
    assert "counting" in outputs and "failing" in failed
    plugins._registry.pop("failing")


def test_steps(spark, tmp_path):
    pages = spark.createDataFrame([("http://h/a", "<p>x</p>"), ("http://h/b", "<p>y</p>")], "url string, html string")
    links = edges_of(spark, [("http://h/a", "http://h/b"), ("http://h/b", "http://h/gone"), ("http://h/a", "http://o/x")])
    spec = {
        "steps": [
            {"type": "crawl", "name": "walk", "urls": ["http://h/a"], "config": {"max_depth": 3}},
            {"type": "fetch", "name": "got", "urls": ["http://h/b"]},
            {"type": "dance", "name": "no"},
        ],
        "output": {"path": str(tmp_path / "out")},
    }
    with pytest.warns(UserWarning, match="unknown step type"):
        out = steps.run_steps(spec, {"pages": pages, "links": links})
    row = out["walk"].first()
    assert (row.processed, row.success) == (3, 2)
    assert set(out) == {"walk", "got"} and (tmp_path / "out" / "walk").exists()


def test_case_scores(spark):
    rows = [("a", 0, 10, 10, 5), ("b", 0, 1, 1, 5), ("c", None, 0, 0, 5), ("d", 0, 5, 0, 5)]
    df = spark.createDataFrame(rows, "name string, exit_code int, file_count int, non_empty_files int, expected_min_files int")
    assert {r["name"]: r.score for r in steps.case_scores(df).collect()} == {"a": 10.0, "b": 3.0, "c": 1.0, "d": 3.0}
    assert steps.test_summary(df).first().average_score == 4.25


def test_process_pages_plan_is_one_native_projection(spark):
    pages = readers.read_pages(spark, "/root/testdata/sf0.001/pages.parquet")
    out = process_pages(pages, CrawlConfig(max_size_mb=1))
    text = plan(out)
    assert "Exchange" not in text and "Python" not in text
    assert out.count() > 0


def test_scan_reads_only_needed_columns(spark):
    from pagewright.functions.urls import normalize_url

    df = readers.read_pages(spark, "/root/testdata/sf0.001/pages.parquet").select(normalize_url("url"))
    assert "ReadSchema: struct<url:string>" in df._jdf.queryExecution().executedPlan().toString() or "html" not in df._jdf.queryExecution().executedPlan().toString()


def test_checkpoint_dir_is_kept(spark):
    assert ensure_checkpoint_dir(spark) == ensure_checkpoint_dir(spark)


def test_config_rejects_negative_limits():
    with pytest.raises(ValueError, match="max_urls"):
        CrawlConfig(max_urls=-1)


def test_knn_gives_out_copies_of_queries_in_bounded_pieces(monkeypatch):
    """Queries that need every shard never stand in one frame with all their copies."""
    import numpy as np
    import pandas as pd

    monkeypatch.setattr(records, "ROUTED_ROWS", 16)
    points = np.random.default_rng(1).normal(size=(40, 4))
    centres = points[:30]
    batch = pd.DataFrame({"query_id": range(40), "embedding": list(points), "bound": np.inf})
    run = records._route(centres, np.full(30, 9.0), np.full(30, 2), 50, home=False)
    out = list(run(iter([batch])))
    assert max(map(len, out)) <= 16 and sum(map(len, out)) == 40 * 29


def test_nearest_rows_are_exact_for_any_numbers(monkeypatch):
    """Far offsets, equal rows, tiny and huge numbers, and what is not a number."""
    import numpy as np

    monkeypatch.setattr(records, "POINTS_AT_ONCE", 7)
    monkeypatch.setattr(records, "ROWS_AT_ONCE", 11)
    monkeypatch.setattr(records, "MET_AT_ONCE", 5)
    rng = np.random.default_rng(6)
    free = rng.normal(size=(60, 5))
    grid = rng.integers(0, 2, (60, 5)).astype(float)
    odd = free.copy()
    odd[3, 1], odd[9, 0] = np.nan, np.inf
    for rows in (free, grid, free * 0.01 + 1e4, free * 1e-24, free * 1e25, odd):
        names = rng.permutation(len(rows))
        points = rows[::2]
        with np.errstate(invalid="ignore"):
            far = [np.square(rows - p).sum(axis=1) for p in points]
            for bound in (np.full(len(points), np.inf), np.array([np.sort(d)[6] for d in far])):
                at, distance, found = records.nearest_of(points, bound, rows, names, 7)
                for i, d in enumerate(far):
                    best = np.lexsort((names, d))[:7]
                    assert found[at == i].tolist() == names[best].tolist()
                    assert np.array_equal(distance[at == i], d[best], equal_nan=True)


def test_knn_of_missing_and_repeated_vectors(spark):
    """As the SQL has it: a missing vector has no distance, and comes last."""
    import duckdb

    import __spark_entry__ as entry

    sql = entry.oracle_sql()["knn_l2"]
    same = [1.0, 2.0]
    for rows in (
        [(i, same if i % 2 else [float(i), 0.0]) for i in range(30)] + [(40, None), (7, same), (8, [9.0, 9.0])],
        [(1, None), (2, None), (3, [1.0, 0.0]), (4, [0.0, 0.0])],
        [(1, None), (2, None)],
    ):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        con = duckdb.connect()
        con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
        con.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
        want = con.execute(f"SELECT query_id, rank, vec_id, distance FROM ({sql})").fetchall()
        got = records.knn_l2(df, df, 5, block_rows=4, shard_rows=3)
        got = [(r.query_id, r["rank"], r.vec_id, r.distance and round(r.distance, 6)) for r in got.collect()]
        by = lambda r: (r[0], r[1])
        assert sorted(got, key=by) == sorted(want, key=by)


def test_knn_query_searches_from_every_vector(spark, tmp_path):
    """All rows are queries, whatever their ids, in the query and in its SQL."""
    import duckdb

    import __spark_entry__ as entry

    rows, _ = clustered(spark, 5)
    df = spark.createDataFrame([(7 * i + 1, v) for i, v in rows], "vec_id long, embedding array<float>")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = entry.queries()["knn_l2"](spark, str(tmp_path)).collect()
    assert len(got) == 5 * len(rows) and {r.query_id for r in got} == {7 * i + 1 for i, _ in rows}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(f"SELECT query_id, rank, vec_id FROM ({entry.oracle_sql()['knn_l2']})").fetchall()
    assert {(r.query_id, r["rank"], r.vec_id) for r in got} == set(want)


def test_knn_sends_a_query_once_to_a_group_of_shards(spark):
    """Where no shard can be ruled out, copies grow with the groups, not with the shards."""
    rows, vecs = clustered(spark, 20)
    _, centres, sizes = records.space_shards(vecs, "vec_id", 9)
    groups = records.shard_groups(centres, sizes, 150)
    assert len(centres) > 100 and 1 < groups.max() + 1 <= 4
    asked = vecs.selectExpr("vec_id AS query_id", "embedding", "CAST(1e9 AS DOUBLE) AS bound")
    sent = records.routed_queries(asked, centres, sizes, 10**6, home=False, groups=groups).collect()
    assert len(sent) == len(rows) * (groups.max() + 1)
    close = asked.withColumn("bound", F.lit(60.0).cast("double"))
    assert records.routed_queries(close, centres, sizes, 5, home=False, groups=groups).count() < len(sent)
