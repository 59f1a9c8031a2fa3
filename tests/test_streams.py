"""Streams stopped and restarted equal one batch run."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pagewright.streaming import streams as R

SCHEMA = "url STRING, ts TIMESTAMP, v BIGINT"


def put(spark, path, name, rows):
    df = spark.createDataFrame(rows, "url string, t string, v long").select("url", F.to_timestamp("t").alias("ts"), "v")
    df.coalesce(1).write.mode("append").parquet(str(path / name))
    return df


def source(spark, path):
    return spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(str(path))


def test_upsert_resumes(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    put(spark, src, "a", [("u", "2024-01-01 00:00:00", 1), ("w", "2024-01-01 00:00:00", 9)])
    R.run_once(R.stream_upsert(source(spark, src), out), ck)
    put(spark, src, "b", [("u", "2024-01-02 00:00:00", 2), ("u", "2023-01-02 00:00:00", 3)])
    R.run_once(R.stream_upsert(source(spark, src), out), ck)
    assert {(r.url, r.v) for r in R.read_upserts(spark, out, SCHEMA).collect()} == {("u", 2), ("w", 9)}


def test_domain_cap_resumes(spark, tmp_path):
    src, work, ck = tmp_path / "in", str(tmp_path / "work"), str(tmp_path / "ck")
    src.mkdir()
    for name, ids in (("a", range(0, 3)), ("b", range(3, 9))):
        put(spark, src, name, [(f"http://h{i % 2}/{i}", "2024-01-01 00:00:00", i) for i in ids])
        R.run_once(R.stream_domain_cap(source(spark, src), work, 3, ["v"]), ck)
    kept = spark.read.schema("v BIGINT").parquet(f"{work}/accepted")
    assert sorted(r.v for r in kept.select("v").collect()) == [0, 1, 2, 3, 4, 5]


def test_dedup_resumes(spark, tmp_path):
    src, out, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    src.mkdir()
    for name in ("a", "b"):
        put(spark, src, name, [("u", "2024-01-01 00:00:00", 1)] * 40 + [(f"u{name}", "2024-01-01 00:01:00", 2)])
        stream = R.stream_dedup_urls(source(spark, src), "ts", "1 day").select("url")
        R.run_once(stream.writeStream.format("parquet").option("path", out), ck)
    assert sorted(r.url for r in spark.read.schema("url STRING").parquet(out).collect()) == ["u", "ua", "ub"]


def test_late_rows_leave_closed_windows(spark, tmp_path):
    src, out, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    src.mkdir()

    def run():
        m = R.stream_crawl_metrics(
            source(spark, src), delay="10 minutes", failed=F.col("v") < 0, seconds=F.col("v").cast("double"), size="v"
        )
        R.run_once(m.writeStream.outputMode("append").format("parquet").option("path", out), ck)

    put(spark, src, "a", [("u", "2024-01-01 00:10:00", 1), ("u", "2024-01-01 00:20:00", -1), ("u", "2024-01-01 03:00:00", 1)])
    run()
    put(spark, src, "b", [("late", "2024-01-01 00:30:00", 1), ("u", "2024-01-01 06:00:00", 1)])
    run()
    rows = spark.read.parquet(out).orderBy("start").collect()
    assert (rows[0].pages_crawled, rows[0].pages_failed) == (1, 1)


def test_log_lines(spark):
    lines = ['{"timestamp": "t", "level": "INFO", "message": "m"}', '{"level": "ERROR", "error_type": "IOError"}', '{"level": "ERROR", "error_type": "IOError"}']
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    assert {(r.level, r.error_type, r.n) for r in R.log_events(df).collect()} == {("INFO", None, 1), ("ERROR", "IOError", 2)}


def upserted(spark, n):
    """Batches that update a few keys again and again, and what has to remain."""
    want, batches = {}, []
    for b in range(n):
        rows = [(f"u{(b * 7 + i) % 11}", f"2024-01-01 00:{(b * 13 + i) % 60:02d}:00", b * 10 + i) for i in range(3)]
        batches.append(spark.createDataFrame(rows, "url string, t string, v long").select("url", F.to_timestamp("t").alias("ts"), "v"))
        best = {}
        for url, t, v in rows:
            best[url] = max(best.get(url, ("", 0)), (t, v))
        for url, (t, v) in best.items():
            if url not in want or (t, b) >= want[url][:2]:
                want[url] = (t, b, v)
    return batches, {url: v for url, (_, _, v) in want.items()}


def test_upsert_runs_stay_few(spark, tmp_path):
    out, fanout = str(tmp_path / "out"), 3
    batches, want = upserted(spark, 30)
    for i, batch in enumerate(batches):
        R.save_batch(batch.coalesce(1), i, out, "url", "ts", fanout)
        assert len(R.live_runs(spark, out)) <= 2 * 4
        if i == 20:
            # Replays of a merged batch and of the last one change nothing.
            R.save_batch(batches[4].coalesce(1), 4, out, "url", "ts", fanout)
            R.save_batch(batch.coalesce(1), i, out, "url", "ts", fanout)
    runs = R.live_runs(spark, out)
    assert [(r.first, r.last) for r in runs] == [(0, 26), (27, 29)]
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == sorted(f"run={r.level}-{r.first}-{r.last}" for r in runs)
    assert {r.url: r.v for r in R.read_upserts(spark, out, SCHEMA).collect()} == want


def test_upsert_merge_that_was_not_published(spark, tmp_path):
    from pagewright.streaming import merged as M

    out = str(tmp_path / "out")
    batches, want = upserted(spark, 4)
    for i, batch in enumerate(batches[:3]):
        R.save_batch(batch.coalesce(1), i, out, "url", "ts", 4)
    # A merge is killed after writing half of its rows, before it is published.
    batches[0].limit(1).withColumn("_batch", F.lit(0).cast("long")).write.parquet(M.Run(0, 3, 1).folder(out))
    assert len(R.live_runs(spark, out)) == 3
    R.save_batch(batches[3].coalesce(1), 3, out, "url", "ts", 4)
    assert [r.level for r in R.live_runs(spark, out)] == [1]
    assert {r.url: r.v for r in R.read_upserts(spark, out, SCHEMA).collect()} == want
    # A merge is killed after publishing, before its parts are deleted.
    M.write_run(spark.read.parquet(M.Run(0, 3, 1).folder(out)).limit(0), out, M.Run(2, 2, 0))
    assert {r.url: r.v for r in R.read_upserts(spark, out, SCHEMA).collect()} == want
    assert R.read_upserts(spark, str(tmp_path / "none"), SCHEMA).count() == 0


@pytest.mark.parametrize("files", [1, 3])
def test_tables_of_one_file_and_of_a_folder_stream_whole(spark, tmp_path, files):
    import __spark_entry__ as entry

    rows = [(i, f"http://h{i % 4}.org/{i}", "<p>x</p>") for i in range(20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(files)
    events = spark.createDataFrame([(i, i % 7, "view", 0.5, "{}") for i in range(20)], "event_id long, user_id long, event_type string, value double, props string")
    for name, df in (("pages", pages), ("events", events.withColumn("ts", F.timestamp_seconds("event_id")).repartition(files))):
        out = tmp_path / f"{name}.parquet"
        df.write.parquet(str(out))
        if files == 1:
            part = next(out.glob("part-*"))
            (tmp_path / "one").mkdir(exist_ok=True)
            (tmp_path / "one" / f"{name}.parquet").write_bytes(part.read_bytes())
    d = str(tmp_path / "one" if files == 1 else tmp_path)
    queries = entry.queries()
    assert queries["stream_domain_cap"](spark, d).columns == ["page_id"]
    assert sorted(r.page_id for r in queries["stream_domain_cap"](spark, d).collect()) == list(range(8))
    assert queries["stream_pages"](spark, d).count() == 20
    assert queries["stream_dedup_urls"](spark, d).count() == 7


def test_domain_cap_without_a_batch(spark, tmp_path):
    assert R.read_accepted(spark, str(tmp_path / "none"), "v BIGINT").count() == 0
