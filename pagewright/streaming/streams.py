"""Structured Streaming jobs and their batch twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from pagewright import schemas
from pagewright.functions.base import as_col
from pagewright.functions.urls import domain_of, url_hash
from pagewright.operators.skew import running_total, top_per_group
from pagewright.sources.records import upsert_latest
from pagewright.sources.state import list_versions
from pagewright.streaming.merged import (
    BATCH,
    FANOUT,
    Run,
    is_merged,
    latest,
    live_runs,
    merge_full_levels,
    write_run,
)

# Upper bounds of the response-time histogram, in seconds.
LATENCY_BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0]
DEDUP_SALTS = 16


def stream_pages(
    spark: SparkSession,
    path: str,
    schema: str = schemas.RAW_PAGES,
    files_per_trigger: int | None = None,
    glob: str | None = None,
    recursive: bool = False,
) -> DataFrame:
    """Files of a folder as a stream; with ``recursive`` also a single file.

    ``glob`` tests file names, not folders: a table that may be one file or a
    folder of files is read by its own path with ``recursive``.
    """
    reader = spark.readStream.schema(schema)
    if recursive:
        reader = reader.option("recursiveFileLookup", True)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def _first_sighting(df: DataFrame, key: str, ts: str, delay: str, salts: int) -> DataFrame:
    """First row per key within the watermark.

    A key that fills the stream is thinned per salt before it meets in the
    task that owns the key; state is forgotten past the watermark.
    """
    marked = df.withWatermark(ts, delay)
    if salts > 1:
        salted = marked.withColumn("_salt", F.pmod(F.xxhash64(F.col(ts), F.rand(7)), F.lit(salts)))
        marked = salted.dropDuplicatesWithinWatermark([key, "_salt"]).drop("_salt")
    return marked.dropDuplicatesWithinWatermark([key])


def stream_dedup_urls(
    df: DataFrame, ts: str, delay: str = "1 hour", url: str = "url", salts: int = DEDUP_SALTS
) -> DataFrame:
    return _first_sighting(df.withColumn("url_key", url_hash(url)), "url_key", ts, delay, salts)


def stream_dedup_content(
    df: DataFrame, ts: str, delay: str = "1 hour", content: str = "content", salts: int = DEDUP_SALTS
) -> DataFrame:
    return _first_sighting(df.withColumn("content_hash", F.sha2(content, 256)), "content_hash", ts, delay, salts)


def crawl_metrics(
    events: DataFrame,
    failed: Column,
    seconds: Column | str,
    size: Column | str,
    ts: str = "ts",
    window: str = "1 hour",
    slide: str | None = None,
) -> DataFrame:
    """Counters and a cumulative latency histogram per window.

    The same code serves batch and stream; rows of a busy window are summed
    before the shuffle.
    """
    s = as_col(seconds)
    buckets = [
        F.sum((s <= bound).cast("long")).alias("le_" + str(bound).replace(".", "_")) for bound in LATENCY_BOUNDS
    ]
    spans = F.window(ts, window, slide) if slide else F.window(ts, window)
    return (
        events.groupBy(spans.alias("span"))
        .agg(
            F.sum((~failed).cast("long")).alias("pages_crawled"),
            F.sum(failed.cast("long")).alias("pages_failed"),
            F.sum(as_col(size)).alias("bandwidth_bytes"),
            F.count("*").alias("le_inf"),
            *buckets,
        )
        .select(F.col("span.start").alias("start"), F.col("span.end").alias("end"), "*")
        .drop("span")
    )


def stream_crawl_metrics(events: DataFrame, ts: str = "ts", delay: str = "1 hour", **how) -> DataFrame:
    return crawl_metrics(events.withWatermark(ts, delay), ts=ts, **how)


def queue_size(changes: DataFrame, order: list[str], delta: str = "delta") -> DataFrame:
    """Gauge after every change: a distributed running sum over the order."""
    return running_total(changes, order, delta, "queue_size")


def stream_queue_size(changes: DataFrame, queue: str = "queue", delta: str = "delta") -> DataFrame:
    """Current gauge per queue; run in update or complete mode.

    The state is one sum per queue and each trigger pre-aggregates its rows.
    """
    return changes.groupBy(queue).agg(F.sum(delta).alias("queue_size"))


# --- upserts ---------------------------------------------------------------------


def save_batch(batch: DataFrame, batch_id: int, path: str, key: str, ts: str, fanout: int = FANOUT) -> None:
    """Store a micro-batch as a run, and merge the levels it fills.

    A replayed batch overwrites its run; if that has been merged already, the
    rows are there and nothing is written. So the result is exact.
    """
    spark = batch.sparkSession
    rows = upsert_latest(batch.limit(0), batch, key, ts).withColumn(BATCH, F.lit(batch_id).cast("long"))
    if not is_merged(spark, path, batch_id):
        write_run(rows, path, Run(batch_id, batch_id, 0))
    merge_full_levels(spark, path, rows.schema, key, ts, fanout)


def stream_upsert(
    updates: DataFrame, path: str, key: str = "url", ts: str = "ts", fanout: int = FANOUT
) -> DataStreamWriter:
    """Keep the latest row per key in ``path``.

    A micro-batch writes only its own latest rows. Its run is merged with
    others level by level, so that the number of files stays bounded.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        save_batch(batch, batch_id, path, key, ts, fanout)

    return updates.writeStream.outputMode("append").foreachBatch(save)


def read_upserts(spark: SparkSession, path: str, schema: str, key: str = "url", ts: str = "ts") -> DataFrame:
    """Latest row per key over all batches; a later batch wins equal times."""
    folders = [run.folder(path) for run in live_runs(spark, path)]
    if not folders:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, {BATCH} BIGINT").parquet(*folders)
    return latest(rows, key, ts).drop(BATCH)


# --- domain cap -------------------------------------------------------------------


def stream_domain_cap(pages: DataFrame, path: str, n: int, order: list[str]) -> DataStreamWriter:
    """Accept at most ``n`` pages per domain over the life of the stream.

    Accepted rows and the counts after each batch are stored per batch id.
    Within a batch no domain keeps more than ``n`` rows past the first,
    salted cut, so a domain that fills the stream does not fill a task.
    """
    spark = pages.sparkSession

    def accept(batch: DataFrame, batch_id: int) -> None:
        done = [v for v in list_versions(spark, f"{path}/counts", "_SUCCESS") if v < batch_id]
        counts = (
            spark.read.schema("domain STRING, stored BIGINT").parquet(f"{path}/counts/v={done[-1]}")
            if done
            else spark.createDataFrame([], "domain STRING, stored BIGINT")
        )
        ranked = top_per_group(
            batch.withColumn("domain", domain_of("url")), ["domain"], [F.col(c) for c in order], n, rank="_rank"
        )
        taken = ranked.join(counts, "domain", "left").filter(
            F.col("_rank") + F.coalesce("stored", F.lit(0)) <= n
        )
        out = f"{path}/accepted/batch={batch_id}"
        taken.drop("_rank", "stored", "domain").write.mode("overwrite").parquet(out)
        fresh = spark.read.schema(batch.schema).parquet(out).select(domain_of("url").alias("domain"))
        after = (
            counts.unionByName(fresh.select("domain", F.lit(1).cast("long").alias("stored")))
            .groupBy("domain")
            .agg(F.sum("stored").alias("stored"))
        )
        after.write.mode("overwrite").parquet(f"{path}/counts/v={batch_id}")

    return pages.writeStream.outputMode("append").foreachBatch(accept)


def read_accepted(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows accepted so far; none if the stream has had no batch."""
    none = spark.createDataFrame([], schema)
    if not list_versions(spark, f"{path}/counts", "_SUCCESS"):
        return none
    return spark.read.schema(schema).parquet(f"{path}/accepted").select(*none.columns)


# --- log lines --------------------------------------------------------------------


def parse_log(lines: DataFrame, value: str = "value") -> DataFrame:
    parsed = F.from_json(F.col(value), schemas.LOG_LINE)
    return lines.select(parsed.alias("_e")).select("_e.*")


def log_events(lines: DataFrame, value: str = "value") -> DataFrame:
    """Number of structured log lines per level and error type."""
    return parse_log(lines, value).groupBy("level", "error_type").agg(F.count("*").alias("n"))


def run_once(writer: DataStreamWriter, checkpoint: str) -> None:
    """Drive a stream over everything available, resuming at the checkpoint."""
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

