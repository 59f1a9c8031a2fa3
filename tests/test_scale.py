"""Steps rewritten so that their memory or time stays bounded."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import functions as F

from pagewright.plans import process
from pagewright.sources import readers


def test_archive_members_go_out_in_small_batches(monkeypatch):
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        for i in range(10):
            z.writestr(f"{i}.txt", "x" * 100)
    batch = pa.RecordBatch.from_pydict({"path": ["a.zip"] * 3, "content": [box.getvalue()] * 3})
    monkeypatch.setattr(readers, "BATCH_CHARS", 400)
    out = list(readers._explode_batches([batch]))
    assert sum(b.num_rows for b in out) == 30 and max(b.num_rows for b in out) <= 4


def test_a_large_table_is_dealt_out_by_its_bytes(spark, tmp_path):
    spark.range(100_000).select(F.sha2(F.col("id").cast("string"), 256).alias("v")).coalesce(1).write.parquet(str(tmp_path / "t"))
    scan = spark.read.parquet(str(tmp_path / "t"))
    cores = spark.sparkContext.defaultParallelism
    assert readers.spread(scan).rdd.getNumPartitions() == cores
    assert readers.spread(scan, 100_000).rdd.getNumPartitions() > 50


def test_rules_share_one_matching_of_elements(spark):
    html = "<div class=a>one<b class='c'>two</b></div><h1 class='c'>three</h1>"
    pages = spark.createDataFrame([("u", html), ("v", None)], "url string, html string")
    out = process.custom_selectors(pages, {"x": "h1.c, .a", "y": ".a,b", "z": "#none"})
    assert [tuple(r) for r in out.orderBy("url").collect()][0] == ("u", "three", "one two", None)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") <= 2
