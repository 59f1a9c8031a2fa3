"""Line dedup: how many lines are read again to verify pairs."""

from __future__ import annotations

import pytest

pytest.importorskip("pagewright.llm")
from pyspark.sql import functions as F  # noqa: E402

from pagewright.llm import lines as L  # noqa: E402


@pytest.mark.parametrize("wanted", [0, 1, 3_000, 200_000])
def test_few_other_lines_come_along_at_every_size(spark, wanted):
    """With a fixed number of slots their share grows with the number of wanted places."""
    every = spark.range(wanted + 100_000).select("id", F.xxhash64("id").alias("hash"))
    got = L.at_marked_places(every, every.where(F.col("id") < wanted).drop("id"))
    mine, others = got.agg(F.count(F.when(F.col("id") < wanted, 1)), F.count(F.when(F.col("id") >= wanted, 1))).first()
    assert mine == wanted and others < 7_000


def test_places_of_null_documents_and_repeated_places(spark):
    rows = [(None, 5, 0), (None, 5, 1), (1, 7, 0), (1, 7, 0), (-3, 0, 2)]
    every = spark.createDataFrame(rows, "doc_id long, mark long, line_no int").withColumn("hash", F.xxhash64("doc_id", "mark", "line_no"))
    for row in set(rows):
        places = every.where(F.struct("doc_id", "mark", "line_no").eqNullSafe(F.struct(*[F.lit(v).cast(t) for v, t in zip(row, ("long", "long", "int"))])))
        got = [tuple(r) for r in L.at_marked_places(every, places.select("hash")).collect()]
        assert got.count(row) == rows.count(row)
