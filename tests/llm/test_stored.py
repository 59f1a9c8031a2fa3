"""What the stored steps of an operator leave on disk."""

from __future__ import annotations

from pathlib import Path

import pytest

pytest.importorskip("pagewright.llm")
from pagewright.llm import common, lines  # noqa: E402


def folders(spark):
    shared = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    return {p.name.rsplit("-", 1)[0] for p in shared.iterdir()}, {p for p in shared.iterdir()}


def test_line_dedup_leaves_only_what_is_still_read(spark):
    common.stored(spark.range(1), "first")
    before = folders(spark)[1]
    docs = spark.createDataFrame([(1, "a b c d e f\nx"), (2, "a b c d e f\ny"), (3, "a b c d e g f")], "doc_id long, text string")
    assert {r.doc_id: r.removed for r in lines.repeated_lines(docs).collect()} == {2: [0], 3: [0]}
    left = sorted(p.name.rsplit("-", 1)[0] for p in folders(spark)[1] - before)
    assert [n for n in left if n in ("marks", "sets", "pairs", "wanted", "known", "later", "removed")] == ["removed"]


def test_shuffle_files_go_when_a_table_is_stored(spark):
    key = common.SHUFFLE_CLEANUP
    before = spark.conf.get(key)
    blocks = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()
    held = blocks()
    table = common.stored(spark.range(1000).repartition(7), "dealt")
    assert blocks() <= held
    assert table.count() == 1000 and spark.conf.get(key) == before
