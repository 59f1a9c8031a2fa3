"""Upsert runs of a stream, merged level by level.

Every micro-batch is one run of level 0. As soon as a level holds ``fanout``
runs, they are merged into one run of the next level, which keeps the latest row
per key. After n batches at most fanout - 1 runs per level are live, on about
log(n) levels, and a row is rewritten once per level.

A run names the batches it holds and is published by a marker file, which is
created when all its rows are written. Published runs that lie inside a wider
published one are replaced by it. So a reader sees either the parts or the whole,
and a run that was not published is written again.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.sources.state import PUBLISHED, _fs

FANOUT = 8
BATCH = "_batch"


@dataclass(frozen=True, order=True)
class Run:
    first: int
    last: int
    level: int

    def folder(self, path: str) -> str:
        return f"{path}/run={self.level}-{self.first}-{self.last}"

    def holds(self, other: Run) -> bool:
        return self.first <= other.first and other.last <= self.last and self.level > other.level


def published_runs(spark: SparkSession, path: str) -> list[Run]:
    fs, Path = _fs(spark, path)
    if not fs.exists(Path(path)):
        return []
    found = []
    for status in fs.listStatus(Path(path)):
        match = re.fullmatch(r"run=(\d+)-(\d+)-(\d+)", status.getPath().getName())
        if match:
            run = Run(int(match[2]), int(match[3]), int(match[1]))
            if fs.exists(Path(f"{run.folder(path)}/{PUBLISHED}")):
                found.append(run)
    return sorted(found)


def live_runs(spark: SparkSession, path: str) -> list[Run]:
    """Published runs that no wider one replaces, in the order of their batches."""
    found = published_runs(spark, path)
    return [run for run in found if not any(other.holds(run) for other in found)]


def latest(rows: DataFrame, key: str, ts: str) -> DataFrame:
    """Latest row per key; a later batch wins equal times."""
    rest = [c for c in rows.columns if c not in (key, ts, BATCH)]
    best = rows.groupBy(key).agg(F.max(F.struct(ts, BATCH, *rest)).alias("_row"))
    return best.select(key, *[F.col(f"_row.{c}").alias(c) for c in (ts, *rest, BATCH)])


def write_run(rows: DataFrame, path: str, run: Run) -> None:
    """Write the rows whole, then publish the run."""
    rows.write.mode("overwrite").parquet(run.folder(path))
    fs, Path = _fs(rows.sparkSession, path)
    fs.create(Path(f"{run.folder(path)}/{PUBLISHED}"), True).close()


def is_merged(spark: SparkSession, path: str, batch_id: int) -> bool:
    """Whether a batch already is part of a merged run."""
    return any(run.level and run.first <= batch_id <= run.last for run in published_runs(spark, path))


def merge_full_levels(spark: SparkSession, path: str, schema: str, key: str, ts: str, fanout: int = FANOUT) -> None:
    """Merge every level that holds ``fanout`` runs, from the lowest up.

    Replaced runs are deleted after the merged one is published, and also when
    a stopped attempt has left them.
    """
    fs, Path = _fs(spark, path)
    while True:
        live = live_runs(spark, path)
        for run in published_runs(spark, path):
            if run not in live:
                fs.delete(Path(run.folder(path)), True)
        levels: dict[int, list[Run]] = {}
        for run in live:
            levels.setdefault(run.level, []).append(run)
        full = min((level for level, runs in levels.items() if len(runs) >= fanout), default=None)
        if full is None:
            return
        runs = levels[full]
        rows = spark.read.schema(schema).parquet(*[run.folder(path) for run in runs])
        write_run(latest(rows, key, ts), path, Run(runs[0].first, runs[-1].last, full + 1))
