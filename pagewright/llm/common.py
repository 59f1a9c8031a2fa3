"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.session import ensure_checkpoint_dir

# Words everywhere: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries run inside go when each of them ends.

    Otherwise they stay until the driver happens to collect its garbage.
    """
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def stored(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write a table into the session's shared folder and read it back.

    The files outlive lost executors, so work before this point is not redone.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Delete the files of ``stored`` tables of this run that no later step reads."""
    for df in tables:
        context = df.sparkSession.sparkContext
        for file in df.inputFiles()[:1]:
            folder = context._jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and leave every other character alone."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names near ``names`` that ``df`` does not use."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def prefix_sums(df: DataFrame, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Inclusive running sums over a global order, without a single-task window.

    Rows are cut into ranges of ``order`` (which has to be unique); only one
    row per range is accumulated on its own.
    """
    part, *values = fresh(df, "_part", *[f"_v{i}" for i in range(len(sums))])
    before = [f"{v}_before" for v in values]
    ranged = stored(
        df.withColumns(dict(zip(values, sums.values())))
        .repartitionByRange(*[F.col(c) for c in order])
        .withColumn(part, F.spark_partition_id()),
        "ranges",
    )
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(part)
        .agg(*[F.sum(v).alias(v) for v in values])
        .select(part, *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(b) for v, b in zip(values, before)])
    )
    within = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # One row per partition of the job: the broadcast side is bounded by that.
    return (
        ranged.join(F.broadcast(offsets), part)
        .withColumns({out: F.sum(v).over(within) + F.col(b) for out, v, b in zip(sums, values, before)})
        .drop(part, *values, *before)
    )


# Slots in a row of a table of slots on its way to the driver.
TABLE_ROW_BITS = 12


def _table_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for cells in batch.column("cells").to_pylist():
            row = np.zeros(1 << TABLE_ROW_BITS, dtype=np.uint8)
            for cell in cells:
                row[cell["slot"] & ((1 << TABLE_ROW_BITS) - 1)] = cell["value"]
            out.append(row.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.binary())], ["row", "cells"])


def byte_table(values: DataFrame, bits: int) -> bytes:
    """2^bits bytes from rows (slot long, value int), one per slot; else zero.

    The caller bounds ``bits``, and with it what the driver receives. Rows of
    slots are put together on executors.
    """
    rows = (
        values.groupBy(F.shiftright("slot", TABLE_ROW_BITS).alias("row"))
        .agg(F.collect_list(F.struct("slot", "value")).alias("cells"))
        .mapInArrow(_table_rows, "row long, cells binary")
    )
    table = np.zeros((1 << (bits - TABLE_ROW_BITS), 1 << TABLE_ROW_BITS), dtype=np.uint8)
    for row in rows.collect():
        table[row.row] = np.frombuffer(row.cells, dtype=np.uint8)
    return table.tobytes()
