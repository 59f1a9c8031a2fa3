"""Joins, rankings and running totals that survive hot keys.

Any single key may hold a large share of all rows. Nothing here gathers the
rows of one key in one task: lookups of hot keys are spread by a salt, top-n
lists are cut per salt first, and global orders are built from ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.base import as_col
from pagewright.session import cut_lineage

# A key is hot when it holds this many rows; at most HOT_KEYS of them are
# treated, which bounds what is broadcast.
HOT_ROWS = 200_000
HOT_KEYS = 1_000
SALTS = 64
# Row bound under which a side is broadcast. It is always counted first.
BROADCAST_ROWS = 200_000


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint when a count proves the side small, else unchanged."""
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df


def row_salt(df: DataFrame, salts: int = SALTS) -> Column:
    """Salt computed from the row itself, so a retried task repeats it."""
    plain = [c for c, t in df.dtypes if not t.startswith(("map", "variant"))]
    return F.pmod(F.xxhash64(*[F.col(c) for c in plain]), F.lit(salts)).cast("int")


def lookup(
    big: DataFrame,
    small: DataFrame,
    keys: list[str],
    weight: str,
    how: str = "left",
    hot_rows: int = HOT_ROWS,
    salt_from: list[str] | None = None,
) -> DataFrame:
    """Join ``big`` to ``small``, which has one row per key.

    ``weight`` is the column of ``small`` that counts the matching rows of
    ``big``. The heaviest keys are salted on both sides, so no join task holds
    a whole hot key.
    """
    hot = (
        small.filter(F.col(weight) >= hot_rows)
        .select(*keys, weight)
        .orderBy(F.desc(weight))
        .limit(HOT_KEYS)
        .select(*keys, F.lit(True).alias("_hot"))
    )
    salt = (
        F.pmod(F.xxhash64(*salt_from), F.lit(SALTS)).cast("int") if salt_from else row_salt(big)
    )
    left = (
        big.join(F.broadcast(hot), keys, "left")
        .withColumn("_salt", F.when(F.col("_hot"), salt).otherwise(0))
        .drop("_hot")
    )
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = (
        small.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    )
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def top_per_group(
    df: DataFrame, keys: list[str], order: list[Column], n: int, salts: int = SALTS, rank: str | None = None
) -> DataFrame:
    """First ``n`` rows per key: cut within salts, then within the key."""
    first = Window.partitionBy(*keys, "_salt").orderBy(*order)
    second = Window.partitionBy(*keys).orderBy(*order)
    out = (
        df.withColumn("_salt", row_salt(df, salts))
        .withColumn("_rn", F.row_number().over(first))
        .filter(F.col("_rn") <= n)
        .withColumn("_rn", F.row_number().over(second))
        .filter(F.col("_rn") <= n)
        .drop("_salt")
    )
    return out.withColumnRenamed("_rn", rank) if rank else out.drop("_rn")


def running_total(df: DataFrame, order: list[str], value: Column | str, out: str) -> DataFrame:
    """Running sum over a global order without a single-task window.

    Rows are cut into ranges of the order, each range is summed, and only the
    range sums (one row per partition) are accumulated on their own.
    ``order`` has to be unique.
    """
    ranged = cut_lineage(
        df.withColumn("_v", as_col(value))
        .repartitionByRange(*[F.col(c) for c in order])
        .withColumn("_part", F.spark_partition_id())
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("_part")
        .agg(F.sum("_v").alias("_sum"))
        .withColumn("_offset", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
        .select("_part", "_offset")
    )
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # One row per partition of the job: the side to broadcast is bounded by that.
    return (
        ranged.join(F.broadcast(offsets), "_part")
        .withColumn(out, F.sum("_v").over(within) + F.col("_offset"))
        .drop("_part", "_v", "_offset")
    )
