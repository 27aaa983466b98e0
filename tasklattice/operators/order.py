"""Places in an order, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tasklattice.workspace import cut

BROADCAST_ROWS = 100_000


def numbered(df: DataFrame, order: list[str | Column], name: str, per: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with its place, from 0, in the order of each group of ``per``, or of all rows.

    Rows are dealt by ranges of (per, order), so a group of any size spreads over
    tasks; a group's places go on from what the partitions before hold of it.
    """
    ordered = cut(df.orderBy(*per, *order).withColumns({"_part": F.spark_partition_id(), "_own": F.monotonically_increasing_id()}))
    held = ordered.groupBy("_part", *per).agg(F.count("*").alias("_n"), F.min("_own").alias("_low"))
    before = F.sum("_n").over(Window.partitionBy(*per).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    shifts = held.withColumn("_shift", F.coalesce(before, F.lit(0)) - F.col("_low"))
    shifts = cut(shifts.select(F.col("_part").alias("_in"), "_shift", *[F.col(c).alias(f"_of_{c}") for c in per]))
    same = F.col("_part") == F.col("_in")
    for c in per:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    if shifts.count() <= BROADCAST_ROWS:
        shifts = F.broadcast(shifts)
    placed = ordered.join(shifts, same).withColumn(name, F.col("_own") + F.col("_shift"))
    return placed.drop("_part", "_own", "_in", "_shift", *[f"_of_{c}" for c in per])
