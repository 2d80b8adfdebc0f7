"""Dense surrogate ids at scale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from presswork.session import durable


def highest_id(df: DataFrame, column: str = "id") -> int:
    """The largest id in use, 0 for an empty table."""
    return df.agg(F.max(column)).first()[0] or 0


def assign_ids(df: DataFrame, order_by: list[str | Column], after: int = 0,
               name: str = "id") -> DataFrame:
    """Number rows ``after + 1, after + 2, ...`` in the given order, without gaps.

    The order must be total. Rows are range-partitioned and sorted, kept in the
    checkpoint folder so that a lost executor cannot renumber them, and counted
    per partition; the running total over those counts is the only thing that
    meets in one task, one row per partition. Pass keys rather than wide rows
    and join the payload by key afterwards.
    """
    ordered = durable(df.orderBy(*order_by))
    placed = ordered.select(
        "*", F.spark_partition_id().alias("_part"),
        F.monotonically_increasing_id().alias("_row"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part").agg(F.count("*").alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    # One row per partition of the sort, so always small enough to broadcast.
    numbered = placed.join(F.broadcast(offsets), "_part")
    in_part = F.col("_row") - F.shiftleft(F.col("_part").cast("long"), 33)
    number = (F.lit(after) + F.col("_offset") + in_part + 1).cast("long")
    return numbered.withColumn(name, number).drop("_part", "_row", "_offset")
