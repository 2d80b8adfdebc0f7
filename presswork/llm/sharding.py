"""Contiguous shards of nearly equal byte size, from prefix sums of sizes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from presswork.llm.workers import map_batches
from presswork.session import durable, durable_table


def document_size(text: str | Column) -> Column:
    """UTF-8 bytes of a text plus eight for its record header; NULL counts as no bytes."""
    column = F.col(text) if isinstance(text, str) else text
    return (F.coalesce(F.octet_length(column), F.lit(0)) + 8).cast("long")


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds each row's partition, and the bytes and rows before it in that partition."""
    part = TaskContext.get().partitionId()
    bytes_before = rows_before = 0
    for batch in batches:
        n = batch.num_rows
        sizes = batch.column("size").to_numpy()
        ends = np.cumsum(sizes) + bytes_before
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(ends - sizes),
             pa.array(np.arange(rows_before, rows_before + n))],
            names=[*batch.schema.names, "part", "bytes_before", "rows_before"])
        if n:
            bytes_before, rows_before = int(ends[-1]), rows_before + n


def shard_by_bytes(sizes: DataFrame, n_shards: int, order_by: list[str],
                   size: str = "size") -> DataFrame:
    """Cut rows, in the given order, into ``n_shards`` runs of nearly equal size.

    ``sizes`` holds one narrow row per record: the order columns and a positive
    ``size``. Rows are range-partitioned and sorted, kept in the checkpoint folder
    so that a rerun task sees the same rows, and summed up per partition; prefix
    sums run over one row per partition, then inside each partition. A row goes to
    the shard in which its middle byte falls, so a shard is off its equal share by
    one record at most. Adds ``shard`` (int, from 0) and ``slot`` (long, gapless
    from 0 within the shard), which replace columns of those names.

    Equal keys are split like any others, so one order key may hold most rows. NULL
    keys come first. Rows that agree in all order columns are placed in any order
    among themselves. A record larger than the share leaves shards empty. An empty
    table gives an empty table. A NULL size counts as 0.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    kept = [c for c in sizes.columns if c not in ("shard", "slot")]
    values = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("record")
    # Kept, since the sort reads its input twice and wide texts may stand behind it.
    keyed = durable_table(sizes.select(
        values, F.coalesce(F.col(f"`{size}`"), F.lit(0)).cast("long").alias("size")))
    ordered = durable(keyed.orderBy(*[F.col("record").getField(c) for c in order_by]))
    schema = f"record {ordered.schema['record'].dataType.simpleString()}, size long, " \
             "part int, bytes_before long, rows_before long"
    placed = map_batches(ordered, _running, schema)
    totals = ordered.groupBy(F.spark_partition_id().alias("part")).agg(
        F.sum("size").alias("part_bytes"), F.count("*").alias("part_rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("part").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("part_bytes").over(before), F.lit(0)).alias("bytes_offset"),
        F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("rows_offset"),
        F.sum("part_bytes").over(whole).alias("all_bytes"))
    exact = "decimal(38,0)"
    # One row per partition of the sort.
    located = placed.join(F.broadcast(offsets), "part").select(
        "record", (F.col("rows_before") + F.col("rows_offset")).alias("row"),
        F.expr(f"least({n_shards - 1}, cast((cast(2 * (bytes_before + bytes_offset) + size AS {exact}) "
               f"* {n_shards}) DIV greatest(2 * all_bytes, 1) AS int))").alias("shard"))
    located = durable_table(located)
    firsts = located.groupBy("shard").agg(F.min("row").alias("first_row"))
    # One row per shard.
    return located.join(F.broadcast(firsts), "shard").select(
        "record.*", "shard", (F.col("row") - F.col("first_row")).cast("long").alias("slot"))
