"""The last row of every key, found without moving its texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from presswork.session import durable_table


def _rank(order: Column, text: Column) -> Column:
    """One decimal that sorts by the order, NULL first, then by 60 bits of a digest of the text."""
    first = F.coalesce(order.cast("long"), F.lit(-2 ** 63)).cast("decimal(20,0)")
    digest = F.shiftrightunsigned(F.xxhash64(text), 4)
    return (first * F.lit(2 ** 60).cast("decimal(19,0)") + digest.cast("decimal(19,0)")).cast("decimal(38,0)")


def latest(rows: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """The row with the greatest ``order`` of each ``key``; of several, one chosen by a digest of the text.

    The rows are written once with a number. Only the key, a rank and that number go
    through hash aggregations, which reduce before they shuffle, so a key may hold most
    rows; texts move once, when the rows of the numbers that are left are fetched.
    """
    stored = durable_table(rows.withColumn("_row", F.monotonically_increasing_id()))
    ranked = durable_table(stored.select(key, _rank(F.col(order), F.col(text)).alias("_rank"), "_row"))
    best = ranked.groupBy(key).agg(F.max("_rank").alias("_rank"))
    same = ranked.join(best, (ranked[key].eqNullSafe(best[key])) & (ranked["_rank"] == best["_rank"]), "left_semi")
    chosen = same.groupBy(key).agg(F.min("_row").alias("_row")).select("_row")
    return stored.join(chosen, "_row", "left_semi").select(*rows.columns)
