"""Writing translations back to the content table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from presswork.operators.latest import latest


def latest_translations(updates: DataFrame) -> DataFrame:
    """(content_id, translation): the last translation per item by ``seq``."""
    return latest(updates, "content_id", "seq", "translation").select("content_id", "translation")


def apply_translations(content: DataFrame, updates: DataFrame) -> DataFrame:
    """``content`` with ``content_persian`` set where an update names the id.

    Updates are (content_id, translation, seq); unknown ids change nothing. All of
    ``content`` goes through a join; in a corpus folder, ``store_translations`` rewrites
    the folders with an updated item only.
    """
    return with_translations(content, latest_translations(updates))


def with_translations(content: DataFrame, last: DataFrame) -> DataFrame:
    """The same with one (content_id, translation) per item."""
    hits = last.select(F.col("content_id").alias("_of"), F.lit(True).alias("_hit"), F.col("translation").alias("_text"))
    text = F.when(F.col("_hit"), F.col("_text")).otherwise(F.col("content_persian"))
    return content.join(hits, F.col("id") == F.col("_of"), "left").withColumn(
        "content_persian", text).select(*content.columns)
