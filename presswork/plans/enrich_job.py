"""Storing what enrichment gives: translations, generated tags, and images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from presswork.operators.enrich import tag_results
from presswork.operators.sieve import sieve
from presswork.operators.tags import (
    TAG_REASONS, TAG_TARGET, create_missing_tags, explode_tags, new_links, rejected_tags, short_tag_lists,
    tag_ids)
from presswork.operators.translations import latest_translations, with_translations
from presswork.plans.ingest_job import BatchWriter, corpus_table, highest_stored
from presswork.schema import CONTENT, IMAGE_ROWS
from presswork.session import durable, durable_table, scratch, shared_folder
from presswork.sources.images import new_images, numbered_images, read_images
from presswork.sources.tables import read_table


def _stored_ids(spark: SparkSession, root: str, ids: DataFrame) -> DataFrame:
    """(id, batch, day) of stored content whose id may be among ``ids`` (one column, id)."""
    places = read_table(spark, f"{root}/content", CONTENT, keep=("batch", "day"))
    return sieve(places.select("id", "batch", "day"), "id", ids).join(ids, "id", "left_semi")


def store_translations(updates: DataFrame, root: str) -> int:
    """Set the last translation of each item in a corpus folder; gives the number of folders rewritten.

    Updates are (content_id, translation, seq); unknown ids change nothing. The narrow set
    of updated ids tells which folders hold one, from the ids of the content alone. Only
    those are read whole, joined, and written to a new place, from which they then replace
    the old ones; files of other folders stay as they are. A run that is repeated, also
    after it was broken off, gives the same.
    """
    spark = updates.sparkSession
    with scratch(spark):
        last = durable_table(latest_translations(updates))
        ids = durable(last.select(F.col("content_id").alias("id")).where("id IS NOT NULL"))
        touched = durable(_stored_ids(spark, root, ids).select("batch", "day").distinct())
        # One row for each folder, which the driver has listed anyway.
        folders = touched.collect()
        if not folders:
            return 0
        content = read_table(spark, f"{root}/content", CONTENT, keep=("batch", "day"))
        on_day = F.col("day").isin([f.day for f in folders if f.day])
        if any(f.day is None for f in folders):
            on_day |= F.col("day").isNull()
        same = touched.toDF("_batch", "_day")
        content = content.where(on_day & F.col("batch").isin([f.batch for f in folders])).join(
            F.broadcast(same), (F.col("batch") == F.col("_batch")) & F.col("day").eqNullSafe(F.col("_day")), "left_semi")
        path = shared_folder(spark, "updated")
        rows = with_translations(content, last)
        rows.hint("rebalance", "batch", "day").write.partitionBy("batch", "day").parquet(path)
        (spark.read.schema(rows.schema).parquet(path).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch", "day").parquet(f"{root}/content"))
        return len(folders)


def store_generated_tags(replies: DataFrame, root: str, batch: int) -> None:
    """Add the tags that replies (content_id, seq, response) hold, up to the target of each item.

    A batch of its own, with new tags and links, tags that were turned away, and its
    counts in the ledger. Items that are not stored, or have enough tags, get none.
    Only their ids, tags and links are read.
    """
    spark = replies.sparkSession
    with scratch(spark):
        writer = BatchWriter(spark, root, batch)
        tags = corpus_table(spark, root, "tags", batch)
        links = corpus_table(spark, root, "content_tags", batch)
        ids = durable(replies.select(F.col("content_id").alias("id")).distinct())
        known = _stored_ids(spark, root, ids).select(F.col("id").alias("content_id"))
        own = durable(links.join(known, "content_id", "left_semi"))
        full = own.groupBy("content_id").agg(F.count("*").alias("_n")).where(F.col("_n") >= TAG_TARGET)
        items = known.join(full.select("content_id"), "content_id", "left_anti").join(
            short_tag_lists(own, tags), "content_id", "left")
        results = durable(tag_results(items, replies))
        wanted = durable(explode_tags(results))
        fresh = durable(create_missing_tags(wanted, tags, highest_stored(spark, root, "tags", batch)))
        writer.write("tags", fresh, ids="id")
        every = tags.select("id", "tag").unionAll(fresh)
        writer.write("content_tags", new_links(tag_ids(wanted, every), links))
        writer.write("rejected_tags", rejected_tags(results), reason="reject_reason", reasons=TAG_REASONS)
        writer.close()


def store_images(files: DataFrame, owners: DataFrame, root: str, batch: int) -> None:
    """Add image files (image_url, image_data) and rows for their owners (content_id, image_url).

    The bytes are written once and not moved again; ids are joined to their digests.
    """
    spark = files.sparkSession
    with scratch(spark):
        writer = BatchWriter(spark, root, batch)
        writer.write("image_files", numbered_images(files))
        stored = read_images(spark, writer.path("image_files"))
        rows = new_images(stored, owners, after=highest_stored(spark, root, "content_images", batch))
        writer.write("content_images", rows, ids="id")
        writer.close()


def stored_images(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """The image table of a corpus folder and the bytes that it points to."""
    return (read_table(spark, f"{root}/content_images", IMAGE_ROWS, keep=("batch",)),
            read_images(spark, f"{root}/image_files"))
