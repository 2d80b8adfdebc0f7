"""The tag dimension, its bridge to content, and tagging quotas.

The tag table grows with the corpus, so no join here asks for a broadcast: the
optimizer broadcasts it while its size allows and otherwise shuffles, with
adaptive skew handling for tags that many items share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from presswork.functions.text import utf16_units
from presswork.operators.collation import collated
from presswork.operators.ids import assign_ids, highest_id
from presswork.schema import TAG_LIMIT

# Tags an article should have, and how a tag line is joined.
TAG_TARGET = 7
TAG_LINE_SEPARATOR = " ,"


#: Every reason for which a tag is turned away.
TAG_REASONS = ("tag_missing", "tag_too_long")


def _judged(items: DataFrame, tags_column: str) -> DataFrame:
    """(content_id, pos, tag, reject_reason); no reason for a tag that can be stored."""
    missing, too_long = TAG_REASONS
    reason = F.when(F.col("tag").isNull(), missing).when(utf16_units(F.col("tag")) > TAG_LIMIT, too_long)
    return items.select("content_id", F.posexplode(tags_column).alias("pos", "tag")).withColumn("reject_reason", reason)


def explode_tags(items: DataFrame, tags_column: str = "tags") -> DataFrame:
    """(content_id, pos, tag) rows from a list column, unusable tags left out."""
    return _judged(items, tags_column).where(F.col("reject_reason").isNull()).drop("reject_reason")


def rejected_tags(items: DataFrame, tags_column: str = "tags") -> DataFrame:
    """(content_id, pos, tag, reject_reason) of the tags that ``explode_tags`` leaves out."""
    return _judged(items, tags_column).where(F.col("reject_reason").isNotNull())


def create_missing_tags(wanted: DataFrame, tags: DataFrame, after: int | None = None,
                        collation: str | None = None) -> DataFrame:
    """(id, tag) rows for wanted tags the table does not have yet.

    Existing ids never change; new ones follow the highest in use (``after``, or looked
    up), by tag. Under a ``collation`` tags that it calls equal are one, spelled like the
    first of them in byte order.
    """
    fresh = wanted.where(F.col("tag").isNotNull()).select("tag").distinct()
    if collation is not None:
        # Distinct spellings only, so few rows share a group.
        alike = Window.partitionBy(collated(F.col("tag"), collation)).orderBy("tag")
        fresh = fresh.withColumn("_nth", F.row_number().over(alike)).where("_nth = 1").drop("_nth")
    known = tags.select(collated(F.col("tag"), collation).alias("_known"))
    fresh = fresh.join(known, collated(F.col("tag"), collation) == F.col("_known"), "left_anti")
    return assign_ids(fresh, ["tag"], after=highest_id(tags) if after is None else after).select("id", "tag")


def tag_ids(wanted: DataFrame, tags: DataFrame, collation: str | None = None) -> DataFrame:
    """Wanted rows with the ``tag_id`` of their tag; order them by ``pos``."""
    if collation is None:
        return wanted.join(tags.select(F.col("id").alias("tag_id"), "tag"), "tag")
    known = tags.select(F.col("id").alias("tag_id"), collated(F.col("tag"), collation).alias("_known"))
    return wanted.join(known, collated(F.col("tag"), collation) == F.col("_known")).drop("_known")


def new_links(pairs: DataFrame, content_tags: DataFrame) -> DataFrame:
    """(content_id, tag_id) pairs to append: each once, none already there."""
    keys = ["content_id", "tag_id"]
    return pairs.select(*keys).distinct().join(content_tags.select(*keys), keys, "left_anti")


def tags_of(content_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """(content_id, tag) for every link; filter by content_id for one item."""
    known = tags.select(F.col("id").alias("tag_id"), "tag")
    return content_tags.join(known, "tag_id").select("content_id", "tag")


def tag_lines(content_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """One text per item with its tags in order, as the detail page shows them.

    The text of an item is as long as its tags; for anything but display use
    ``tags_of``, which never brings an item's tags together.
    """
    return (
        tags_of(content_tags, tags)
        .groupBy("content_id")
        .agg(F.array_join(F.array_sort(F.collect_list("tag")), TAG_LINE_SEPARATOR)
             .alias("tag_line"))
    )


def tag_quota(existing: Column) -> Column:
    """How many tags are still to be found for an item with this tag list."""
    return F.greatest(F.lit(TAG_TARGET) - F.coalesce(F.size(existing), F.lit(0)), F.lit(0))


def under_tagged(content_ids: DataFrame, content_tags: DataFrame) -> DataFrame:
    """Items with fewer than the wanted number of tags and how many they lack.

    ``content_ids`` needs only ``id``, so no text moves. Links are counted
    before the join, in part before the shuffle.
    """
    counts = content_tags.groupBy(F.col("content_id").alias("id")).agg(
        F.count("*").alias("n_tags"))
    n_tags = F.coalesce(F.col("n_tags"), F.lit(0))
    return (
        content_ids.select("id").join(counts, "id", "left")
        .where(n_tags < TAG_TARGET)
        .select("id", n_tags.alias("n_tags"), (F.lit(TAG_TARGET) - n_tags).alias("to_generate"))
    )


def short_tag_lists(content_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """(content_id, existing_tags) for tagged items still below the target.

    Items at the target are removed before lists are built, so no list holds
    more than a handful of tags.
    """
    below = (
        content_tags.groupBy("content_id").agg(F.count("*").alias("_n"))
        .where(F.col("_n") < TAG_TARGET).select("content_id")
    )
    return (
        tags_of(content_tags, tags).join(below, "content_id", "left_semi")
        .groupBy("content_id")
        .agg(F.array_sort(F.collect_list("tag")).alias("existing_tags"))
    )
