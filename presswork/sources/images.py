"""Image files and the image table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from presswork.operators.ids import assign_ids
from presswork.schema import CONTENT_IMAGES, IMAGE_FILES, conform
from presswork.sources.tables import read_table


def image_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(image_url, image_data) of every file under a folder that is not empty.

    ``image_url`` is where the file lies, as Spark spells it. Empty files are left out by
    their length, before any bytes are read.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
        .load(folder)
        .where("length > 0")
    )
    return files.select(F.col("path").alias("image_url"), F.col("content").alias("image_data"))


def numbered_images(files: DataFrame) -> DataFrame:
    """(image_url, image_data) as rows to store: with a place of their own, a digest and a length.

    Empty ones are left out. The place must be written before it is used; it rises with
    the files, so that a few places are read from few of them.
    """
    return files.where(F.octet_length("image_data") > 0).select(
        F.monotonically_increasing_id().alias("place"), "image_url", F.sha2("image_data", 256).alias("digest"),
        F.octet_length("image_data").alias("n_bytes"), "image_data")


def write_images(files: DataFrame, path: str) -> None:
    """Write the bytes once, where they are read; nothing is shuffled."""
    numbered_images(files).write.mode("overwrite").parquet(path)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, IMAGE_FILES, keep=("batch",))


def new_images(stored: DataFrame, owners: DataFrame, after: int = 0) -> DataFrame:
    """Rows to append to the image table, without their bytes but with the place of these.

    ``stored`` are written images, of which only narrow columns are read; ``owners`` is
    (content_id, image_url). Each image of a URL and item gets an id of its own; the same
    bytes there are one image, by their digest.
    """
    keys = ["content_id", "image_url", "digest"]
    linked = stored.select("image_url", "digest", "n_bytes", "place").join(
        owners.select("content_id", "image_url").distinct(), "image_url")
    each = linked.groupBy(*keys).agg(F.min("place").alias("place"), F.max("n_bytes").alias("n_bytes"))
    return assign_ids(each, keys, after=after).select("id", *keys, "n_bytes", "place")


def with_bytes(images: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of the image table with their bytes, fetched by place (and batch, if there is one)."""
    at = [c for c in ("batch", "place") if c in images.columns and c in stored.columns]
    return conform(stored.select(*at, "image_data").join(images, at), CONTENT_IMAGES)


def images_of(images: DataFrame, stored: DataFrame, content_id: int) -> DataFrame:
    """The image bytes of one item; no row when it has none."""
    return with_bytes(images.where(F.col("content_id") == content_id), stored).select("image_data")


def images_by_item(content: DataFrame, images: DataFrame) -> DataFrame:
    """(id, image_data) rows for every item, NULL for items without an image.

    One row per image rather than a list, which could outgrow a task. An item
    may hold any share of all images, so images keep to the side of the join
    that adaptive execution can split, and items without any come from their own
    join with the image owners, each once.
    """
    linked = images.select(F.col("content_id").alias("id"), "image_data")
    items = content.select("id")
    without = items.join(linked.select("id").distinct(), "id", "left_anti")
    return linked.join(items, "id", "left_semi").unionByName(
        without.withColumn("image_data", F.lit(None).cast("binary")))
