"""The four tables of the corpus and how a frame is brought to one of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

CONTENT = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("title", T.StringType()),
    T.StructField("title_persian", T.StringType()),
    T.StructField("date", T.TimestampNTZType()),
    T.StructField("content", T.StringType()),
    T.StructField("content_persian", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("views", T.IntegerType()),
    T.StructField("source", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("summary_persian", T.StringType()),
    T.StructField("final_score", T.DoubleType()),
    T.StructField("type", T.StringType()),
])

CONTENT_IMAGES = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("content_id", T.LongType()),
    T.StructField("image_url", T.StringType()),
    T.StructField("image_data", T.BinaryType()),
])

# How images are kept: their bytes once, and rows that name the place of these.
IMAGE_FILES = T.StructType([
    T.StructField("place", T.LongType()),
    T.StructField("image_url", T.StringType()),
    T.StructField("digest", T.StringType()),
    T.StructField("n_bytes", T.IntegerType()),
    T.StructField("image_data", T.BinaryType()),
])
IMAGE_ROWS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("content_id", T.LongType()),
    T.StructField("image_url", T.StringType()),
    T.StructField("digest", T.StringType()),
    T.StructField("n_bytes", T.IntegerType()),
    T.StructField("place", T.LongType()),
])

TAGS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("tag", T.StringType()),
])

CONTENT_TAGS = T.StructType([
    T.StructField("content_id", T.LongType(), False),
    T.StructField("tag_id", T.LongType(), False),
])

# Longest text each bounded column holds, in UTF-16 units.
TEXT_LIMITS = {
    "title": 255,
    "title_persian": 255,
    "url": 500,
    "author": 255,
    "source": 255,
    "type": 100,
}
TAG_LIMIT = 255


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with exactly the columns of ``schema``, in its order and types.

    Columns the frame lacks come in as NULL and columns the schema lacks go,
    which is how files of an older or narrower layout join the current table.
    """
    present = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ])


def union_conformed(schema: T.StructType, *frames: DataFrame) -> DataFrame:
    """All rows of frames of different layout vintages under one schema."""
    first, *rest = [conform(df, schema) for df in frames]
    for df in rest:
        first = first.unionAll(df)
    return first
