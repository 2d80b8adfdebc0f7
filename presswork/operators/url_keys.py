"""The URLs that are stored, as a narrow table in folders by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from presswork.operators.sieve import sieve
from presswork.sources.tables import read_table

#: Folders that URLs are dealt to.
FOLDERS = 64
URL_KEYS = T.StructType([T.StructField("url", T.StringType()), T.StructField("id", T.LongType())])


def url_folder(url: Column) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(FOLDERS)).cast("int")


def write_url_keys(content: DataFrame, path: str) -> None:
    """Write (url, id) of rows with a URL, one file to a folder; nothing else of them is read."""
    keys = content.where(F.col("url").isNotNull()).select("url", "id", url_folder(F.col("url")).alias("folder"))
    keys.repartition("folder").write.mode("overwrite").partitionBy("folder").parquet(path)


def read_url_keys(spark: SparkSession, path: str) -> DataFrame:
    """(url, id, folder) and, under a corpus folder, the batch."""
    return read_table(spark, path, URL_KEYS, keep=("folder", "batch"))


def keys_of_url(keys: DataFrame, url: str) -> DataFrame:
    """The rows of one URL; a single folder is read."""
    return keys.where((F.col("folder") == url_folder(F.lit(url))) & (F.col("url") == url))


def among(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """The stored ``url`` values that may be among those of ``wanted``, which is small and written.

    Folders that none of them falls into are not read, and a sieve of them is put before
    the first shuffle, so what moves grows with the batch and not with the corpus.
    ``stored`` is a key table, or any table with ``url``.
    """
    if "folder" in stored.columns:
        # At most FOLDERS numbers.
        folders = wanted.where("url IS NOT NULL").select(url_folder(F.col("url")).alias("folder")).distinct()
        stored = stored.where(F.col("folder").isin([row.folder for row in folders.collect()]))
    return sieve(stored.select("url"), "url", wanted)
