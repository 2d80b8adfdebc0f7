"""Adding batches of records to the corpus folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from presswork.operators.ids import highest_id
from presswork.operators.ingest import REASONS, ingest, stage_items
from presswork.operators.tags import TAG_REASONS
from presswork.operators.url_keys import read_url_keys, write_url_keys
from presswork.schema import CONTENT, CONTENT_TAGS, TAGS, conform
from presswork.session import TEXT_CODEC, scratch
from presswork.sources.tables import read_table

_TABLES = {"content": CONTENT, "tags": TAGS, "content_tags": CONTENT_TAGS}

#: What each batch stored in a table (no reason) and turned away (by reason), and its highest id.
LEDGER = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("reason", T.StringType()),
    T.StructField("rows", T.LongType()), T.StructField("highest", T.LongType())])


def _before(rows: DataFrame, batch: int | None) -> DataFrame:
    return rows if batch is None or "batch" not in rows.columns else rows.where(F.col("batch") < batch)


def corpus_table(spark: SparkSession, root: str, name: str,
                 before_batch: int | None = None) -> DataFrame:
    """One of content, tags and content_tags under a corpus folder."""
    rows = read_table(spark, f"{root}/{name}", _TABLES[name], keep=("day", "batch"))
    return _before(rows, before_batch).drop("batch")


def ledger(spark: SparkSession, root: str, before_batch: int | None = None) -> DataFrame:
    """(batch, name, reason, rows, highest): a few rows for every batch that has ended."""
    rows = read_table(spark, f"{root}/ledger", LEDGER, keep=("batch",))
    if "batch" not in rows.columns:
        rows = rows.withColumn("batch", F.lit(None).cast("int"))
    return _before(rows, before_batch)


def highest_stored(spark: SparkSession, root: str, name: str, before_batch: int | None = None) -> int:
    """The highest id of a table, from the ledger; the table itself is not read."""
    return highest_id(ledger(spark, root, before_batch).where(F.col("name") == name), "highest")


def stored_urls(spark: SparkSession, root: str, before_batch: int | None = None) -> DataFrame:
    """The URL keys of a corpus folder."""
    return _before(read_url_keys(spark, f"{root}/url_keys"), before_batch)


def _by_day(content: DataFrame) -> DataFrame:
    return conform(content, CONTENT).withColumn("day", F.to_date("date")).hint("rebalance", "day")


class BatchWriter:
    """Writes the tables of one batch, counts what goes into each, and enters that in the ledger.

    Every table gets a folder per batch, which a repeated run replaces. Rows are counted
    by the write itself (``DataFrame.observe``). The ledger is written last: a batch that
    is not in it has not ended and is to be run again.
    """

    def __init__(self, spark: SparkSession, root: str, batch: int):
        self.spark, self.root, self.batch, self.entries = spark, root, batch, []

    def path(self, name: str) -> str:
        return f"{self.root}/{name}/batch={self.batch}"

    def write(self, name: str, rows: DataFrame, partition: str | None = None, ids: str | None = None,
              reason: str | None = None, reasons: tuple[str, ...] = ()) -> int:
        """Write a table; with ``reason``, a column, its rows are counted for each of ``reasons``."""
        def number(value: Column) -> Column:
            return F.coalesce(F.sum(value.cast("long")), F.lit(0).cast("long"))
        seen = Observation()
        counted = rows.observe(
            seen, F.count(F.lit(1)).alias("rows"),
            F.max(F.col(ids) if ids else F.lit(None).cast("long")).alias("highest"),
            *[number(F.col(reason) == r).alias(r) for r in reasons])
        writer = counted.write.mode("overwrite").option("compression", TEXT_CODEC)
        (writer.partitionBy(partition) if partition else writer).parquet(self.path(name))
        got = seen.get
        if reason:
            self.entries += [(name, r, got.get(r) or 0, None) for r in reasons if got.get(r)]
        else:
            self.entries.append((name, None, got.get("rows") or 0, got.get("highest")))
        return got.get("rows") or 0

    def enter(self, name: str, reason: str, rows: int) -> None:
        if rows:
            self.entries.append((name, reason, rows, None))

    def close(self) -> None:
        entries = self.spark.createDataFrame(self.entries, LEDGER)
        entries.coalesce(1).write.mode("overwrite").parquet(self.path("ledger"))


def store_corpus(content: DataFrame, tags: DataFrame, content_tags: DataFrame, root: str,
                 batch: int = 0) -> None:
    """Put existing tables into a corpus folder as one batch, with its URL keys and ledger."""
    writer = BatchWriter(content.sparkSession, root, batch)
    writer.write("content", _by_day(content), partition="day", ids="id")
    writer.write("tags", conform(tags, TAGS), ids="id")
    writer.write("content_tags", conform(content_tags, CONTENT_TAGS))
    _write_keys(writer)
    writer.close()


def _write_keys(writer: BatchWriter) -> None:
    """The URL keys of the content just written, from two of its columns."""
    content = writer.spark.read.schema(CONTENT).parquet(writer.path("content"))
    write_url_keys(content, writer.path("url_keys"))


def ingest_batch(items: DataFrame, root: str, batch: int) -> None:
    """Add a batch of (seq, raw) records; running it again changes nothing.

    The records are parsed and written once; every table is made from that. Of earlier
    batches only URL keys, tags, links and the ledger are read. Batches go in one after
    the other. Nothing of it stays in the checkpoint folder.
    """
    spark = items.sparkSession
    with scratch(spark):
        staged = stage_items(items)
        rows = ingest(
            staged, stored_urls(spark, root, batch), corpus_table(spark, root, "tags", batch),
            corpus_table(spark, root, "content_tags", batch),
            after=highest_stored(spark, root, "content", batch),
            after_tag=highest_stored(spark, root, "tags", batch))
        writer = BatchWriter(spark, root, batch)
        stored = writer.write("content", _by_day(rows.content), partition="day", ids="id")
        writer.enter("content", "url_repeated", staged.accepted.count() - stored)
        writer.write("tags", rows.tags, ids="id")
        writer.write("content_tags", rows.content_tags)
        writer.write("rejected", rows.rejected, reason="reject_reason", reasons=REASONS)
        writer.write("rejected_tags", rows.rejected_tags, reason="reject_reason", reasons=TAG_REASONS)
        _write_keys(writer)
        writer.close()
