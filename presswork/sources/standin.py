"""The corpus tables as views over the general test tables.

Nothing is copied: each view is a plan over the parquet files of one folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from presswork.operators.binding import bind
from presswork.operators.ids import assign_ids
from presswork.operators.tags import explode_tags, tag_ids
from presswork.schema import CONTENT
from presswork.session import durable_table

# The fixed "now" of every time-bounded query.
AS_OF = "2024-01-15 00:00:00"

_FROM_EVENTS = {"date", "views", "final_score", "type"}
_FROM_PAGES = {"content", "url"}
_ITEM_COLUMNS = ("id", "title", "title_persian", "date", "content", "url", "author", "views",
                 "source", "summary", "summary_persian", "final_score", "type", "tags")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def content(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The content table, or some columns of it; ``tags`` can be asked for too.

    A table that only other columns come from is not joined; all joins are on
    unique keys and keep every document.
    """
    names = columns or tuple(CONTENT.fieldNames())
    doc = F.col("doc_id")
    second = (F.col("lang") != "en") | (doc % 3 == 0)
    first_line = F.split_part("text", F.lit("\n"), F.lit(1))
    every = {
        "id": doc,
        "title": F.when(F.col("lang") == "en", first_line),
        "title_persian": F.when(second, first_line),
        "date": F.when(doc % 97 != 0, F.col("ts")),
        "content": F.coalesce("html", "text"),
        "content_persian": F.when(second, F.col("text")).when(doc % 7 == 0, ""),
        "url": F.col("url"),
        "author": F.col("c_name"),
        "views": F.floor("value").cast("int"),
        "source": F.when(doc % 101 != 0, F.col("source")),
        "summary": F.when(F.col("lang") == "en", F.col("text")),
        "summary_persian": F.when(F.col("lang") != "en", F.col("text")),
        "final_score": F.when(doc % 89 != 0, F.col("value")),
        "type": F.col("event_type"),
        "tags": long_words(F.col("text")),
    }
    rows = table(spark, sf_dir, "documents").drop("n_chars")
    if _FROM_EVENTS & set(names):
        # Every fifth event, by the document's own number, so that all joins share one shuffle of the texts.
        events = table(spark, sf_dir, "events").where("event_id % 5 = 0").select(
            F.expr("event_id DIV 5").alias("event_doc"), "ts", "value", "event_type")
        rows = rows.join(events, F.col("event_doc") == doc, "left")
    if _FROM_PAGES & set(names):
        rows = rows.join(table(spark, sf_dir, "pages"), F.col("page_id") == doc, "left")
    if "author" in names:
        people = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
        rows = rows.join(people, F.col("c_custkey") == doc, "left")
    return rows.select(*[every[name].alias(name) for name in names])


def long_words(text: Column) -> Column:
    """The words that stand in for a document's tags: all of twelve letters or more."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]{12,}"), 0)


def tag_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(content_id, tags) of every document."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("content_id"), "text")
    return bind(docs, "tags", long_words(F.col("text"))).drop("text")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, raw) records for ingest, one per document and one per page again.

    Some keys are left out, some values and tags are null, too long or unreadable, and
    the page records repeat URLs that document records carry.
    """
    rows = content(spark, sf_dir, *_ITEM_COLUMNS)
    doc = F.col("id")
    fields = {
        "title": F.when(doc % 13 == 0, F.rpad(F.coalesce("title", F.lit("")), 256, "x"))
                  .otherwise(F.col("title")),
        "title_persian": F.col("title_persian"),
        "date": F.when(doc % 19 == 0, F.lit("some day")).otherwise(F.col("date").cast("string")),
        "content": F.col("content"),
        "summary": F.col("summary"),
        "summary_persian": F.col("summary_persian"),
        "url": F.col("url"),
        "author": F.col("author"),
        "views": F.col("views"),
        "source": F.col("source"),
        "final_score": F.col("final_score"),
        "type": F.col("type"),
        "tags": F.when(doc % 17 == 0, F.array_append("tags", F.lit(None).cast("string")))
                 .when(doc % 23 == 0, F.array_append("tags", F.lit("t" * 256))).otherwise(F.col("tags")),
    }
    full = F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]),
                     {"ignoreNullFields": "false"})
    # NULL fields are left out of these, so required ones can be missing too.
    sparse = F.to_json(F.struct(*[v.alias(k) for k, v in fields.items() if k != "views"]),
                       {"ignoreNullFields": "true"})
    record = F.when(doc % 2 == 0, full).otherwise(sparse)
    first = bind(rows, "raw", record).select(doc.alias("seq"), "raw")
    pages = table(spark, sf_dir, "pages")
    again = pages.select(
        (F.col("page_id") + 1_000_000_000_000).alias("seq"),
        F.to_json(F.struct(
            F.lit("2024-01-20 08:00:00").alias("date"), "url",
            F.lit("desk").alias("author"), F.lit("wire").alias("source"))).alias("raw"))
    return first.unionAll(again)


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(content_id, seq, response): assistant turns in the shape of a chat reply.

    Every fifth conversation's replies have no choices.
    """
    turns = table(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
    message = F.struct(F.struct(F.concat(F.lit("  "), "text", F.lit("\n")).alias("content"))
                       .alias("message"))
    reply = F.to_json(F.struct(F.array(message).alias("choices")))
    return turns.select(
        F.col("conv_id").alias("content_id"), F.col("turn").alias("seq"),
        F.when(F.col("conv_id") % 5 == 0, F.lit('{"choices": []}')).otherwise(reply)
        .alias("response"))


def translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(content_id, seq, translation): assistant turns, several per item."""
    return table(spark, sf_dir, "conversations").where(F.col("role") == "assistant").select(
        F.col("conv_id").alias("content_id"), F.col("turn").alias("seq"),
        F.col("text").alias("translation"))


def image_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(content_id, image_url, image_data): a whole page as image bytes."""
    page = F.when(F.col("page_id") % 4 == 0, "").otherwise(F.col("html"))
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("content_id"),
        F.concat(F.lit("img"), "page_id", F.lit(".png")).alias("image_url"),
        F.encode(page, "UTF-8").alias("image_data"))


def write_files(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """A file for every fifty pages, in a folder that names them; its bytes are the pages, a line end after each."""
    pages = table(spark, sf_dir, "pages").where("html IS NOT NULL").groupBy(F.expr("page_id DIV 50").alias("page")).agg(
        F.array_sort(F.collect_list(F.struct("page_id", "html"))).alias("pages"))
    pages.select("page", F.array_join("pages.html", "\n")).write.partitionBy("page").text(folder)


def image_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(content_id, seq, response): page URLs in the shape of an image reply.

    Some replies name no image, an empty one, or a number.
    """
    page = F.col("page_id")
    named = F.to_json(F.struct(F.array(F.struct("url")).alias("data")))
    response = (
        F.when(page % 11 == 0, F.lit('{"data": []}'))
        .when(page % 7 == 0, F.lit('{"data": [{"url": ""}]}'))
        .when(page % 5 == 0, F.lit('{"data": [{"url": 5}]}'))
        .otherwise(named))
    return table(spark, sf_dir, "pages").select(
        page.alias("content_id"), F.lit(0).alias("seq"), response.alias("response"))


def tag_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(content_id, pos, tag), kept as a table: finding words is slow."""
    return durable_table(explode_tags(tag_lists(spark, sf_dir)))


def tags(wanted: DataFrame) -> DataFrame:
    """(id, tag): a tag table of just the tags in some rows, numbered by tag."""
    return assign_ids(wanted.select("tag").distinct(), ["tag"]).select("id", "tag")


def content_tags(wanted: DataFrame, tag_table: DataFrame) -> DataFrame:
    """(content_id, tag_id) for the rows whose tag is in the table."""
    return tag_ids(wanted, tag_table).select("content_id", "tag_id").distinct()


def in_languages(wanted: DataFrame, sf_dir: str, *langs: str) -> DataFrame:
    """The rows of documents in some languages."""
    docs = table(wanted.sparkSession, sf_dir, "documents").where(F.col("lang").isin(*langs))
    return wanted.join(docs.select(F.col("doc_id").alias("content_id")), "content_id", "left_semi")
