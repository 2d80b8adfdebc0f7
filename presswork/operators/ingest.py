"""Article records to content rows: defaults, rejects and URL dedup."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from presswork.functions.text import utf16_units
from presswork.operators.binding import bind
from presswork.operators.collation import collated
from presswork.operators.ids import assign_ids, highest_id
from presswork.operators.tags import (
    create_missing_tags, explode_tags, new_links, rejected_tags, tag_ids)
from presswork.operators.url_keys import among
from presswork.schema import CONTENT, TEXT_LIMITS, conform
from presswork.session import TEXT_CODEC, discard, durable, shared_folder

# Record keys that must be there, and what others default to.
REQUIRED = ("date", "url", "author", "source")
DEFAULTS = {
    "title": "",
    "title_persian": "",
    "content": "",
    "content_persian": "",
    "views": "0",
    "summary": "",
    "summary_persian": "",
    "final_score": "0",
    "type": "News",
}

_RECORD = ", ".join(f"{name} string" for name in (*REQUIRED, *DEFAULTS)) + ", tags array<string>"


def parse_items(items: DataFrame) -> DataFrame:
    """Content columns, ``tags`` and ``reject_reason`` from (seq, raw) records.

    ``raw`` is one JSON object. A default stands in for a missing key only; an
    explicit null stays NULL. The text is parsed twice, once for its keys and
    once for its values.
    """
    parts = F.struct(F.json_object_keys("raw").alias("keys"),
                     F.from_json("raw", _RECORD).alias("rec"))
    read = bind(items.select("seq", "raw"), "_json", parts).select(
        "seq", "raw", F.col("_json.keys").alias("_keys"), F.col("_json.rec").alias("_rec"))

    def has(name: str) -> Column:
        return F.array_contains("_keys", name)

    values = {name: F.col(f"_rec.{name}") for name in REQUIRED}
    for name, default in DEFAULTS.items():
        values[name] = F.when(has(name), F.col(f"_rec.{name}")).otherwise(F.lit(default))
    date = values["date"].try_cast("timestamp_ntz")
    number = values["views"].try_cast("double")
    views = F.when(F.abs(number) < 2 ** 31, number.cast("int"))
    score = values["final_score"].try_cast("double")

    reasons = [F.when(F.col("_keys").isNull(), F.lit("not_an_object"))]
    reasons += [F.when(~has(name), F.lit(f"missing_{name}")) for name in REQUIRED]
    reasons += [
        F.when(values[name].isNotNull() & parsed.isNull(), F.lit(f"bad_{name}"))
        for name, parsed in (("date", date), ("views", views), ("final_score", score))
    ]
    reasons += [
        F.when(utf16_units(values[name]) > limit, F.lit(f"{name}_too_long"))
        for name, limit in TEXT_LIMITS.items()
    ]
    typed = values | {"date": date, "views": views, "final_score": score}
    return read.select(
        "seq", "raw",
        F.coalesce(*reasons).alias("reject_reason"),
        *[typed[f.name].cast(f.dataType).alias(f.name) for f in CONTENT.fields if f.name != "id"],
        F.col("_rec.tags").alias("tags"),
    )


#: Every reason for which a record is turned away.
REASONS = ("not_an_object", *(f"missing_{name}" for name in REQUIRED),
           *(f"bad_{name}" for name in ("date", "views", "final_score")),
           *(f"{name}_too_long" for name in TEXT_LIMITS))


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reject_reason").isNull()).drop("reject_reason", "raw")


def rejected(parsed: DataFrame) -> DataFrame:
    """Records that cannot be stored, with their text and the first reason."""
    return parsed.where(F.col("reject_reason").isNotNull()).select("seq", "reject_reason", "raw")


@dataclass(frozen=True)
class Staged:
    """A parsed batch as files, in a folder for each outcome, from which everything is read."""

    path: str
    accepted: DataFrame
    rejected: DataFrame

    def discard(self) -> None:
        discard(self.accepted.sparkSession, self.path)


def stage_items(items: DataFrame) -> Staged:
    """Parse (seq, raw) records, once, and write them to the checkpoint folder by outcome.

    Rejected records keep their text and reason only, accepted ones all but these. What is
    read later is one folder of it and the columns in use. ``discard`` removes it.
    """
    spark = items.sparkSession
    parsed = parse_items(items)
    good = F.col("reject_reason").isNull()
    kept = [F.when(~good, F.col(c)).alias(c) if c == "raw" else F.when(good, F.col(c)).alias(c)
            for c in parsed.columns if c not in ("seq", "reject_reason")]
    outcome = F.when(good, "accepted").otherwise("rejected").alias("outcome")
    path = shared_folder(spark, "staged")
    parsed.select("seq", "reject_reason", *kept, outcome).write.option(
        "compression", TEXT_CODEC).partitionBy("outcome").parquet(path)
    rows = spark.read.schema(parsed.schema.add("outcome", "string")).parquet(path)
    return Staged(path, rows.where("outcome = 'accepted'").drop("outcome", "reject_reason", "raw"),
                  rows.where("outcome = 'rejected'").select("seq", "reject_reason", "raw"))


def first_by_url(incoming: DataFrame, collation: str | None = None) -> DataFrame:
    """(seq, url) of the first record of every URL; NULL URLs are all kept.

    Works on two columns and reduces to one number per URL before the shuffle,
    so any number of copies of one URL is cheap. Records without a URL are
    groups of their own and spread evenly. Under a ``collation`` URLs that it calls
    equal are one; the first keeps its spelling.
    """
    own = F.when(F.col("url").isNull(), F.col("seq")).alias("_own")
    first = incoming.groupBy(collated(F.col("url"), collation).alias("url"), own).agg(F.min("seq").alias("seq"))
    if collation is None:
        return first.select("seq", "url")
    return incoming.select("seq", "url").join(first.select("seq"), "seq", "left_semi")


def _stored_among(stored: DataFrame, wanted: DataFrame, collation: str | None) -> DataFrame:
    """The stored URLs to compare with, as ``_stored``; cut down to likely ones if they compare by bytes."""
    urls = among(stored, wanted) if collation is None else stored.where("url IS NOT NULL").select("url")
    return urls.select(collated(F.col("url"), collation).alias("_stored"))


def unseen_urls(incoming: DataFrame, stored: DataFrame, collation: str | None = None) -> DataFrame:
    """(seq, url) of records to store: first of their URL and not stored yet.

    ``stored`` is the table of URL keys, or any with ``url``. Repeats in it do not matter
    and are not removed. Without a ``collation`` URLs compare by their bytes.
    """
    firsts = durable(first_by_url(incoming, collation))
    known = _stored_among(stored, firsts, collation)
    # A record without a URL meets nothing; its number keeps such records from
    # all going to the same task.
    key = collated(F.coalesce("url", F.col("seq").cast("string")), collation)
    same = (key == F.col("_stored")) & F.col("url").isNotNull()
    return firsts.join(known, same, "left_anti")


def seen_urls(incoming: DataFrame, stored: DataFrame, collation: str | None = None) -> DataFrame:
    """(seq, url) of records whose URL is stored already."""
    wanted = durable(incoming.where("url IS NOT NULL").select("seq", "url"))
    known = _stored_among(stored, wanted, collation)
    return wanted.join(known, collated(F.col("url"), collation) == F.col("_stored"), "left_semi")


def new_content(good: DataFrame, stored: DataFrame, after: int, collation: str | None = None) -> DataFrame:
    """Rows that accepted records add to the content table, with their ``tags``.

    ``good`` should be staged, since it is read for its keys and again for its rows;
    ``stored`` are the URL keys and ``after`` the highest id in use. Ids go by ``seq``,
    which must be unique in the batch. Dedup and numbering move two narrow columns; the
    wide rows are shuffled once, when they meet their id.
    """
    fresh = unseen_urls(good.select("seq", "url"), stored, collation).select("seq")
    numbered = assign_ids(fresh, ["seq"], after=after)
    return numbered.join(good, "seq").select(*CONTENT.fieldNames(), "tags")


def new_tags_and_links(added: DataFrame, tags: DataFrame, content_tags: DataFrame,
                       after: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows that new content adds to the tag table and to the bridge."""
    wanted = durable(explode_tags(added.select(F.col("id").alias("content_id"), "tags")))
    fresh = durable(create_missing_tags(wanted, tags, after))
    known = tags.select("id", "tag").unionAll(fresh)
    return fresh, new_links(tag_ids(wanted, known), content_tags)


@dataclass(frozen=True)
class IngestRows:
    """Rows one batch adds to each table, and the records and tags it turned away."""

    content: DataFrame
    tags: DataFrame
    content_tags: DataFrame
    rejected: DataFrame
    rejected_tags: DataFrame


def ingest(staged: Staged, stored: DataFrame, tags: DataFrame, content_tags: DataFrame,
           after: int | None = None, after_tag: int | None = None) -> IngestRows:
    """Everything a staged batch of records adds to the corpus.

    ``stored`` are URL keys, or content with ``url`` and ``id``. Without ``after`` and
    ``after_tag`` the highest ids in use are looked up in ``stored`` and ``tags``.
    """
    added = new_content(staged.accepted, stored, highest_id(stored) if after is None else after)
    fresh, links = new_tags_and_links(added, tags, content_tags, after_tag)
    turned_away = rejected_tags(added.select(F.col("id").alias("content_id"), "tags"))
    return IngestRows(conform(added, CONTENT), fresh, links, staged.rejected, turned_away)
