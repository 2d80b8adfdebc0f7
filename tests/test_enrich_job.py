"""Storing translations, generated tags and images in a corpus folder."""

import datetime as dt
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from presswork.operators.latest import latest
from presswork.plans.enrich_job import (
    store_generated_tags, store_images, store_translations, stored_images)
from presswork.plans.ingest_job import (
    corpus_table, highest_stored, ingest_batch, ledger, store_corpus)
from presswork.schema import CONTENT
from presswork.sources.images import images_of, with_bytes


@pytest.fixture
def root(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1 + i % 4) if i < 8 else None, f"old {i}") for i in range(10)]
    content = spark.createDataFrame(rows, "id long, date timestamp_ntz, content_persian string")
    tags = spark.createDataFrame([(1, "a"), (2, "b")] + [(i, f"t{i}") for i in range(3, 9)], "id long, tag string")
    links = spark.createDataFrame([(1, 1), (1, 2)] + [(2, i) for i in range(1, 8)], "content_id long, tag_id long")
    store_corpus(content, tags, links, str(tmp_path / "corpus"))
    store_corpus(content.where("id < 4").withColumn("id", F.col("id") + 100), tags.limit(0), links.limit(0),
                 str(tmp_path / "corpus"), batch=1)
    return str(tmp_path / "corpus")


def files(root):
    return {p: p.stat().st_mtime_ns for p in Path(root, "content").rglob("*.parquet")}


def test_translations_rewrite_their_folders_only(spark, root):
    before, old = files(root), {r.id: r.content_persian for r in corpus_table(spark, root, "content").collect()}
    updates = spark.createDataFrame(
        [(1, 1, "first"), (1, 5, "last"), (5, 2, "five"), (9, 0, "no day"), (77, 1, "unknown"), (None, 1, "x"), (102, 1, None)],
        "content_id long, seq int, translation string")
    # Days 2 (items 1 and 5), none (9), and day 3 of the second batch (102).
    assert store_translations(updates, root) == 3
    new = {r.id: r.content_persian for r in corpus_table(spark, root, "content").collect()}
    assert new == old | {1: "last", 5: "five", 9: "no day", 102: None}
    after = files(root)
    changed = {"/".join(p.parts[-3:-1]) for p in set(before.items()) ^ set(after.items()) for p in [p[0]]}
    assert changed == {"batch=0/day=2024-01-02", "batch=0/day=__HIVE_DEFAULT_PARTITION__", "batch=1/day=2024-01-03"}
    assert corpus_table(spark, root, "content").columns[:14] == CONTENT.fieldNames()
    # Again, and with nothing to do.
    assert store_translations(updates, root) == 3
    assert {r.id: r.content_persian for r in corpus_table(spark, root, "content").collect()} == new
    assert store_translations(updates.where("content_id = 77"), root) == 0
    assert store_translations(updates.limit(0), root) == 0


def chat(text):
    return json.dumps({"choices": [{"message": {"content": text}}]})


def test_generated_tags(spark, root):
    replies = spark.createDataFrame(
        [(1, 1, chat("x")), (1, 2, chat("a, c, c,," + "y" * 256 + ",d,e,f,g")), (2, 1, chat("z")), (3, 1, chat("c")),
         (50, 1, chat("c")), (4, 1, "{}")], "content_id long, seq int, response string")
    store_generated_tags(replies, root, 2)
    tags = {r.tag: r.id for r in corpus_table(spark, root, "tags").collect()}
    assert tags["c"] == 9 and tags["d"] == 10 and "x" not in tags and "z" not in tags
    before = {(r.content_id, r.tag_id) for r in corpus_table(spark, root, "content_tags", before_batch=2).collect()}
    after = {(r.content_id, r.tag_id) for r in corpus_table(spark, root, "content_tags").collect()}
    # Five more for the first item, of which one is there, one repeated and one too long.
    assert after - before == {(1, 9), (1, 10), (3, 9)} and before <= after
    entries = {(r.name, r.reason): r.rows for r in ledger(spark, root).where("batch = 2").collect()}
    assert entries == {("tags", None): 2, ("content_tags", None): 3, ("rejected_tags", "tag_too_long"): 1}


def test_images(spark, root):
    def store(rows, owners, batch):
        store_images(spark.createDataFrame(rows, "image_url string, image_data binary"),
                     spark.createDataFrame(owners, "content_id long, image_url string"), root, batch)
    store([("a", b"x"), ("b", b""), ("c", b"yy")], [(1, "a"), (2, "a"), (2, "b"), (2, "c"), (3, "none")], 2)
    store([("a", b"x"), ("a", b"new")], [(1, "a")], 3)
    rows, stored = stored_images(spark, root)
    assert sorted(r.id for r in rows.collect()) == [1, 2, 3, 4, 5]
    assert sorted(bytes(r.image_data) for r in images_of(rows, stored, 1).collect()) == [b"new", b"x", b"x"]
    assert with_bytes(rows, stored).where("content_id = 2").count() == 2
    assert highest_stored(spark, root, "content_images") == 5


def test_latest(spark):
    rows = spark.createDataFrame(
        [(1, 1, "a"), (1, 2, "b"), (1, 2, "b"), (2, None, "x"), (None, 3, "n"), (None, 4, "m"), (3, -5, "q"),
         (3, -6, "r"), (4, 1, "one"), (4, 1, "two")], "k long, seq int, t string")
    got = [tuple(r) for r in latest(rows, "k", "seq", "t").collect()]
    assert len(got) == 5 and {(1, 2, "b"), (2, None, "x"), (None, 4, "m"), (3, -5, "q")} < set(got)
    again = [tuple(r) for r in latest(rows.repartition(3), "k", "seq", "t").collect()]
    assert set(again) == set(got)


def test_jobs_leave_nothing_in_the_checkpoint_folder(spark, root):
    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))

    def left():
        return {p.name for p in folder.iterdir() if "-" in p.name and not p.name.startswith("rdd-")}
    before = left()
    store_translations(spark.createDataFrame([(1, 1, "x")], "content_id long, seq int, translation string"), root)
    store_generated_tags(spark.createDataFrame([(3, 1, chat("n"))], "content_id long, seq int, response string"), root, 5)
    raw = json.dumps({"date": "2024-01-05", "url": "http://new", "author": "a", "source": "s"})
    ingest_batch(spark.createDataFrame([(0, raw)], "seq long, raw string"), root, 6)
    assert corpus_table(spark, root, "content").where("url = 'http://new'").count() == 1
    assert left() == before
