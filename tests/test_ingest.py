import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from presswork.operators import ingest as I
from presswork.operators.collation import IGNORE_CASE
from presswork.operators.filters import by_url
from presswork.operators.sieve import sieve
from presswork.operators.url_keys import among, url_folder
from presswork.plans.ingest_job import (
    corpus_table, highest_stored, ingest_batch, ledger, stored_urls)
from presswork.schema import CONTENT, CONTENT_TAGS, TAGS

BASE = {"date": "2024-01-05 10:00:00", "url": "http://x/1", "author": "ann", "source": "s"}


def record(**changes):
    item = {**BASE, **changes}
    return json.dumps({k: v for k, v in item.items() if v is not ...}, ensure_ascii=False)


def frame(spark, *raws):
    return spark.createDataFrame(list(enumerate(raws)), "seq long, raw string")


def test_missing_gets_the_default_and_null_stays(spark):
    rows = I.parse_items(frame(
        spark,
        record(),
        record(title=None, content=None, views=None, final_score=None, type=None),
        record(title="t", views="12", final_score=2, type="Blog", tags=["a", None]),
    )).orderBy("seq").collect()
    assert [r.reject_reason for r in rows] == [None] * 3
    missing, null, given = rows
    assert (missing.title, missing.content, missing.views, missing.final_score, missing.type) == (
        "", "", 0, 0.0, "News")
    assert (null.title, null.content, null.views, null.final_score, null.type) == (None,) * 5
    assert (given.title, given.views, given.final_score, given.type) == ("t", 12, 2.0, "Blog")
    assert given.tags == ["a", None] and missing.tags is None
    assert missing.date == dt.datetime(2024, 1, 5, 10)


@pytest.mark.parametrize("raw, reason", [
    ("not json", "not_an_object"),
    ("[1]", "not_an_object"),
    (record(date=...), "missing_date"),
    (record(url=...), "missing_url"),
    (record(author=...), "missing_author"),
    (record(source=...), "missing_source"),
    (record(date="soon"), "bad_date"),
    (record(views="many"), "bad_views"),
    (record(views=3e10), "bad_views"),
    (record(final_score="high"), "bad_final_score"),
    (record(title="x" * 256), "title_too_long"),
    (record(title="😀" * 128), "title_too_long"),
    (record(url="http://x/" + "y" * 500), "url_too_long"),
    (record(type="t" * 101), "type_too_long"),
    (record(title="x" * 255), None),
    (record(title="😀" * 127), None),
    (record(url=None, date=None), None),
    (record(views=7.9), None),
])
def test_reject_reasons(spark, raw, reason):
    parsed = I.parse_items(frame(spark, raw))
    assert parsed.first().reject_reason == reason
    assert I.rejected(parsed).count() == (reason is not None)
    assert I.accepted(parsed).count() == (reason is None)


def test_url_dedup(spark):
    incoming = spark.createDataFrame(
        [(5, "u1"), (2, "u1"), (3, None), (4, None), (6, "u2"), (7, "u3")], "seq long, url string")
    stored = spark.createDataFrame([("u2",), ("u2",), (None,)], "url string")
    fresh = sorted(map(tuple, I.unseen_urls(incoming, stored).collect()))
    assert fresh == [(2, "u1"), (3, None), (4, None), (7, "u3")]
    assert [tuple(r) for r in I.seen_urls(incoming, stored).collect()] == [(6, "u2")]


def test_one_url_on_every_third_record(spark):
    incoming = spark.range(30_000).select(
        F.col("id").alias("seq"),
        F.when(F.col("id") % 3 == 2, "hot").when(F.col("id") % 3 == 1, F.col("id").cast("string"))
        .alias("url"))
    fresh = I.unseen_urls(incoming, incoming.limit(0))
    assert fresh.count() == 20_001
    assert fresh.where("url = 'hot'").first().seq == 2


def test_batches_into_a_folder(spark, tmp_path):
    root = str(tmp_path / "corpus")

    def counts():
        return tuple(corpus_table(spark, root, t).count() for t in ("content", "tags", "content_tags"))

    first = frame(spark, record(tags=["b", "a", "b"]), record(url="http://x/2", tags=["a"]),
                  record(), record(url=None), record(url=...))
    ingest_batch(first, root, 0)
    assert counts() == (3, 2, 3)
    content = corpus_table(spark, root, "content")
    assert sorted(r.id for r in content.collect()) == [1, 2, 3]
    assert [f.name for f in content.schema][:14] == CONTENT.fieldNames()
    # The same batch again replaces itself.
    ingest_batch(first, root, 0)
    assert counts() == (3, 2, 3)
    # A later batch with the same URLs adds only what is new.
    second = frame(spark, record(tags=["z"]), record(url="http://x/3", tags=["a", "c"]))
    ingest_batch(second, root, 1)
    assert counts() == (4, 3, 5)
    assert corpus_table(spark, root, "tags").where("tag = 'c'").first().id == 3
    assert corpus_table(spark, root, "content").where("url = 'http://x/3'").first().id == 4
    assert spark.read.parquet(f"{root}/rejected").count() == 1


def test_ingest_from_nothing(spark):
    empty = [spark.createDataFrame([], s) for s in (CONTENT, TAGS, CONTENT_TAGS)]
    staged = I.stage_items(frame(spark, record()))
    rows = I.ingest(staged, *empty)
    assert rows.content.columns == CONTENT.fieldNames()
    assert (rows.content.count(), rows.tags.count(), rows.content_tags.count()) == (1, 0, 0)
    staged.discard()
    assert not os.path.exists(staged.path.removeprefix("file:"))


def test_empty_batch(spark, tmp_path):
    root = str(tmp_path / "corpus")
    ingest_batch(frame(spark, record()).limit(0), root, 0)
    assert corpus_table(spark, root, "content").count() == 0
    ingest_batch(frame(spark, record(tags=["a"])), root, 1)
    assert [tuple(r) for r in corpus_table(spark, root, "tags").collect()] == [(1, "a")]
    entries = {(r.batch, r.name, r.reason): r.rows for r in ledger(spark, root).collect()}
    assert entries[0, "content", None] == 0 and entries[1, "content", None] == 1


def test_ledger(spark, tmp_path):
    root = str(tmp_path / "corpus")
    ingest_batch(frame(
        spark, record(tags=["b", None, "x" * 256, "x" * 255]), record(url="http://x/2", tags=[None]), record(),
        record(url=...), record(url=...), record(title="x" * 256), "no"), root, 3)
    rows = {(r.name, r.reason): (r.rows, r.highest) for r in ledger(spark, root).where("batch = 3").collect()}
    assert rows == {
        ("content", None): (2, 2), ("content", "url_repeated"): (1, None), ("tags", None): (2, 2),
        ("content_tags", None): (2, None), ("rejected", "missing_url"): (2, None),
        ("rejected", "title_too_long"): (1, None), ("rejected", "not_an_object"): (1, None),
        ("rejected_tags", "tag_missing"): (2, None), ("rejected_tags", "tag_too_long"): (1, None)}
    away = spark.read.parquet(f"{root}/rejected_tags").orderBy("content_id", "pos").collect()
    assert [(r.content_id, r.pos, r.reject_reason) for r in away] == [
        (1, 1, "tag_missing"), (1, 2, "tag_too_long"), (2, 0, "tag_missing")]
    assert highest_stored(spark, root, "content", before_batch=3) == 0
    assert highest_stored(spark, root, "content") == 2


def test_stored_content_is_not_read(spark, tmp_path, monkeypatch):
    """The second batch compares with URL keys of its own folders, sieved before any shuffle."""
    root = str(tmp_path / "corpus")
    ingest_batch(frame(spark, *[record(url=f"http://x/{i}") for i in range(300)]), root, 0)
    keys = stored_urls(spark, root, before_batch=1)
    incoming = I.stage_items(frame(spark, record(url="http://x/7"), record(url="http://y/1"))).accepted
    fresh = I.unseen_urls(incoming, keys)
    assert [r.url for r in fresh.collect()] == ["http://y/1"]
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    assert "/content" not in plan and "SortAggregate" not in plan
    folders = {url_folder_of(spark, u) for u in ("http://x/7", "http://y/1")}
    scan = plan[plan.index("PartitionFilters: [isnotnull(batch" if "isnotnull(batch" in plan else "PartitionFilters"):]
    assert all(str(f) in scan for f in folders) and "folder" in scan
    passed = among(keys, incoming)
    assert passed.count() < 30
    ingest_batch(frame(spark, record(url="http://x/7"), record(url="http://y/1")), root, 1)
    assert corpus_table(spark, root, "content").count() == 301


def url_folder_of(spark, url):
    return spark.range(1).select(url_folder(F.lit(url))).first()[0]


def test_sieve(spark):
    rows = spark.range(100_000).select(F.col("id").cast("string").alias("k"), "id")
    wanted = rows.where("id % 1000 = 0").select("k")
    got = sieve(rows, "k", wanted)
    assert got.columns == rows.columns and got.where("id % 1000 = 0").count() == 100
    assert got.count() < 100 + 2500
    assert sieve(rows, "k", wanted.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None,), ("5",)], "k string")
    assert [r.k for r in sieve(nulls, "k", nulls).collect()] == ["5"]


def test_urls_that_differ_in_case(spark):
    incoming = spark.createDataFrame([(1, "http://X/a"), (2, "http://x/A"), (3, "http://x/b"), (4, None), (5, None)], "seq long, url string")
    stored = spark.createDataFrame([("HTTP://X/B",), (None,)], "url string")
    fresh = sorted(map(tuple, I.unseen_urls(incoming, stored, IGNORE_CASE).collect()))
    assert fresh == [(1, "http://X/a"), (4, None), (5, None)]
    assert [tuple(r) for r in I.seen_urls(incoming, stored, IGNORE_CASE).collect()] == [(3, "http://x/b")]
    assert I.unseen_urls(incoming, stored).count() == 5
    one = spark.createDataFrame([(3, "http://X/a"), (2, "HTTP://x/A")], "id long, url string")
    assert by_url(one, "http://x/a", IGNORE_CASE).first().id == 2 and by_url(one, "http://x/a").count() == 0


def test_staged_rejects_keep_their_text_and_no_parsed_values(spark):
    staged = I.stage_items(frame(
        spark, record(title="kept", content="body"), record(url=..., content="long text"), "no object"))
    files = spark.read.parquet(staged.path)
    rejects = files.where("outcome = 'rejected'").drop("outcome", "seq", "raw", "reject_reason").collect()
    assert len(rejects) == 2 and all(value is None for row in rejects for value in row)
    good = files.where("outcome = 'accepted'").collect()
    assert [(r.raw, r.title, r.content) for r in good] == [(None, "kept", "body")]
    assert {(r.seq, r.reject_reason) for r in staged.rejected.collect()} == {(1, "missing_url"), (2, "not_an_object")}
    staged.discard()
