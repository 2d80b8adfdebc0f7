import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from presswork.functions.responses import image_url, message_text, string_urls
from presswork.operators import enrich as E
from presswork.operators.translations import apply_translations

CONTENT = [
    (1, "t1", "عنوان", dt.datetime(2024, 1, 2, 3, 4, 5), "<p>body</p>", None, "u1", "s1", "sum", None),
    (2, None, None, dt.datetime(2024, 1, 2, 3, 4, 5, 120), "", "second", None, None, "", "sp"),
    (3, "", "", None, None, "", "u3", "s3", None, ""),
    (4, "t4", "p4", None, "100% %s", "done", "u4", "s4", None, None),
]
COLUMNS = ("id long, title string, title_persian string, date timestamp_ntz, content string, "
           "content_persian string, url string, source string, summary string, "
           "summary_persian string")


@pytest.fixture(scope="module")
def content(spark):
    return spark.createDataFrame(CONTENT, COLUMNS)


def prompts(df, *keys):
    return {tuple(r[k] for k in ("content_id", *keys)): r.prompt for r in df.collect()}


def chat(text):
    return json.dumps({"choices": [{"message": {"content": text}}]})


REPLIES = [
    (chat("  hi \n"), "hi"), (chat(""), ""), ('{"choices": []}', "-"), ("{}", "-"), ("oops", "-"),
    ('{"choices": [{"message": {}}]}', "-"), ('{"choices": [{"message": {"content": null}}]}', "-"),
    (None, "-"),
]


def test_message_text(spark):
    df = spark.createDataFrame([(r,) for r, _ in REPLIES], "r string")
    got = [r[0] for r in df.select(message_text(F.col("r"), "-")).collect()]
    assert got == [t for _, t in REPLIES]


def test_image_url(spark):
    replies = ['{"data": [{"url": "http://i"}, {"url": "no"}]}', '{"data": []}', "{}", "oops",
               '{"data": [{"url": ""}]}', '{"data": [{"url": 5}]}', '{"data": [{"x": 1}]}', None]
    df = spark.createDataFrame([(r,) for r in replies], "r string")
    got = [r[0] for r in df.select(image_url(F.col("r"))).collect()]
    assert got == ["http://i"] + [None] * 7
    df = spark.createDataFrame([(["a", None, "b"],)], "u array<string>")
    assert df.select(string_urls(F.col("u"))).first()[0] == ["a", "b"]


def test_tag_prompts(spark, content):
    tags = spark.createDataFrame([(i, f"t{i}") for i in range(9)], "id long, tag string")
    links = spark.createDataFrame([(1, 2), (1, 1)] + [(4, i) for i in range(7)],
                                  "content_id long, tag_id long")
    got = prompts(E.tag_prompts(content, links, tags), "quota")
    assert got == {
        (1, 5): E.TAG_PROMPT % (5, "<p>body</p>", "t1, t2"),
        (2, 7): E.TAG_PROMPT % (7, "second", ""),
    }


def test_tag_results(spark):
    items = spark.createDataFrame(
        [(1, ["a", "b"]), (2, None), (3, list("abcdefgh")), (4, ["k"]), (5, ["m"])],
        "content_id long, existing_tags array<string>")
    replies = spark.createDataFrame(
        [(1, 0, chat("old")), (1, 1, chat("c,,d , A,e,f,g")), (2, 0, chat("a,,b , ")),
         (3, 0, chat("z")), (5, 0, '{"choices": []}')],
        "content_id long, seq int, response string")
    got = {r.content_id: r.tags for r in E.tag_results(items, replies).collect()}
    assert got == {1: ["a", "b", "c", "d", "A", "e", "f"], 2: ["a", "b"],
                   3: list("abcdefgh"), 4: ["k"], 5: ["m"]}


def test_translation_round_trip(spark, content):
    got = prompts(E.translation_prompts(content))
    assert got == {(1,): E.TRANSLATION_PROMPT % ("en", "fa", "<p>body</p>")}
    replies = spark.createDataFrame(
        [(1, 1, chat(" first ")), (1, 2, chat("last")), (3, 1, chat(" ")), (99, 1, chat("x")),
         (4, 1, "{}")], "content_id long, seq int, response string")
    updates = E.translation_updates(replies)
    assert updates.count() == 3
    after = {r.id: r.content_persian for r in apply_translations(content, updates).collect()}
    assert after == {1: "last", 2: "second", 3: "", 4: "done"}


def test_many_updates_of_one_item(spark):
    content = spark.range(300).select("id", F.lit("old").alias("content_persian"))
    updates = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 100 + 1000).alias("content_id"),
        F.col("id").alias("seq"), F.col("id").cast("string").alias("translation"))
    after = {r.id: r.content_persian for r in apply_translations(content, updates).collect()}
    assert after.pop(7) == "8997" and set(after.values()) == {"old"}


def test_article_prompts(spark, content):
    rows = content.withColumn("matched_keywords", F.array(F.lit("k1"), F.lit("k2")))
    got = prompts(E.article_prompts(rows, "example.org"))
    assert got[(1,)] == E.ARTICLE_PROMPT % (
        "example.org", "k1, k2", "عنوان", "s1", "u1", "2024-01-02 03:04:05", "<p>body</p>")
    assert got[(2,)] == E.ARTICLE_PROMPT % (
        "example.org", "k1, k2", None, None, None, "2024-01-02 03:04:05.000120", "second")
    assert "- **Date**: NaT" in got[(3,)] and "100% %s" in got[(4,)]
    assert "keywords:  (if" in prompts(E.article_prompts(content, "example.org"))[(1,)]
    replies = spark.createDataFrame(
        [(1, 1, chat("text")), (2, 1, "{}"), (3, 1, chat("No Article"))],
        "content_id long, seq int, response string")
    assert [r.article for r in E.generated_articles(replies).collect()] == ["text"]


def test_image_prompts(content):
    got = prompts(E.image_prompts(content, images=2), "image_no")
    texts = {1: "sum", 2: "sp", 4: "p4"}
    assert got == {(i, n): E.IMAGE_PROMPT % t for i, t in texts.items() for n in (1, 2)}
    assert E.image_prompts(content, images=0).count() == 0


def test_texts_of_full_items_do_not_move(spark, tmp_path):
    path = str(tmp_path / "content")
    spark.range(3000).select(
        "id", F.concat(F.lit("text "), "id").alias("content"), F.lit(None).cast("string").alias("content_persian")
    ).write.parquet(path)
    links = spark.range(3000).where("id % 100 <> 0").select(
        F.col("id").alias("content_id"), F.explode(F.expr("sequence(1L, 7L)")).alias("tag_id"))
    tags = spark.createDataFrame([(i, f"t{i}") for i in range(1, 8)], "id long, tag string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = E.tag_prompts(spark.read.parquet(path), links, tags)
        assert {r.content_id for r in rows.collect()} == set(range(0, 3000, 100))
        plan = rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # The texts meet the sieve where they are read, and cross one exchange after it.
    above = plan[:plan.index("ReadSchema: struct<id:bigint,content:string")]
    assert "BroadcastHashJoin [pmod(xxhash64(id" in above and "SortAggregate" not in plan
    wide = [line for line in above.splitlines() if "Exchange hashpartitioning" in line]
    assert len(wide) <= 1
