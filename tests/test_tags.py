import pytest
from pyspark.sql import functions as F

from presswork.operators import integrity, tags as T

LISTS = [
    (1, ["b", "a", "b"]), (2, []), (3, None), (4, ["old", "a", None]),
    (5, list("abcdefg")), (6, ["x" * 255, "y" * 256]),
]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(LISTS, "content_id long, tags array<string>")


@pytest.fixture(scope="module")
def stored(spark):
    return spark.createDataFrame([(7, "old"), (9, "c")], "id long, tag string")


def test_get_or_create(spark, items, stored):
    wanted = T.explode_tags(items)
    fresh = T.create_missing_tags(wanted, stored)
    names = sorted({"a", "b", "d", "e", "f", "g", "x" * 255})
    assert sorted(map(tuple, fresh.collect())) == [(10 + i, n) for i, n in enumerate(names)]
    known = stored.unionAll(fresh)
    ids = {r.tag: r.id for r in known.collect()}
    rows = T.tag_ids(wanted, known).where("content_id = 1").orderBy("pos").collect()
    assert [r.tag_id for r in rows] == [ids["b"], ids["a"], ids["b"]]
    # A second time there is nothing to create.
    assert T.create_missing_tags(wanted, known).count() == 0


def test_links_once_each(spark, items, stored):
    wanted = T.explode_tags(items)
    known = stored.unionAll(T.create_missing_tags(wanted, stored))
    pairs = T.tag_ids(wanted, known)
    bridge = spark.createDataFrame([(4, 7)], "content_id long, tag_id long")
    added = T.new_links(pairs, bridge)
    assert added.where("content_id = 1").count() == 2
    assert added.where("content_id = 4").count() == 1
    assert T.new_links(pairs, bridge.unionAll(added)).count() == 0


def test_tag_rows_lines_and_quotas(spark, items, stored):
    wanted = T.explode_tags(items)
    known = stored.unionAll(T.create_missing_tags(wanted, stored))
    bridge = T.tag_ids(wanted, known).select("content_id", "tag_id").distinct()
    lines = {r.content_id: r.tag_line for r in T.tag_lines(bridge, known).collect()}
    assert lines[1] == "a ,b" and lines[4] == "a ,old" and 2 not in lines
    assert T.tags_of(bridge, known).where("content_id = 5").count() == 7
    content = items.select(F.col("content_id").alias("id"))
    backlog = {r.id: (r.n_tags, r.to_generate) for r in T.under_tagged(content, bridge).collect()}
    assert backlog == {1: (2, 5), 2: (0, 7), 3: (0, 7), 4: (2, 5), 6: (1, 6)}
    short = {r.content_id: r.existing_tags for r in T.short_tag_lists(bridge, known).collect()}
    assert short == {1: ["a", "b"], 4: ["a", "old"], 6: ["x" * 255]}
    quotas = {r[0]: r[1] for r in items.select("content_id", T.tag_quota(F.col("tags"))).collect()}
    assert quotas == {1: 4, 2: 7, 3: 7, 4: 4, 5: 0, 6: 5}


def test_a_tag_on_every_third_item(spark):
    items = spark.range(3000).select(
        F.col("id").alias("content_id"),
        F.when(F.col("id") % 3 == 0, F.array(F.lit("hot"))).otherwise(
            F.array(F.col("id").cast("string"))).alias("tags"))
    none = spark.createDataFrame([], "id long, tag string")
    wanted = T.explode_tags(items)
    known = T.create_missing_tags(wanted, none)
    assert known.count() == 2001
    rows = T.tag_ids(wanted, known)
    assert rows.where("tag = 'hot'").count() == 1000 and rows.count() == 3000


def test_integrity(spark):
    parents = spark.createDataFrame([(1,), (2,), (2,)], "id long")
    children = spark.createDataFrame([(1, "a"), (3, "b"), (None, "c"), (2, "d")],
                                     "content_id long, v string")
    assert [r.v for r in integrity.orphans(children, parents, "content_id").collect()] == ["b"]
    left = integrity.cascade_delete(children, parents.where("id = 2"), "content_id")
    assert sorted(r.v for r in left.collect()) == ["a", "b", "c"]
    assert left.columns == children.columns
