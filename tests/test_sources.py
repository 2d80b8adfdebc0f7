import datetime as dt

import pytest
from pyspark.sql import functions as F

from presswork.schema import CONTENT, TAGS, conform, union_conformed
from presswork.sources import images, tables
from presswork.operators.filters import by_date_range, since_days


def test_conform(spark):
    old = spark.createDataFrame([("5", "t", 1)], "views string, title string, id int")
    rows = conform(old, CONTENT)
    assert rows.schema.fieldNames() == CONTENT.fieldNames()
    assert [f.dataType for f in rows.schema] == [f.dataType for f in CONTENT]
    assert rows.first().views == 5 and rows.first().content_persian is None
    assert union_conformed(CONTENT, old, rows).count() == 2


def test_content_files(spark, tmp_path):
    path = str(tmp_path / "content")
    assert tables.read_table(spark, path, CONTENT).count() == 0
    rows = spark.createDataFrame(
        [(i, dt.datetime(2024, 1, 1 + i % 5) if i % 7 else None) for i in range(70)],
        "id long, date timestamp_ntz")
    tables.append_content(rows, path)
    # An older layout in another folder of the same table.
    tables.append_rows(spark.createDataFrame([(100, "x")], "id long, title string"),
                       f"{path}/day=2020-01-01")
    content = tables.read_table(spark, path, CONTENT)
    assert content.count() == 71 and content.columns == [*CONTENT.fieldNames(), "day"]
    scan = [r.id for r in tables.content_scan(content).collect()]
    known = {r.id: r.date for r in content.collect()}
    assert scan == sorted(known, key=lambda i: (
        known[i] is None, -(known[i].timestamp()) if known[i] else 0, i))
    for df in (by_date_range(content, "2024-01-02", "2024-01-03"), since_days(content, "2024-01-09", 6)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(day" in plan
        assert "PushedFilters: [IsNotNull(date), GreaterThanOrEqual(date" in plan
    with pytest.raises(Exception):
        tables.write_new(rows, path)


def test_errors_other_than_a_missing_path_are_not_hidden(spark, tmp_path):
    (tmp_path / "bad.parquet").write_text("not parquet")
    with pytest.raises(Exception):
        tables.read_table(spark, str(tmp_path / "bad.parquet"), TAGS).count()


def test_jdbc_ranges_need_a_bound(spark):
    with pytest.raises(ValueError):
        tables.read_jdbc(spark, "jdbc:none", "Content", CONTENT, {}, partitions=4)


def test_image_files(spark, tmp_path):
    folder = tmp_path / "img" / "deep"
    folder.mkdir(parents=True)
    for name, data in (("a.png", b"\x89a"), ("b.png", b""), ("c.png", b"c"), ("d.txt", b"d")):
        (folder / name).write_bytes(data)
    files = images.image_files(spark, str(tmp_path / "img"), "*.png")
    found = {r.image_url.rsplit("/", 1)[1]: r.image_url for r in files.collect() if r.image_data}
    assert sorted(found) == ["a.png", "c.png"]
    # Spark may leave empty files out by itself; rows without bytes go in any case.
    empty = spark.createDataFrame([("b.png", bytearray())], files.schema)
    files = files.where("image_url not like '%b.png'").unionAll(empty)
    owners = spark.createDataFrame(
        [(1, found["a.png"]), (1, found["a.png"]), (1, found["c.png"]), (2, found["a.png"]),
         (2, "b.png"), (3, "none.png")],
        "content_id long, image_url string")
    images.write_images(files, str(tmp_path / "stored"))
    stored = images.read_images(spark, str(tmp_path / "stored"))
    found = images.new_images(stored, owners, after=10)
    rows = images.with_bytes(found, stored)
    got = sorted((r.id, r.content_id, r.image_url[-5:], bytes(r.image_data))
                 for r in rows.collect())
    assert got == [(11, 1, "a.png", b"\x89a"), (12, 1, "c.png", b"c"), (13, 2, "a.png", b"\x89a")]
    assert images.images_of(found, stored, 1).count() == 2 and images.images_of(found, stored, 3).count() == 0
    by_item = images.images_by_item(spark.createDataFrame([(1,), (3,)], "id long"), rows)
    assert sorted((r.id, r.image_data is None) for r in by_item.collect()) == [
        (1, False), (1, False), (3, True)]
    assert by_item.where(F.col("id") == 3).count() == 1


def test_two_images_of_one_url_get_ids_of_their_own(spark, tmp_path):
    rows = [("a.png", b"x"), ("a.png", b"y"), ("a.png", b"x"), ("b.png", None)]
    images.write_images(spark.createDataFrame(rows, "image_url string, image_data binary"), str(tmp_path / "stored"))
    stored = images.read_images(spark, str(tmp_path / "stored"))
    owners = spark.createDataFrame([(1, "a.png"), (2, "a.png"), (1, "b.png")], "content_id long, image_url string")
    found = images.new_images(stored, owners, after=10)
    assert sorted(r.id for r in found.collect()) == [11, 12, 13, 14]
    assert {(r.content_id, bytes(r.image_data)) for r in images.with_bytes(found, stored).collect()} == {
        (1, b"x"), (1, b"y"), (2, b"x"), (2, b"y")}


def test_bytes_of_images_stay_where_they_are(spark, tmp_path):
    files = spark.createDataFrame([("a.png", b"x")], "image_url string, image_data binary")
    written = images.numbered_images(files)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in written
    images.write_images(files, str(tmp_path / "stored"))
    owners = files.selectExpr("1L as content_id", "image_url")
    rows = images.new_images(images.read_images(spark, str(tmp_path / "stored")), owners)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "image_data" not in plan and "SortAggregate" not in plan
