import datetime as dt

import pytest
from pyspark.sql import functions as F

from presswork.operators import filters, ordering, stats

ROWS = [
    (1, "Alpha news", "خبر آلفا", dt.datetime(2024, 1, 1), "s1", "News", 2.0, "c one", "x"),
    (2, None, "alpha", dt.datetime(2024, 1, 7), "s2", "Blog", 1.0, "two", None),
    (3, "ALPHA", "Alpha", dt.datetime(2024, 1, 7, 0, 0, 1), None, "News", None, None, "c"),
    (4, "b+c", None, None, "s1", None, 1.0, "C+ One", ""),
    (5, None, None, dt.datetime(2024, 1, 3, 12), "s3", "News", 1.0, "", "one"),
]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(
        ROWS, "id long, title string, title_persian string, date timestamp_ntz, source string, "
              "type string, final_score double, content string, content_persian string")


def ids(frame):
    return sorted(r.id for r in frame.collect())


def order(frame):
    return [r.id for r in frame.collect()]


def test_title_search(df):
    assert ids(filters.title_search(df, "alpha")) == [1, 2, 3, 3]
    assert ids(filters.title_search(df, "alpha", mode="any")) == [1, 2, 3]
    assert ids(filters.title_search(df, "آلفا")) == [1]
    assert ids(filters.title_search(df, "b+c")) == []
    assert ids(filters.title_search(df, "b+c", literal=True)) == [4]
    assert ids(filters.title_search(df, "")) == [1, 2, 3, 4, 5]
    with pytest.raises(ValueError):
        filters.title_search(df, "a", mode="both")


def test_content_search(df):
    assert filters.keyword_pattern(" a, b ,") == "a|b|"
    assert ids(filters.content_search(df, "one, two")) == [1, 2, 4, 5]
    assert ids(filters.content_search(df, "c , ONE", mode="any")) == [1, 3, 4, 5]
    # A trailing comma is an empty alternative, found in every text there is.
    assert ids(filters.content_search(df, "zzz,")) == [1, 1, 2, 3, 4, 4, 5, 5]
    assert ids(filters.content_search(df, "c+ o", literal=True)) == [4]
    assert ids(filters.content_search(df, None)) == [1, 2, 3, 4, 5]


def test_sources(df):
    assert ids(filters.by_sources(df, ["s1", "s3"])) == [1, 4, 5]
    assert ids(filters.by_sources(df, [])) == [1, 2, 3, 4, 5]
    assert ids(filters.by_sources(df, ["s1", filters.ALL])) == [1, 2, 3, 4, 5]


def test_date_range(df):
    day = dt.date(2024, 1, 7)
    assert ids(filters.by_date_range(df, "2024-01-01", day)) == [1, 2, 5]
    assert ids(filters.by_date_range(df, "2024-01-01", day, end_inclusive_day=True)) == [1, 2, 3, 5]
    assert ids(filters.by_date_range(df, "2024-01-01", None)) == [1, 2, 3, 4, 5]
    with_day = df.withColumn("day", F.to_date("date"))
    for whole in (False, True):
        assert ids(filters.by_date_range(with_day, "2024-01-03", day, whole)) == ids(
            filters.by_date_range(df, "2024-01-03", day, whole))


def test_simple_filters(df):
    assert ids(filters.by_type(df, "News")) == [1, 3, 5]
    assert ids(filters.by_type(df, filters.ALL)) == [1, 2, 3, 4, 5]
    assert ids(filters.by_id(df, 2)) == [2] and ids(filters.by_id(df, 99)) == []
    assert ids(filters.since_days(df, "2024-01-10 12:00:00")) == [2, 3, 5]
    assert ids(filters.needs_translation(df)) == [2, 4]


@pytest.mark.parametrize("column", ordering.SORT_COLUMNS)
@pytest.mark.parametrize("up", [True, False])
def test_sort_puts_nulls_last(df, column, up):
    rows = df.collect()
    known = sorted((r for r in rows if r[column] is not None), key=lambda r: r.id)
    known.sort(key=lambda r: r[column], reverse=not up)
    expected = [r.id for r in known] + sorted(r.id for r in rows if r[column] is None)
    assert order(ordering.sort_articles(df, column, up)) == expected


def test_sort_choices(df):
    assert order(ordering.sort_articles(df, "تاریخ")) == order(ordering.newest_first(df))
    with pytest.raises(ValueError):
        ordering.sort_articles(df, "views")


def test_counts(df):
    rows = stats.source_counts(df, "2024-01-08").collect()
    assert [tuple(r) for r in rows] == [("s1", 1), ("s2", 1), ("s3", 1)]
    assert [tuple(r) for r in stats.daily_counts(df).collect()] == [
        (dt.date(2024, 1, 1), 1), (dt.date(2024, 1, 3), 1), (dt.date(2024, 1, 7), 2)]
    assert [tuple(r) for r in stats.facet(df, "type").collect()] == [
        (0, filters.ALL), (1, "Blog"), (1, "News")]


def test_newest_first_of_hot_days_and_moments(spark, tmp_path):
    """A third of the rows share a moment, another third have none; texts cross one exchange."""
    path = str(tmp_path / "content")
    spark.range(6000).select(
        (F.col("id") * 7919 % 6000).alias("id"), F.concat(F.lit("text "), "id").alias("content"),
        F.when(F.col("id") % 3 == 0, F.lit("2024-01-05 10:00:00")).when(
            F.col("id") % 3 == 1, F.concat(F.lit("2024-01-0"), F.col("id") % 9 + 1, F.lit(" 0"), F.col("id") % 7, F.lit(":00:00")))
        .cast("timestamp_ntz").alias("date")).write.parquet(path)
    rows = ordering.newest_first(spark.read.parquet(path), partitions=12)
    got = [(r.date, r.id) for r in rows.collect()]
    assert got == sorted(got, key=lambda r: (r[0] is None, -r[0].timestamp() if r[0] else 0, r[1])) and len(got) == 6000
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= 10 and max(sizes) < 1500
    plan = rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
    assert plan.count("content#") and plan.count("FileScan parquet") == 1
    assert plan.count("- Exchange ") + plan.count("REPARTITION") <= 2 and "SortMergeJoin" not in plan
    assert ordering.newest_first(spark.read.parquet(path).limit(0)).count() == 0
