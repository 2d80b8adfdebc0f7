"""Sort orders of the list page and of the stored table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from presswork.session import durable

# Sort choices, by column and by the label shown for it.
SORT_COLUMNS = ("date", "title_persian", "source", "final_score")
SORT_LABELS = {
    "تاریخ": "date",
    "عنوان": "title_persian",
    "منبع": "source",
    "امتیاز نهایی": "final_score",
}


def sort_articles(df: DataFrame, by: str, ascending: bool = False) -> DataFrame:
    """A total order by one column, NULLs last in both directions.

    The id breaks ties. It also lets the range partitioning of the sort split a
    value that many rows share. Keep only the columns to be shown before this.
    """
    column = SORT_LABELS.get(by, by)
    if column not in SORT_COLUMNS:
        raise ValueError(f"sort by one of {SORT_COLUMNS}")
    key = F.col(column).asc_nulls_last() if ascending else F.col(column).desc_nulls_last()
    return df.orderBy(key, F.col("id").asc())


def newest_first(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """All rows by falling date, then id, NULL dates last; wide rows are read and shuffled once.

    Sorting ``date`` and ``id`` alone tells where each of ``partitions`` ranges begins (the
    session's number of shuffle partitions if not given). A row finds its range by its
    day and the beginnings inside that day, goes there, and is sorted among its range. So the
    input is not read a second time as a sample of wide rows, and a day, or rows without
    a date, that hold most rows are as many ranges as they need.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("date").desc_nulls_last(), F.col("id").asc()]
    keys = durable(df.select("date", "id").repartitionByRange(n, *order).sortWithinPartitions(*order))
    in_part = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    day = F.to_date("date")
    # One row for each range, and one for each day of the calendar that occurs.
    firsts = keys.withColumn("_at", in_part).where("_at = 0").select(day.alias("day"), "date", "id").collect()
    days = sorted((r.day for r in keys.select(day.alias("day")).distinct().collect()),
                  key=lambda d: (d is None, -d.toordinal() if d else 0))
    inside: dict = {d: [] for d in days}
    for first in firsts:
        inside[first.day].append((first.date, first.id))
    rows, before = [], 0
    for d in days:
        rows.append((d, before, inside[d]))
        before += len(inside[d])
    ranges = spark.createDataFrame(
        rows, "_day date, _before int, _firsts array<struct<date:timestamp_ntz,id:bigint>>")
    passed = F.size(F.filter("_firsts", lambda f: F.coalesce(f["date"] > F.col("date"), F.lit(False)) | (
        f["date"].eqNullSafe(F.col("date")) & (f["id"] <= F.col("id")))))
    placed = df.join(F.broadcast(ranges), day.eqNullSafe(F.col("_day"))).withColumn(
        "_range", F.greatest(F.col("_before") + passed - 1, F.lit(0)))
    return placed.repartitionById(n, "_range").sortWithinPartitions(*order).select(*df.columns)
