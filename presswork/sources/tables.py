"""Reading and writing the corpus tables as files or from a database."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from presswork.operators.ordering import newest_first
from presswork.schema import CONTENT, conform


def read_table(spark: SparkSession, path: str, schema: T.StructType,
               keep: tuple[str, ...] = ("day",)) -> DataFrame:
    """A table's files under its schema, empty when nothing is written yet.

    The schema is given and not merged from the files' footers; columns that
    older files lack read as NULL. Partition columns named in ``keep`` stay, so
    that filters on them skip whole folders.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema)
    files = spark.read.schema(schema).parquet(path)
    kept = [c for c in keep if c in files.columns]
    extra = T.StructType(schema.fields + [files.schema[c] for c in kept])
    return conform(files, extra)


def read_jdbc(spark: SparkSession, url: str, table: str, schema: T.StructType,
              properties: dict[str, str], highest_id: int | None = None,
              partitions: int = 1) -> DataFrame:
    """A table of the user's own database, read in id ranges side by side.

    Spark sends filters and the column list to the database. The driver jar has
    to be on the class path.
    """
    if partitions > 1 and highest_id is None:
        raise ValueError("reading in ranges needs the highest id")
    if partitions > 1:
        rows = spark.read.jdbc(url, table, column="id", lowerBound=1, upperBound=highest_id,
                               numPartitions=partitions, properties=properties)
    else:
        rows = spark.read.jdbc(url, table, properties=properties)
    return conform(rows, schema)


def content_scan(content: DataFrame) -> DataFrame:
    """All content columns of the whole table, newest first."""
    return newest_first(conform(content, CONTENT))


def append_content(df: DataFrame, path: str) -> None:
    """Append content rows in one folder per day.

    Rows are rebalanced by day first: busy days are split over several files and
    quiet ones do not leave a file per task.
    """
    (
        conform(df, CONTENT).withColumn("day", F.to_date("date"))
        .hint("rebalance", "day")
        .write.mode("append").partitionBy("day").parquet(path)
    )


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_new(df: DataFrame, path: str) -> None:
    """Write to a place that must not exist yet, so no input is overwritten."""
    df.write.mode("errorifexists").parquet(path)
