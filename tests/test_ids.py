from pyspark.sql import functions as F

from presswork.operators.ids import assign_ids, highest_id


def test_dense_ids_in_order(spark):
    df = spark.range(10_000).select((F.col("id") * 7919 % 10_007).alias("k")).repartition(7)
    rows = assign_ids(df, ["k"], after=41).collect()
    by_key = sorted(rows, key=lambda r: r.k)
    assert [r.id for r in by_key] == list(range(42, 10_042))


def test_heavy_and_null_keys(spark):
    """A third of the rows share a key and a third have none."""
    df = spark.range(9_000).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.col("id").cast("string"))
        .alias("k")).withColumnRenamed("id", "n")
    rows = assign_ids(df, [F.col("k").asc_nulls_last(), "n"]).collect()
    expected = sorted(rows, key=lambda r: (r.k is None, r.k or "", r.n))
    assert [r.id for r in expected] == list(range(1, 9_001))


def test_empty(spark):
    df = spark.createDataFrame([], "k string")
    assert assign_ids(df, ["k"]).count() == 0
    assert highest_id(spark.createDataFrame([], "id long")) == 0
    assert highest_id(spark.createDataFrame([(3,), (9,)], "id long")) == 9


def test_ids_do_not_change_when_read_again(spark):
    df = assign_ids(spark.range(1000).select(F.rand(1).alias("k")), ["k"])
    assert {tuple(r) for r in df.collect()} == {tuple(r) for r in df.collect()}
    assert df.where("id <= 10").count() == 10
