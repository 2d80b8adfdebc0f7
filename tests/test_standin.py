import datetime as dt

from pyspark.sql import functions as F

from presswork.sources import standin


def _tables(spark, folder):
    docs = [(i, f"text {i}", "en", "src0", 6) for i in (-1, 0, 1, 2)] + [(None, "none", "de", "src1", 4)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{folder}/documents.parquet")
    moment = dt.datetime(2024, 1, 2)
    events = [(i, moment, float(i or 0), f"kind {i}") for i in (-5, 0, 4, 5, 5, 6, None)]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, value double, event_type string").write.parquet(
        f"{folder}/events.parquet")
    spark.createDataFrame([(1, "http://x/1", "<p>1</p>")], "page_id long, url string, html string").write.parquet(
        f"{folder}/pages.parquet")
    spark.createDataFrame([(2, "ann")], "c_custkey long, c_name string").write.parquet(f"{folder}/customer.parquet")


def test_texts_are_shuffled_once_for_all_joins_of_the_content_view(spark, tmp_path):
    folder = str(tmp_path)
    _tables(spark, folder)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = standin.content(spark, folder)
        plan = rows._jdf.queryExecution().executedPlan().toString()
        # Documents, events, pages and customers once each.
        assert plan.count("Exchange hashpartitioning") == 4
        found = rows.select("id", "type", "url", "author").orderBy(F.col("id").asc_nulls_first()).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert [tuple(r) for r in found] == [
        (None, None, None, None), (-1, "kind -5", None, None), (0, "kind 0", None, None),
        (1, "kind 5", "http://x/1", None), (1, "kind 5", "http://x/1", None), (2, None, None, "ann")]
