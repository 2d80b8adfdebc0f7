"""Bounded samples of labelled rows, which models are fitted on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from presswork.session import durable_table

#: Most labelled rows that a model is fitted on.
MAX_ROWS = 20_000
#: Most documents of one key in a sample, so that no key outweighs the others.
PER_KEY = 4


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, text: str = "text",
                    max_rows: int = MAX_ROWS, allowed: Column | None = None,
                    key: str = "doc_id") -> DataFrame:
    """At most ``max_rows`` labelled documents, as ``label`` (int) and ``text``.

    Labels are ordered by a hash of their key, which is as good as drawing by lot and
    gives the same rows on every run. ``allowed`` is a condition on the labels' key.
    NULL keys and labels are left out; of several labels for a key the highest counts.
    A key that several documents share gives at most PER_KEY of them, those of the least
    hashes of their texts, and further ones only after each key has one.
    """
    known = labels.select(F.col(f"`{key}`").alias("_key"),
                          F.col(f"`{label}`").cast("int").alias("_label")).dropna()
    known = known.groupBy("_key").agg(F.max("_label").alias("_label"))
    if allowed is not None:
        known = known.withColumn(key, F.col("_key")).filter(allowed).select("_key", "_label")
    # Tables of at most max_rows rows of a few numbers are broadcast.
    drawn = known.orderBy(F.xxhash64("_key"), "_key").limit(max_rows)
    texts = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("text"))
    held = texts.join(F.broadcast(drawn), "_key").groupBy("_key", "_label").agg(F.count("*").alias("_rows"))
    places = (held.withColumn("_place", F.explode(F.sequence(F.lit(1), F.least("_rows", F.lit(PER_KEY)).cast("int"))))
              .orderBy("_place", F.xxhash64("_key"), "_key").limit(max_rows))
    quotas = durable_table(places.groupBy("_key", "_label", "_rows").agg(F.max("_place").alias("_quota")))
    alone = texts.join(F.broadcast(quotas.filter("_rows = 1")), "_key").select("_label", "text")
    several = quotas.filter("_rows > 1")
    if not several.isEmpty():
        # The bound by a constant cuts a key's rows before they are shuffled.
        nth = F.row_number().over(Window.partitionBy("_key").orderBy(F.xxhash64("text"), "text"))
        ranked = (texts.join(F.broadcast(several), "_key").withColumn("_nth", nth)
                  .filter(F.col("_nth") <= PER_KEY).filter("_nth <= _quota"))
        alone = alone.union(ranked.select("_label", "text"))
    return alone.select(F.col("_label").alias("label"), "text")
