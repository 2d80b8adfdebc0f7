"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from presswork.session import durable


def connected_components(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Each linked ``id`` with the least id of its component, as ``label``.

    ``links`` has two columns ``a`` and ``b`` of one orderable type, without NULLs;
    direction, repeats and loops do not matter. Rounds of large and small stars bring
    every id under the least of its component; their number grows with the logarithm
    of the longest chain. A round reduces before it shuffles, and its joins can be split, so a
    much linked id is no bottleneck. Rounds are kept in the checkpoint folder.
    """
    edges = durable(links.filter("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
            F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = durable(small.filter("u <> v").distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            labels = edges.select(F.col("u").alias("id"), F.col("v").alias("label"))
            return labels.union(edges.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct())
        state = now
    raise RuntimeError(f"components have not settled after {max_rounds} rounds")
