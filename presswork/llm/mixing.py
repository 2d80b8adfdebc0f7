"""Poisson replication: sources repeated to target weights, then shuffled globally."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from presswork.session import durable, durable_table

#: Largest mean drawn with one uniform number; larger means are sums of several draws.
CHUNK = 32
#: Entries of the distribution kept for a mean of CHUNK; the rest weighs under 1e-20.
STEPS = 128
#: Uniform numbers have so many bits.
BITS = 52
#: Sources whose distributions, of a kilobyte each, are sent to all executors; more are joined.
BROADCAST_SOURCES = 10_000
#: Equal rows that are counted off in one place; more are dealt out in runs of so many.
TWINS = 1024


def keyed_bits(*parts: Column | str) -> Column:
    """A long of BITS bits, spread evenly, that depends on the parts alone."""
    text = F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else
                              F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("long")


def repetition_rates(docs: DataFrame, weights: dict[str, float], default_weight: float = 1.0,
                     epochs: float = 1.0, source: str = "source", text: str = "text") -> DataFrame:
    """One row per source: ``source``, ``bytes`` and ``rate``.

    The rate is the mean number of copies of each document with which a source gets
    its share ``weight / sum of weights`` of ``epochs`` times all bytes. A document
    counts its UTF-8 bytes plus one. NULL is a source of its own with the default
    weight. Sums are made before anything is shuffled, so a source may hold most rows.
    """
    if default_weight < 0 or any(w < 0 for w in weights.values()):
        raise ValueError("weights must not be negative")
    size = F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).cast("long") + 1
    sizes = durable(docs.groupBy(F.col(f"`{source}`").alias("source"))
                    .agg(F.sum(size).alias("bytes")))
    weight = F.lit(float(default_weight))
    for name, value in weights.items():
        weight = F.when(F.col("source") == name, F.lit(float(value))).otherwise(weight)
    weighed = sizes.withColumn("weight", weight)
    total, all_weights = weighed.agg(F.sum("bytes"), F.sum("weight")).first()
    share = F.col("weight") / F.lit(float(all_weights or 1.0) or 1.0)
    return weighed.select(
        "source", "bytes",
        (share * F.lit(float(epochs) * (total or 0)) / F.col("bytes")).alias("rate"))


def _distribution(mean: Column) -> Column:
    """The cumulative Poisson probabilities of 0 to STEPS - 1."""
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("cdf"))

    def step(state: Column, k: Column) -> Column:
        p = state["p"] * mean / k
        return F.struct(p.alias("p"), F.array_append(
            state["cdf"], F.element_at(state["cdf"], -1) + p).alias("cdf"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS - 1)), start, step, lambda s: s["cdf"])


def _told_apart(keyed: DataFrame) -> DataFrame:
    """``_record``, ``_from`` and a ``_key`` (text) that no two rows share.

    A key that stands on one row is left alone, so its hashes are a function of the key.
    Rows that share a key, NULL and the empty text being one, add a digest of the whole
    row and, for equal rows, a number from 0. Equal rows are counted before they are
    shuffled, and dealt out in runs, so they may be most rows.
    """
    keyed = keyed.withColumn("_key", F.coalesce("_key", F.lit("")))
    shared = durable_table(keyed.groupBy("_key").agg(F.count("*").alias("_n")).filter("_n > 1")
                           .select(F.col("_key").alias("_shared")))
    if shared.isEmpty():
        return keyed
    sharing = F.col("_key") == F.col("_shared")
    equal = durable_table(keyed.join(shared, sharing, "left_semi")
                          .groupBy("_record", "_from", "_key").agg(F.count("*").alias("_n")))
    marked = equal.withColumn("_key", F.concat_ws("|", "_key", F.md5(F.to_json("_record", {"ignoreNullFields": "false"}))))
    few = marked.filter(F.col("_n") <= TWINS).withColumn("_twin", F.explode(F.expr("sequence(0L, _n - 1)")))
    runs = (marked.filter(F.col("_n") > TWINS)
            .withColumn("_start", F.explode(F.expr(f"sequence(0L, _n - 1, {TWINS}L)")))
            .repartition("_key", "_start")
            .withColumn("_twin", F.explode(F.expr(f"sequence(_start, least(_start + {TWINS}, _n) - 1)"))))
    columns = ["_record", "_from", F.concat_ws("|", "_key", "_twin").alias("_key")]
    return (keyed.join(shared, sharing, "left_anti")
            .union(few.select(*columns)).union(runs.select(*columns)))


def replicate(docs: DataFrame, rates: DataFrame, seed: str = "mix", key: str = "doc_id",
              source: str = "source", copy: str = "copy_no", order: str = "mix_key",
              partitions: int | None = None) -> DataFrame:
    """Each document as often as its Poisson draw says, in a global random order.

    The draw inverts the distribution whose mean is the source's rate at a number
    hashed from ``seed`` and the key, so it is the same on every run and machine. Rows
    with one key, NULL keys and repeated rows too, each have a draw and a place of their
    own: they hash their content and a number among equal rows as well, since one draw
    for all would lose or repeat them together and put them in one place. A mean above CHUNK is split into equal parts with a draw each. Adds ``copy`` (int,
    from 0) and ``order`` (long), which replace columns of those names. Rows are
    dealt to partitions by ranges of ``order``, which needs no sampling since hashes
    are spread evenly, and sorted inside: files in the order of their names, rows in
    theirs, are the global order.

    A NULL source draws at its own rate; a source without a row in ``rates``, or with rate 0, gives
    no copies. Up to BROADCAST_SOURCES sources are broadcast, so that the only shuffle of
    documents is the one into their order. Texts are carried whole, NULL and empty ones too. An empty table gives
    an empty table.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = [c for c in docs.columns if c not in (copy, order)]
    parts = F.greatest(F.ceil(F.col("rate") / CHUNK), F.lit(1)).cast("int")
    drawn = rates.filter("rate > 0").select(
        F.col("source").alias("_source"), parts.alias("_parts"),
        _distribution(F.col("rate") / parts).alias("_cdf"))
    record = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_record")
    keyed = _told_apart(docs.select(record, F.col(f"`{source}`").alias("_from"),
                                    F.col(f"`{key}`").cast("string").alias("_key")))
    # Counted first: only as a broadcast do documents stay where they are, and a source may be most of them.
    if rates.filter("rate > 0").limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        drawn = F.broadcast(drawn)
    joined = keyed.join(drawn, F.col("_from").eqNullSafe(F.col("_source")))

    def draw(j: Column) -> Column:
        uniform = keyed_bits(seed, "draw", j, F.col("_key")) / F.lit(float(2 ** BITS))
        return F.size(F.filter("_cdf", lambda c: c <= uniform))
    times = F.aggregate(F.sequence(F.lit(0), F.col("_parts") - 1), F.lit(0),
                        lambda total, j: total + draw(j))
    copies = (
        joined.select("_record", "_key", times.alias("_times"))
        .select("_record", "_key",
                F.explode(F.expr("CASE WHEN _times > 0 THEN sequence(0, _times - 1) END")).alias(copy))
        .select("_record.*", copy,
                keyed_bits(seed, "order", F.col(copy), F.col("_key")).alias(order)))
    slot = F.floor(F.col(order) / F.lit(float(2 ** BITS)) * n).cast("int")
    return (copies.repartitionById(n, slot)
            .sortWithinPartitions(order, copy, *[c for c in (key,) if c in columns]))
