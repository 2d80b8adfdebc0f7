"""A large table cut down to the keys that a small one may hold, before anything is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Keys a sieve is made of at most; the broadcast then holds MAX_KEYS * BITS / 64 pairs of longs.
MAX_KEYS = 4_000_000
#: Bits for each key. A key that is not there passes about once in a hundred.
BITS = 24


def _mark(key: Column) -> Column:
    """Two of the 64 bits of a word, by a hash of the key."""
    h = F.xxhash64(F.lit(1), key)
    one, other = F.pmod(h, F.lit(64)).cast("int"), F.pmod(F.shiftright(h, 20), F.lit(64)).cast("int")
    one_bit = F.lit(1).cast("long")
    return F.call_function("shiftleft", one_bit, one).bitwiseOR(F.call_function("shiftleft", one_bit, other))


def sieve(rows: DataFrame, key: str, keys: DataFrame, keys_column: str | None = None) -> DataFrame:
    """The ``rows`` whose ``key`` may be among the ``keys``; an exact join must follow.

    A Bloom filter in words of 64 bits, two of them for each key, made by a hash
    aggregation and looked up in a broadcast join, all inside generated code. So rows that
    meet nothing leave where they are read. ``keys`` is read twice; pass a stored table.
    NULL keys never pass. Beyond MAX_KEYS keys all other rows pass, and only the join decides.
    """
    wanted = keys.select(F.col(keys_column or key).alias("_key")).where("_key IS NOT NULL")
    n = wanted.limit(MAX_KEYS + 1).count()
    known = rows.where(F.col(key).isNotNull())
    if n > MAX_KEYS:
        return known
    words = max(1, n * BITS // 64)

    def word(column: Column) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(words).cast("long"))
    marks = wanted.groupBy(word(F.col("_key")).alias("_word")).agg(F.bit_or(_mark(F.col("_key"))).alias("_marks"))
    mark = _mark(F.col(key))
    # At most one row for each word, counted above.
    return known.join(F.broadcast(marks), word(F.col(key)) == F.col("_word")).where(
        F.col("_marks").bitwiseAND(mark) == mark).select(*rows.columns)
