"""Row filters over the content table.

All are narrow: no shuffle, and the ones on plain columns reach the scan.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from presswork.operators.collation import collated
from presswork.functions.text import filled, matches

# Fixed value: the facet entry that stands for "no filter".
ALL = "همه"


def _search(df: DataFrame, first: Column, second: Column, mode: str) -> DataFrame:
    """Rows where either condition holds.

    ``bag`` keeps a row once for each condition it meets, as a union of two
    filtered frames would, but from a single scan; ``any`` keeps it once.
    """
    hits = df.where(first | second)
    if mode == "any":
        return hits
    if mode != "bag":
        raise ValueError("mode is 'bag' or 'any'")
    branches = F.array_compact(F.array(F.when(first, 1), F.when(second, 2)))
    return hits.withColumn("_branch", F.explode(branches)).drop("_branch")


def title_search(df: DataFrame, pattern: str | None, mode: str = "bag",
                 literal: bool = False) -> DataFrame:
    """Titles in either language that a regex is found in, ignoring case."""
    if not pattern:
        return df
    return _search(df, matches(F.col("title_persian"), pattern, literal),
                   matches(F.col("title"), pattern, literal), mode)


def keyword_pattern(keywords: str, literal: bool = False) -> str:
    """One alternation of the comma-separated, trimmed entries.

    Empty entries stay, and an empty alternative is found in every text.
    """
    parts = [part.strip() for part in keywords.split(",")]
    if literal:
        parts = ["\\Q" + part.replace("\\E", "\\E\\\\E\\Q") + "\\E" for part in parts]
    return "|".join(parts)


def content_search(df: DataFrame, keywords: str | None, mode: str = "bag",
                   literal: bool = False) -> DataFrame:
    """Contents in either language that hold one of the comma-separated entries."""
    if not keywords:
        return df
    pattern = keyword_pattern(keywords, literal)
    return _search(df, matches(F.col("content_persian"), pattern),
                   matches(F.col("content"), pattern), mode)


def by_sources(df: DataFrame, sources: list[str] | None) -> DataFrame:
    """Rows from the named sources; every row for no list or one with ``ALL``."""
    if not sources or ALL in sources:
        return df
    return df.where(F.col("source").isin(list(sources)))


def by_date_range(df: DataFrame, start: dt.date | str | None, end: dt.date | str | None,
                  end_inclusive_day: bool = False) -> DataFrame:
    """Rows dated between two moments, both included; needs both ends.

    A plain end date means its first instant, so that day's later rows are out
    unless ``end_inclusive_day`` is set. A ``day`` partition column, when there
    is one, is bounded too so that whole partitions are skipped.
    """
    if not start or not end:
        return df
    low = F.lit(str(start)).cast("timestamp_ntz")
    high = F.lit(str(end)).cast("timestamp_ntz")
    if end_inclusive_day:
        high = F.to_date(high) + F.expr("INTERVAL 1 DAY")
        in_range = (F.col("date") >= low) & (F.col("date") < high.cast("timestamp_ntz"))
    else:
        in_range = F.col("date").between(low, high)
    if "day" in df.columns:
        in_range &= F.col("day").between(F.to_date(low), F.to_date(high))
    return df.where(in_range)


def by_domain(df: DataFrame, domain: str | None) -> DataFrame:
    """Rows of one registered domain, from a ``domain`` column."""
    return df if domain in (None, ALL) else df.where(F.col("domain") == domain)


def by_type(df: DataFrame, kind: str | None) -> DataFrame:
    return df if kind in (None, ALL) else df.where(F.col("type") == kind)


def by_id(df: DataFrame, content_id: int) -> DataFrame:
    """The row with this id, no row when there is none."""
    return df.where(F.col("id") == content_id).limit(1)


def by_url(df: DataFrame, url: str, collation: str | None = None) -> DataFrame:
    """The row with this URL, of several the one with the least id; no row when there is none.

    URLs compare by their bytes, or under one of Spark's collations.
    """
    return df.where(collated(F.col("url"), collation) == collated(F.lit(url), collation)).orderBy("id").limit(1)


def url_stored(df: DataFrame, url: str) -> DataFrame:
    """Whether any row has this URL, as one row."""
    return df.where(F.col("url") == url).agg((F.count("*") > 0).alias("stored"))


def since_days(df: DataFrame, as_of: dt.datetime | str, days: int = 7) -> DataFrame:
    """Rows dated no earlier than ``days`` before ``as_of``, later ones included."""
    bound = F.lit(str(as_of)).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))
    recent = F.col("date") >= bound
    if "day" in df.columns:
        recent &= F.col("day") >= F.to_date(bound)
    return df.where(recent)


def needs_translation(df: DataFrame) -> DataFrame:
    """Rows whose second-language content is NULL or empty."""
    return df.where(~filled(F.col("content_persian")))
