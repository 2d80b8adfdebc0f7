"""Counts and facets. All aggregate partially before the shuffle."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from presswork.functions.suffixes import SuffixRules
from presswork.functions.urls import host
from presswork.operators.domains import with_domain
from presswork.operators.filters import ALL, since_days


def source_counts(df: DataFrame, as_of: dt.datetime | str, days: int = 7) -> DataFrame:
    """Articles per source since ``days`` before ``as_of``, the largest first."""
    return (
        since_days(df, as_of, days)
        .where(F.col("source").isNotNull())
        .groupBy("source").agg(F.count("*").alias("articles"))
        .orderBy(F.desc("articles"), F.asc("source"))
    )


def daily_counts(df: DataFrame) -> DataFrame:
    """Articles per calendar day in date order; days without any are absent."""
    return (
        df.where(F.col("date").isNotNull())
        .groupBy(F.to_date("date").alias("day")).agg(F.count("*").alias("articles"))
        .orderBy("day")
    )


def facet(df: DataFrame, column: str) -> DataFrame:
    """The filter choices of a column: ``ALL`` first, then its values in order."""
    values = (
        df.where(F.col(column).isNotNull())
        .select(F.col(column).alias("value")).distinct()
        .select(F.lit(1).alias("rank"), "value")
    )
    everything = df.sparkSession.range(0, 1, 1, 1).select(
        F.lit(0).alias("rank"), F.lit(ALL).alias("value"))
    return everything.unionAll(values).orderBy("rank", "value")


def domain_facet(df: DataFrame, rules: SuffixRules | None = None) -> DataFrame:
    """The same for registered domains; each host is looked up once."""
    hosts = df.where(F.col("url").isNotNull()).select(host(F.col("url")).alias("url")).distinct()
    return facet(with_domain(hosts, rules), "domain")


def url_count(df: DataFrame, url: str) -> DataFrame:
    """How many rows carry this URL, as one row."""
    return df.where(F.col("url") == url).agg(F.count("*").alias("n"))
