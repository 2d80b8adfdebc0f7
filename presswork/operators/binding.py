"""Costly values computed once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def bind(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column whose expression the optimizer keeps in one place.

    A projected expression is copied into every filter that is pushed below the
    projection, and from there into each use of it. A generator over one value
    gives the same rows, but nothing is pushed or inlined through it.
    """
    return df.withColumn(name, F.explode(F.array(value)))
