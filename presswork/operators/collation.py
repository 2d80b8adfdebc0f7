"""Equality of texts under a collation."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Letters that differ in case only are equal, as in a database that ignores case.
IGNORE_CASE = "UTF8_LCASE"


def collated(text: Column, collation: str | None) -> Column:
    """A text that compares under one of Spark's collations; by its bytes without one."""
    return text if collation is None else F.collate(text, collation)
