"""Foreign keys checked and deletes cascaded as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def orphans(children: DataFrame, parents: DataFrame, key: str,
            parent_key: str = "id") -> DataFrame:
    """Child rows whose parent does not exist; a NULL key refers to nothing."""
    parent = parents.select(F.col(parent_key).alias(key)).distinct()
    return children.where(F.col(key).isNotNull()).join(parent, key, "left_anti")


def cascade_delete(children: DataFrame, deleted: DataFrame, key: str,
                   parent_key: str = "id") -> DataFrame:
    """Child rows left after their parents in ``deleted`` are gone."""
    gone = deleted.select(F.col(parent_key).alias(key)).distinct()
    return children.join(gone, key, "left_anti").select(*children.columns)
