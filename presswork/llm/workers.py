"""Arrow batches handed to functions of this package in the Python workers."""

from __future__ import annotations

import gc
import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructType

_ROOT = str(Path(__file__).resolve().parents[2])

#: What this worker holds for later tasks of the same kind, such as an encoder; see ``map_batches``.
HELD: list = []


def let_go() -> None:
    """Frees what is held now; an encoder and its words refer to each other and would else wait for the collector."""
    if HELD:
        HELD.clear()
        gc.collect()


def find_package(df: DataFrame) -> None:
    """Lets workers on this machine import the package from where the driver did.

    On other machines the package must be there, or come along with ``--py-files``.
    """
    environment = df.sparkSession.sparkContext.environment
    known = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in known:
        environment["PYTHONPATH"] = os.pathsep.join([*known, _ROOT])


def map_batches(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
                schema: StructType | str, holds: bool = False) -> DataFrame:
    """``function`` over the rows of each partition; what Arrow holds goes back when it ends.

    Workers outlive a job. A function that is not said to use what is in ``HELD`` has it freed
    first, so that a later step does not run beside what an earlier one remembered.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not holds:
            let_go()
        try:
            yield from function(batches)
        finally:
            pa.default_memory_pool().release_unused()

    find_package(df)
    return df.mapInArrow(run, schema)


def with_text(docs: DataFrame, columns: list[str], text: str) -> tuple[DataFrame, int]:
    """The columns and the text, which is sent once, and the text's place."""
    kept = [docs[c] for c in columns]
    if text in columns and docs.schema[text].dataType == StringType():
        return docs.select(*kept), columns.index(text)
    return docs.select(*kept, docs[text].cast("string").alias("_text")), len(columns)
