"""Session settings and durable materialisation shared by all operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    # Checkpoints go when nothing refers to them any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # Otherwise every column expression looks up its Python call site.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


#: How files with whole texts are compressed.
TEXT_CODEC = "zstd"


def build_session(app_name: str = "presswork", master: str | None = None,
                  **conf: str) -> SparkSession:
    """A session with adaptive execution and skew handling switched on.

    Naive timestamps are compared as they are, so the zone is pinned to UTC.
    Extra settings are given with dots written as double underscores, e.g.
    ``spark__sql__shuffle__partitions="2000"``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = SESSION_CONF | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _checkpoint_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, set from its configuration if need be.

    A temporary folder is only used in local mode.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="presswork-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


_SCRATCH: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def shared_folder(spark: SparkSession, kind: str) -> str:
    """The path of a new folder that all executors share, in the checkpoint folder."""
    path = f"{_checkpoint_folder(spark)}/{kind}-{uuid.uuid4().hex}"
    if (named := _SCRATCH.get()) is not None:
        named.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """For a job that ends with its results written elsewhere: folders named in it are removed after it."""
    named: list[str] = []
    before = _SCRATCH.set(named)
    try:
        yield
    finally:
        _SCRATCH.reset(before)
        for path in named:
            discard(spark, path)


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and return it read back from there.

    Used where two passes must see the same rows in the same partitions and
    order, also after an executor is lost.
    """
    _checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def durable_table(df: DataFrame, codec: str | None = None) -> DataFrame:
    """The same for wide rows that later steps read only some columns of."""
    path = shared_folder(df.sparkSession, "table")
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a folder that ``shared_folder`` named, when nothing reads it any more."""
    if not path.startswith(f"{_checkpoint_folder(spark)}/"):
        raise ValueError("only folders in the checkpoint folder are removed")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
