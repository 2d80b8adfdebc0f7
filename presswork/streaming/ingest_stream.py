"""Records that keep arriving, ingested as a stream of batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from presswork.plans.ingest_job import ingest_batch
from presswork.session import durable


def start_ingest(spark: SparkSession, arrivals: str, root: str, progress: str,
                 **trigger: object) -> StreamingQuery:
    """Watch a folder of JSON-lines files and add what arrives to the corpus.

    ``progress`` is the stream's own checkpoint folder. A batch that is run
    again after a failure replaces what it wrote before. Triggers are those of
    ``DataStreamWriter.trigger``; without one, batches follow each other.
    """
    def add(batch: DataFrame, batch_id: int) -> None:
        numbered = batch.select(F.monotonically_increasing_id().alias("seq"),
                                F.col("value").alias("raw"))
        ingest_batch(durable(numbered), root, batch_id)

    writer = spark.readStream.text(arrivals).writeStream.foreachBatch(add).option(
        "checkpointLocation", progress)
    return (writer.trigger(**trigger) if trigger else writer).start()
