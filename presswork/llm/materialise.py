"""Token sequences written in training order, as binary shards of fixed stride."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import (
    ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType)

from presswork.llm import bpe
from presswork.llm.workers import map_batches
from presswork.session import durable_table

_ROUNDS = 6


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def permute(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """Where each of the numbers 0 to ``size`` - 1 goes in the permutation that ``key`` names.

    A Feistel network permutes the least square power of two that holds ``size``
    numbers; what falls outside goes through it again until it is inside, so the
    whole is one to one. The square has under four times ``size`` numbers.
    """
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = _mix(np.arange(1, _ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                + np.uint64(key % (1 << 64)))
    values = index.astype(np.uint64)
    outside = np.ones(len(values), bool)
    while outside.any():
        left, right = values[outside] >> shift, values[outside] & mask
        for k in keys:
            left, right = right, left ^ (_mix(right + k) & mask)
        values[outside] = left << shift | right
        outside = values >= np.uint64(size)
    return values.astype(np.int64)


#: Texts from which the compressor learns what token sequences look like, the characters it
#: takes of each, and the bytes it keeps of it all.
SAMPLE_TEXTS, SAMPLE_CHARACTERS, DICTIONARY_BYTES = 500, 20_000, 112_640
#: Sequences handed on at once.
BATCH_SEQUENCES = 2000


def _ended(raw: bytes, end_id: int) -> np.ndarray:
    """A text's ids and an end token, in 16 bits."""
    ids = np.empty(len(raw) // 4 + 1, "<u2")
    ids[:-1], ids[-1] = np.frombuffer(raw, np.int32), end_id
    return ids


def learn_dictionary(docs: DataFrame, vocabulary: Broadcast, length: int, end_id: int,
                     text: str = "text") -> bytes:
    """A compression dictionary from sequences of at most SAMPLE_TEXTS texts; b"" if they are too few.

    It only makes stored rows smaller: any dictionary gives the same rows back.
    """
    own = bpe.Encoder(vocabulary.value)
    texts = docs.select(F.substring(docs[text].cast("string"), 1, SAMPLE_CHARACTERS).alias("text")).limit(SAMPLE_TEXTS)
    parts = [_ended(raw, end_id) for t in texts.toLocalIterator() if (raw := own.encode(t["text"]))]
    stream = np.concatenate([*parts, np.zeros(0, "<u2")])
    if 2 * len(stream) < 4 * DICTIONARY_BYTES:
        return b""
    rows = [stream[i:i + length].tobytes() for i in range(0, len(stream), length)]
    return zstandard.train_dictionary(DICTIONARY_BYTES, rows).as_bytes()


def sequences(docs: DataFrame, vocabulary: Broadcast, length: int, end_id: int,
              text: str = "text", key: str = "doc_id", dictionary: bytes = b"") -> DataFrame:
    """Rows of ``length`` token ids: ``docs``, ``n_tokens``, ``payload``.

    The texts of a partition follow each other, an end token after each, and are cut into
    sequences; only the partition's last one is filled up, with end tokens that ``n_tokens``
    does not count. ``docs`` lists what a sequence is made of: ``doc_id``, ``doc_start`` (the
    part's place in the document's tokens), ``start`` (its place in the sequence) and
    ``n_tokens`` (the end token included). ``payload`` is the 16-bit little-endian form,
    compressed with the help of ``dictionary``, which ``write_shards`` then needs too. NULL
    texts and those without tokens are in no sequence. A vocabulary with ids above 65,535
    is refused.
    """
    if max(end_id, bpe.highest_id(vocabulary)) > 0xFFFF:
        raise ValueError("sequences hold ids of 16 bits")
    part = StructType([
        StructField("doc_id", docs.schema[key].dataType), StructField("doc_start", IntegerType()),
        StructField("start", IntegerType()), StructField("n_tokens", IntegerType())])
    schema = StructType([StructField("docs", ArrayType(part)), StructField("n_tokens", IntegerType()),
                         StructField("payload", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, packer = bpe.encoder(vocabulary), zstandard.ZstdCompressor(6, dict_data=_known(dictionary))
        kind = None
        # The sequence that is being filled, those that are full, the parts of all, and how many of them are in full ones.
        row, used, parts, listed = np.full(length, end_id, "<u2"), 0, [], 0
        full: list[tuple] = []

        def out() -> pa.RecordBatch:
            counts, sizes, payloads = zip(*full)
            columns = [pa.array(c, t) for c, t in zip(zip(*parts), (kind, *[pa.int32()] * 3))]
            return pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]), pa.int32()),
                                          pa.StructArray.from_arrays(columns, names=part.names)),
                 pa.array(sizes, pa.int32()), pa.array(payloads, pa.binary())], names=schema.names)
        for batch in batches:
            kind = batch.column(0).type
            texts = own.encode_all(item.as_py() for item in batch.column(1))
            for name, raw in zip(batch.column(0).to_pylist(), texts):
                if not raw:
                    continue
                ids, at = _ended(raw, end_id), 0
                while at < len(ids):
                    n = min(length - used, len(ids) - at)
                    row[used:used + n] = ids[at:at + n]
                    parts.append((name, at, used, n))
                    at, used = at + n, used + n
                    if used == length:
                        full.append((len(parts) - listed, used, packer.compress(row)))
                        used, listed = 0, len(parts)
                        if len(full) == BATCH_SEQUENCES:
                            yield out()
                            full, parts, listed = [], [], 0
        if used:
            row[used:] = end_id
            full.append((len(parts) - listed, used, packer.compress(row)))
        if full:
            yield out()

    return map_batches(docs.select(docs[key].alias("doc_id"), docs[text].cast("string").alias("text")),
                       run, schema, holds=True)


def _known(dictionary: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


def assign_slots(rows: DataFrame, key: int, columns: list[str]) -> tuple[DataFrame, int]:
    """``columns`` of ``rows`` with a global ``slot`` each, and the number of slots.

    Rows are written once with their task and their place in it; places become
    numbers by the tasks' running totals, one row per task, and numbers become slots
    by the keyed permutation. Nothing is sorted or shuffled.
    """
    in_task = F.monotonically_increasing_id()
    part = F.spark_partition_id()
    stored = durable_table(rows.select(
        *columns, part.alias("_part"),
        (in_task - F.shiftleft(part.cast("long"), 33)).alias("_place")))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    tasks = stored.groupBy("_part").agg(F.count("*").alias("_rows"))
    offsets = durable_table(tasks.select(
        "_part", "_rows", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset")))
    size = offsets.agg(F.sum("_rows")).first()[0] or 0
    # One row per task.
    numbered = stored.join(F.broadcast(offsets.select("_part", "_offset")), "_part").select(
        *columns, (F.col("_offset") + F.col("_place")).alias("slot"))
    schema = StructType([*[rows.schema[c] for c in columns], StructField("slot", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = permute(batch.column(len(columns)).to_numpy(), size, key)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(slots)], names=schema.names)

    return map_batches(numbered, run, schema), size


def write_shards(slotted: DataFrame, size: int, folder: str, length: int, per_shard: int,
                 dictionary: bytes = b"") -> DataFrame:
    """Writes all sequences by slot and gives a row for each: where it lies and what it is.

    Slot s is the ``length * 2`` bytes from ``s % per_shard * length * 2`` on in the
    file ``shard-<s // per_shard>.bin``, so a reader can start at any slot. A task
    writes the whole shards of a range of slots, each to a name of its own that is
    then moved to the final one: a task that runs again writes the same bytes there.
    ``folder`` is one that all executors share.
    """
    spark = slotted.sparkSession
    shards = max(1, -(-size // per_shard))
    tasks = min(shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = slotted.withColumn("shard", F.expr(f"slot DIV {per_shard}")).repartitionById(
        tasks, F.expr(f"cast((slot DIV {per_shard}) * {tasks} DIV {shards} AS int)")).sortWithinPartitions("slot")
    schema = StructType([
        StructField("slot", LongType()), StructField("shard", LongType()), StructField("offset", LongType()),
        slotted.schema["docs"], StructField("n_tokens", IntegerType()), StructField("crc32", LongType()),
        StructField("path", StringType())])
    stride = 2 * length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        unpack = zstandard.ZstdDecompressor(dict_data=_known(dictionary))
        name = stream = None

        def close() -> None:
            if stream is not None:
                stream.close()
                files.move(f"{name}.{token}", name)
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("slot", "shard", "n_tokens", "payload")]
            sums, paths = [], []
            for slot, shard, *_, payload in zip(*columns):
                path = f"{root}/shard-{shard:08d}.bin"
                if path != name:
                    close()
                    name, token = path, uuid.uuid4().hex
                    stream = files.open_output_stream(f"{name}.{token}")
                raw = unpack.decompress(payload)
                stream.write(raw)
                sums.append(zlib.crc32(raw))
                paths.append(path)
            slots = np.array(columns[0], np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array(slots), pa.array(columns[1], pa.int64()), pa.array(slots % per_shard * stride),
                batch.column(batch.schema.get_field_index("docs")), pa.array(columns[2], pa.int32()), pa.array(sums, pa.int64()), pa.array(paths, pa.string())],
                names=schema.names)
        close()

    return durable_table(map_batches(
        ordered.select("slot", "shard", "docs", "n_tokens", "payload"), run, schema))


def read_shards(spark, folder: str, length: int, per_shard: int, size: int, start: int = 0) -> DataFrame:
    """``slot`` and ``ids`` of all sequences from slot ``start`` on, read from the shard files."""
    first, shards = start // per_shard, -(-size // per_shard)
    names = spark.range(first, max(shards, first)).withColumnRenamed("id", "shard")
    stride = 2 * length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                skip = max(start - shard * per_shard, 0)
                with files.open_input_file(f"{root}/shard-{shard:08d}.bin") as file:
                    file.seek(skip * stride)
                    slot = shard * per_shard + skip
                    while raw := file.read(1024 * stride):
                        ids = np.frombuffer(raw, "<u2").astype(np.int32)
                        n = len(ids) // length
                        yield pa.RecordBatch.from_arrays([
                            pa.array(np.arange(slot, slot + n)),
                            pa.ListArray.from_arrays(pa.array(np.arange(0, len(ids) + 1, length), pa.int32()),
                                                     pa.array(ids))], names=["slot", "ids"])
                        slot += n

    return map_batches(names, run, "slot long, ids array<int>")
