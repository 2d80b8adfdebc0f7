"""Near duplicates by HyperMinHash: banded compressed registers, estimates, exact checks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import (
    ArrayType, BinaryType, LongType, StructField, StructType)

from presswork.llm.components import connected_components
from presswork.llm.memory import Memory
from presswork.llm.workers import map_batches
from presswork.session import durable_table

#: Words in a shingle.
WORDS = 5
#: Links join sets whose intersection is at least so many hundredths of their union.
PERCENT = 75
#: Buckets of a sketch, each with a register of leading zeros and mantissa bits.
REGISTERS = 256
MANTISSA_BITS = 10
#: Bands of four registers. Sets alike by 0.75 miss each other in all bands once in 80 million.
BANDS, ROWS = 48, 4
#: Members of a bucket, and shingles of them, that are compared with as many others at once;
#: larger buckets are compared block by block.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20

_SHIFT = np.uint64(56)
_LOW = np.uint64((1 << 56) - 1)
_MULTIPLIERS = np.random.default_rng(5).integers(1, 1 << 63, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)
#: For each bucket, the order in which an empty one looks for a register to borrow.
_PROBES = np.array([np.random.default_rng(1000 + i).permutation(REGISTERS) for i in range(REGISTERS)])
_STARTS = np.arange(REGISTERS, dtype=np.uint64) << _SHIFT


def _mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers evenly, one to one."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles_of(text: str | None, hashes: Memory) -> np.ndarray:
    """The sorted 64-bit hashes of a whole text's distinct shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    word = np.array(hashes.all(words), np.uint64)
    if len(words) < WORDS:
        # Word by word, since any character may stand in a word.
        return np.array([xxhash.xxh3_64_intdigest(word.tobytes(), seed=len(words))], np.uint64)
    n = len(word) - WORDS + 1
    total = np.zeros(n, np.uint64)
    for i in range(WORDS):
        total += word[i:i + n] * _MULTIPLIERS[i]
    return np.unique(_mix(total))


def sketch_of(shingles: np.ndarray) -> tuple[bytes, bytes]:
    """REGISTERS 16-bit registers, and one bit each that tells whether a shingle fell in the bucket.

    A bucket keeps its least hash, compressed to the count of leading zeros and the
    bits after the first one. An empty bucket borrows from another one, in an order
    that is the same for all sets, so registers agree as often as sets are alike.
    """
    at = np.searchsorted(shingles, _STARTS)
    filled = np.diff(np.append(at, len(shingles))) > 0
    least = shingles[np.minimum(at, len(shingles) - 1)] & _LOW
    exponent = np.frexp(least.astype(np.float64))[1]
    mantissa = (least >> np.maximum(exponent - 1 - MANTISSA_BITS, 0).astype(np.uint64)).astype(np.int64)
    registers = ((56 - exponent) << MANTISSA_BITS) | (mantissa & ((1 << MANTISSA_BITS) - 1))
    if not filled.all():
        empty = np.flatnonzero(~filled)
        lender = _PROBES[empty, np.argmax(filled[_PROBES[empty]], axis=1)]
        registers[empty] = registers[lender]
    return registers.astype(np.uint16).tobytes(), np.packbits(filled).tobytes()


def band_keys(registers: bytes) -> np.ndarray:
    """One number per band, which sets share if their registers agree in all the band's rows."""
    packed = np.frombuffer(registers, np.uint64)[:BANDS]
    return _mix(packed + _mix(np.arange(1, BANDS + 1, dtype=np.uint64))).view(np.int64)


def sketches(docs: DataFrame, text: str = "text", key: str = "doc_id",
             row: str | None = None) -> DataFrame:
    """Per row: the key, ``n_shingles``, ``set_id``, ``registers``, ``filled``, and the long ``row``.

    ``set_id`` is a 128-bit digest of the shingle set; NULL for a text without words.
    """
    carried = [row] if row else []
    schema = StructType([
        StructField("doc_id", docs.schema[key].dataType), StructField("n_shingles", LongType()),
        StructField("set_id", BinaryType()), StructField("registers", BinaryType()),
        StructField("filled", BinaryType()), *[StructField(c, LongType()) for c in carried]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Memory(xxhash.xxh3_64_intdigest)
        for batch in batches:
            rows = []
            for item in batch.column(1):
                found = shingles_of(item.as_py(), hashes)
                rows.append((len(found), _digest(found), *sketch_of(found)) if len(found)
                            else (0, None, None, None))
            n, digests, registers, filled = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()),
                pa.array(registers, pa.binary()), pa.array(filled, pa.binary()),
                *batch.columns[2:]], names=schema.names)

    return map_batches(docs.select(docs[key].alias("doc_id"), docs[text].cast("string").alias("text"),
                                   *[docs[c] for c in carried]), run, schema)


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _shingle_sets(docs: DataFrame) -> DataFrame:
    """``set_id`` and all ``shingles`` (array of long) of each text."""
    schema = StructType([StructField("set_id", BinaryType()),
                         StructField("shingles", ArrayType(LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Memory(xxhash.xxh3_64_intdigest)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                sets = [shingles_of(t.as_py(), hashes) for t in batch.column(0).slice(start, 500)]
                ends = np.cumsum([0, *map(len, sets)])
                flat = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array([_digest(s) if len(s) else None for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))],
                    names=schema.names)

    return map_batches(docs.select("text"), run, schema)


def _explode_bands(classes: DataFrame) -> DataFrame:
    schema = StructType([StructField("band", LongType()), StructField("no", LongType()),
                         StructField("set_id", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = np.concatenate([band_keys(r.as_py()) for r in batch.column(1)])
                owner = np.repeat(np.arange(batch.num_rows), BANDS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), pa.array(np.tile(np.arange(BANDS), batch.num_rows)),
                     batch.column(0).take(pa.array(owner))], names=schema.names)

    return map_batches(classes.select("set_id", "registers"), run, schema)


def estimate(agreeing: np.ndarray, either: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the filled buckets: agreeing ones among those that ``either`` set fills.

    Registers of unlike sets also agree by chance, since they are short; the expected
    share of such agreements (the published approximation for HyperMinHash) is taken off.
    """
    ratio = np.maximum(n_a, n_b) / np.maximum(np.minimum(n_a, n_b), 1)
    # Fixed value: the constant of the published approximation.
    chance = 0.169919487159739 * 2.0 ** -MANTISSA_BITS * 4 * ratio / (1 + ratio) ** 2
    return agreeing / np.maximum(either, 1) - chance


def _promising(agreeing, either, n_a, n_b) -> np.ndarray:
    """Whether a pair may be a link: its estimate is not five deviations below the threshold.

    The deviation is at most that of REGISTERS independent draws: sets with fewer shingles
    than buckets mostly have a bucket for each. Of sets with very few all pairs pass.
    """
    least = PERCENT / 100 - 5 * np.sqrt(0.1875 / REGISTERS)
    alike = 100 * np.minimum(n_a, n_b) >= PERCENT * np.maximum(n_a, n_b)
    return alike & ((estimate(agreeing, either, n_a, n_b) >= least) | (np.maximum(n_a, n_b) < 16))


def _bits(filled: list[bytes]) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(filled), np.uint8)).reshape(-1, REGISTERS).astype(bool)


def _estimated(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sketches promise a link."""
    schema = StructType([StructField("a", BinaryType()), StructField("b", BinaryType())])
    side = classes.select("set_id", F.struct("registers", "n_shingles", "filled").alias("sketch"))
    both = (pairs.join(side.select(F.col("set_id").alias("a"), F.col("sketch").alias("of_a")), "a")
            .join(side.select(F.col("set_id").alias("b"), F.col("sketch").alias("of_b")), "b")
            .select("a", "b", "of_a.registers", "of_b.registers", "of_a.n_shingles", "of_b.n_shingles",
                    "of_a.filled", "of_b.filled")
            .toDF("a", "b", "ra", "rb", "na", "nb", "fa", "fb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ra, rb = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16)
                          .reshape(-1, REGISTERS) for i in (2, 3))
                fa, fb = (_bits(batch.column(i).to_pylist()) for i in (6, 7))
                good = _promising(((ra == rb) & fa & fb).sum(axis=1), (fa | fb).sum(axis=1),
                                  batch.column(4).to_numpy(), batch.column(5).to_numpy())
                yield batch.select(["a", "b"]).filter(pa.array(good))

    return map_batches(both, run, schema)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are links, by their full sets."""
    inside = F.size(F.array_intersect("sa", "sb")).cast("long")
    return (pairs.join(sets.select(F.col("set_id").alias("a"), F.col("shingles").alias("sa")), "a")
            .join(sets.select(F.col("set_id").alias("b"), F.col("shingles").alias("sb")), "b")
            .select("a", "b", inside.alias("i"), (F.size("sa") + F.size("sb")).alias("n"))
            .filter(f"100 * i >= {PERCENT} * (n - i)").select("a", "b"))


class _Block:
    """Two blocks of a bucket: ``left`` rows, none of them in its main component, and ``right`` ones."""

    def __init__(self, rows: pa.Table):
        self.rows = rows
        left = rows.column("is_left").to_numpy()
        self.left, self.right = np.flatnonzero(left), np.flatnonzero(~left)
        self.ids = np.array(rows.column("set_id").to_pylist(), object)
        self.rank = np.unique(self.ids, return_inverse=True)[1]
        self.labels = np.unique(np.array(rows.column("label").to_pylist(), object), return_inverse=True)[1]
        self.stray = rows.column("stray").to_numpy()
        self.n = rows.column("n_shingles").to_numpy()
        self.no = rows.column("no")[0].as_py()
        self.registers = np.frombuffer(b"".join(rows.column("registers").to_pylist()), np.uint16).reshape(-1, REGISTERS)
        self.filled = _bits(rows.column("filled").to_pylist())

    def promising(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of the pairs of different components that their sketches promise to be links.

        A pair of two strays is looked at from one side only, and a pair that meets in
        several bands in the first one only.
        """
        earlier = np.ascontiguousarray(self.registers).view(np.uint64)[:, :self.no]
        y, counts = self.right, self.filled.sum(axis=1)
        numbers = self.filled[y].T.astype(np.float32)
        found = [np.zeros((2, 0), int)]
        for start in range(0, len(self.left), 32):
            x = self.left[start:start + 32]
            part = x[:, None]
            both = self.filled[part] & self.filled[y][None]
            agreeing = ((self.registers[part] == self.registers[y][None]) & both).sum(axis=2)
            either = counts[part] + counts[y][None] - (self.filled[x] @ numbers).astype(int)
            good = _promising(agreeing, either, self.n[part], self.n[y][None])
            good &= self.labels[part] != self.labels[y][None]
            good &= ~self.stray[y][None] | (self.rank[part] < self.rank[y][None])
            a, b = np.nonzero(good)
            once = ~(earlier[x[a]] == earlier[y[b]]).any(axis=1)
            found.append(np.stack([x[a[once]], y[b[once]]]))
        return tuple(np.concatenate(found, axis=1))

    def candidates(self) -> pa.Table:
        """The rows that are part of a promising pair."""
        return self.rows.take(pa.array(np.unique(np.concatenate(self.promising()))))

    def links(self) -> pa.RecordBatch:
        """Links that join components, at most one less than there are rows, by full sets.

        A promising pair is checked unless a chain of links found before joins it already.
        """
        column = self.rows.column("shingles").combine_chunks()
        sizes = column.value_lengths().to_numpy()
        starts = np.cumsum(sizes) - sizes
        kinds, numbers = np.unique(column.flatten().to_numpy(), return_inverse=True)
        marked = np.zeros(len(kinds), bool)
        root = list(range(len(self.ids)))

        def find(k: int) -> int:
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k
        ends = []
        a, b = self.promising()
        firsts = np.flatnonzero(np.diff(a, prepend=-1))
        for x, some in zip(a[firsts], np.split(b, firsts[1:])):
            own = numbers[starts[x]:starts[x] + sizes[x]]
            partners = [y for y in some if find(self.labels[y]) != find(self.labels[x])]
            if not partners:
                continue
            marked[own] = True
            length = sizes[partners]
            before = np.cumsum(length) - length
            at = np.arange(length.sum()) - np.repeat(before, length) + np.repeat(starts[partners], length)
            inside = np.add.reduceat(marked[numbers[at]].astype(np.int64), before)
            marked[own] = False
            for y in np.array(partners)[100 * inside >= PERCENT * (sizes[x] + length - inside)]:
                one, other = find(self.labels[x]), find(self.labels[y])
                if one != other:
                    root[one] = other
                    ends.append((self.ids[x], self.ids[y]))
        return pa.RecordBatch.from_arrays(
            [pa.array([e[i] for e in ends], pa.binary()) for i in (0, 1)], names=["a", "b"])


def _by_block(function):
    """Hands each pair of blocks of rows that come sorted by ``_KEYS`` to the function, one at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None

        def finished() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held)
            # Without rows on both sides there is nothing to compare.
            if 0 < np.count_nonzero(rows.column("is_left").to_numpy()) < rows.num_rows:
                out = function(_Block(rows))
                yield from out.to_batches() if isinstance(out, pa.Table) else [out]
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in _KEYS], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(keys)]
            for start, end in zip(cuts[:-1], cuts[1:]):
                if start == end:
                    continue
                if key is not None and key != tuple(keys[start]):
                    yield from finished()
                    held = []
                key = tuple(keys[start])
                held.append(batch.slice(start, end - start))
        if held:
            yield from finished()
    return run


_KEYS = ["band", "i", "j"]
_PLACED = "band long, no long, i int, j int, set_id binary, label binary, is_left boolean, stray boolean, " \
          "registers binary, n_shingles long, filled binary"


def _block_links(members: DataFrame, labels: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that join the components of ``labels`` which meet in buckets, all of them.

    Of buckets with the same members, the one of the first band is looked into. Those of
    its members that are not in its largest component are compared, block by block, with
    all members. First by sketches, which leaves the rows of promising pairs; then these
    come together with their full sets, and the pairs are checked where they meet.
    """
    known = members.join(labels.withColumnRenamed("id", "set_id"), "set_id", "left").join(
        classes.select("set_id", "n_shingles"), "set_id").select(
        "band", "no", "set_id", "n_shingles", F.coalesce("label", "set_id").alias("label"))
    known = durable_table(known)
    wide = "decimal(38,0)"
    by_label = known.groupBy("band", "no", "label").agg(
        F.count("*").alias("rows"), F.sum("n_shingles").alias("shingles"),
        F.sum(F.xxhash64("set_id").cast(wide)).alias("who"),
        F.sum(F.xxhash64(F.lit(1), "set_id").cast(wide)).alias("and_who"))
    split = by_label.groupBy("band", "no").agg(
        F.count("*").alias("labels"), F.max(F.struct("rows", "label", "shingles")).alias("main"),
        *[F.sum(c).alias(c) for c in ("rows", "shingles", "who", "and_who")]).filter("labels > 1")
    split = split.groupBy("rows", "who", "and_who").agg(
        F.min(F.struct("no", "band", "main", "shingles")).alias("first")).select("rows", "first.*")

    def blocks(rows, shingles):
        return F.greatest(F.ceil(rows / BLOCK), F.ceil(shingles / BLOCK_SHINGLES)).cast("int")
    split = split.select(
        "band", F.col("main.label").alias("main"), blocks(F.col("rows"), F.col("shingles")).alias("all"),
        blocks(F.col("rows") - F.col("main.rows"), F.col("shingles") - F.col("main.shingles")).alias("strays"))
    spot = F.xxhash64(F.lit(2), "set_id")
    stray = F.col("label") != F.col("main")

    def places(own: str, other: str, is_left: bool):
        block, others = F.pmod(spot, own).cast("int"), F.sequence(F.lit(0), F.col(other) - 1)
        return F.transform(others, lambda k: F.struct(
            (block if is_left else k).alias("i"), (k if is_left else block).alias("j"), F.lit(is_left).alias("is_left")))
    both = F.when(stray, F.concat(places("all", "strays", False), places("strays", "all", True))).otherwise(
        places("all", "strays", False))
    placed = (known.join(split, "band").withColumn("stray", stray).withColumn("_at", F.explode(both))
              .join(classes.select("set_id", "registers", "filled"), "set_id")
              .select("band", "no", "_at.i", "_at.j", "set_id", "label", "_at.is_left", "stray",
                      "registers", "n_shingles", "filled"))
    close = durable_table(map_batches(
        placed.repartition(*_KEYS).sortWithinPartitions(*_KEYS), _by_block(_Block.candidates), _PLACED))
    full = close.join(sets, "set_id")
    return map_batches(full.repartition(*_KEYS).sortWithinPartitions(*_KEYS), _by_block(_Block.links),
                       "a binary, b binary")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``.

    Texts with the same shingles are one class. Classes whose registers agree in a band
    meet in a bucket. Each is first paired with the one that meets most classes in its
    buckets; pairs that the collision-corrected estimate promises are checked on their
    full sets, and the links make components. In buckets that still hold several, all
    members outside the largest one are then compared with all members, in blocks of
    BLOCK; the full sets of promising pairs are brought to the blocks, checked there, and
    only links that join components are handed on. So no link between classes that meet
    in a bucket is lost, what leaves a block grows with its members, and no bucket has to
    fit into one task.

    NULL and empty texts, and texts without words, have no shingles, are linked with
    nothing and kept. Texts of fewer than five words are alike only if equal. Rows with
    a repeated key are rows of their own in one component if their texts are alike;
    ``component_id`` is the least key, ``kept`` tells whether it is the row's own. A
    NULL key never is the least unless all are NULL. ``one_of_each`` keeps one row.
    """
    rows = durable_table(sketches(docs, text, key))
    named = _labelled(rows, docs, text, key)
    least = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    of_class = named.join(least, "label").select("set_id", "component_id")
    return (rows.select("doc_id", "n_shingles", "set_id").join(of_class, "set_id", "left")
            .withColumn("component_id", F.when(F.col("set_id").isNull(), F.col("doc_id"))
                        .otherwise(F.col("component_id")))
            .select("doc_id", "n_shingles", "component_id",
                    F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")))


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each component of near duplicates, and all rows without words.

    The row with the least key stays, NULL keys last; of several such rows the one that
    stands first in the table in which the rows are written and numbered. Rows are told
    apart by that number alone, so keys may be NULL, repeated, or stand on unlike texts.
    """
    row = "_row"
    while row in docs.columns:
        row = f"_{row}"
    stored = durable_table(docs.withColumn(row, F.monotonically_increasing_id()))
    rows = durable_table(sketches(stored, text, key, row))
    named = _labelled(rows, stored, text, key)
    worded = rows.filter("set_id IS NOT NULL").select("set_id", "doc_id", F.col(row).alias("_at"))
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "_at")
    # First within a class, then within a component: both reduce before they shuffle.
    of_class = worded.groupBy("set_id").agg(F.min(rank).alias("_first"))
    elected = (of_class.join(named.select("set_id", "label"), "set_id")
               .groupBy("label").agg(F.min("_first").alias("_first")).select("_first._at"))
    dropped = worded.select("_at").join(elected, "_at", "left_anti")
    return stored.join(dropped, stored[row] == dropped["_at"], "left_anti").select(
        *[stored[f"`{c}`"] for c in docs.columns])


def _labelled(rows: DataFrame, docs: DataFrame, text: str, key: str) -> DataFrame:
    """Each class of ``rows`` (sketches of ``docs``): ``set_id``, least ``doc_id``, component ``label``."""
    classes = durable_table(rows.filter("set_id IS NOT NULL").groupBy("set_id").agg(
        F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"),
        F.first("registers").alias("registers"), F.first("filled").alias("filled")))
    banded = _explode_bands(classes)
    met = banded.groupBy("band").agg(F.count("*").alias("rows")).filter("rows > 1")
    members = durable_table(banded.join(met, "band"))
    texts = docs.select(docs[key].alias("doc_id"), docs[text].cast("string").alias("text"))
    meeting = members.select("set_id").distinct().join(classes.select("set_id", "doc_id"), "set_id")
    wanted = meeting.select("doc_id").distinct()
    again = texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["doc_id"]), "left_semi")
    # A key may stand on several texts; only those that meet others are kept.
    sets = durable_table(
        _shingle_sets(again).join(meeting.select("set_id"), "set_id", "left_semi")
        .groupBy("set_id").agg(F.first("shingles").alias("shingles")))
    # Each class with the one that meets most others among the first ones of its buckets,
    # such as the text that copies were made from.
    meets = members.groupBy("set_id").agg(F.sum("rows").alias("meets"))
    counted = members.join(meets, "set_id")
    firsts = counted.groupBy("band").agg(F.max(F.struct("meets", "set_id")).alias("most"))
    stars = counted.select("band", "set_id").join(firsts, "band").groupBy("set_id").agg(
        F.max("most").alias("most")).select(F.col("most.set_id").alias("a"), F.col("set_id").alias("b")).filter("a <> b")
    links = durable_table(_verified(durable_table(_estimated(stars, classes)), sets))
    more = durable_table(_block_links(members.drop("rows"), connected_components(links), classes, sets))
    labels = connected_components(links.union(more))
    return (rows.filter("set_id IS NOT NULL").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"))
            .join(labels.withColumnRenamed("id", "set_id"), "set_id", "left")
            .select("set_id", "doc_id", F.coalesce("label", "set_id").alias("label")))
