"""Toxicity: a factorization machine over hashed terms."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import (
    ArrayType, DoubleType, IntegerType, LongType, StructField, StructType)

from presswork.llm.memory import Memory
from presswork.llm.workers import map_batches, with_text
from presswork.session import durable_table

#: Terms are hashed to so many buckets.
BUCKETS = 1 << 24
#: Common terms, and strong ones, that are screened in pairs: a matrix of the sample's rows and these.
SCREENED = 512
_TERM = re.compile(r"\w+")


def terms_of(text: str | None) -> set[str]:
    """The distinct terms of a whole text: runs of letters, digits and underscores in lower case."""
    return set(_TERM.findall((text or "").lower()))


def buckets_of(term: str) -> list[int]:
    """The buckets of a term and of its beginnings of 3 to 7 letters, which inflected forms share."""
    names = [term, *(term[:n] + "-" for n in range(3, min(8, len(term))))]
    return [zlib.crc32(name.encode()) % BUCKETS for name in names]


def _signature(text: str | None) -> int:
    """A number that copies and near copies of a text mostly share: its least five-term hash."""
    terms = _TERM.findall((text or "").lower())
    spans = zip(*(terms[i:] for i in range(5))) if len(terms) >= 5 else [terms]
    return min(zlib.crc32(" ".join(span).encode()) for span in spans)


@dataclass(frozen=True)
class Machine:
    """Buckets in use (sorted), their linear weights and factors, and the constant."""

    buckets: np.ndarray
    weights: np.ndarray
    factors: np.ndarray
    constant: float

    def score(self, known: list[int]) -> float:
        """The probability of label 1, given the places of a text's terms in ``buckets``."""
        total = self.constant
        if known:
            factors = self.factors[known]
            total += self.weights[known].sum()
            total += 0.5 * ((factors.sum(axis=0) ** 2).sum() - (factors ** 2).sum())
        return float(1.0 / (1.0 + np.exp(-np.clip(total, -30, 30))))


def _hashed(sample: DataFrame) -> DataFrame:
    """The sample's ``label``, ``signature`` and distinct ``buckets``."""
    schema = StructType([StructField("label", IntegerType()), StructField("signature", LongType()),
                         StructField("buckets", ArrayType(IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([_signature(t) for t in texts], pa.int64()),
                pa.array([sorted({b for w in terms_of(t) for b in buckets_of(w)}) for t in texts],
                         pa.list_(pa.int32()))], names=schema.names)

    return map_batches(sample.select("label", "text"), run, schema)


def _only(rows: DataFrame, buckets: np.ndarray) -> pa.Table:
    """The rows with the places of their buckets among ``buckets``, on the driver."""
    schema = StructType([StructField("label", IntegerType()), StructField("share", DoubleType()),
                         StructField("places", ArrayType(IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = []
            for item in batch.column(2):
                own = item.values.to_numpy()
                at = np.searchsorted(buckets, own).clip(max=max(len(buckets) - 1, 0))
                places.append(at[buckets[at] == own] if len(buckets) else at[:0])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(places, pa.list_(pa.int32()))],
                names=schema.names)

    return map_batches(rows.select("label", "share", "buckets"), run, schema).toArrow()


def _in_pairs(table: pa.Table, buckets: np.ndarray, least: float, most: int) -> np.ndarray:
    """The buckets of the pairs whose joint presence tells more of the label than both alone.

    For each pair the share of label 1 is taken in the four cells of presence and absence;
    what the cells differ by beyond the sum of both effects, squared over its variance (a cell's own or that of all rows, whichever is larger), is
    at least ``least`` for the ``most`` strongest pairs that are chosen. Cells hold five rows or more.
    """
    m = len(buckets)
    if not table.num_rows or m < 2:
        return buckets[:0]
    lists = table.column("places").combine_chunks()
    x = np.zeros((table.num_rows, m), np.float32)
    x[np.repeat(np.arange(table.num_rows), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()] = 1
    share = table.column("share").to_numpy().astype(np.float32)
    label = share * table.column("label").to_numpy().astype(np.float32)

    def cells(weight: np.ndarray) -> list[np.ndarray]:
        """The weight with both, the first alone, the second alone, and neither."""
        both = ((x * weight[:, None]).T @ x).astype(float)
        own = np.diagonal(both)
        one, other = own[:, None] - both, own[None] - both
        return [both, one, other, float(weight.sum()) - both - one - other]
    rows, positive = cells(share), cells(label)
    mean = float(label.sum() / share.sum())
    with np.errstate(all="ignore"):
        effects = [p / r for p, r in zip(positive, rows)]
        contrast = effects[0] - effects[1] - effects[2] + effects[3]
        guessed = [(p + 0.5) / (r + 1) for p, r in zip(positive, rows)]
        square = contrast ** 2 / sum(np.maximum(g * (1 - g), mean * (1 - mean)) / r for g, r in zip(guessed, rows))
    usable = np.logical_and.reduce([r >= 5 for r in rows]) & (square >= least)
    a, b = np.nonzero(np.triu(usable, 1))
    order = np.lexsort((b, a, -square[a, b]))[:most]
    return buckets[np.unique(np.concatenate([a[order], b[order]]))]


def train(sample: DataFrame, rank: int = 4, least_rows: int = 3, chi_square: float = 10.83,
          max_features: int = 4096, pair_square: float = 40.0, max_pairs: int = 64, decay: float = 5e-5, factor_decay: float = 3e-4,
          steps: int = 300, rate: float = 0.05, seed: int = 7) -> Machine:
    """Fits the machine to a bounded sample with ``label`` (0 or 1) and ``text``.

    Copies and near copies share one row's weight, so that a text stored often does not
    teach its own words. Terms in at least ``least_rows`` rows whose presence depends on
    the label (chi square, of a term alone) are features, at most ``max_features`` with
    the strongest first; Spark counts them. Terms that are neutral alone join them by
    pairs: of the SCREENED most common and the SCREENED strongest terms all pairs are
    tested for an interaction (``pair_square``), and the terms of the ``max_pairs`` strongest
    are features too. Only features come to the driver, where their weights and pairwise factors are fitted by gradient descent with adaptive steps.
    Without rows of both labels there is nothing to learn from, and no text is called
    toxic: all scores are 0 to twelve places.
    """
    hashed = durable_table(_hashed(sample))
    copies = hashed.groupBy("signature").agg(F.count("*").alias("copies"))
    rows = hashed.join(copies, "signature").select(
        "label", (1 / F.col("copies")).alias("share"), "buckets")
    total, positive = rows.agg(F.sum("share"), F.sum(F.col("share") * F.col("label"))).first()
    total, positive = total or 0.0, positive or 0.0
    if not 0 < positive < total:
        return Machine(np.zeros(0, np.int32), np.zeros(0), np.zeros((0, rank)), -np.inf)
    constant = float(np.log((positive + 0.5) / (total - positive + 0.5)))
    counts = rows.select("share", "label", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(
        F.sum("share").alias("n"), F.sum(F.col("share") * F.col("label")).alias("p"))
    spread = F.col("n") * (total - F.col("n")) * (positive * (total - positive))
    chi = F.round((F.col("p") - F.col("n") * (positive / total)) ** 2 * total ** 3 / spread, 6)
    chosen = (counts.filter((F.col("n") >= least_rows) & (F.col("n") < total))
              .withColumn("chi", chi).filter(F.col("chi") >= chi_square)
              .orderBy(F.desc("chi"), "bucket").limit(max_features).select("bucket").toArrow())
    strongest = chosen.column("bucket").to_numpy().astype(np.int32)
    # Terms that are common enough to be screened in pairs, most even ones first.
    common = (counts.filter(F.col("n").between(0.02 * total, 0.98 * total))
              .orderBy(F.desc(F.col("n") * (total - F.col("n"))), "bucket").limit(SCREENED).select("bucket").toArrow())
    screened = np.union1d(strongest[:SCREENED], common.column("bucket").to_numpy().astype(np.int32))
    buckets = np.union1d(strongest, _in_pairs(_only(rows, screened), screened, pair_square, max_pairs))
    table = _only(rows, buckets).sort_by([("label", "ascending"), ("share", "ascending")])
    lists = table.column("places").combine_chunks()
    owners = np.repeat(np.arange(table.num_rows), np.diff(lists.offsets.to_numpy()))
    weights, factors = _descend(
        owners, lists.flatten().to_numpy(), table.column("label").to_numpy().astype(float),
        table.column("share").to_numpy() / total, len(buckets), rank, constant, decay,
        factor_decay, steps, rate, seed)
    return Machine(buckets, weights[:-1], factors, float(weights[-1]))


def _descend(rows: np.ndarray, features: np.ndarray, labels: np.ndarray, share: np.ndarray, m: int,
             rank: int, constant: float, decay: float, factor_decay: float, steps: int, rate: float,
             seed: int):
    """Weights (the constant last) and factors of the least penalised logistic loss."""
    n = len(labels)
    weights = np.append(np.zeros(m), constant)
    factors = np.random.default_rng(seed).normal(0, 0.1, (m, rank))
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (weights, factors)]
    for step in range(1, steps + 1):
        sums = np.stack([np.bincount(rows, factors[features, f], n) for f in range(rank)], axis=1)
        squares = np.bincount(rows, (factors ** 2).sum(axis=1)[features], n)
        linear = np.bincount(rows, weights[:-1][features], n)
        z = weights[-1] + linear + 0.5 * ((sums ** 2).sum(axis=1) - squares)
        error = share * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels)
        on = error[rows]
        slope_w = np.append(np.bincount(features, on, m) + decay * weights[:-1], error.sum())
        slope_v = np.stack([np.bincount(features, on * (sums[rows, f] - factors[features, f]), m)
                            for f in range(rank)], axis=1) + factor_decay * factors
        for parameter, slope, (first, second) in zip((weights, factors), (slope_w, slope_v), moments):
            first += 0.1 * (slope - first)
            second += 0.001 * (slope ** 2 - second)
            parameter -= rate * (first / (1 - 0.9 ** step)) / (
                np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
    return weights, factors


def score(docs: DataFrame, machine: Machine, text: str = "text", name: str = "score",
          keep: list[str] | None = None) -> DataFrame:
    """Adds the probability (double) that a whole text is toxic; it replaces a column of that name.

    Only the text goes in. NULL and empty texts, and texts without a known term, get
    the constant's probability. ``keep`` names the columns that stay (all if not given).
    The machine's size is bounded by ``max_features`` and ``max_pairs``.
    """
    columns = [c for c in (docs.columns if keep is None else keep) if c != name]
    schema = StructType([docs.schema[c] for c in columns] + [StructField(name, DoubleType())])
    narrow, at = with_text(docs, columns, text)
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        places = {int(b): i for i, b in enumerate(own.buckets)}
        find = Memory(lambda term: tuple(places[b] for b in buckets_of(term) if b in places))
        for batch in batches:
            scores = []
            for item in batch.column(at):
                known = set(chain.from_iterable(find.all(list(terms_of(item.as_py())))))
                scores.append(own.score(sorted(known)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(columns)], pa.array(scores, pa.float64())], names=schema.names)

    return map_batches(narrow, run, schema)
