"""Embedding whitening: an incremental eigendecomposition by rank-one updates, refined over all vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import (
    ArrayType, DoubleType, IntegerType, LongType, StructField, StructType)

from presswork.llm.workers import find_package, map_batches
from presswork.session import durable_table

#: Most components given back, and further directions that the refinement carries along.
COMPONENTS, SPARE = 16, 16
#: Vectors of a run, for each of their dimensions; an update costs the cube of the dimensions.
BLOCK = 16
#: Spectra that one task combines.
FAN_IN = 16
#: Most dimensions of a vector: a basis of so many squared doubles goes to every task.
MAX_DIMENSIONS = 2048
#: Rounds of refinement, and the residual (over the largest eigenvalue) at which they end.
ROUNDS, RESIDUAL = 12, 1e-13
#: Components whose eigenvalue is not above this share of the largest one have no direction.
NO_VARIANCE = 1e-13
#: Entries are cut to this size, so that sums over a table stay exact.
LARGEST = 2 ** 50

_EPS = np.finfo(float).eps


def scaled_entries(vector: Column, factor: int = 64, shift: int = 1_000_000) -> Column:
    """Entries c as longs floor(factor * c) + shift; NULL for a vector that takes no part.

    That is one that is NULL, empty, or holds NULL or an entry that is not finite. Entries
    are cut to LARGEST in size.
    """
    doubles = F.transform(vector, lambda c: c.cast("double"))
    bad = F.exists(doubles, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    cut = F.transform(doubles, lambda c: F.floor(F.greatest(F.least(
        c * factor, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))) + F.lit(shift).cast("long"))
    return F.when((F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True)), cut)


def secular_roots(poles: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The roots of 1 + sum(z_i^2 / (poles_i - t)) as (pole, distance from it), one after each pole.

    Poles rise strictly and no z is 0. All roots are looked for together: each is measured
    from the nearer of its two poles, and steps to the root of a function with those two
    poles whose value and slopes agree with the sums on either side; a step that leaves
    the interval known to hold the root halves it instead.
    """
    n, square = len(poles), z * z
    after = np.append(poles[1:], poles[-1] + square.sum())
    middle = (poles + after) / 2
    value = 1 + (square / (poles[None] - middle[:, None])).sum(axis=1)
    # A root lies before the middle if the function has passed 0 there.
    origin = np.where((value >= 0) | (np.arange(n) == n - 1), np.arange(n), np.arange(1, n + 1))
    origin[-1] = n - 1
    base = poles[origin]
    low, high = poles - base, after - base
    first = origin == np.arange(n)
    half = (after - poles) / 2
    low = np.where(first, 0.0, -half)
    high = np.where(first, np.where(value >= 0, half, after - poles), 0.0)
    low = np.where(first & (value < 0), half, low)
    delta = poles[None] - base[:, None]
    t = (low + high) / 2
    left = np.arange(n)[None] <= np.arange(n)[:, None]
    own, following = poles - base, np.append(poles[1:] - base[:-1], np.inf)
    for _ in range(60):
        gap = delta - t[:, None]
        term = square / gap
        slope = term / gap
        f = 1 + term.sum(axis=1)
        size = 1 + np.abs(term).sum(axis=1)
        low, high = np.where(f < 0, t, low), np.where(f < 0, high, t)
        done = (np.abs(f) <= 32 * _EPS * size) | (high - low <= 2 * _EPS * np.maximum(np.abs(low), np.abs(high)))
        if done.all():
            break
        a = np.where(left, slope, 0).sum(axis=1) * (own - t) ** 2
        with np.errstate(all="ignore"):
            b = np.where(left, 0, slope).sum(axis=1) * (following - t) ** 2
            b = np.where(np.isfinite(following), b, 0.0)
            c = f - a / (own - t) - np.where(b > 0, b / (following - t), 0.0)
            # c (own - s)(following - s) + a (following - s) + b (own - s) = 0 for s.
            p = c * (own + following) + a + b
            q = c * own * following + a * following + b * own
            root = np.sqrt(np.maximum(p * p - 4 * c * q, 0))
            s = np.where(p >= 0, 2 * q / (p + root), (p - root) / (2 * c))
            other = np.where(p >= 0, (p + root) / (2 * c), 2 * q / (p - root))
            s = np.where((s > low) & (s < high), s, other)
            s = np.where(np.isfinite(following), s, own + a / c)
        inside = (s > low) & (s < high)
        t = np.where(done, t, np.where(inside, s, (low + high) / 2))
    return origin, t


@dataclass
class Spectrum:
    """Of ``n`` vectors: their mean, and eigenvalues and orthonormal eigenvectors of their scatter.

    The scatter is the sum of squared deviations from the mean. Directions without any are
    not kept: ``vectors`` has a column for each of the rising ``values``.
    """

    n: int
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def of_dimension(cls, d: int) -> "Spectrum":
        return cls(0, np.zeros(d), np.zeros(0), np.zeros((d, 0)))

    def add(self, x: np.ndarray) -> None:
        """A centred rank-one update by one more vector."""
        off = x - self.mean
        self.n += 1
        self.mean = self.mean + off / self.n
        if self.n > 1:
            self.update(off * np.sqrt((self.n - 1) / self.n))

    def add_rows(self, x: np.ndarray) -> None:
        """The same for many vectors at once, by one update for each dimension.

        The triangular factor of their deviations from their own mean has the same scatter
        in as many rows as there are dimensions; those are the updates, and one for the means.
        Fewer vectors than that are taken one by one.
        """
        m = len(x)
        if m <= x.shape[1]:
            for row in x:
                self.add(row)
            return
        mean = x.mean(axis=0)
        off, n = mean - self.mean, self.n + m
        rows = np.linalg.qr(x - mean, mode="r")
        # Rows that are rounding errors only, where vectors span fewer dimensions.
        least = 8 * _EPS * np.sqrt((rows ** 2).sum()) * np.sqrt(len(rows))
        for row in rows:
            if np.sqrt(row @ row) > least:
                self.update(row)
        if self.n:
            self.update(off * np.sqrt(self.n * (m / n)))
        self.mean, self.n = self.mean + off * (m / n), n

    def update(self, v: np.ndarray) -> None:
        """Adds the square of ``v`` to the scatter: the eigenvalues are roots of a secular equation."""
        z = self.vectors.T @ v
        rest = v - self.vectors @ z
        more = self.vectors.T @ rest
        rest -= self.vectors @ more
        z += more
        length, out = np.sqrt(v @ v), np.sqrt(rest @ rest)
        if length == 0:
            return
        values, vectors = self.values, self.vectors
        # What is below this, times the length of the update, changes the scatter by rounding errors only.
        scale = max(values[-1] if len(values) else 0.0, length * length)
        least = 8 * _EPS * scale / length
        if out > max(least, 16 * _EPS * length) and vectors.shape[1] < len(v):
            # A direction that was not met before: an eigenvalue of 0 joins in.
            values, z = np.append(0.0, values), np.append(out, z)
            vectors = np.column_stack([rest / out, vectors])
        # Deflation: equal eigenvalues are turned so that one of them takes the whole of z,
        # and those that z does not touch stay as they are.
        for i in np.flatnonzero(np.diff(values) <= 8 * _EPS * scale):
            r = np.hypot(z[i], z[i + 1])
            if r > 0 and z[i] != 0:
                c, s = z[i + 1] / r, z[i] / r
                z[i], z[i + 1] = 0.0, r
                vectors[:, [i, i + 1]] = vectors[:, [i, i + 1]] @ np.array([[c, s], [-s, c]])
        moved = np.flatnonzero(np.abs(z) > least)
        if not len(moved):
            self.values, self.vectors = values, vectors
            return
        poles, part = values[moved], z[moved]
        origin, distance = secular_roots(poles, part)
        roots = poles[origin] + distance
        # poles_i - root_j, from the nearer pole so that nothing cancels.
        gaps = (poles[:, None] - poles[origin][None]) - distance[None]
        # The z for which these roots are exact makes the eigenvectors orthogonal.
        across = poles[:, None] - poles[None]
        np.fill_diagonal(across, 1.0)
        ratio = gaps / across
        np.fill_diagonal(ratio, np.diagonal(gaps))
        exact = np.sqrt(np.abs(ratio.prod(axis=1)))
        turn = np.copysign(exact, part)[:, None] / gaps
        turn /= np.sqrt((turn ** 2).sum(axis=0))
        values, vectors = values.copy(), vectors.copy()
        values[moved], vectors[:, moved] = roots, vectors[:, moved] @ turn
        order = np.argsort(values, kind="stable")
        self.values, self.vectors = values[order], vectors[:, order]

    def combine(self, other: "Spectrum") -> None:
        """Takes in another spectrum, by an update for each of its eigenvectors and one for the means."""
        if not other.n:
            return
        if not self.n:
            self.n, self.mean, self.values, self.vectors = other.n, other.mean, other.values, other.vectors
            return
        off, n = other.mean - self.mean, self.n + other.n
        for value, vector in zip(other.values, other.vectors.T):
            self.update(np.sqrt(max(value, 0.0)) * vector)
        self.update(off * np.sqrt(self.n * (other.n / n)))
        self.mean, self.n = self.mean + off * (other.n / n), n


_SPECTRUM = "part long, n long, mean array<double>, values array<double>, vectors array<double>"


def _as_row(part: int, spectrum: Spectrum) -> pa.Table:
    return pa.table({
        "part": pa.array([part], pa.int64()), "n": pa.array([spectrum.n], pa.int64()),
        **{name: pa.array([getattr(spectrum, name).ravel().tolist()], pa.list_(pa.float64()))
           for name in ("mean", "values", "vectors")}})


def _from_rows(rows: pa.Table) -> Iterator[Spectrum]:
    for row in rows.to_pylist():
        mean, values = np.array(row["mean"]), np.array(row["values"], float)
        yield Spectrum(row["n"], mean, values, np.array(row["vectors"], float).reshape(len(mean), len(values)))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _offsets(batch: np.ndarray, n: int, sums: list[int], largest: int) -> np.ndarray:
    """n * x - S for each row, exact: as longs, or as Python's integers where those would overflow."""
    if 2 * n * largest >= 2 ** 62:
        return n * batch.astype(object) - np.array(sums, object)
    return n * batch - np.array(sums, np.int64)


def _means(offsets: np.ndarray, n: int) -> np.ndarray:
    """x - S / n from n * x - S, rounded once."""
    return (offsets / n).astype(float)


def spectra_of(fit: DataFrame, d: int, near: np.ndarray) -> DataFrame:
    """One row per partition of ``fit`` (``x``, array of long): the spectrum of its vectors.

    Vectors are taken in runs of BLOCK for each dimension, each run a series of centred
    rank-one updates. They are measured from ``near``, which only serves to keep doubles small.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spectrum = Spectrum.of_dimension(d)
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK * d):
                spectrum.add_rows((_matrix(batch.column(0).slice(start, BLOCK * d), d) - near).astype(float))
        if spectrum.n:
            yield from _as_row(0, spectrum).to_batches()

    rows = map_batches(fit.select("x"), run, _SPECTRUM)
    return rows.withColumn("part", F.spark_partition_id().cast("long"))


def combined(spectra: DataFrame) -> Spectrum | None:
    """All spectra in one. At most FAN_IN meet in a task; only the last one comes to the driver."""
    find_package(spectra)

    def merge(key, rows):
        total = None
        for other in _from_rows(rows.sort_by("part")):
            total = total or Spectrum.of_dimension(len(other.mean))
            total.combine(other)
        return _as_row(key[0].as_py(), total)

    spectra = durable_table(spectra)
    while (count := spectra.count()) > 1:
        group = F.pmod("part", F.lit(-(-count // FAN_IN)))
        spectra = durable_table(spectra.withColumn("group", group).groupBy("group").applyInArrow(merge, _SPECTRUM))
    for spectrum in _from_rows(spectra.toArrow()):
        return spectrum
    return None


def _summed(fit: DataFrame, d: int, shape: tuple[int, int], part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of the matrices that ``part`` makes of batches of vectors; one matrix comes back."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                total += part(_matrix(batch.column(0), d))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(total.size, dtype=np.int64)), pa.array(total.ravel())], names=["at", "value"])

    cells = map_batches(fit.select("x"), run, "at long, value double")
    rows = cells.groupBy("at").agg(F.sum("value").alias("value")).orderBy("at").toArrow()
    total = np.zeros(shape)
    total.ravel()[rows.column("at").to_numpy()] = rows.column("value").to_numpy()
    return total


@dataclass(frozen=True)
class Whitening:
    """Of ``n`` distinct vectors with sums ``sums``: leading unit eigenvectors and eigenvalues of their covariance."""

    n: int
    sums: list[int]
    largest: int
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float


def fit_whitening(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Fits to the distinct ``x`` (arrays of long, all of one length) of ``vectors``; None without any.

    Each partition updates a spectrum by its vectors; spectra are combined; the leading
    directions, with SPARE more, are then refined over all vectors: the covariance is applied
    to the basis in one distributed pass and solved inside it (Rayleigh-Ritz), and the
    residuals of the leading ones join the basis until they vanish. The covariance itself
    is never formed, but its trace is.
    """
    fit = durable_table(vectors.select("x").distinct())
    d = fit.agg(F.max(F.size("x"))).first()[0]
    if d is None:
        return None
    if d > MAX_DIMENSIONS:
        raise ValueError(f"vectors have {d} entries; {MAX_DIMENSIONS} are the most")
    n = fit.count()
    exact = "decimal(38,0)"
    sums = [int(r[1]) for r in fit.select(F.posexplode("x").alias("at", "entry")).groupBy("at").agg(
        F.sum(F.col("entry").cast(exact)).alias("total")).orderBy("at").collect()]
    largest = int(fit.agg(F.max(F.greatest(F.array_max("x"), -F.array_min("x")))).first()[0])
    near = np.array([s // n for s in sums], np.int64)
    spectrum = combined(spectra_of(fit, d, near))
    width = min(d, components + SPARE)
    basis = spectrum.vectors[:, ::-1][:, :width]
    if basis.shape[1] < width:
        # Fewer directions were met; any others complete the basis.
        basis = np.linalg.qr(np.column_stack([basis, np.eye(d)]))[0][:, :width]

    def centred(batch: np.ndarray) -> np.ndarray:
        return _means(_offsets(batch, n, sums, largest), n)
    trace = float(_summed(fit, d, (1, 1), lambda x: np.full((1, 1), (centred(x) ** 2).sum()))[0, 0]) / n
    for _ in range(ROUNDS):
        basis = np.linalg.qr(basis)[0]
        applied = _summed(fit, d, basis.shape, lambda x, q=basis: (c := centred(x)).T @ (c @ q)) / n
        inner = basis.T @ applied
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        leading = turn[:, :components]
        ritz = basis @ leading
        residual = applied @ leading - ritz * values[:components]
        if basis.shape[1] == d or np.abs(residual).max() <= RESIDUAL * max(values[0], 0):
            break
        basis = np.column_stack([basis @ turn[:, :width], residual / np.abs(residual).max(axis=0).clip(1e-300)])[:, :d]
    values = values[:components]
    with_variance = values > NO_VARIANCE * max(values[0], 0)
    ritz, values = ritz[:, with_variance], values[with_variance]
    # The entry of largest size is positive.
    ritz = ritz * np.sign(ritz[np.abs(ritz).argmax(axis=0), np.arange(ritz.shape[1])])
    error = 0.0
    if len(values):
        k, scale = len(values), ritz / np.sqrt(values)
        gram = _summed(fit, d, (k, k), lambda x: (w := centred(x) @ scale).T @ w) / n
        error = float(np.abs(gram - np.eye(k)).max())
    return Whitening(n, sums, largest, ritz, values, trace, error)


def usual_length(vectors: DataFrame, name: str = "x") -> DataFrame:
    """The rows whose vector has the length that most have (of several such, the greatest); no NULLs."""
    known = durable_table(vectors.filter(F.col(name).isNotNull()))
    lengths = known.groupBy(F.size(name).alias("d")).agg(F.count("*").alias("rows"))
    usual = lengths.orderBy(F.desc("rows"), F.desc("d")).limit(1).first()
    return known.filter(F.size(name) == (usual["d"] if usual else 0))


def whiten(docs: DataFrame, fitted: Whitening | None, key: str = "vec_id") -> DataFrame:
    """Per row of ``docs`` (``key`` and ``x``) and component: the whitened entry.

    ``component`` (int, from 1 by falling eigenvalue), ``n`` (long), ``deviation`` (long, the
    sum over dimensions of (n * x - S) squared, exact; a sum beyond a long counts as the
    largest one), ``whitened`` (x - S/n projected on the component, over the root of its
    eigenvalue), ``explained`` (the eigenvalue's share of the trace), ``identity_error``.
    Components without variance have no rows, so a table of one distinct vector gives none.
    Rows of one key each have rows of their own. Vectors are those of one length that the
    whitening was fitted to; see ``usual_length``.
    """
    schema = StructType([
        StructField(key, docs.schema[key].dataType), StructField("component", IntegerType()),
        StructField("n", LongType()), StructField("deviation", LongType()),
        StructField("whitened", DoubleType()), StructField("explained", DoubleType()),
        StructField("identity_error", DoubleType())])
    if fitted is None or not len(fitted.values):
        return docs.sparkSession.createDataFrame([], schema)
    k, d = len(fitted.values), len(fitted.sums)
    shared = docs.sparkSession.sparkContext.broadcast(fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        basis = own.vectors / np.sqrt(own.values)
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                m = part.num_rows
                offsets = _offsets(_matrix(part.column(1), d), own.n, own.sums, own.largest)
                if float(np.abs(offsets).max()) ** 2 * d < 2 ** 62:
                    deviation = (offsets ** 2).sum(axis=1)
                else:
                    sums = (offsets.astype(object) ** 2).sum(axis=1)
                    deviation = np.array([min(int(s), 2 ** 63 - 1) for s in sums], np.int64)
                whitened = _means(offsets, own.n) @ basis
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, own.n)), pa.array(np.repeat(deviation, k).astype(np.int64)),
                    pa.array(whitened.ravel()), pa.array(np.tile(own.values / own.trace, m)),
                    pa.array(np.full(m * k, own.identity_error))], names=schema.names)

    return map_batches(docs.select(key, "x"), run, schema)
