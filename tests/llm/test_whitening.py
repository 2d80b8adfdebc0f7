"""The whitened vectors against a dense eigendecomposition, and their edges."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from presswork.llm import queries, whitening

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def expected(x, components=16):
    """Whitened rows, shares of the trace and deviations, from the whole covariance of distinct rows."""
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = (n * fit - sums) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return ((n * x - sums) / n @ vectors / np.sqrt(values),
            values / np.square(centred).sum() * n, ((n * x - sums) ** 2).sum(axis=1))


def matrix(rows):
    cells = {(r.vec_id, r.component): r for r in rows}
    ids, k = sorted({r.vec_id for r in rows}), max(r.component for r in rows)
    assert len(rows) == len(ids) * k
    return ids, np.array([[cells[i, c].whitened for c in range(1, k + 1)] for i in ids])


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")
def test_query(spark):
    table = queries.table(spark, SF_DIR, "embeddings").collect()
    x = {r.vec_id: [math.floor(64 * float(c)) + 1_000_000 for c in r.embedding] for r in table}
    rows = queries.op12_whitening(spark, SF_DIR).collect()
    ids, whitened = matrix(rows)
    all_x = np.array([x[i] for i in ids])
    wanted, shares, deviations = expected(all_x)
    assert ids == sorted(x) and np.abs(whitened - wanted).max() < 1e-9
    assert {r.n for r in rows} == {len(np.unique(all_x, axis=0))}
    assert all(abs(r.explained / shares[r.component - 1] - 1) < 1e-9 for r in rows)
    assert {r.vec_id: r.deviation for r in rows} == dict(zip(ids, deviations.tolist()))
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-9


def test_secular_equation():
    dice = np.random.default_rng(4)
    for n in (1, 2, 7, 40):
        for spread in (1.0, 1e-9):
            poles = np.sort(dice.uniform(0, 100, n)) if spread == 1 else 5 + np.arange(n) * spread
            z = dice.normal(size=n) * 10.0 ** dice.integers(-4, 2, n)
            origin, distance = whitening.secular_roots(poles, z)
            roots = poles[origin] + distance
            wanted = np.linalg.eigvalsh(np.diag(poles) + np.outer(z, z))
            assert np.abs(roots - wanted).max() <= 1e-12 * wanted[-1]
            assert np.all(np.diff(roots) >= 0) and np.all(roots >= poles)


@pytest.mark.parametrize("run", [1, 7, 10_000])
@pytest.mark.parametrize("d, n", [(6, 300), (30, 12), (1, 40), (10, 400)])
def test_spectrum_of_partitions(d, n, run):
    dice = np.random.default_rng(d)
    x = np.floor(64 * dice.normal(size=(n, d)) * dice.uniform(0.01, 1, d))
    if d == 10:
        x[:, 5:] = x[:, :5]
        x[100:200] = x[:100]
    parts = []
    for part in np.array_split(x, 3):
        parts.append(whitening.Spectrum.of_dimension(d))
        for start in range(0, len(part), run):
            parts[-1].add_rows(part[start:start + run])
    total = whitening.Spectrum.of_dimension(d)
    for part in parts:
        total.combine(part)
    centred = x - x.mean(axis=0)
    scatter = centred.T @ centred
    k = len(total.values)
    assert k <= min(d, n - 1) and total.n == n
    assert np.abs(total.vectors.T @ total.vectors - np.eye(k)).max() < 1e-12
    assert np.abs(total.vectors * total.values @ total.vectors.T - scatter).max() < 1e-12 * np.abs(scatter).max()


def test_many_partitions_are_combined(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 3)
    dice = np.random.default_rng(1)
    # More dimensions than the refinement carries, falling off slowly.
    x = np.floor(dice.normal(size=(600, 40)) * np.linspace(1, 60, 40)).astype(int)
    frame = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, x array<long>")
    spectra = whitening.spectra_of(frame.repartition(11), 40, np.zeros(40, np.int64))
    total = whitening.combined(spectra)
    assert total.n == 600 and np.allclose(total.mean, x.mean(axis=0))
    assert np.allclose(total.values, np.linalg.eigvalsh(600 * np.cov(x.T, bias=True)))
    monkeypatch.setattr(whitening, "SPARE", 2)
    fitted = whitening.fit_whitening(frame, components=4)
    rows = whitening.whiten(frame, fitted).collect()
    ids, whitened = matrix(rows)
    assert np.abs(whitened - expected(x, 4)[0]).max() < 1e-9


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, [3.0, -1.0]), (2, [3.0, -1.0]), (None, [0.5, 0.25]), (4, None), (5, []),
            (6, [1.0, None]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [1.0, 2.0, 3.0]), (1, [0.0, 7.0])]
    frame = spark.createDataFrame(rows, "vec_id long, e array<float>").select(
        "vec_id", whitening.scaled_entries(F.col("e")).alias("x"))
    vectors = whitening.usual_length(frame)
    out = whitening.whiten(vectors, whitening.fit_whitening(vectors)).collect()
    # Two components for each of five rows; copies fit once, rows of one id each have theirs.
    assert len(out) == 10 and {r.n for r in out} == {4}
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in e] for i, e in rows if e and len(e) == 2 and i not in (6, 7, 8)])
    wanted = expected(x)
    assert sorted(r.deviation for r in out) == sorted(np.repeat(wanted[2], 2).tolist())
    assert np.allclose(sorted(r.whitened for r in out), sorted(wanted[0].ravel()))


def test_tables_without_a_spectrum(spark):
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]):
        frame = spark.createDataFrame(rows, "vec_id long, e array<float>").select(
            "vec_id", whitening.scaled_entries(F.col("e")).alias("x"))
        vectors = whitening.usual_length(frame)
        out = whitening.whiten(vectors, whitening.fit_whitening(vectors))
        assert out.count() == 0 and "identity_error" in out.columns


def test_large_entries(spark):
    rows = [(i, [1e30 * (i % 2), float(i), -1e30]) for i in range(6)]
    frame = spark.createDataFrame(rows, "vec_id long, e array<double>").select(
        "vec_id", whitening.scaled_entries(F.col("e")).alias("x"))
    out = whitening.whiten(frame, whitening.fit_whitening(frame)).collect()
    assert {r.deviation for r in out} == {2 ** 63 - 1} and max(abs(r.whitened) for r in out) < 10
