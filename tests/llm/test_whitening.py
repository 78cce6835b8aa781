import math
import random

import numpy as np
import pytest

from panelwright.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, component int, n string"


def frame(spark, rows):
    return spark.createDataFrame([(i, x, 7, "x") for i, x in rows], SCHEMA).repartition(3)


def brute(rows, want):
    """From the covariance itself: n, deviations by id, eigenvalues over trace, projections up to sign."""
    x = [[math.floor(64 * v) + 1_000_000 for v in e] for _, e in rows]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    y = np.array([[(n * v - s) / n for v, s in zip(r, sums, strict=True)] for r in x])
    cov = y.T @ y / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:want], u[:, ::-1][:, :want]
    return n, [sum((n * v - s) ** 2 for v, s in zip(r, sums, strict=True)) for r in x], e / np.trace(cov), y @ u / np.sqrt(e)


def check(got, rows, want):
    n, deviation, explained, z = brute(rows, want)
    assert len(got) == len(rows) * want and {r.n for r in got} == {n}
    found = {(r.vec_id, r.component): r for r in got}
    for i, (key, _) in enumerate(rows):
        assert found[key, 1].deviation == deviation[i]
    w = np.array([[found[key, c + 1].whitened for c in range(want)] for key, _ in rows])
    assert np.abs(w * np.sign((w * z).sum(axis=0)) - z).max() < 1e-8
    assert np.allclose([found[rows[0][0], c + 1].explained for c in range(want)], explained, rtol=1e-10)
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9
    assert np.abs((w - w.mean(0)).T @ (w - w.mean(0)) / n - np.eye(want)).max() < 1e-9


def vectors(n, dim, seed=1):
    r = random.Random(seed)
    return [(i, [r.gauss(0.2, 1 + 3 * j / dim) for j in range(dim)]) for i in range(n)]


def test_equals_eigenvectors(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", 64)
    rows = vectors(400, 12)
    check(whitening.whiten(frame(spark, rows), components=4).collect(), rows, 4)
    check(whitening.whiten(frame(spark, rows), components=12).collect(), rows, 12)


def test_awkward_rows(spark):
    good = [*vectors(60, 3), (500, [0.1, 0.2, 0.3])]
    bad = [(900, None), (901, [1.0, None, 2.0]), (902, [float("nan"), 0.0, 0.0]), (903, [float("inf"), 0.0, 0.0]), (904, [1.0, 2.0]), (905, []), (906, [1e300, 0.0, 0.0])]
    check(whitening.whiten(frame(spark, good + bad), components=3).collect(), good, 3)
    assert whitening.whiten(frame(spark, []), components=3).collect() == []
    assert whitening.whiten(frame(spark, [(1, [2.0, 3.0, 1.0])] * 3), components=3).collect() == []  # nothing varies


def test_repeated_rows_and_ids(spark):
    rows = vectors(50, 3)
    got = whitening.whiten(frame(spark, [*rows, rows[0], (None, rows[1][1])]), components=2).collect()
    assert len(got) == 104 and got[0].n == 52 and sum(r.vec_id is None for r in got) == 2


def test_fewer_directions_than_asked_for(spark):
    rows = [(i, [x := random.Random(i).gauss(0, 9), 2.0, -x - 0.0]) for i in range(40)]
    rows = [(i, [math.floor(v * 64) / 64 for v in x]) for i, x in rows]
    got = whitening.whiten(frame(spark, rows), components=3).collect()
    assert {r.component for r in got} == {1} and got[0].explained == pytest.approx(1.0, rel=1e-9)


def test_deviation_beyond_64_bits(spark):
    rows = [(0, [2.0**50, 1.0]), (1, [0.0, 3.0]), (2, [5.0, -(2.0**40)])]
    got = whitening.whiten(frame(spark, rows), components=2).collect()
    _, deviation, _, _ = brute(rows, 2)
    assert {r.vec_id: r.deviation for r in got} == {i: d if d < 2**63 else None for i, d in enumerate(deviation)}


@pytest.mark.parametrize(("dim", "want", "seed"), [(60, 5, 1), (120, 8, 2), (40, 32, 3)])
def test_pairs_of_an_operator(dim, want, seed):
    r = np.random.default_rng(seed)
    m = r.standard_normal((dim, dim))
    a = m @ m.T
    values, vectors = whitening.leading_pairs(lambda w: a @ w, dim, want)
    e, _ = np.linalg.eigh(a)
    assert np.allclose(values, e[::-1][:want], rtol=1e-12)
    assert np.linalg.norm(a @ vectors - vectors * values, axis=0).max() < 1e-12 * e[-1]
    assert np.abs(vectors.T @ vectors - np.eye(want)).max() < 1e-12


def test_repeated_eigenvalues():
    a = np.diag(np.r_[np.full(6, 4.0), np.full(30, 1.0), np.zeros(30)])
    q, _ = np.linalg.qr(np.random.default_rng(0).standard_normal(a.shape))
    a = q @ a @ q.T
    values, vectors = whitening.leading_pairs(lambda w: a @ w, len(a), 10, guard=2)
    assert np.allclose(values, [4.0] * 6 + [1.0] * 4)
    assert np.abs(vectors.T @ vectors - np.eye(10)).max() < 1e-12


def test_minres_solves_each_column():
    r = np.random.default_rng(4)
    m = r.standard_normal((30, 30))
    a, shift, b = m + m.T, np.array([0.0, 3.0, -50.0]), r.standard_normal((30, 3))
    x = whitening.minres(lambda w: a @ w - w * shift, b, 60)
    assert np.abs(a @ x - x * shift - b).max() < 1e-6
