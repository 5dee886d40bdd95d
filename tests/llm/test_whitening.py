"""Whitening against a direct eigendecomposition of the fit list's covariance."""

from __future__ import annotations

import math

import numpy as np
import pytest

from shelfmark.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, id string, component int"


def vectors(n=300, size=12, seed=3):
    rng = np.random.default_rng(seed)
    made = rng.normal(size=(n, size)) * np.linspace(1, 0.2, size) + rng.normal(size=size)
    rows = [(k, [float(x) for x in np.float32(v)], k % 3, "x", k) for k, v in enumerate(made)]
    rows += [(1000 + k, rows[k][1], 0, "x", 0) for k in range(40)]  # copies
    rows += [(2000 + k, rows[7][1], 0, "x", 0) for k in range(100)]
    rows += [rows[3], (None, rows[4][1], None, None, None)]
    rows += [(3000, None, 1, "", 0), (3001, [float("nan")] * size, 1, "", 0), (3002, [None] + [1.0] * (size - 1), 1, "", 0)]
    rows += [(3003, [float("inf")] * size, 1, "", 0), (3004, [], 1, "", 0), (3005, [1.0, 2.0], 1, "", 0)]
    return rows


def plain(rows, size, wanted=4):
    """Rows and columns of the result, signs left open."""
    good = [r for r in rows if r[1] and len(r[1]) == size and all(x is not None and math.isfinite(x) for x in r[1])]
    x = [tuple(math.floor(256 * float(np.float32(c))) for c in r[1]) for r in good]
    fit = sorted(set(x))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[a - s / n for a, s in zip(v, sums, strict=True)] for v in fit])
    values, vecs = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:wanted]
    out = []
    for r, v in zip(good, x, strict=True):
        deviation = sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True))
        z = np.array([a - s / n for a, s in zip(v, sums, strict=True)]) @ vecs[:, order] / np.sqrt(values[order])
        out += [(r[0], c + 1, n, deviation, z[c], values[order[c]] / values.sum()) for c in range(len(order))]
    return out


def same(got, want):
    key = lambda r: (str(r[0]), r[1], r[3], abs(r[4]))
    got, want = sorted((tuple(r) for r in got), key=key), sorted(want, key=key)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    sign = {}
    for g, w in zip(got, want, strict=True):
        assert g[5] == pytest.approx(w[5], rel=1e-9)
        assert g[6] < 1e-9
        if abs(w[4]) > 1e-3:
            assert sign.setdefault(g[1], g[4] * w[4] > 0) == (g[4] * w[4] > 0)
        assert abs(g[4]) == pytest.approx(abs(w[4]), abs=1e-8)


def test_against_eigenvectors(spark):
    rows = vectors()
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = whitening.whiten(table)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    same(got.collect(), plain(rows, 12))


def test_fewer_dimensions_than_components(spark):
    rows = [(k, [float(k % 7), float(k % 5) / 3], 0, "", 0) for k in range(60)]
    same(whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect(), plain(rows, 2))


def test_no_variance_no_rows(spark):
    for rows in ([], [(1, None, 0, "", 0)], [(1, [1.0, 2.0], 0, "", 0)] * 5, [(1, [0.0], 0, "", 0)]):
        assert whitening.whiten(spark.createDataFrame(rows, SCHEMA)).count() == 0


def test_rank_below_four(spark):
    rows = [(k, [float(k), 2.0 * k, -1.0 * k, 5.0, 0.0, float(k % 2)], 0, "", 0) for k in range(50)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.component for r in got} == {1, 2}
    assert sum(r.explained for r in got if r.vec_id == 0) == pytest.approx(1)


def test_large_numbers(spark):
    rng = np.random.default_rng(2)
    rows = [(k, [float(x) for x in np.float32(v)], 0, "", 0) for k, v in enumerate(rng.normal(size=(50, 3)) * 1e9)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    want = plain(rows, 3)
    assert [r.deviation for r in got] == [None] * len(got)  # beyond 64 bits
    same([(*r[:3], 0, *r[4:]) for r in got], [(*w[:3], 0, *w[4:]) for w in want])
    huge = [(k, [1e30 * (k % 3 - 1), float(k)], 0, "", 0) for k in range(20)]
    assert whitening.whiten(spark.createDataFrame(huge, SCHEMA)).count() > 0


def product_of(x, calls):
    def product(w):
        calls.append(1)
        u = x @ w
        return x.T @ u, float(u @ u)

    return product


def spectrum(values, rows=400, seed=0):
    """A matrix with these singular values."""
    rng = np.random.default_rng(seed)
    left = np.linalg.qr(rng.normal(size=(rows, len(values))))[0]
    right = np.linalg.qr(rng.normal(size=(len(values), len(values))))[0]
    return left * np.array(values, float) @ right


@pytest.mark.parametrize(
    "values",
    [
        [5, 5, 5, 5, 5, 5, 5, 5],  # one start finds one vector of each value
        [9, 7, 7, 7, 7, 1, 1, 1, 0.5],
        [9, 9, 9, 9, *([1.0] * 30)],
        [10, 1e-3, 1e-5, 1e-6, 1e-7],
        [3, 2, 1, 0, 0, 0],
    ],
)
def test_equal_and_small_singular_values(values):
    x = spectrum(values)
    got, vecs = whitening.Bidiagonal(len(values), product_of(x, [])).run(4)
    assert got == pytest.approx(sorted(values, reverse=True)[:4], abs=1e-9 * max(values))
    np.testing.assert_allclose(vecs.T @ vecs, np.eye(4), atol=1e-12)
    np.testing.assert_allclose(np.linalg.norm(x @ vecs, axis=0), got, atol=1e-9 * max(values))


def test_steps_stop_long_before_the_dimensions():
    values = [100, 70, 50, 30, *np.linspace(5, 0.1, 396)]
    x, calls = spectrum(values, 900), []
    got, vecs = whitening.Bidiagonal(len(values), product_of(x, calls)).run(4)
    assert got == pytest.approx(values[:4], rel=1e-12)
    want = np.linalg.svd(x)[2][:4].T
    np.testing.assert_allclose(np.abs((want * vecs).sum(axis=0)), 1, atol=1e-13)
    assert len(calls) < 80
