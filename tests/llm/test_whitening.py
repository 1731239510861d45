"""Whitening against numpy's dense eigensolver, exact sums against Python integers, and its defined edge cases."""

import math

import numpy as np
import pytest

from incidentlens.llm import whitening as W
from conftest import TESTDATA


def _brute(vectors, components=8):
    x = np.array([[math.floor(1024 * c) + 100000 for c in v] for v in vectors], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    apart = n * x - sums
    centred = apart.astype(float) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:components]
    return n, (apart ** 2).sum(axis=1).tolist(), centred @ axes[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def _check(rows, vectors, components=8, close=1e-7):
    n, deviation, white, explained = _brute(vectors, components)
    got = {}
    for r in rows:
        got.setdefault(r.vec_id, {})[r.component] = r
    assert len(rows) == len(vectors) * min(components, len(vectors[0]))
    ours = np.array([[got[i][c + 1].whitened for c in range(white.shape[1])] for i in range(len(vectors))])
    signs = np.sign((ours * white).sum(axis=0))
    assert np.abs(ours - white * signs).max() < close
    for i in range(len(vectors)):
        assert all(r.n == n and r.deviation == deviation[i] for r in got[i].values())
    assert np.allclose([got[0][c + 1].explained for c in range(white.shape[1])], explained, rtol=1e-10)
    assert max(r.identity_error for r in rows) < 1e-9


def test_query(spark):
    sf = str(TESTDATA / "sf0.01")
    vectors = [r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()]
    _check(W.op13_whitening(spark, sf).collect(), vectors)


@pytest.mark.parametrize("n", [1, 2, 3, 17, 60])
def test_solver(n):
    rng = np.random.default_rng(n)
    spread = rng.standard_normal((n, n)) * np.logspace(0, -9, n)
    doubled = np.vstack([np.eye(n), np.eye(n)])[:n] * 3.0
    constant = rng.standard_normal((n, n))
    constant[:, n // 2] = 0
    close = np.diag(1 + 1e-9 * np.arange(n)) @ np.linalg.qr(rng.standard_normal((n, n)))[0]
    low = rng.standard_normal((n, 1)) @ rng.standard_normal((1, n))
    for matrix in (spread, doubled, constant, close, low, np.zeros((n, n)), spread.T.copy()):
        triangle = np.linalg.qr(matrix, mode="r")
        values, axes = W.solve(triangle, 8)
        want = np.linalg.svd(matrix, compute_uv=False)[:8] ** 2
        assert np.abs(values - want).max(initial=0) <= 1e-13 * max(want.max(), 1e-300)
        assert np.abs(axes.T @ axes - np.eye(len(values))).max() < 1e-10
        gram = matrix.T @ matrix
        assert np.abs(gram @ axes - axes * values).max() <= 1e-12 * max(want.max(), 1e-300)


def test_small_values_keep_their_digits():
    """dqds of a graded bidiagonal matrix, whose small singular values a dense solver loses."""
    a, b = np.array([1.0, 1e-4, 1e-9, 1e-15]), np.array([1e-3, 1e-8, 1e-13])
    from fractions import Fraction

    t = [[Fraction(0)] * 4 for _ in range(4)]
    for i in range(4):
        t[i][i] = Fraction(a[i]) ** 2 + (Fraction(b[i - 1]) ** 2 if i else 0)
        if i < 3:
            t[i][i + 1] = t[i + 1][i] = Fraction(a[i]) * Fraction(b[i])

    def below(x):  # eigenvalues under x, by exact pivots
        count, pivot = 0, Fraction(1)
        for i in range(4):
            pivot = t[i][i] - x - (t[i][i - 1] ** 2 / pivot if i else 0)
            count += pivot < 0
        return count

    for place, value in enumerate(sorted(W.qd_eigenvalues(a ** 2, b ** 2))):
        assert below(Fraction(value) * (1 - Fraction(1, 10 ** 13))) <= place < below(Fraction(value) * (1 + Fraction(1, 10 ** 13)))


def test_several_rounds_of_triangles_and_hot_vector(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.standard_normal((400, 5)) @ rng.standard_normal((5, 5))).tolist() + [[0.5, 0.25, -1.0, 2.0, 0.125]] * 200
    df = spark.createDataFrame([(i, v, "x") for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, component string").repartition(40)
    _check(W.whiten(df, cells=20, fan_in=3).collect(), vectors, close=1e-8)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 2.0]), (2, [2.0, 1.0]), (2, [2.0, 1.0]), (None, [0.0, 0.5]), (3, None), (4, []), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, None]),
        (8, [1.0, 2.0, 3.0]), (9, [3.0]),
    ]
    got = W.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0, r.component) for r in got) == [
        (False, 1, 1), (False, 1, 2), (False, 2, 1), (False, 2, 1), (False, 2, 2), (False, 2, 2), (True, 0, 1), (True, 0, 2)]
    assert {r.n for r in got} == {4} and max(r.identity_error for r in got) < 1e-12
    assert W.whiten(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0
    one = W.whiten(spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<double>")).collect()
    assert [(r.component, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, None, None, None), (2, 0, None, None, None)]
    flat = W.whiten(spark.createDataFrame([(i, [float(i), 7.0, 2.0 * i]) for i in range(9)], "vec_id long, embedding array<float>")).collect()
    assert sum(r.whitened is not None for r in flat) == 9 and max(r.identity_error for r in flat) < 1e-12
    huge = W.whiten(spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0])], "vec_id long, embedding array<double>")).collect()
    assert {r.deviation for r in huge} == {None} and {r.n for r in huge} == {2}
