"""Exact scatter, polynomial and roots against integers and numpy; whitened rows against eigh."""

from fractions import Fraction

import numpy as np
import pytest

from seriesprep.llm import whitening as wh


def determinant(matrix, t):
    rows = [[Fraction(t * (i == j) - int(v)) for j, v in enumerate(row)] for i, row in enumerate(matrix)]
    value = Fraction(1)
    for k in range(len(rows)):
        pivot = next((i for i in range(k, len(rows)) if rows[i][k]), None)
        if pivot is None:
            return 0
        if pivot != k:
            rows[k], rows[pivot], value = rows[pivot], rows[k], -value
        value *= rows[k][k]
        for i in range(k + 1, len(rows)):
            factor = rows[i][k] / rows[k][k]
            rows[i] = [a - factor * b for a, b in zip(rows[i], rows[k])]
    return value


def gram(seed, n, d, size):
    x = np.random.default_rng(seed).integers(-size, size, (n, d)).astype(object)
    return x.T @ x


@pytest.mark.parametrize("matrix", [gram(1, 9, 6, 5), gram(2, 3, 6, 10**9), np.diag([4, 4, 0, 7]).astype(object), np.zeros((2, 2), object), gram(3, 5, 1, 9)])
def test_polynomial_is_the_determinant(spark, matrix):
    c = wh.characteristic_polynomial(spark, matrix)
    for t in range(-3, len(matrix) + 1):
        assert sum(v * t**k for k, v in enumerate(c)) == determinant(matrix, t)


def test_roots_are_isolated_with_their_multiplicity():
    c = [1]
    for root in (0, 0, 3, 3, 5, 5, 5, 900):
        c = [a - root * b for a, b in zip([0, *c], [*c, 0])]
    found = sorted((r.first, r.many, float(Fraction(2 * r.low + 1, 2 << r.bits))) for r in wh.largest_roots(c, 16))
    assert [(f, m, round(v, 9)) for f, m, v in found] == [(1, 1, 900), (2, 3, 5), (5, 2, 3)]
    assert wh.roots_above(c, 9, 1) == 4 and wh.roots_above(c, 3, 0) == 4
    assert [r.first for r in wh.largest_roots(c, 1)] == [1]


def test_limbs_add_up():
    rows = np.array([[0, -1, 1 << 61, -(1 << 61)], [5, (1 << 20) - 1, -(1 << 20), 123456789012]])
    limbs = wh._limbs(rows)
    assert all(sum(int(limb[i, j]) << (20 * k) for k, limb in enumerate(limbs)) == rows[i, j] for i in range(2) for j in range(4))
    assert all(np.abs(limb).max() <= 1 << 20 for limb in limbs)


def whitened(frame, **options):
    out = wh.whiten(frame, **options)
    return out.selectExpr("vec_id", f"inline({out.columns[-1]})").toPandas().sort_values(["vec_id", "component"])


@pytest.mark.parametrize("scale", [1.0, 1e9])
def test_equals_eigh(spark, scale):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 5)) @ np.diag([5, 3, 2, 1, 0.5]) * scale
    x[40:] = x[7]  # copies count once in the fit
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    got = whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3))
    y = np.floor(64 * x)
    fit = np.unique(y, axis=0)
    values, vectors = np.linalg.eigh(np.cov(fit.T, bias=True))
    values, vectors = values[::-1], vectors[:, ::-1]
    want = (y - fit.mean(0)) @ vectors / np.sqrt(values)
    have = got["whitened"].to_numpy().reshape(60, 5)
    assert np.abs(want * np.sign((want * have).sum(0)) - have).max() < 1e-9
    assert set(got["n"]) == {40} and got["identity_error"].max() < 1e-9
    assert np.abs(got["explained"].to_numpy()[:5] - values / values.sum()).max() < 1e-12
    sums = [int(s) for s in fit.astype(object).sum(0)]
    exact = [sum((40 * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in y]
    told = got["deviation"].to_numpy().reshape(60, 5)[:, 0]
    assert [None if np.isnan(t) else int(t) for t in told] == [e if e < 1 << 63 else None for e in exact]


def test_repeated_eigenvalues_and_missing_rank(spark):
    corners = [[float(v) for v in row] for row in np.vstack([np.eye(4), -np.eye(4)])]
    rows = [(k, [*v, 7.0]) for k, v in enumerate(corners)]
    got = whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert got["component"].max() == 4 and got["identity_error"].max() < 1e-12
    assert np.allclose(got["explained"], 0.25)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0], "x"), (1, [1.0, 2.0], "x"), (2, None, "x"), (3, [1.0, None], None), (4, [nan, 1.0], "y"), (5, [inf, 1.0], "y")]
    rows += [(6, [], "y"), (7, [1.0], "y"), (None, [3.0, 1.0], None), (8, [1e300, 1.0], "z"), (9, [0.0, 0.5], "z")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, white string")
    got = whitened(frame)
    assert got["vec_id"].fillna(-1).astype(int).tolist().count(1) == 4 and set(got["vec_id"].dropna()) == {1, 9}
    assert set(got["n"]) == {3} and len(got) == 8
    for empty in (frame.limit(0), frame.filter("vec_id = 1"), frame.filter("vec_id = 6"), frame.filter("vec_id = 2")):
        assert len(whitened(empty)) == 0
