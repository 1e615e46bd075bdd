import math

import numpy as np
import pytest

from quarry.llm.whitening import exact_product, jacobi, whiten


def test_jacobi():
    r = np.random.default_rng(0)
    for d in (1, 2, 5, 30):
        v = r.normal(0, 1, (d, d))
        v = v @ v.T
        e, q = jacobi(v)
        assert np.allclose(e, np.linalg.eigvalsh(v)[::-1], rtol=1e-10) and np.allclose(q.T @ q, np.eye(d), atol=1e-12) and np.allclose(q * e @ q.T, v, atol=1e-11)
    assert jacobi(np.zeros((3, 3)))[0].tolist() == [0, 0, 0]


def test_small_eigenvalues_are_accurate_to_their_own_size():
    from fractions import Fraction

    s = [Fraction(1, 10 ** (3 * i)) for i in range(4)]
    exact = [[(1 if i == j else Fraction(3, 10)) * s[i] * s[j] for j in range(4)] for i in range(4)]
    e, _ = jacobi(np.array([[float(x) for x in r] for r in exact]))
    det = np.linalg.det(np.full((4, 4), 0.3) + 0.7 * np.eye(4)) * 10.0 ** -36  # the product of all four, exact but for rounding
    assert math.isclose(np.prod(e), det, rel_tol=1e-12) and e[-1] < 1e-17


def test_exact_product():
    r = np.random.default_rng(1)
    for most in (10, 2**24, 2**30, 2**45):
        y = r.integers(-most, most, (50, 3))
        assert exact_product(y) == (y.astype(object).T @ y.astype(object)).tolist()


def whole(c):
    return math.floor(256 * float(np.float32(c)))


def test_equals_plain_numpy(spark):
    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in r.normal(0.3, 0.2, 6) * [1, 1, 0.5, 0.5, 2, 0.1]]) for i in range(300)]
    rows += [(i, rows[5][1]) for i in range(300, 500)] + [(7, rows[7][1]), (None, rows[3][1])]  # a hot vector, a repeated row, a null key
    rows += [(500, None), (501, [None] + [0.1] * 5), (502, [math.nan] * 6), (503, [-math.inf] * 6), (504, [0.1]), (505, [])]
    df = spark.createDataFrame([(i, v, "x", 0.5) for i, v in rows], "vec_id long, embedding array<float>, component string, whitened double")
    fine = [(i, [whole(c) for c in v]) for i, v in rows if v and len(v) == 6 and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in fine}))
    n, sums = len(fit), fit.sum(0)
    e, q = np.linalg.eigh(np.cov(fit.T, bias=True))
    e, q = e[::-1], q[:, ::-1]
    got = whiten(df).collect()
    assert len(got) == 4 * len(fine) and all(x.identity_error < 1e-10 for x in got)
    for k in range(4):
        mine = sorted((x.vec_id is None, x.vec_id or 0, x.whitened) for x in got if x.component == k + 1)
        theirs = [(i is None, i or 0, float((np.array(x) - sums / n) @ q[:, k] / np.sqrt(e[k]))) for i, x in fine]
        sign = 1 if np.dot([m[2] for m in mine], [t[2] for t in sorted(theirs)]) > 0 else -1
        assert np.allclose([m[2] for m in mine], [t[2] for t in sorted((a, b, sign * w) for a, b, w in theirs)], atol=1e-11)
        assert all(math.isclose(x.explained, e[k] / e.sum(), rel_tol=1e-10) for x in got if x.component == k + 1)
    want = sorted((i is None, i or 0, sum((n * c - int(s)) ** 2 for c, s in zip(x, sums))) for i, x in fine for _ in range(4))
    assert sorted((x.vec_id is None, x.vec_id or 0, x.deviation) for x in got) == want and {x.n for x in got} == {n}


@pytest.mark.parametrize("rows, components", [([(1, [0.1, 0.2])] * 3, 2), ([(1, [0.5]), (2, [0.25])], 1), ([(1, [0.5, 0.5, 0.1]), (2, [0.25, 0.25, 0.1])], 3)])
def test_without_variance(spark, rows, components):
    """Directions in which nothing varies have no scale: whitened is null there, explained 0."""
    got = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == components * len(rows)
    varies = len({tuple(v) for _, v in rows}) > 1
    assert all((x.whitened is not None) == (varies and x.component == 1) for x in got)
    assert all(math.isclose(x.explained, 1.0 if varies and x.component == 1 else 0.0, abs_tol=1e-12) and x.identity_error < 1e-12 for x in got)


def test_empty(spark):
    df = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert whiten(df).count() == 0 and whiten(df.limit(0)).count() == 0


def test_large_numbers_stay_exact(spark):
    rows = [(i, [float(2**30 + i), float(-i)]) for i in range(5)]
    xs = [[256 * int(c) for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*xs)]
    got = {x.vec_id: x.deviation for x in whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {i: sum((5 * c - s) ** 2 for c, s in zip(x, sums)) for (i, _), x in zip(rows, xs)}
