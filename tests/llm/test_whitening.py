"""Whitening against exact arithmetic in fractions."""

from fractions import Fraction

import numpy as np
import pytest

from chronofold.llm import whitening

KIND = "vec_id long, embedding array<float>, label int"


def exact(xs):
    """n, sums and the covariance of the distinct rows, in fractions."""
    fit = sorted(set(map(tuple, xs)))
    n, dims = len(fit), len(fit[0])
    s = [sum(x[i] for x in fit) for i in range(dims)]
    mean = [Fraction(v, n) for v in s]
    d = [[x[i] - mean[i] for i in range(dims)] for x in fit]
    return n, s, [[sum(r[i] * r[j] for r in d) / n for j in range(dims)] for i in range(dims)], d


def code(v):
    return tuple(int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v)


def held(spark, rows, k=16):
    """Runs whiten on rows (vec_id, embedding) and holds it against fractions."""
    got = whitening.whiten(spark.createDataFrame([(i, v, None) for i, v in rows], KIND).repartition(3)).collect()
    fine = [(i, code(v)) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    n, s, cov, d = exact([x for _, x in fine])
    values = np.linalg.eigvalsh(np.array([[float(c) for c in r] for r in cov]))[::-1]
    trace = sum(cov[i][i] for i in range(len(cov)))
    width = min(k, len(s))
    assert sorted(((r.vec_id, r.component) for r in got), key=str) == sorted(((i, c + 1) for i, _ in fine for c in range(width)), key=str)
    deviation = {i: sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True)) for i, x in fine}
    for r in got:
        assert (r.n, r.deviation) == (n, deviation[r.vec_id])
        assert r.identity_error < 1e-9
        assert r.explained == pytest.approx(values[r.component - 1] / float(trace), rel=1e-9, abs=1e-14)
    white = {(r.vec_id, r.component): r.whitened for r in got}
    first = {x: i for i, x in reversed(fine)}
    w = np.array([[white[i, c + 1] for c in range(width)] for i in first.values()])
    assert np.abs(w.T @ w / n - np.eye(width)).max() < 1e-9
    # a component is an eigenvector: V maps it to itself, so projections of V's rows agree with those of the data
    x = np.array([[float(v) for v in r] for r in d])
    order = {x: k for k, x in enumerate(sorted(set(x for _, x in fine)))}
    w = np.array([[white[first[x], c + 1] for c in range(width)] for x in order])
    vectors = (x.T @ w / n) / np.sqrt(values[:width])  # V p / sqrt(e) / sqrt(e) = p
    assert np.abs(vectors.T @ vectors - np.eye(width)).max() < 1e-8
    return got


def test_whitening_is_exact_arithmetics(spark):
    rng = np.random.RandomState(1)
    base = rng.normal(size=(80, 20)) @ rng.normal(size=(20, 20))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(500, rows[3][1]), (501, rows[3][1]), (None, rows[4][1]), (600, None), (601, [None] * 20), (602, [float("nan"), *rows[0][1][1:]]), (603, [float("inf"), *rows[0][1][1:]])]
    held(spark, rows)


def test_few_dimensions_far_from_zero(spark):
    rng = np.random.RandomState(2)
    held(spark, [(i, [1e4 + v, -2e4 + w]) for i, (v, w) in enumerate(rng.normal(size=(50, 2)).tolist())])


def test_products_lose_nothing():
    rng = np.random.RandomState(3)
    x = rng.randint(-1000, 1000, (3000, 4)) + 10**6
    n, s, cov, _ = exact([tuple(r) for r in x.tolist()])
    x = np.array(sorted(set(map(tuple, x.tolist()))))
    high, low = whitening.products(*whitening.centred(x, whitening.mean_parts(s, n)))
    for i in range(4):
        for j in range(4):
            assert abs(Fraction(high[i, j]) + Fraction(low[i, j]) - n * cov[i][j]) < Fraction(1, 10**24) * n * cov[i][i]
    # naive sums lose digits that these keep
    a, b = whitening.add(1e16, 0.0, 1.0)
    assert (a, b) == (1e16, 1.0) or Fraction(a) + Fraction(b) == 10**16 + 1


def test_parts_add_up():
    rng = np.random.RandomState(4)
    x = rng.normal(size=(100, 3)) * [1e-5, 1, 1e7]
    a, b, c = whitening.parts(x, np.zeros_like(x))
    assert (a + b + c == x).all()
    exactly = [[sum(Fraction(p) * Fraction(q) for p, q in zip(a[:, i], a[:, j], strict=True)) for j in range(3)] for i in range(3)]
    assert [[Fraction(v) for v in r] for r in a.T @ a] == exactly


def test_no_variance_other_lengths_and_empty(spark):
    run = lambda rows: whitening.whiten(spark.createDataFrame([(i, v, 0) for i, v in rows], KIND)).collect()
    assert run([]) == []
    assert run([(1, None), (2, [])]) == []
    one = run([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [5.0])])
    assert sorted((r.vec_id, r.component) for r in one) == [(1, 1), (1, 2), (2, 1), (2, 2)]
    assert {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one} == {(1, 0, None, None, None)}
    line = run([(i, [float(i), 2.0 * i]) for i in range(4)])
    assert {r.component: (round(r.explained, 9), r.whitened is None) for r in line} == {1: (1.0, False), 2: (0.0, True)}
    assert all(r.identity_error < 1e-12 for r in line)


def test_large_numbers(spark):
    rows = [(1, [3e38]), (2, [1e12]), (3, [-1e12])]
    got = {r.vec_id: r for r in whitening.whiten(spark.createDataFrame([(i, v, 0) for i, v in rows], KIND)).collect()}
    assert set(got) == {2, 3} and got[2].deviation is None
    assert got[2].whitened == pytest.approx(1.0) or got[2].whitened == pytest.approx(-1.0)


def test_extra_columns(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], "a", "b"), (2, [0.0, 1.0], "c", "d")], "vec_id long, embedding array<float>, x string, component string")
    assert whitening.whiten(df).count() == 4
