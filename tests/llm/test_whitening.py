"""Whitening against numpy's eigenvectors, and its exact steps against plain integer work."""

import math
from decimal import Decimal, localcontext
from fractions import Fraction

import numpy as np
import pytest

from flipline.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, x int, n string, component int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "n", 2) for r in rows], SCHEMA)


def quantised(rows, dims):
    out = []
    for vec_id, vector in rows:
        if vector is not None and all(c is not None and math.isfinite(c) for c in vector):
            x = [math.floor(256 * float(np.float32(c))) for c in vector]
            out.append((vec_id, tuple(x + [0] * (dims - len(x)))))
    return out


def compare(spark, rows, dims, count=4):
    usable = quantised(rows, dims)
    distinct = np.array(sorted({x for _, x in usable}))
    n, sums = len(distinct), distinct.sum(axis=0)
    centred = distinct - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert len(got) == len(usable) * min(count, dims)
    by = {}
    for r in got:
        by.setdefault((str(r.vec_id), r.deviation), {})[r.component] = r
    for vec_id, x in usable:
        deviation = sum((n * a - int(s)) ** 2 for a, s in zip(x, sums, strict=True))
        cells = by[str(vec_id), deviation]
        for k in range(min(count, dims)):
            assert cells[k + 1].n == n
            assert cells[k + 1].explained == pytest.approx(values[k] / values.sum(), rel=1e-9)
            want = (np.array(x) - sums / n) @ vectors[:, k] / math.sqrt(values[k])
            assert abs(cells[k + 1].whitened) == pytest.approx(abs(want), abs=1e-8)
    assert all(r.identity_error < 1e-12 for r in got)
    white = {x: [by[str(i), sum((n * a - int(s)) ** 2 for a, s in zip(x, sums, strict=True))][k + 1].whitened for k in range(min(count, dims))] for i, x in usable}
    z = np.array(list(white.values()))
    assert np.abs(z.T @ z / n - np.eye(z.shape[1])).max() < 1e-9


@pytest.mark.parametrize("dims", [2, 6, 24])
def test_against_eigh(spark, dims):
    rng = np.random.default_rng(dims)
    mix = rng.normal(0, 1, (dims, dims))
    rows = [(i, [float(c) for c in rng.normal(0, 0.3, dims) @ mix]) for i in range(200)]
    nan = float("nan")
    rows += [rows[0], rows[5], (900, rows[7][1]), (None, rows[8][1]), (901, None), (902, [nan] * dims), (903, [None] + [0.0] * (dims - 1)), (904, [0.5]), (905, [])]
    compare(spark, rows, dims)


def test_hot_vector_counts_once(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in rng.normal(0, 0.3, 5)]) for i in range(50)] + [(100 + i, [0.25] * 5) for i in range(500)]
    compare(spark, rows, 5)


def test_equal_roots(spark):
    rows = [(i, [float(s) if j == i // 2 else 0.0 for j in range(6)]) for i, s in enumerate([1, -1] * 6)]
    got = whitening.whiten(frame(spark, rows)).toPandas()
    assert np.allclose(got["explained"], 1 / 6) and (got["identity_error"] < 1e-12).all()
    z = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(z.T @ z / 12 - np.eye(4)).max() < 1e-9


def test_low_rank_and_few_rows(spark):
    assert whitening.whiten(frame(spark, [])).collect() == []
    assert whitening.whiten(frame(spark, [(1, []), (2, None)])).collect() == []
    one = whitening.whiten(frame(spark, [(1, [0.5] * 5), (2, [0.5] * 5)])).collect()
    assert len(one) == 8 and all((r.whitened, r.explained, r.identity_error, r.deviation, r.n) == (None, 0.0, None, 0, 1) for r in one)
    line = whitening.whiten(frame(spark, [(i, [0.5 * i, -0.5 * i, 0.0]) for i in range(5)])).toPandas()
    first = line[line["component"] == 1]
    assert len(line) == 15 and np.allclose(first["explained"], 1) and np.allclose(first["whitened"] ** 2, [2, 0.5, 0, 0.5, 2])
    assert line[line["component"] > 1]["whitened"].isna().all()


def plain_characteristic(a):
    """Faddeev and LeVerrier, over fractions."""
    n = len(a)
    a = [[Fraction(int(c)) for c in row] for row in a]
    m = [[Fraction(0)] * n for _ in range(n)]
    out = [Fraction(1)]
    for k in range(1, n + 1):
        m = [[sum(a[i][t] * m[t][j] for t in range(n)) + (out[-1] if i == j else 0) for j in range(n)] for i in range(n)]
        out.append(-sum(a[i][t] * m[t][i] for i in range(n) for t in range(n)) / k)
    return [int(c) for c in out]


@pytest.mark.parametrize("kind", ["dense", "sparse", "zero", "large"])
def test_characteristic(spark, kind):
    rng = np.random.default_rng(5)
    b = rng.integers(-9, 10, (7, 5)).astype(object)
    if kind == "sparse":
        b[rng.random((7, 5)) < 0.7] = 0
    scatter = b @ b.T * {"zero": 0, "large": 10**30}.get(kind, 1)
    assert whitening.characteristic(spark, scatter) == plain_characteristic(scatter)


def test_roots():
    polynomial = [1]
    for root in (0, 0, 3, 3, 7, 1000):
        polynomial = [a - root * b for a, b in zip([*polynomial, 0], [0, *polynomial], strict=True)]
    assert [whitening.roots_above(polynomial, at, 0) for at in (-1, 0, 2, 3, 6, 7, 999, 1000)] == [6, 4, 4, 2, 2, 1, 1, 0]
    roots = whitening.largest_roots(polynomial, 6, 1013)
    assert [round((a + 0.5) / 2**bits, 9) if a else 0 for a, bits in roots] == [1000, 7, 3, 3, 0, 0]


def test_null_vectors_of_close_roots():
    scatter = np.array([[10**12, 1, 0], [1, 10**12, 0], [0, 0, 5]], object)
    polynomial = plain_characteristic(scatter)
    with localcontext() as context:
        context.prec = whitening.DIGITS
        roots = [Decimal(2 * a + 1) / Decimal(2) ** (bits + 1) for a, bits in whitening.largest_roots(polynomial, 3, 2 * 10**12 + 5)]
        first, second, third = (np.array([float(c) for c in v]) for v in whitening.null_vectors(scatter, roots))
    assert np.allclose(abs(first), [0.5**0.5, 0.5**0.5, 0], atol=1e-15) and np.allclose(abs(third), [0, 0, 1], atol=1e-15)
    assert first[0] * first[1] > 0 > second[0] * second[1]


def test_primes():
    found = whitening.primes(2**100)
    assert math.prod(found) > 2**100 and all(all(p % d for d in range(3, 46341, 2)) for p in found)


def test_moments_beyond_int64():
    x = np.array([[2**40, -(2**41)], [3, 2**40]])
    assert whitening._product(x).tolist() == (x.astype(object).T @ x.astype(object)).tolist()
