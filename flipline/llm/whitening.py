"""Whitening of embeddings by the exact characteristic polynomial of their scatter.

Tasks sum the integer moments of the distinct vectors. From the count n, the sums S and the second moments G the scatter
M = n * G - S * S' is an integer matrix, n * n times the covariance. Its characteristic polynomial is found modulo many
primes, each by reduction to Hessenberg form in a task of its own, and put together by the Chinese remainder theorem.
All its roots are real, so the sign changes of its coefficients after a shift by a count the roots above a, with their
multiplicity and without error. Bisection by that count isolates the largest roots; an isolated one is narrowed by the
sign of the polynomial. Inverse iteration on M minus the root, in decimal numbers of more digits than the root has, gives the
vector that spans the null space. Only moments and residues, whose number follows the dimension, reach the driver.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from decimal import Decimal, localcontext
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flipline.llm.vectors import matrix, quantised, usable, widest

COMPONENTS = 4
#: Binary digits to which roots are narrowed, and decimal digits of the inverse iteration.
ROOT_BITS = 140
DIGITS = 110
ROUNDS = 4
LARGEST = np.iinfo(np.int64).max


class Model(NamedTuple):
    """n, sums and trace of the scatter are integers; ``vectors`` holds a unit vector per row; a root of 0 has none."""

    n: int
    sums: list[int]
    trace: int
    roots: list[Decimal]
    vectors: np.ndarray
    identity_error: float | None


def _product(x: np.ndarray) -> np.ndarray:
    """x' x in exact integers: int64 in slices whose sums cannot overflow, Python's integers for entries beyond that."""
    most = int(np.abs(x.astype(object)).max()) ** 2 if x.size and x.min() == np.iinfo(np.int64).min else int(np.abs(x).max(initial=0)) ** 2
    total = np.zeros((x.shape[1],) * 2, object)
    if most >= LARGEST:
        wide = x.astype(object)
        return wide.T @ wide
    step = LARGEST // max(most, 1)
    for at in range(0, len(x), step):
        part = np.ascontiguousarray(x[at : at + step].T)
        total += (part @ part.T).astype(object)
    return total


def moments(distinct: DataFrame, dims: int) -> np.ndarray:
    """Sums over the rows of ``x`` of (1, x)' (1, x), as Python integers; summed in tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims + 1,) * 2, object)
        for batch in batches:
            x = matrix(batch.column(0), dims)
            total += _product(np.concatenate([np.ones((len(x), 1), np.int64), x], axis=1))
        i, j = np.triu_indices(dims + 1)
        sums = pa.array([str(s) for s in total[i, j]])
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), sums], ["i", "j", "s"])

    parts = distinct.select("x").mapInArrow(run, "i int, j int, s string")
    rows = parts.groupBy("i", "j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    out = np.zeros((dims + 1,) * 2, object)
    for r in rows:
        if r.s is None:
            raise OverflowError("second moments beyond 38 digits")
        out[r.i, r.j] = out[r.j, r.i] = int(r.s)
    return out


def _is_prime(n: int) -> bool:
    """Miller-Rabin; with these bases right for all n below 2**32."""
    if n < 2 or any(n % p == 0 for p in (2, 3, 5, 7)):
        return n in (2, 3, 5, 7)
    odd = n - 1
    twos = (odd & -odd).bit_length() - 1
    odd >>= twos
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes(bound: int) -> list[int]:
    """Primes of 31 bits, the largest first, whose product is over ``bound``."""
    found, product, n = [], 1, 2**31 - 1
    while product <= bound:
        if _is_prime(n):
            found.append(n)
            product *= n
        n -= 2
    return found


def characteristic_mod(scatter: np.ndarray, p: int) -> list[int]:
    """Coefficients of det(x - scatter) modulo p, constant first; ``scatter`` is reduced modulo p, p below 2**31."""
    a, n = scatter.copy(), len(scatter)
    for m in range(1, n - 1):
        below = np.flatnonzero(a[m:, m - 1])
        if not len(below):
            continue
        i = m + below[0]
        a[[i, m]] = a[[m, i]]
        a[:, [i, m]] = a[:, [m, i]]
        factor = a[m + 1 :, m - 1] * pow(int(a[m, m - 1]), -1, p) % p
        a[m + 1 :] = (a[m + 1 :] - factor[:, None] * a[m] % p) % p
        a[:, m] = (a[:, m] + (a[:, m + 1 :] * factor % p).sum(axis=1)) % p
    leading = np.zeros((n + 1, n + 1), np.int64)
    leading[0, 0] = 1
    for k in range(1, n + 1):
        row = -a[k - 1, k - 1] * leading[k - 1] % p
        row[1:] += leading[k - 1, :-1]
        weights, chain = np.zeros(k - 1, np.int64), 1
        for i in range(k - 2, -1, -1):
            chain = chain * int(a[i + 1, i]) % p
            weights[i] = chain * int(a[i, k - 1]) % p
        leading[k] = (row - (weights[:, None] * leading[: k - 1] % p).sum(axis=0)) % p
    return leading[n].tolist()


def characteristic(spark: SparkSession, scatter: np.ndarray) -> list[int]:
    """Coefficients of det(x - scatter), the leading 1 first, of a positive semi-definite integer matrix.

    Each is at most (1 + trace / n) ** n, because the roots are not negative. A task takes one prime.
    """
    n, trace = len(scatter), int(np.trace(scatter))
    chosen = primes(2 * (2 + trace // n) ** n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column(0).to_pylist():
                residues = characteristic_mod((scatter % p).astype(np.int64), p)
                yield pa.RecordBatch.from_pydict({"p": pa.array([p]), "residues": pa.array([residues])})

    tasks = min(len(chosen), spark.sparkContext.defaultParallelism)
    dealt = spark.createDataFrame([(p,) for p in chosen], "p long").repartition(tasks)
    rows = dealt.mapInArrow(run, "p long, residues array<long>").collect()
    whole = math.prod(chosen)
    parts = [(whole // r.p * pow(whole // r.p % r.p, -1, r.p), r.residues) for r in rows]
    values = [sum(weight * residues[k] for weight, residues in parts) % whole for k in range(n + 1)]
    return [v - whole if v > whole // 2 else v for v in reversed(values)]


def roots_above(polynomial: list[int], at: int, bits: int) -> int:
    """The number of roots above at / 2**bits of a polynomial whose roots are all real: sign changes after the shift."""
    shifted = [c << (bits * k) for k, c in enumerate(polynomial)]
    for end in range(len(shifted) - 1, 0, -1):
        for k in range(1, end + 1):
            shifted[k] += at * shifted[k - 1]
    signs = [c > 0 for c in shifted if c]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def _sign(polynomial: list[int], at: int, bits: int) -> int:
    value = 0
    for k, c in enumerate(polynomial):
        value = value * at + (c << (bits * k))
    return (value > 0) - (value < 0)


def largest_roots(polynomial: list[int], count: int, most: int) -> list[tuple[int, int]]:
    """The ``count`` largest roots, repeats included, as (a, bits): the root is in (a, a + 1] / 2**bits; (0, 0) for 0.

    ``most`` is no less than any root, and none is negative. The integer a has at least ROOT_BITS binary digits.
    """
    rank = len(polynomial) - 1 - next((k for k, c in enumerate(reversed(polynomial)) if c), len(polynomial) - 1)
    found = []
    for k in range(1, min(count, len(polynomial) - 1) + 1):
        if k > rank:
            found.append((0, 0))
            continue
        low, high, bits = 0, most, 0
        above_low, above_high = rank, 0
        while True:
            if high - low == 1:
                if low.bit_length() >= ROOT_BITS:
                    break
                low, high, bits = low << 16, high << 16, bits + 16
            middle = (low + high) // 2
            if above_low - above_high == 1:
                # sign below the only root here: that beyond all roots, turned once for each root above
                below = 1 if above_low % 2 == 0 else -1
                if _sign(polynomial, middle, bits) == below:
                    low = middle
                else:
                    high = middle
                continue
            above = roots_above(polynomial, middle, bits)
            if above >= k:
                low, above_low = middle, above
            else:
                high, above_high = middle, above
        found.append((low, bits))
    return found


def _factor(a: np.ndarray, tiny: Decimal) -> tuple[np.ndarray, list[int]]:
    """LU factors in place and the row swaps, with partial pivoting; a pivot of 0 becomes ``tiny``."""
    swaps = []
    for k in range(len(a)):
        i = k + max(range(len(a) - k), key=lambda r: abs(a[k + r, k]))
        swaps.append(i)
        if i != k:
            a[[i, k]] = a[[k, i]]
        if not a[k, k]:
            a[k, k] = tiny
        a[k + 1 :, k] /= a[k, k]
        a[k + 1 :, k + 1 :] -= a[k + 1 :, k, None] * a[k, k + 1 :]
    return a, swaps


def _solve(lu: np.ndarray, swaps: list[int], v: np.ndarray) -> np.ndarray:
    v = v.copy()
    for k, i in enumerate(swaps):
        v[[k, i]] = v[[i, k]]
        v[k + 1 :] -= lu[k + 1 :, k] * v[k]
    for k in range(len(v) - 1, -1, -1):
        v[k] /= lu[k, k]
        v[:k] -= lu[:k, k] * v[k]
    return v


def null_vectors(scatter: np.ndarray, roots: list[Decimal]) -> list[np.ndarray]:
    """For each root a unit vector of decimals in the null space of scatter - root, at right angles to the earlier ones."""
    found: list[np.ndarray] = []
    size = len(scatter)
    wide = np.array([[Decimal(int(c)) for c in row] for row in scatter], object).reshape(size, size)
    lu = swaps = None
    for k, root in enumerate(roots):
        if k == 0 or root != roots[k - 1]:
            shifted = wide.copy()
            shifted[np.diag_indices(size)] -= root
            lu, swaps = _factor(shifted, root.scaleb(-DIGITS))
        draw = random.Random(k)
        v = np.array([Decimal(draw.random()) + 1 for _ in range(size)], object)
        for _ in range(ROUNDS):
            v = _solve(lu, swaps, v)
            v /= max(abs(c) for c in v)
            for _ in range(2):
                for other in found:
                    v = v - (v @ other) * other
            v /= (v @ v).sqrt()
        found.append(v)
    return found


def fit(x: DataFrame, dims: int, components: int = COMPONENTS) -> Model:
    """The model of the rows of ``x``, vectors of ``dims`` integers, each distinct vector counted once.

    No rows give n = 0. The work on the driver follows ``dims`` alone.
    """
    sums = moments(x.select("x").distinct(), dims)
    n, s, g = int(sums[0, 0]), sums[0, 1:], sums[1:, 1:]
    scatter = n * g - np.outer(s, s)
    trace = int(np.trace(scatter)) if dims else 0
    count = min(components, dims)
    if not n or not trace:
        return Model(n, s.tolist(), 0, [Decimal(0)] * count, np.zeros((0, dims)), None)
    narrowed = largest_roots(characteristic(x.sparkSession, scatter), count, trace)
    with localcontext() as context:
        context.prec = DIGITS
        roots = [Decimal(2 * a + 1) / (Decimal(2) ** (bits + 1)) if a else Decimal(0) for a, bits in narrowed]
        positive = [r for r in roots if r]
        vectors = np.array([[float(c) for c in v] for v in null_vectors(scatter, positive)])
        exact = np.array([[Decimal(float(c)) for c in v] for v in vectors], object)
        wide = np.array([[Decimal(int(c)) for c in row] for row in scatter], object)
        spread = exact @ wide @ exact.T
        error = max(
            abs(spread[i, j] / (positive[i] * positive[j]).sqrt() - (i == j)) for i in range(len(positive)) for j in range(len(positive))
        )
        return Model(n, s.tolist(), trace, roots, vectors, float(error))


def apply(rows: DataFrame, model: Model, dims: int) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for rows (vec_id, x)."""
    n, sums, count = model.n, model.sums, len(model.roots)
    wide_sums = np.array(sums, object)
    rank = len(model.vectors)
    with localcontext() as context:
        context.prec = DIGITS
        # (x - S / n) v / sqrt(e) is (n x - S) v / sqrt(root), for the root is n * n * e
        scale = [float(1 / r.sqrt()) for r in model.roots[:rank]]
        explained = [float(r / model.trace) if model.trace else 0.0 for r in model.roots]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x"), dims)
            size = int(max(abs(int(x.min(initial=0))), int(x.max(initial=0)))) * n + max(map(abs, sums), default=0)
            if size * size * max(dims, 1) <= LARGEST:
                moved = n * x - np.array(sums, np.int64)
                deviation = (moved * moved).sum(axis=1).tolist()
            else:
                moved = n * x.astype(object) - wide_sums
                deviation = [d if d <= LARGEST else None for d in (moved * moved).sum(axis=1).tolist()] if dims else [0] * len(x)
            whitened = np.full((len(x), count), np.nan)
            if rank:
                whitened[:, :rank] = moved.astype(float) @ model.vectors.T * scale
            ids = np.repeat(np.arange(len(x)), count)
            component = np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))
            flat = whitened.ravel()
            columns = {
                "vec_id": batch.column("vec_id").take(pa.array(ids)),
                "component": pa.array(component),
                "n": pa.array(np.full(len(ids), n, np.int64)),
                "deviation": pa.array(deviation, pa.int64()).take(pa.array(ids)),
                "whitened": pa.array(flat, mask=np.isnan(flat)),
                "explained": pa.array(np.tile(np.array(explained, float), len(x))),
                "identity_error": pa.array([model.identity_error] * len(ids), pa.float64()),
            }
            yield pa.RecordBatch.from_pydict(columns)

    names = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return rows.select("vec_id", "x").mapInArrow(run, names)


def whiten(table: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable row of ``table`` and component, up to the dimension.

    Rows without a vector or with a null or non-finite entry are dropped. A null vec_id stays null, repeated rows stay
    repeated but count once in the fit, other columns are ignored. Vectors shorter than the longest count as filled up
    with zeros. Components numbered beyond the rank of the scatter have no whitened value and explain 0, and the
    identity error is that of the others, null if there are none (one distinct vector). A deviation beyond a long is
    null; second moments beyond 38 digits raise. Equal roots get vectors at right angles. Of an empty table, or where
    all vectors are empty, nothing comes out.
    """
    rows = table.where(usable(column)).select(F.col("vec_id").cast("long").alias("vec_id"), quantised(column).alias("x"))
    dims = widest(rows, "x")
    padded = rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("x"))))
    return apply(padded, fit(padded, dims, components), dims)
