"""Hard negatives against all pairs, and Strassen's products against plain ones."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flipline.llm import hard_negatives

SCHEMA = "vec_id long, label int, embedding array<float>, tile int, block string, x int"


@pytest.mark.parametrize("shape", [(1, 1, 1), (17, 40, 33), (64, 64, 64), (65, 31, 129), (0, 5, 7), (200, 3, 50), (33, 0, 40)])
def test_strassen(shape):
    rows, inner, cols = shape
    rng = np.random.default_rng(1)
    a, b = (rng.integers(-(2**20), 2**20, (n, inner)) for n in (rows, cols))
    assert (hard_negatives.strassen(a, b, 4) == a @ b.T).all()
    big = rng.integers(-(2**62), 2**62, (rows, inner))
    assert (hard_negatives.strassen(big, b, 2) == big @ b.T).all()


def plain(rows, anchor, positives=5, negatives=10):
    fit = []
    for place, (vec_id, label, vector, *_) in enumerate(rows):
        if label is None or vector is None or any(c is None or not math.isfinite(c) for c in vector):
            continue
        fit.append((place, vec_id, label, [math.floor(256 * float(np.float32(c))) for c in vector]))
    out = []
    for place, vec_id, label, x in fit:
        if vec_id is None or not anchor(vec_id):
            continue
        scored = [(-sum(a * b for a, b in zip(x, y, strict=False)), i is None, i or 0, lab) for p, i, lab, y in fit if p != place]
        mine = sorted(s for s in scored if s[3] == label)[:positives]
        others = sorted(s for s in scored if s[3] != label)
        for score, none, positive, _ in mine:
            window = [s for s in others if 30 * -score <= 100 * -s[0] <= 90 * -score][:negatives]
            for rank, (low, unnamed, negative, _) in enumerate(window, 1):
                out.append((vec_id, str(None if none else positive), rank, str(None if unnamed else negative), -score, -low))
    return sorted(out)


def found(spark, rows, each=10):
    df = spark.createDataFrame([(*r, 1, "b", 2) for r in rows], SCHEMA)
    got = hard_negatives.mine(df, F.col("vec_id") % each == 0).collect()
    return sorted((r.anchor_id, str(r.positive_id), r.rank, str(r.negative_id), r.positive_score, r.negative_score) for r in got)


def table(seed, n, dims, labels):
    rng = np.random.default_rng(seed)
    return [(i, int(rng.integers(labels)), [float(c) for c in rng.normal(0.1, 0.2, dims)]) for i in range(n)]


@pytest.mark.parametrize("small", [False, True])
def test_against_all_pairs(spark, small, monkeypatch):
    if small:
        for name, size in (("BLOCK", 7), ("TILE", 4), ("SLAB", 2)):
            monkeypatch.setattr(hard_negatives, name, size)
    rows = table(1, 400, 20, 3)
    nan, inf = float("nan"), float("inf")
    rows += [(400, None, [0.1] * 20), (410, 1, None), (420, 1, [nan] * 20), (430, 1, [inf] + [0.0] * 19), (440, 1, [None, 0.5])]
    rows += [(450, 1, []), (460, 2, [0.5, 0.25]), (None, 1, [0.2] * 20), (None, 0, [0.2] * 20), (470, 9, [0.3] * 20)]
    rows += [rows[10], rows[20], rows[3], (480, 0, [0.0] * 20), (490, 2, [-0.2] * 20)]
    got = found(spark, rows)
    assert got == plain(rows, lambda i: i % 10 == 0)
    assert len({a for a, *_ in got}) > 30


def test_ties_and_copies(spark):
    rows = [(i, i % 2, [1.0, 0.5, -1.0]) for i in range(60)] + [(100 + i, i % 2, [0.5, 0.5, -0.25]) for i in range(60)]
    got = found(spark, rows)
    assert got == plain(rows, lambda i: i % 10 == 0) and got


def test_few_rows(spark):
    assert found(spark, []) == []
    assert found(spark, [(0, 1, [1.0])]) == []
    assert found(spark, [(0, 1, [1.0]), (1, 1, [1.0])]) == []
    assert found(spark, [(1, 1, [1.0]), (2, 2, [1.0])]) == []


def test_bounds():
    scores = np.array([-17, -1, 0, 1, 9, 10, 11, 2**61])
    least, most = hard_negatives.bounds(scores, (3, 10), (9, 10))
    assert least.tolist() == [-(-3 * int(s) // 10) for s in scores]
    assert most.tolist() == [9 * int(s) // 10 for s in scores]
