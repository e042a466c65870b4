"""Chain operators against a plain sequential restatement, with blocks far smaller than the chains."""

import random

import pytest
from pyspark.sql import functions as F

from flipline.operators import chains as ch
from flipline.operators.scans import nearest, positions

LABELS = ["No_Data"] * 5 + ["not affected_patch", "not affected_intro", "affected_patch", "affected_intro", "affected", None]
OUTCOMES = ["APPEARS", "BUILD_SUCCESS", "BUILD_FAILURE_OTHER"]
COLS = ["row_pos", "CVE_ID", "Library", "PoC", "Execution Result", "LLM_Verdict", "True Affected Version"]


def make_rows(seed, contiguous):
    rnd = random.Random(seed)
    cves = ["A", "B", "C", "D"]
    order = sorted(rnd.choices(cves, k=90)) if contiguous else rnd.choices(cves[:2], k=90)
    lib, poc, out = "x", "p", "APPEARS"
    rows = []
    for i, cve in enumerate(order):
        if rnd.random() < 0.15:
            lib = rnd.choice("xy")
        if rnd.random() < 0.1:
            poc = rnd.choice("pq")
        if rnd.random() < 0.3:
            out = rnd.choice(OUTCOMES)
        rows.append((i, cve, lib, poc, out, rnd.choice(LABELS), rnd.choice(["affected", "not affected", None])))
    return rows


def text(x):
    return "nan" if x is None else str(x).strip()


def seq_default(rows):
    v = [text(r[5]) for r in rows]
    for i, r in enumerate(rows):
        if v[i] == "No_Data":
            if r[4] == "APPEARS":
                v[i] = "affected"
            elif i and rows[i - 1][1] == r[1] and v[i - 1] == "not affected_patch":
                v[i] = v[i - 1]
    for i in range(len(rows) - 2, -1, -1):
        if v[i] == "No_Data" and rows[i][1:3] == rows[i + 1][1:3] and v[i + 1] == "not affected_intro":
            v[i] = v[i + 1]
    return v


def seq_full(rows):
    v = ["affected" if text(r[5]) == "No_Data" and r[4] == "APPEARS" else text(r[5]) for r in rows]
    key = [(r[1], r[2], r[4] == "APPEARS", r[3]) for r in rows]
    n = len(rows)
    passes = [("not affected_patch", 1), ("not affected_intro", -1), ("affected_patch", 1), ("affected_patch", -1), ("affected_intro", -1), ("affected_intro", 1)]
    for label, step in passes:
        for i in range(n) if step == 1 else range(n - 1, -1, -1):
            j = i - step
            if v[i] == "No_Data" and 0 <= j < n and v[j] == label and key[j] == key[i]:
                v[i] = label
    return v


def frame(spark, rows):
    schema = "row_pos long, CVE_ID string, Library string, PoC string, `Execution Result` string, LLM_Verdict string, `True Affected Version` string"
    return spark.createDataFrame(rows, schema)


def verdicts(df):
    return ["nan" if r["LLM_Verdict"] is None else r["LLM_Verdict"] for r in df.orderBy("row_pos").collect()]


@pytest.mark.parametrize("contiguous", [True, False])
def test_propagation_matches_sequential(spark, contiguous):
    for seed in range(4):
        rows = make_rows(seed, contiguous)
        df = frame(spark, rows).repartition(3)
        for size in (7, 1000):
            kw = dict(contiguous=contiguous, block_rows=size)
            assert verdicts(ch.propagate_default(df, **kw)) == seq_default(rows)
            assert verdicts(ch.propagate_full(df, **kw)) == seq_full(rows)


def test_propagation_compares_neighbours_by_default(spark):
    for seed in range(2):
        rows = make_rows(seed, False)
        df = frame(spark, rows).repartition(3)
        assert verdicts(ch.propagate_default(df, block_rows=7)) == seq_default(rows)
        assert verdicts(ch.propagate_full(df, block_rows=7)) == seq_full(rows)


@pytest.mark.parametrize("sorted_rows", [True, False])
def test_conflict_zone_matches_sequential(spark, sorted_rows):
    rows = make_rows(11, sorted_rows)
    got = [r["in_conflict_zone"] for r in ch.conflict_zone(frame(spark, rows), block_rows=5).orderBy("row_pos").collect()]
    want = []
    for i, r in enumerate(rows):
        hit = False
        for j in (i - 1, i + 1):
            if 0 <= j < len(rows) and rows[j][1:4] == r[1:4]:
                other = (rows[j][4] == "APPEARS") != (r[4] == "APPEARS")
                hit |= other and bool({text(r[5]), text(rows[j][5])} & {"affected_intro", "affected_patch"})
        want.append(hit)
    assert got == want


def test_boundaries_match_sequential_and_skip_null_issues(spark):
    rows = [(i, None if i % 13 == 0 else c, *rest) for i, c, *rest in make_rows(5, False)]
    got = {r["row_pos"]: r["boundary_mode"] for r in ch.infer_boundaries(frame(spark, rows), block_rows=6).collect()}
    want = {r[0]: None for r in rows}
    for cve in {r[1] for r in rows} - {None}:
        group = [r for r in rows if r[1] == cve]
        for a, b in zip(group, group[1:]):
            if a[4] == "APPEARS" != b[4] and text(b[5]) == "No_Data":
                want[b[0]] = want[b[0]] or "patch"
            if a[4] != "APPEARS" == b[4] and text(a[5]) == "No_Data":
                want[a[0]] = "introduction"
    assert got == want


def test_positions_and_nearest_across_blocks(spark):
    rows = [("hot", p * 3, p if p % 4 == 0 else None) for p in range(50)] + [("cold", 1, 9)]
    df = spark.createDataFrame(rows, "k string, pos long, v long")
    pos = positions(df, "k", "pos", "n", block_rows=10, start=0)
    assert [r["n"] for r in pos.where("k = 'hot'").orderBy("pos").collect()] == list(range(50))
    near = nearest(df, "k", "pos", {"b": F.col("v")}, {"a": F.col("v")}, block_rows=10)
    got = [(r["b"], r["a"]) for r in near.where("k = 'hot'").orderBy("pos").collect()]
    want = []
    for p in range(50):
        below = [q for q in range(p) if q % 4 == 0]
        above = [q for q in range(p + 1, 50) if q % 4 == 0]
        want.append((below[-1] if below else None, above[0] if above else None))
    assert got == want
