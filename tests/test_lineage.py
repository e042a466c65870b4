"""Release branches against a plain restatement of the assignment rules, and small hand-made placements."""

import random
import time
from datetime import datetime, timedelta

import pytest

from flipline.operators import lineage as ln


def plain_lineage(history, window):
    """(version, day, rank, core, line, kind, major) in time order -> {version: (branch number, position, type)}."""
    branches, placed, where, core_branch, kinds = [], [], {}, {}, {}

    def lower(e):
        return [p for p in placed if p[2] < e[2]]

    def by_gap(cands, e):
        gap = lambda p: e[6] - p[6] if e[6] >= p[6] >= 0 else 10**9
        return max(cands, key=lambda p: (-gap(p), p[1], p[2]), default=None)

    def put(b, e):
        where[e[0]] = (b, len(branches[b]["e"]), branches[b]["t"])
        branches[b]["e"].append(e)
        placed.append(e)

    def new(t, e):
        branches.append({"t": t, "line": e[4], "e": []})
        return len(branches) - 1

    for e in sorted(history, key=lambda x: (x[1], x[2])):
        kinds[e[0]] = e[5]
        if not branches:
            put(new("main", e), e)
            continue
        same = [p for p in lower(e) if p[3] == e[3] and e[3]]
        if [p for p in same if e[1] - p[1] <= 1.0 and branches[where[p[0]][0]]["t"] != "hotfix"]:
            kinds[e[0]] = "hotfix"
            put(new("hotfix", e), e)
            continue
        own = [i for i, b in enumerate(branches) if b["line"] == e[4] and b["t"] in ("main", "line") and b["e"][-1][2] <= e[2]]
        if own:
            put(max(own, key=lambda i: branches[i]["e"][-1][1:3]), e)
            continue
        if e[5] == "stable" and by_gap([p for p in lower(e) if kinds[p[0]] == "stable" and p[4] != e[4]], e):
            put(new("line", e), e)
            continue
        if e[5] in ("runtime-fork", "suffix-fork") and [p for p in same if e[1] - p[1] <= window]:
            b = core_branch.get(e[3])
            if b is None or branches[b]["e"][-1][2] > e[2]:
                b = core_branch[e[3]] = new("same-core", e)
            put(b, e)
            continue
        put(new("line", e), e)
    return where


def test_lineage_matches_plain_rules(spark):
    rnd = random.Random(3)
    start = datetime(2020, 1, 1)
    rows = []
    for a in range(12):
        for _ in range(30):
            v = f"{rnd.randint(0, 2)}.{rnd.randint(0, 2)}.{rnd.randint(0, 2)}" + rnd.choice(["", "", "-rc1", "-jdk8", "-GA", "-jdk7"])
            rows.append((f"a{a}", v, start + timedelta(hours=rnd.randint(0, 200))))
    h = ln.release_history(spark.createDataFrame(rows, "artifact string, version string, release_date timestamp"))
    facts = h.orderBy("artifact", "order_key").collect()
    got = {}
    for r in ln.lineage(h.repartition(5), 3.0).collect():
        got.setdefault(r["artifact"], {})[r["version"]] = (r["matrix_row"], r["matrix_col"], r["branch_type"])
    for artifact in {r["artifact"] for r in facts}:
        mine = [r for r in facts if r["artifact"] == artifact]
        hist = [
            (r["version"], r["release_date"].timestamp() / 86400, i, r["core"], r["line_key"], r["branch_kind"], r["semver"][0])
            for i, r in enumerate(mine)
        ]
        assert got[artifact] == plain_lineage(hist, 3.0)


def fold_rows(rnd, n, lines):
    """Rows of one artifact as the fold takes them, and the same for the plain rules; ``lines`` names a line freely."""
    facts = []
    for k in range(n):
        major = rnd.choice([-1, 0, 1, 2, 5])
        core = f"{major}.{rnd.randrange(3)}.{rnd.randrange(3)}" if major >= 0 else ""
        facts.append((rnd.random() * 40, core, rnd.choice(["stable", "stable", "runtime-fork", "suffix-fork", "pre-release"]), lines(rnd, core), major, k))
    ranks = sorted(range(n), key=lambda k: (facts[k][4], facts[k][1], rnd.random()))
    rank = {k: r for r, k in enumerate(ranks, 1)}
    rows = [("a", f"v{k}", None, core, kind, line, day, major, rank[k]) for k, (day, core, kind, line, major, _) in enumerate(facts)]
    return sorted(rows, key=lambda r: (r[6], r[8]))


@pytest.mark.parametrize("scattered", [False, True])
def test_fold_of_a_long_history(scattered):
    def line(rnd, core):
        return rnd.choice("xyz") if scattered else core[:3] or "unknown"

    for seed in range(6):
        rows = fold_rows(random.Random(seed), 250, line)
        got = {r[1]: (r[4], r[5], r[9]) for r in ln._History(rows, 3.0).run()}
        assert got == plain_lineage([(r[1], r[6], r[8], r[3], r[5], r[4], r[7]) for r in rows], 3.0)


def test_fold_does_not_slow_down_with_the_history():
    rows = fold_rows(random.Random(1), 30_000, lambda rnd, core: core[:3] or "unknown")
    start = time.perf_counter()
    assert len(ln._History(rows, 30.0).run()) == 30_000
    assert time.perf_counter() - start < 30


def test_hotfix_candidates_against_all_pairs(spark):
    rnd = random.Random(5)
    start = datetime(2020, 1, 1)
    rows = [(f"a{rnd.randrange(3)}", f"1.{rnd.randrange(3)}" + rnd.choice(["", "-rc", "-fix", "-b"]) + str(rnd.randrange(40)), start + timedelta(hours=6 * rnd.randrange(60))) for _ in range(500)]
    h = ln.release_history(spark.createDataFrame(rows, "artifact string, version string, release_date timestamp"))
    facts = [(r["artifact"], r["core"], r["version"], r["release_date"], i) for i, r in enumerate(h.orderBy("order_key").collect()) if r["core"]]
    for window in (0.0, 1.0, 4.5):
        want = {}
        for a, core, v, d, k in facts:
            near = [(d2, k2, v2) for a2, c2, v2, d2, k2 in facts if (a2, c2) == (a, core) and d2 <= d and k2 < k and (d - d2) <= timedelta(days=window)]
            if near:
                want[a, v] = max(near)[2], max(near)[0]
        got = {(r["artifact"], r["version"]): (r["anchor_version"], r["anchor_date"]) for r in ln.hotfix_candidates(h, window).collect()}
        assert got == want and want


def test_hotfix_anchor_and_tree(spark):
    d = datetime(2021, 1, 1)
    rows = [("g:a", "1.0", d), ("g:a", "1.1", d + timedelta(days=9)), ("g:a", "1.1-fix", d + timedelta(days=9, hours=5)), ("g:a", "2.0", d + timedelta(days=30)), ("g:a", "1.2", d + timedelta(days=40))]
    h = ln.release_history(spark.createDataFrame(rows, "artifact string, version string, release_date timestamp"))
    got = {r["version"]: r for r in ln.lineage(h).collect()}
    assert got["1.1-fix"]["branch_kind"] == "hotfix" and got["1.1-fix"]["fork_anchor_version"] == "1.1"
    assert got["2.0"]["branch_key"] == "line@2.0#3" and got["2.0"]["fork_anchor_version"] == "1.1"
    # A release of a line without an appendable branch opens one under the latest lower stable release.
    assert got["1.2"]["branch_type"] == "line" and got["1.2"]["fork_anchor_version"] == "1.1"
    tree = {r["matrix_row"]: [v["version"] for v in r["versions"]] for r in ln.version_tree(ln.lineage(h)).collect()}
    assert tree[0] == ["1.0"] and sorted(sum(tree.values(), [])) == sorted(got)


def test_place_untested_and_pairs(spark):
    d = datetime(2021, 1, 1)
    rel = [("g:a", f"1.{i}.0", d + timedelta(days=i)) for i in range(4)]
    h = ln.release_history(spark.createDataFrame([(a, v.replace("1.", "1.0.", 1), t) for a, v, t in rel], "artifact string, version string, release_date timestamp"))
    tested = [("g:a", 0, "pre", "BUILD_SUCCESS"), ("g:a", 1, "1.0.0.0", "APPEARS"), ("g:a", 2, "mid", "BUILD_FAILURE_OTHER"), ("g:a", 3, "mid2", "APPEARS"), ("g:a", 4, "1.0.3.0", "BUILD_SUCCESS"), ("g:b", 0, "lost", "APPEARS")]
    t = spark.createDataFrame([(*r, f"c{r[1]}") for r in tested], "artifact string, row_pos long, version string, outcome string, cause string")
    placed = ln.place_untested(t, ln.lineage(h), h, block_rows=2)
    order = [r["version"] for r in placed.where("matrix_row = 0").orderBy("matrix_col").collect()]
    assert order == ["pre", "1.0.0.0", "mid", "mid2", "1.0.3.0"]
    keys = {r["version"]: r["branch_key"] for r in placed.collect()}
    assert keys["mid2"] == "excel-unresolved@mid" and keys["pre"] == "excel-unresolved@prefix:1.0.0.0"
    assert [r["version"] for r in ln.still_unresolved(placed).collect()] == ["lost"]
    pairs = [(r["left_version"], r["right_version"], r["seek_patch"], r["cause"]) for r in ln.boundary_pairs(placed).orderBy("left_col").collect()]
    assert pairs == [("pre", "1.0.0.0", False, ""), ("1.0.0.0", "mid", True, "c2"), ("mid", "mid2", None, None), ("mid2", "1.0.3.0", True, "")]


def test_rows_are_dealt_by_their_number(spark):
    from pyspark.sql import functions as F

    from flipline.operators import lineage, scans

    rows = spark.range(1_000_000).select((F.col("id") % 1000).cast("string").alias("artifact"), F.concat(F.lit("1."), "id").alias("version"), F.lit("2020-01-01").alias("release_date"))
    assert scans.tasks_for(rows) == max(10, int(spark.conf.get("spark.sql.shuffle.partitions")))
    assert lineage.release_history(rows).rdd.getNumPartitions() == scans.tasks_for(rows)
