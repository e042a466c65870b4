"""Line diffs rebuild both documents, keep the longest rise of unique lines, and their hunks apply."""

import random
import re

import pytest
from pyspark.sql import functions as F

from flipline.operators import diffs

SCHEMA = "id long, x string, y string"


def edited(rng, rows):
    rows = list(rows)
    for _ in range(rng.randrange(1, 5)):
        at, kind = rng.randrange(len(rows) + 1), rng.randrange(4)
        if kind == 0:
            rows[at:at] = [f"new {rng.randrange(50)}"] * rng.randrange(1, 3)
        elif kind == 1:
            del rows[at : at + rng.randrange(1, 4)]
        elif kind == 2 and rows:
            moved = rows.pop(rng.randrange(len(rows)))
            rows.insert(rng.randrange(len(rows) + 1), moved)
        elif rows:
            rows[at % len(rows)] += "!"
    return rows


def pairs():
    rng = random.Random(3)
    found = [("a\nb", "a\nb"), ("", "a\nb\n"), ("a", ""), (None, "a"), ("a", None), (None, None), ("a\r\nb\x0bc", "a\nb\nx\nc"), ("a\nb\n", "a\nb")]
    found += [("same\n" * 5, "same\n" * 7), ("a\nb\nc\nd\ne", "e\na\nb\nc\nd")]
    for _ in range(60):
        rows = [rng.choice(["", "{", "}", f"line {rng.randrange(40)}", f"own {i}"]) for i in range(rng.randrange(1, 60))]
        found.append(("\n".join(rows), "\n".join(edited(rng, rows))))
    return [(i, x, y) for i, (x, y) in enumerate(found)]


def split(text):
    return re.split(r"\r\n|[\n\x0b\r]", re.sub(r"(\r\n|[\n\x0b\r])\Z", "", text)) if text else []


def longest_rise(values):
    best = []
    for k, v in enumerate(values):
        best.append(1 + max((best[j] for j in range(k) if values[j] < v), default=0))
    return max(best, default=0)


@pytest.fixture(scope="module")
def given(spark):
    return spark.createDataFrame(pairs(), SCHEMA)


def test_rows_rebuild_both_sides(given):
    rows = {}
    for r in diffs.line_diff(given, "id", "x", "y").orderBy("id", "place").collect():
        rows.setdefault(r["id"], []).append(r)
    for i, x, y in pairs():
        mine, before, after = rows.get(i, []), split(x), split(y)
        if x == y:
            assert mine == []
            continue
        assert [r.place for r in mine] == list(range(1, len(mine) + 1))
        assert [r.line for r in mine if r.sign != "+"] == before and [r.line for r in mine if r.sign != "-"] == after
        assert [r.before_line for r in mine if r.sign != "+"] == list(range(1, len(before) + 1))
        assert [r.after_line for r in mine if r.sign != "-"] == list(range(1, len(after) + 1))
        shared = [line for line in before if before.count(line) == 1 and after.count(line) == 1]
        kept = {r.line for r in mine if r.sign == " "}
        assert len(kept & set(shared)) >= longest_rise([after.index(line) for line in shared])


def test_moved_line_keeps_the_rest(given):
    mine = diffs.line_diff(given.where("id = 9"), "id", "x", "y").orderBy("place").collect()
    assert "".join(r.sign + r.line for r in mine) == "+e a b c d-e"


def test_unified_text_applies(given):
    d = diffs.unified_diff(given, "id", "x", "y", F.lit("old"), F.lit("new"))
    for r in d.collect():
        before, after = split(r.x), split(r.y)
        if before == after:
            assert r["diff"] == "(no textual diff)\n"
            continue
        head, *body = r["diff"].removesuffix("\n").split("\n")[1:]
        assert r["diff"].startswith("--- old\n+++ new\n@@ -") and head == "+++ new"
        out, at, hunks = [], 0, 0
        while body:
            b, nb, a, na = re.fullmatch(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", body.pop(0)).groups()
            nb, na, hunks = int(nb or 1), int(na or 1), hunks + 1
            start = int(b) - (nb > 0)
            out += before[at:start]
            assert len(out) == int(a) - (na > 0)
            at = start
            while nb or na:
                sign, line = body[0][0], body.pop(0)[1:]
                if sign != "+":
                    assert before[at] == line
                    at, nb = at + 1, nb - 1
                if sign != "-":
                    out.append(line)
                    na -= 1
        assert out + before[at:] == after and hunks


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert diffs.line_diff(empty, "id", "x", "y").collect() == []
    assert diffs.unified_diff(empty, "id", "x", "y", F.lit("a"), F.lit("b")).collect() == []
