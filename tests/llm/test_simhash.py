"""SimHash against a plain restatement, and links against all pairs."""

import random

import numpy as np
import pytest
import xxhash

from flipline.llm import components, simhash

SCHEMA = "doc_id long, text string, fp int, u string"


def plain(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints, radius=2):
    values = sorted({f for _, f in prints})
    root = {v: v for v in values}

    def top(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                root[top(a)] = top(b)
    least = {}
    for d, f in prints:
        if d is not None:
            least[top(f)] = min(d, least.get(top(f), d))
    return sorted((str(d), f, str(least.get(top(f)))) for d, f in prints)


TEXTS = ["", None, " \t\n", "a", "A b", "a B c", "É é x y z", "w " * 5000, "one two three four", "one two three four"]


@pytest.mark.parametrize("text", TEXTS + ["x\x0by\x0cz q", "The THE the the"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain(text)


@pytest.mark.parametrize("crowd", [64, 2])
def test_near_duplicates(spark, crowd):
    rng = random.Random(5)
    rows = [(i, t, 1, "x") for i, t in enumerate(TEXTS)] + [(None, "lost", 1, None), (3, "a", 2, None)]
    base = " ".join(rng.choice("abcdefghij") * 3 for _ in range(400)).split()
    for i in range(120):
        words = list(base)
        words[rng.randrange(400)] = f"w{i}"
        rows.append((100 + i, " ".join(words), 0, None))
    out = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), crowd=crowd).collect()
    got = sorted((str(r.doc_id), r.fp % 2**64, str(r.component_id)) for r in out)
    assert got == classes([(d, plain(t)) for d, t, *_ in rows])
    assert len({c for *_, c in got}) < 100


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("crowd", [64, 1])
def test_links_reach_all(spark, crowd):
    rng = random.Random(1)
    values = {0, 2**64 - 1}
    for _ in range(12):
        v = rng.getrandbits(64)
        for _ in range(25):
            values.add(v)
            v ^= 1 << rng.randrange(64)
            v ^= (1 << rng.randrange(64)) * rng.randrange(2)
    signed = [(int(np.uint64(v).astype(np.int64)),) for v in values]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"), crowd=crowd).collect()
    assert all(((a ^ b) % 2**64).bit_count() <= 2 for a, b in edges)
    root = {v: v for (v,) in signed}

    def top(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        root[top(a)] = top(b)
    for (a,) in signed:
        for (b,) in signed:
            if ((a ^ b) % 2**64).bit_count() <= 2:
                assert top(a) == top(b)


def test_plan_keeps_the_pigeonhole():
    rng = np.random.default_rng(0)
    sample = rng.integers(0, 2**63, 300).astype(np.uint64)
    for parts in simhash.PARTS:
        groups = simhash.group_bits(sample, parts)
        assert sorted(b for g in groups for b in g) == list(range(64))
        assert sum(simhash.allocate(sample, groups, 2, 10**6)[1]) == 2 - parts + 1
    assert simhash.plan(np.zeros(1, np.uint64), 0)


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 300)] + [(rng.randrange(1000, 2000), rng.randrange(1000, 2000)) for _ in range(500)]
    got = {r.u: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {}

    def top(v):
        root.setdefault(v, v)
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    assert got == {v: top(v) for v in root if top(v) != v}
