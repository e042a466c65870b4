"""Dropping shared lines against a plain restatement, and the two filters against exact counts."""

import random
import re

import numpy as np
import pytest

from flipline.llm import line_dedup

SCHEMA = "doc_id long, text string, key string, row_key int, places string"


def plain(rows, least_chars=40, least_docs=5):
    def key(line):
        line = re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line)
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)

    holders = {}
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_chars:
                holders.setdefault(key(line), set()).add(-1 if doc_id is None else doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        own = -1 if doc_id is None else doc_id
        kept = [x for x in lines if len(h := holders.get(key(x), ())) < least_docs or own == max(h)]
        out.append((str(doc_id), "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out)


def found(spark, rows, **settings):
    df = spark.createDataFrame([(d, t, "k", i, "p") for i, (d, t) in enumerate(rows)], SCHEMA)
    return sorted((str(r.doc_id), r.text, r.n_lines, r.n_dropped) for r in line_dedup.drop_shared_lines(df, **settings).collect())


def corpus(seed):
    rng = random.Random(seed)
    lines = [rng.choice("ABé　ßz") * rng.choice([38, 39, 40, 41, 60]) + str(i % 3) for i in range(30)] + ["", " ", "short"]
    rows = []
    for i in range(150):
        picked = [rng.choice(["", "\t", " \x0b", "\x0c\r"]) + rng.choice([x, x.lower(), x + " "]) for x in rng.choices(lines, k=rng.randrange(0, 12))]
        rows.append((rng.choice([i, i, i, i // 3, None]), "\n".join(picked)))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_plain(spark, seed):
    rows = corpus(seed) + [(None, None), (7, ""), (7, ""), (9, "\n\n"), (900, "x" * 300_000 + "\n" + "y" * 50)]
    assert found(spark, rows) == plain(rows)
    assert found(spark, rows, least_chars=2, least_docs=2) == plain(rows, 2, 2)
    assert any(d for *_, d in found(spark, rows))


def test_ties_and_repeats(spark):
    line = "A line that is at least forty code points long."
    same = [(3, line)] * 6
    assert found(spark, same) == plain(same) and not any(d for *_, d in found(spark, same))
    rows = [(i, f"{line}\n{line.upper()} \nown {i}") for i in range(5)] + [(4, line)] * 2 + [(None, line)] * 3
    got = found(spark, rows)
    assert got == plain(rows)
    assert [d for i, _, _, d in got if i == "4"] == [0, 0, 0]


def test_many_holders_of_one_line(spark):
    line = "This very line stands in every document of the table, whatever else."
    rows = [(i, f"{line}\n{i}") for i in range(3000)]
    assert found(spark, rows) == plain(rows)


def test_empty_table(spark):
    assert found(spark, []) == []


@pytest.mark.parametrize("size", [1 << 10, 1 << 20])
def test_filter_misses_no_repeat(spark, size, monkeypatch):
    monkeypatch.setattr(line_dedup, "SLICE_BITS", 1 << 8)
    rng = random.Random(4)
    pool = [f"{i:050d}" for i in range(2000)]
    texts = ["\n".join(rng.choices(pool, k=5)) for _ in range(400)]
    df = spark.createDataFrame([(i, t, "", 0, "") for i, t in enumerate(texts)], SCHEMA).repartition(7)
    twice = line_dedup.repeated_filter(df, size)
    held = {}
    for t in texts:
        for k in {k for _, k in line_dedup.keys_of(t)}:
            held[k] = held.get(k, 0) + 1
    repeated = {k for k, n in held.items() if n > 1}
    assert twice.holds(line_dedup._hashes(repeated)).all()
    single = line_dedup._hashes(set(held) - repeated)
    if size > 1 << 16:
        assert np.count_nonzero(twice.holds(single)) < 0.02 * len(single)
