"""Repeated passages against a count of all runs of words."""

import random
from collections import Counter

import pytest

from flipline.llm import sparse_suffix
from flipline.llm.sparse_suffix import word_places, words_of


def plain(rows, passage):
    texts = Counter((d, t) for d, t, *_ in rows if t)
    seen = Counter()
    for _, t in texts.elements():
        w = words_of(t)
        seen.update(tuple(w[i : i + passage]) for i in range(len(w) - passage + 1))
    out = []
    for d, t in texts:
        w, places = words_of(t), word_places(t)
        starts = [i for i in range(len(w) - passage + 1) if seen[tuple(w[i : i + passage])] > 1]
        spans = []
        for i in starts:
            if spans and i <= spans[-1][1]:
                spans[-1][1] = i + passage
            else:
                spans.append([i, i + passage])
        out += [(d, int(places[a][0]), int(places[b - 1][1]), b - a) for a, b in spans]
    return sorted(out, key=str)


def rows_of(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["é", "b", "cc", "ddd", "x", "y", "zz", "q"]) + str(rng.randrange(40))
    stock = [[word() for _ in range(rng.randrange(8, 40))] for _ in range(6)]
    rows = [(1, None, "a", 1), (2, "", "b", 2), (None, "w " * 300, "c", 3), (3, "w " * 9, None, 4), (4, "v " * 200, "", None)]
    for i in range(60):
        words = []
        for _ in range(rng.randrange(4)):
            words += [word() for _ in range(rng.randrange(30))]
            part = list(rng.choice(stock))
            if rng.random() < 0.3:
                part[rng.randrange(len(part))] = "changed"
            words += part
        rows.append((10 + i, " ".join(words), "s", i))
    return rows + [rows[10], rows[10], (500, rows[12][1], "s", 0), (None, rows[13][1], "s", 0)]


@pytest.mark.parametrize("passage,gap,gram", [(10, 4, 2), (12, 7, 3), (10, 1, 5)])
def test_spans(spark, passage, gap, gram):
    for seed in range(2):
        rows = rows_of(seed)
        out = sparse_suffix.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string, run string, pos int"), passage, gap, gram)
        assert sorted(((r.doc_id, r.start, r.end, r.n_words) for r in out.collect()), key=str) == plain(rows, passage)


def test_empty_table(spark):
    assert sparse_suffix.repeated_passages(spark.createDataFrame([], "doc_id long, text string")).collect() == []
