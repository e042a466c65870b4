"""Toxic terms against a plain search, and texts without an id in the order of the fingerprints."""

import hashlib
import math
import random
import time

import xxhash

from flipline.llm import toxicity, winnow

DOCS = "doc_id long, text string"


def plain_matches(folded, terms, exceptions):
    def whole(phrase):
        at = folded.find(phrase)
        while at >= 0:
            end = at + len(phrase)
            if not (at and folded[at - 1].isalnum()) and not (end < len(folded) and folded[end].isalnum()):
                yield at, end
            at = folded.find(phrase, at + 1)

    spared = [s for p in exceptions for s in whole(p)]
    found = [(a, b, w) for t, w in terms.items() for a, b in whole(t)]
    return sorted(m for m in found if not any(a <= m[0] and m[1] <= b for a, b in spared))


def test_matches_and_scores_against_plain(spark):
    rng = random.Random(6)
    terms = {"bad": 2.0, "awful": 1.5, "vile": 0.7, "rot": 1.1}
    model = toxicity.Model(terms, ["bad luck", "not awful", "so bad", "dry rot"], (-2.0, 1.3, 0.9))
    words = ["bad", "B4D", "luck", "not", "awful", "so", "vile", "rotten", "rot", "dry", "ｒｏｔ", "bаd", "b@d", "xbad", "...", "v1le!"]
    texts = [None, "", "bad", "so bad luck"] + [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 25))) for _ in range(300)]
    automaton = model.automaton()
    rows = toxicity.score(spark.createDataFrame(list(enumerate(texts)), DOCS), model).collect()
    scores = {r.doc_id: r for r in rows}
    for i, text in enumerate(texts):
        folded = toxicity.fold(text)
        want = plain_matches(folded, terms, model.exceptions)
        assert sorted(model.matches(automaton, folded)) == want, text
        weight = sum(w for *_, w in want)
        value = -2.0 + 1.3 * math.log1p(weight) + 0.9 * math.log1p(100 * weight / (100 + len(folded)))
        assert abs(scores[i].score - 1 / (1 + math.exp(-value))) < 1e-12 and scores[i].predicted == (scores[i].score >= 0.5)
        assert sorted(scores[i].terms) == sorted(folded[a:b] for a, b, _ in want)
    assert any(r.terms for r in rows) and toxicity.score(spark.createDataFrame([], DOCS), model).collect() == []


def test_many_exceptions_take_time_in_proportion():
    model = toxicity.Model({"bad": 1.0}, ["bad luck"])
    automaton = model.automaton()

    def taken(times):
        start = time.perf_counter()
        found = model.matches(automaton, "bad luck or bad " * times)
        assert len(found) == times
        return time.perf_counter() - start

    taken(100)
    assert taken(80_000) < 12 * taken(20_000) + 0.5


def test_texts_without_an_id_follow_all_others(spark):
    named = [(5, "five text here to see"), (900, "nine hundred text"), (-4, "below zero text"), (70, None)]
    nameless = [(None, "first lost text of them"), (None, "second lost text"), (None, None), (None, "second lost text")]
    hashed = lambda t: xxhash.xxh64_intdigest((t or "").encode(), 42) >> 4
    order = sorted(named, key=lambda d: -d[0]) + sorted(nameless, key=lambda d: -hashed(d[1]))
    # Texts of one span of hashes, equal ones here, follow each other in order of their text.
    want = []
    for (doc_id, text), (_, other) in zip(order, order[1:] + order[:1], strict=True):
        text, other = text or "", other or ""
        half = len(text) // 2
        want.append((str(doc_id), len(text), hashlib.sha256((text[: len(text) - half] + other[:half]).encode()).hexdigest()))
    out = winnow.compare_edited(spark.createDataFrame(named + nameless, DOCS)).collect()
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in out) == sorted(want)
    only = winnow.compare_edited(spark.createDataFrame(nameless[:2], DOCS)).collect()
    assert len(only) == 2 and all(r.doc_id is None for r in only)
