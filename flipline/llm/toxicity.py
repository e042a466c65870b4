"""Toxicity by a weighted lexicon, matched by Aho-Corasick after folding.

Folding undoes disguises: compatibility forms, accents, letters of other scripts that look Latin, and digits or signs that
stand for letters. Terms are matched as whole words of the folded text; a term inside an exception phrase does not count.
The score is logistic in the matched weight, plain and per length.

The lexicon, its weights, the exception phrases and the logistic coefficients come from labelled texts, a bounded sample of
them; text and label are all that is used.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flipline.llm.pieces import slices

#: Labelled texts per class from which lexicon and coefficients are learnt at most, chosen by the hash of their id.
TRAIN_TEXTS = 10_000
#: Terms and exception phrases kept at most, the best first.
TERMS = 2000
#: A term is in at least this many toxic training texts and this share of them, and most texts with it are toxic.
LEAST_TEXTS = 5
LEAST_SHARE = 0.005
LEAST_TOXIC = 0.6
#: An exception phrase is in at least this many clean texts and in no more toxic ones than this share.
LEAST_CLEAN = 5
MOST_TOXIC = 0.1
#: Look-alikes of Latin letters, digits and signs that stand for letters.
LOOK_ALIKES = {
    "а": "a", "в": "b", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p",
    "с": "c", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ɡ": "g", "һ": "h", "ӏ": "l", "ո": "n", "ս": "u", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "u", "ν": "v", "ο": "o", "ρ": "p", "τ": "t",
    "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o", "đ": "d",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i"}
SIGN_IN_WORD = re.compile(r"(?<=[^\W_])[@$!|]+(?=[^\W_])")
WORD = re.compile(r"[^\W_]+")


@lru_cache(maxsize=1)
def _table() -> dict[int, str]:
    table = {}
    for i in range(0x80, 0x2400):
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(i)) if not unicodedata.combining(c)).lower()
        plain = "".join(LOOK_ALIKES.get(c, c) for c in plain)
        if plain != chr(i):
            table[i] = plain
    for i in range(0xFF01, 0xFF5F):
        c = chr(i - 0xFEE0).lower()
        table[i] = DIGITS.get(c, c)
    for c in ("​", "‌", "‍", "⁠", "﻿", "­"):
        table[ord(c)] = ""
    table |= {ord(a): b for a, b in DIGITS.items()}
    table |= {ord(a): a.lower() for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    return table


def fold(text: str | None) -> str:
    """The text as it reads once disguises are undone; empty for a null text."""
    text = text or ""
    if any(c in text for c in SIGNS):
        text = SIGN_IN_WORD.sub(lambda m: "".join(SIGNS[c] for c in m.group()), text)
    return text.translate(_table())


@dataclass
class Model:
    """Folded terms with weights, folded exception phrases, and logistic coefficients (constant, plain, per length)."""

    terms: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    coefficients: tuple[float, float, float] = (-3.0, 0.0, 0.0)

    def automaton(self):
        automaton = ahocorasick.Automaton()
        for phrase in self.exceptions:
            automaton.add_word(phrase, (len(phrase), None))
        for term, weight in self.terms.items():
            automaton.add_word(term, (len(term), weight))
        automaton.make_automaton()
        return automaton

    def matches(self, automaton, folded: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of terms that stand as whole words outside exception phrases."""
        if not self.terms:
            return []
        found, excepted = [], []
        for last, (size, weight) in automaton.iter(folded):
            start, end = last - size + 1, last + 1
            if (start and folded[start - 1].isalnum()) or (end < len(folded) and folded[end].isalnum()):
                continue
            if weight is None:
                excepted.append((start, end))
            else:
                found.append((start, end, weight))
        if not excepted:
            return found
        excepted.sort()
        starts, furthest = [a for a, _ in excepted], list(accumulate((b for _, b in excepted), max))
        inside = lambda a, b: (i := bisect_right(starts, a)) and furthest[i - 1] >= b
        return [m for m in found if not inside(m[0], m[1])]

    def features(self, automaton, text: str | None) -> tuple[float, float]:
        """Matched weight, damped, and matched weight per 100 characters, damped."""
        folded = fold(text)
        weight = sum(w for *_, w in self.matches(automaton, folded))
        return float(np.log1p(weight)), float(np.log1p(100 * weight / (100 + len(folded))))

    def score(self, features: np.ndarray) -> np.ndarray:
        constant, plain, dense = self.coefficients
        return 1 / (1 + np.exp(-(constant + features[:, 0] * plain + features[:, 1] * dense)))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Coefficients of least penalised loss, no feature counting against toxicity; by Newton steps."""
    z = np.column_stack([np.ones(len(x)), x])
    used = [0, 1, 2]
    while True:
        b = np.zeros(len(used))
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z[:, used] @ b, -30, 30)))
            hessian = (z[:, used] * (p * (1 - p))[:, None]).T @ z[:, used] + 0.1 * np.eye(len(used))
            b -= np.linalg.solve(hessian, z[:, used].T @ (p - y) + 0.1 * b)
        negative = [k for k, v in zip(used, b, strict=True) if k and v < 0]
        if not negative:
            out = np.zeros(3)
            out[used] = b
            return tuple(out.tolist())
        used.remove(negative[0])


def _sample(docs: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """(text, toxic) of the labelled documents that are learnt from, each different text of a class once."""
    known = labels.where(F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    parts = [known.where(F.col("toxic") == k).orderBy(*order).limit(per_class) for k in (0, 1)]
    few = F.broadcast(parts[0].union(parts[1]))  # at most per_class ids of each class
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(few, "doc_id")
    return texts.withColumn("h", F.xxhash64("text")).dropDuplicates(["h", "toxic"]).select("text", "toxic")


def _rates(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_TEXTS) -> Model:
    """Learn from ``docs`` (doc_id, text) joined with ``labels`` (doc_id, toxic 0 or 1).

    Other labels are left out. At most ``per_class`` texts of a class are used. Without labels of both classes the
    lexicon is empty and every score the same.
    """
    sample = _sample(docs, labels, per_class)

    def words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for text, toxic in zip(frame["text"], frame["toxic"], strict=True):
                rows += [(w, int(toxic)) for w in sorted(set(WORD.findall(fold(text)))) if 2 < len(w) <= 40]
            yield pd.DataFrame(rows, columns=["term", "toxic"], dtype=object)

    sizes = dict(sample.groupBy("toxic").count().collect())
    if not sizes.get(0) or not sizes.get(1):
        return Model()
    least = max(LEAST_TEXTS if sizes[1] >= 50 else 2, LEAST_SHARE * sizes[1])
    tilt = sizes[0] / sizes[1]
    toxic_share = F.col("t") / (F.col("t") + F.col("c"))
    counted = _rates(sample.mapInPandas(words, "term string, toxic int"), "term")
    odds = F.log((F.col("t") + 0.5) / (F.col("c") + 0.5) * tilt)
    chosen = counted.where((F.col("t") >= least) & (toxic_share >= LEAST_TOXIC)).select("term", odds.alias("w"), "t")
    terms = {r.term: float(r.w) for r in chosen.orderBy(F.desc("t"), "term").limit(TERMS).collect()}
    model = Model(terms)

    def phrases(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = model.automaton()
        for frame in frames:
            rows = []
            for text, toxic in zip(frame["text"], frame["toxic"], strict=True):
                folded, found = fold(text), set()
                for a, b, _ in model.matches(automaton, folded):
                    before, after = WORD.findall(folded[max(0, a - 40) : a]), WORD.findall(folded[b : b + 40])
                    if before and folded[:a].endswith(before[-1] + " "):
                        found.add(f"{before[-1]} {folded[a:b]}")
                    if after and folded[b:].startswith(" " + after[0]):
                        found.add(f"{folded[a:b]} {after[0]}")
                rows += [(p, int(toxic)) for p in sorted(found)]
            yield pd.DataFrame(rows, columns=["phrase", "toxic"], dtype=object)

    if terms:
        rates = _rates(sample.mapInPandas(phrases, "phrase string, toxic int"), "phrase")
        spared = rates.where((F.col("c") >= LEAST_CLEAN) & (toxic_share <= MOST_TOXIC))
        model.exceptions = [r.phrase for r in spared.orderBy(F.desc("c"), "phrase").limit(TERMS).collect()]

    def features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = model.automaton()
        for frame in frames:
            x = np.array([model.features(automaton, t) for t in frame["text"]]).reshape(-1, 2)
            yield pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "toxic": frame["toxic"].to_numpy()})

    seen = sample.mapInPandas(features, "a double, b double, toxic int")
    cells = seen.groupBy(F.round("a", 3).alias("a"), F.round("b", 3).alias("b"), "toxic").count().toPandas()
    x = np.repeat(cells[["a", "b"]].to_numpy(), cells["count"], axis=0)
    y = np.repeat(cells["toxic"].to_numpy(), cells["count"])
    order = np.lexsort((y, x[:, 1], x[:, 0]))  # at most two classes of sampled rows
    model.coefficients = _logistic(x[order], y[order])
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted and the matched folded terms of every row of ``docs``.

    A null or empty text has no matches and the score of such texts. Repeated rows and null ids stay; an empty table
    gives no rows; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = sent.value.automaton()
        for batch in batches:
            for part in slices(batch):
                x, terms = [], []
                for text in part["text"].to_pylist():
                    folded = fold(text)
                    hits = sent.value.matches(automaton, folded)
                    weight = sum(w for *_, w in hits)
                    x.append((np.log1p(weight), np.log1p(100 * weight / (100 + len(folded)))))
                    terms.append([folded[a:b] for a, b, _ in hits])
                p = sent.value.score(np.array(x, float).reshape(-1, 2))
                predicted = pa.array((p >= 0.5).astype("i4"))
                columns = {"doc_id": part["doc_id"], "score": p, "predicted": predicted, "terms": pa.array(terms, pa.list_(pa.string()))}
                yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, score double, predicted int, terms array<string>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
