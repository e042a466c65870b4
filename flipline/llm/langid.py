"""Language identification with spans: scripts narrow the languages, Viterbi labels words with a switching penalty.

A model holds smoothed log probabilities of hashed letter trigrams per language, from a bounded sample of labelled
texts, and which languages are written in which script. Each word of a text (a run of letters) gets a score per
language, the sum over its trigrams; languages not seen in the word's script are out, unless no language was. The best
sequence of languages maximises word scores less a penalty per switch. The document's language is the one with most
letters, ties going to the first in order of name; its share of letters is the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flipline.llm.pieces import slices

#: Labelled texts from which a language is learnt at most, chosen by the hash of their id; a bound on training alone.
TRAIN_TEXTS = 4000
#: Bits of the hash that are left out of a range, which makes 4,096 ranges.
RANGE_SHIFT = 52
BUCKETS = 1 << 15
SWITCH = 8.0
#: A script counts as used by a language that has at least this share of its training letters in it.
SCRIPT_SHARE = 0.001
UNKNOWN = "und"
#: keep_identified can ask that at most this share of the letters is in scripts of no learnt language, and that the trigrams are
#: on average at least as likely in the languages found as if all buckets were equally likely.
MOST_FOREIGN = 0.5
LEAST_FIT = -float(np.log(BUCKETS))
#: Characters handled at a time.
BLOCK = 1_000_000
LIMIT = 0x32400
#: First code points of blocks of one script, in order, with the script's name.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, "syriac"), (0x0750, "arabic"), (0x0780, "other"), (0x08A0, "arabic"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"),
    (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"),
    (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "mongolian"),
    (0x18B0, "other"), (0x1C80, "cyrillic"), (0x1C90, "georgian"), (0x1CC0, "other"), (0x1E00, "latin"),
    (0x1F00, "greek"), (0x2000, "other"), (0x2100, "latin"), (0x2C00, "other"), (0x2C60, "latin"), (0x2C80, "other"),
    (0x2D00, "georgian"), (0x2D30, "other"), (0x2DE0, "cyrillic"), (0x2E00, "other"), (0x3040, "kana"),
    (0x3100, "other"), (0x3130, "hangul"), (0x3190, "other"), (0x31F0, "kana"), (0x3200, "other"), (0x3400, "han"),
    (0xA000, "other"), (0xA640, "cyrillic"), (0xA6A0, "other"), (0xA720, "latin"), (0xA800, "other"),
    (0xA960, "hangul"), (0xA980, "other"), (0xAB30, "latin"), (0xAB70, "other"), (0xAC00, "hangul"), (0xD800, "other"),
    (0xF900, "han"), (0xFB00, "latin"), (0xFB10, "other"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFF21, "latin"),
    (0xFF66, "kana"), (0x10000, "other"), (0x20000, "han"),
]
NAMES = sorted({name for _, name in SCRIPTS})


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Per code point its lower-case form, 0 where it is no letter, and the number of its script."""
    letters = np.zeros(LIMIT, np.uint32)
    for i in range(LIMIT):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            letters[i] = ord(low) if len(low) == 1 else i
    starts = [s for s, _ in SCRIPTS]
    number = np.array([NAMES.index(n) for _, n in SCRIPTS], np.uint8)
    return letters, number[np.searchsorted(starts, np.arange(LIMIT), "right") - 1]


def _letters(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters (0 elsewhere) and scripts of a text, by code point."""
    points = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), LIMIT - 1)
    letters, scripts = _tables()
    return letters[points], scripts[points]


def _trigrams(letters: np.ndarray) -> np.ndarray:
    """Bucket of the trigram around each character; what is no letter counts as a border."""
    padded = np.concatenate([[0], letters, [0]]).astype(np.uint32)
    h = padded[:-2] * np.uint32(0x9E3779B1) ^ padded[1:-1] * np.uint32(0x85EBCA77) ^ padded[2:] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    return (h * np.uint32(0x27D4EB2F)) >> np.uint32(17)


@dataclass
class Model:
    """Languages in order of name, log probabilities (buckets x languages), and allowed languages per script."""

    languages: list[str]
    weights: np.ndarray
    allowed: np.ndarray

    def word_scores(self, letters: np.ndarray, scripts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, lengths and scores per language of the words in a run of text."""
        inside = letters > 0
        edges = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
        starts, ends = edges[::2], edges[1::2]
        if not len(starts):
            return starts, ends, np.zeros((0, len(self.languages)), np.float32)
        at = np.flatnonzero(inside)
        rows = self.weights[_trigrams(letters)[at]]
        first = np.concatenate([[0], np.cumsum(ends - starts)[:-1]])
        scores = np.add.reduceat(rows, first, axis=0)
        fits = self.allowed[scripts[starts]]
        fits = fits | ~fits.any(axis=1, keepdims=True)
        return starts, ends - starts, np.where(fits, scores, scores - np.float32(1e6))


def _viterbi(scores: np.ndarray, counts: np.ndarray, switch: float) -> np.ndarray:
    """The language of every word; texts are walked side by side, the longest first."""
    order = np.argsort(-counts, kind="stable")
    sizes = counts[order]
    first = (np.cumsum(counts) - counts)[order]
    labels = np.zeros(len(scores), np.int16)
    came = np.zeros(scores.shape, bool)
    tops = np.zeros(len(scores), np.int16)
    best = np.zeros((len(order), scores.shape[1]), np.float32)
    active = len(order)
    longest = int(sizes[0]) if len(sizes) else 0
    for t in range(longest):
        while active and sizes[active - 1] <= t:
            active -= 1
        now = best[:active]
        at = first[:active] + t
        if t:
            top = now.argmax(axis=1)
            jump = now[np.arange(active), top][:, None] - np.float32(switch)
            came[at] = jump > now
            tops[at] = top
            np.maximum(now, jump, out=now)
            now -= now.max(axis=1, keepdims=True)
        now += scores[at]
    state = best.argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        while active < len(order) and sizes[active] > t:
            active += 1
        at = first[:active] + t
        own = state[:active]
        labels[at] = own
        if t:
            state[:active] = np.where(came[at, own], tops[at], own)
    return labels


def label_texts(model: Model, texts: list[str | None], switch: float = SWITCH) -> list[dict]:
    """Language, share of letters and spans (start, end, language by code points) of each text.

    ``foreign`` is the share of letters in scripts of no learnt language, ``fit`` the mean log probability of the trigrams
    in the languages found.
    """
    texts = [t or "" for t in texts]
    starts, sizes, scores = [], [], []
    counts, foreign = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    unlearnt = ~model.allowed.any(axis=1)
    at = 0
    while at < len(texts):
        end, held = at, 0
        while end < len(texts) and (end == at or held + len(texts[end]) <= BLOCK):
            held += len(texts[end]) + 1
            end += 1
        letters, scripts = _letters("\n".join(texts[at:end]))
        s, n, w = model.word_scores(letters, scripts)
        begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts[at:end]])])
        owner = np.searchsorted(begins, s, "right") - 1
        strange = np.concatenate([[0], np.cumsum((letters > 0) & unlearnt[scripts]), [0]])
        strange[-1] = strange[-2]  # the last text ends without a line feed
        foreign[at:end] = np.diff(strange[begins])
        counts[at:end] = np.bincount(owner, minlength=end - at)[: end - at]
        starts.append(s - begins[owner])
        sizes.append(n)
        scores.append(w)
        at = end
    if not texts:
        return []
    start, size = np.concatenate(starts), np.concatenate(sizes)
    score = np.concatenate(scores)
    labels = _viterbi(score, counts, switch)
    chosen = score[np.arange(len(score)), labels]
    out, at = [], 0
    for n, strange in zip(counts.tolist(), foreign.tolist(), strict=True):
        own, lengths, begin, likely = labels[at : at + n], size[at : at + n], start[at : at + n], chosen[at : at + n]
        at += n
        if not n:
            out.append({"lang_pred": UNKNOWN, "score": 0.0, "spans": [], "foreign": 0.0, "fit": 0.0})
            continue
        share = np.bincount(own, lengths, len(model.languages)) / lengths.sum()
        top = int(share.argmax())
        cuts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        lasts = np.concatenate([cuts[1:], [n]]) - 1
        spans = zip(begin[cuts].tolist(), (begin[lasts] + lengths[lasts]).tolist(), own[cuts].tolist(), strict=True)
        spans = [(a, b, model.languages[k]) for a, b, k in spans]
        letters = int(lengths.sum())
        fit = float(likely.sum(dtype=np.float64)) / letters
        out.append({"lang_pred": model.languages[top], "score": float(share[top]), "spans": spans, "foreign": strange / letters, "fit": fit})
    return out


def _lowest(rows: DataFrame, per_language: int) -> DataFrame:
    """The doc_id values that hash lowest in each language.

    Rows are first counted by range of the hash, and only those in ranges that the sample reaches are ranked. So a language
    with most of the rows brings little more than ``per_language`` of them into one task.
    """
    ranged = rows.where("doc_id is not null").withColumn("h", F.xxhash64("doc_id")).withColumn("range", F.shiftright("h", RANGE_SHIFT))
    below = F.sum("n").over(Window.partitionBy("lang").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    sizes = ranged.groupBy("lang", "range").agg(F.count("*").alias("n")).withColumn("below", F.coalesce(below, F.lit(0)))
    reached = sizes.where(F.col("below") < per_language).select("lang", "range")  # at most per_language a language
    order = Window.partitionBy("lang").orderBy("h", "doc_id")
    ranked = ranged.join(F.broadcast(reached), ["lang", "range"]).withColumn("k", F.row_number().over(order))
    return ranked.where(F.col("k") <= per_language).select("doc_id").distinct()


def fit(labelled: DataFrame, per_language: int = TRAIN_TEXTS) -> Model:
    """Learn from rows (doc_id, text, lang); rows without lang are left out.

    A language learns from at most ``per_language`` texts, those whose ids hash lowest. What is gathered on the driver is
    bounded by buckets times languages; the set of languages is taken to be small. No rows give a model that calls
    every text ``und``.
    """
    few = _lowest(labelled.where("lang is not null").select(F.col("doc_id").cast("long"), "lang"), per_language)
    sample = labelled.where("lang is not null").select(F.col("doc_id").cast("long"), "text", "lang")
    sample = sample.join(F.broadcast(few), "doc_id")  # at most per_language ids per language

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lang, group in frame.groupby("lang"):
                grams, scripts = np.zeros(BUCKETS, np.int64), np.zeros(len(NAMES), np.int64)
                for text in group["text"].dropna():
                    letters, script = _letters(text)
                    inside = letters > 0
                    grams += np.bincount(_trigrams(letters)[inside], minlength=BUCKETS)
                    scripts += np.bincount(script[inside], minlength=len(NAMES))
                for kind, counts in ((0, grams), (1, scripts)):
                    at = np.flatnonzero(counts)
                    langs = np.full(len(at), lang, object)
                    yield pd.DataFrame({"lang": pd.Series(langs, dtype=object), "kind": kind, "at": at, "n": counts[at]})

    counted = sample.mapInPandas(count, "lang string, kind int, at int, n long").groupBy("lang", "kind", "at")
    found = counted.agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(found["lang"].unique())
    grams, scripts = np.zeros((BUCKETS, len(languages))), np.zeros((len(NAMES), len(languages)))
    column = found["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(int)
    for kind, table in ((0, grams), (1, scripts)):
        own = (found["kind"] == kind).to_numpy()
        table[found["at"].to_numpy()[own], column[own]] = found["n"].to_numpy()[own]
    weights = np.log((grams + 0.5) / (grams.sum(axis=0) + 0.5 * BUCKETS)).astype(np.float32)
    return Model(languages, weights, scripts >= np.maximum(1, SCRIPT_SHARE * scripts.sum(axis=0)))


SCHEMA = "doc_id long, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>"


def detect(docs: DataFrame, model: Model, switch: float = SWITCH, spans: bool = True) -> DataFrame:
    """doc_id, lang_pred, score and spans of every row of ``docs``.

    A null or empty text, or one without letters, is ``und`` with score 0 and no spans. A null doc_id stays null,
    repeated rows stay, an empty table gives no rows, other columns are ignored. ``spans`` False leaves the spans out.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = part["text"].to_pylist()
                if sent.value.languages:
                    rows = label_texts(sent.value, texts, switch)
                else:
                    rows = [{"lang_pred": UNKNOWN, "score": 0.0, "spans": []} for _ in texts]
                columns = {"doc_id": part["doc_id"]} | {c: pa.array([r[c] for r in rows]) for c in ("lang_pred", "score")}
                if spans:
                    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
                    columns["spans"] = pa.array([[dict(zip(("start", "end", "lang"), s, strict=True)) for s in r["spans"]] for r in rows], kind)
                yield pa.RecordBatch.from_pydict(columns)

    schema = SCHEMA if spans else SCHEMA[: SCHEMA.index(", spans")]
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def keep_identified(docs: DataFrame, model: Model, least: float, switch: float = SWITCH, strict: bool = False) -> DataFrame:
    """Rows of ``docs`` whose language is known with a score of at least ``least``; a null ``lang`` is filled in.

    Null and empty texts and texts without letters go. With ``strict`` also those with more than MOST_FOREIGN of their letters in
    scripts of no learnt language, and those that fit the languages found less than LEAST_FIT. All columns stay as they are otherwise.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema, names = docs.schema, docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = label_texts(sent.value, part["text"].to_pylist(), switch)
                if "lang" in names and part["lang"].null_count:
                    filled = [r["lang_pred"] if x is None else x for x, r in zip(part["lang"].to_pylist(), rows, strict=True)]
                    part = part.set_column(names.index("lang"), "lang", pa.array(filled, part["lang"].type))
                known = [r["lang_pred"] != UNKNOWN and r["score"] >= least for r in rows]
                if strict:
                    known = [k and r["foreign"] <= MOST_FOREIGN and r["fit"] >= LEAST_FIT for k, r in zip(known, rows, strict=True)]
                yield part.filter(pa.array(known, pa.bool_()))

    return docs.mapInArrow(run, schema) if model.languages else docs.limit(0)
