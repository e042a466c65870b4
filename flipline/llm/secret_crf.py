"""Secret scans: fixed patterns, and a linear-chain conditional random field that finds what the patterns miss.

A text is cut into tokens. A token of at least 8 characters of keys, among them a digit, a sign inside, a capital after another
letter or 8 capitals in a row, may be tagged begin or inside; plain words and shorter tokens are outside. So the decoding of a text splits into stretches around such
tokens, outside of which every tag is known, and each stretch is decoded by Viterbi. Features of a token are its own shape, the
words and shapes beside it, and traits of the whole text ("file").

The field is trained on stretches of a bounded sample of texts, tagged by the patterns; the words that made a pattern match are
sometimes hidden from it, so that it also learns from shape and the other words.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flipline.llm.common import cut
from flipline.llm.pieces import slices

#: Texts from which the field is trained at most, chosen by the hash of their id, half of them with a pattern's match.
TRAIN_TEXTS = 2000
#: Different stretches of these that are learnt at most.
SEQUENCES = 1200
FEATURES = 1 << 12
ROUNDS = 120
#: Tokens on either side of one that could hold a secret.
REACH = 4
#: A span of the field is reported only if its tokens are at least this likely to be inside, on average.
CONFIDENCE = 0.8
#: The kinds of base spans in order, and their patterns.
KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]{8,}|[^\W_]+|[^\w\s]", re.ASCII)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{8,}", re.ASCII)
SIGNS = "+/_.=-"
LEAST = 8
CAPITALS = re.compile(r"[a-z].*[A-Z]|[A-Z]{8}", re.ASCII)
HEX_DIGITS = re.compile("[0-9a-fA-F]+")
#: Tokens and features of which a task remembers what they say.
MEMO = 100_000
RUNS = [(re.compile(p), c) for p, c in ((r"[A-Z]+", "A"), (r"[a-z]+", "a"), (r"[0-9]+", "0"))]
OUTSIDE, BEGIN, INSIDE = range(3)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the patterns, leftmost and non-overlapping per kind, that are long enough: (kind, start, end)."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return found + [("hex", *m.span()) for m in HEX.finditer(text)]


def _parts(text: str) -> list[list[tuple[int, int]]]:
    """Per kind where the secrets of base matches lie: the value of an assignment, else the whole match."""
    assign = [m.span(2) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    access = [m.span() for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return [assign, access, [m.span() for m in HEX.finditer(text)]]


def secret_parts(text: str) -> list[tuple[int, int]]:
    """Where the secrets of base matches lie, kind by kind."""
    return [span for spans in _parts(text) for span in spans]


class Overlaps:
    """Lists of spans that do not overlap within a list; finds those that meet a span by bisection."""

    def __init__(self, *lists: list[tuple[int, int]]) -> None:
        self.lists = [(sorted(spans), [e for _, e in sorted(spans)]) for spans in lists]

    def first(self, a: int, b: int) -> tuple[int, int] | None:
        """The first span that meets (a, b), in the order of the lists."""
        for spans, ends in self.lists:
            i = bisect_right(ends, a)
            if i < len(spans) and spans[i][0] < b:
                return spans[i]
        return None


def printed(spans: list[tuple[str, int, int]]) -> str:
    """kind:start:end by start, then kind in the order of KINDS, then end, joined by commas."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


@lru_cache(maxsize=MEMO)
def may_be_secret(token: str) -> bool:
    """At least 8 key characters without the signs at both ends, and no plain word, capitalised or not."""
    if len(token) < LEAST or not CANDIDATE.fullmatch(token):
        return False
    core = token.strip(SIGNS)
    return len(core) >= LEAST and (not core.isalpha() or CAPITALS.search(core) is not None)


@lru_cache(maxsize=MEMO)
def shape(token: str) -> str:
    """Runs of upper, lower and digits as one letter each, with the length class."""
    out = token[:64]
    for run, c in RUNS:
        out = run.sub(c, out)
    return f"{out[:8]}|{min(len(token).bit_length(), 8)}"


def file_features(text: str) -> list[str]:
    """Traits of a whole text."""
    lines = text.count("\n") + 1
    return [
        f"file-lines={min(lines.bit_length(), 8)}",
        f"file-code={int(text.count('{') + text.count(';') > lines)}",
        f"file-assigns={int(text.count('=') > lines)}",
        f"file-size={min(len(text).bit_length() // 3, 6)}",
    ]


@lru_cache(maxsize=MEMO)
def _bucket(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % FEATURES


def stretches(text: str) -> list[tuple[list[tuple[int, int]], list[bool]]]:
    """Runs of tokens (start, end) around those that could be secret, which are marked; none if there are none.

    Each run is cut from the line of text around its candidates, so a text of any length is never held as tokens.
    """
    marked = [m.span() for m in CANDIDATE.finditer(text) if may_be_secret(m.group())]
    out: list[tuple[list[tuple[int, int]], list[bool]]] = []
    until, at = -1, 0
    while at < len(marked):
        a, b = marked[at]
        at += 1
        if a < until:
            continue
        low, high = max(0, a - 80, until), b + 80
        while at < len(marked) and marked[at][0] <= high:
            high = marked[at][1] + 80
            at += 1
        found = [m.span() for m in TOKEN.finditer(text, low, min(len(text), high))]
        able = [e - s >= LEAST and may_be_secret(text[s:e]) for s, e in found]
        near = np.convolve(able, np.ones(2 * REACH + 1, int))[REACH : REACH + len(able)] > 0
        out.append(([t for t, n in zip(found, near, strict=True) if n], [x for x, n in zip(able, near, strict=True) if n]))
        until = high
    return [s for s in out if any(s[1])]


@lru_cache(maxsize=MEMO)
def _own(word: str) -> tuple[int, ...]:
    """Buckets of what a token says of itself."""
    own = [f"shape={shape(word)}", f"kinds={len(set(word[:64])) // 4}", f"ends={word[-1].isalnum()}", "bias"]
    own += [f"hex={int(bool(HEX_DIGITS.fullmatch(word)))}", f"upper={int(word.isupper())}"]
    return tuple(_bucket(f) for f in own)


@lru_cache(maxsize=MEMO)
def _beside(word: str, k: int) -> tuple[int, int]:
    """Buckets of what a token says of the one ``k`` before it: its shape and its word."""
    return _bucket(f"shape{k}={shape(word)}"), _bucket(f"word{k}={word[:24].lower()}")


def features(text: str, tokens: list[tuple[int, int]], traits: list[str], hide: bool = False) -> list[list[int]]:
    """Buckets of the features of each token of a stretch. ``hide`` leaves the neighbouring words out."""
    words = [text[a:b] for a, b in tokens]
    whole = [_bucket(t) for t in traits]
    out = []
    for i, w in enumerate(words):
        own = [*_own(w), *whole]
        for k in (-3, -2, -1, 1, 2):
            if 0 <= i + k < len(words):
                own += _beside(words[i + k], k)[: 1 if hide else 2]
            else:
                own.append(_bucket(f"none{k}"))
        out.append(own)
    return out


@dataclass
class Model:
    """Weights per feature bucket and tag, and per pair of tags in turn; a sequence starts as if after outside."""

    emit: np.ndarray
    turn: np.ndarray

    def scores(self, rows: list[list[int]], able: list[bool]) -> np.ndarray:
        starts = np.cumsum([0, *map(len, rows)])[:-1]
        out = np.add.reduceat(self.emit[np.fromiter(chain.from_iterable(rows), np.int64)], starts, axis=0)
        out[~np.array(able), 1:] = -1e6
        return out

    def viterbi(self, scores: np.ndarray) -> list[int]:
        best, back = scores[0] + self.turn[OUTSIDE], []
        for s in scores[1:]:
            options = best[:, None] + self.turn
            back.append(options.argmax(axis=0))
            best = options.max(axis=0) + s
        tags = [int(best.argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return tags[::-1]

    def marginals(self, scores: np.ndarray) -> np.ndarray:
        """Probability of each tag of each token, by forward and backward sums."""
        ahead, behind = [scores[0] + self.turn[OUTSIDE]], [np.zeros(3)]
        for s in scores[1:]:
            ahead.append(np.logaddexp.reduce(ahead[-1][:, None] + self.turn, axis=0) + s)
        for s in scores[:0:-1]:
            behind.append(np.logaddexp.reduce(self.turn + s + behind[-1], axis=1))
        both = np.array(ahead) + np.array(behind[::-1])
        return np.exp(both - np.logaddexp.reduce(both, axis=1)[:, None])


def _initial() -> Model:
    turn = np.zeros((3, 3))
    turn[OUTSIDE, INSIDE] = -1e6
    return Model(np.zeros((FEATURES, 3)), turn)


def train(sequences: list[tuple[list[list[int]], list[bool], list[int]]], rounds: int = ROUNDS) -> Model:
    """Penalised likelihood by Adam steps over all sequences (features, able, tags) at once."""
    model = _initial()
    if not sequences:
        model.emit[:, OUTSIDE] = 1.0
        return model
    n, longest = len(sequences), max(len(s[2]) for s in sequences)
    width = max(len(r) for s in sequences for r in s[0])
    mask, able, tags = np.zeros((n, longest), bool), np.zeros((n, longest), bool), np.zeros((n, longest), int)
    rows = np.full((sum(len(s[2]) for s in sequences), width), FEATURES)  # one per token, in the order of ``mask``
    at = 0
    for i, (feats, ok, tag) in enumerate(sequences):
        for r in feats:
            rows[at, : len(r)] = r
            at += 1
        mask[i, : len(tag)], able[i, : len(tag)], tags[i, : len(tag)] = True, ok, tag
    before = np.concatenate([np.zeros((n, 1), int), tags[:, :-1]], axis=1)
    gold_turn = np.zeros((3, 3))
    np.add.at(gold_turn, (before[mask], tags[mask]), 1)
    moments = [[np.zeros((FEATURES + 1, 3)), np.zeros((FEATURES + 1, 3))], [np.zeros((3, 3)), np.zeros((3, 3))]]
    emit = np.zeros((FEATURES + 1, 3))
    fixed = model.turn < -1e5
    for step in range(1, rounds + 1):
        scores = np.zeros((n, longest, 3))
        scores[mask] = sum(emit[rows[:, k]] for k in range(width))
        scores[~able, 1:] = -1e6
        ahead, behind = np.zeros((n, longest, 3)), np.zeros((n, longest, 3))
        ahead[:, 0] = scores[:, 0] + model.turn[OUTSIDE]
        for t in range(1, longest):
            moved = np.logaddexp.reduce(ahead[:, t - 1, :, None] + model.turn, axis=1) + scores[:, t]
            ahead[:, t] = np.where(mask[:, t, None], moved, ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            moved = np.logaddexp.reduce(model.turn + (scores[:, t + 1] + behind[:, t + 1])[:, None, :], axis=2)
            behind[:, t] = np.where(mask[:, t + 1, None], moved, behind[:, t + 1])
        whole = np.logaddexp.reduce(ahead[:, -1], axis=1)
        chance = np.exp(ahead + behind - whole[:, None, None])
        wrong = chance.copy()
        np.put_along_axis(wrong, tags[:, :, None], np.take_along_axis(wrong, tags[:, :, None], 2) - 1, 2)
        slope = np.zeros_like(emit)
        for k, part in enumerate(wrong[mask].T):
            slope[:, k] = np.bincount(rows.ravel(), np.repeat(part, width), FEATURES + 1)
        pair = np.exp(ahead[:, :-1, :, None] + model.turn + (scores + behind)[:, 1:, None, :] - whole[:, None, None, None])
        turn_slope = pair[mask[:, 1:]].sum(axis=0) - gold_turn
        turn_slope[OUTSIDE] += chance[:, 0].sum(axis=0)
        slopes = [slope / n + 1e-4 * emit, turn_slope / n + 1e-4 * np.where(fixed, 0, model.turn)]
        steps = []
        for moment, g in zip(moments, slopes, strict=True):
            moment[0] = 0.9 * moment[0] + 0.1 * g
            moment[1] = 0.99 * moment[1] + 0.01 * g * g
            steps.append(0.1 * moment[0] / (1 - 0.9**step) / (np.sqrt(moment[1] / (1 - 0.99**step)) + 1e-8))
        emit -= steps[0]
        emit[FEATURES] = 0
        model.turn -= np.where(fixed, 0, steps[1])
    model.emit = emit[:FEATURES]
    return model


def tagged(text: str, hide: bool = False) -> list[tuple[list[list[int]], list[bool], list[int]]]:
    """The stretches of a text with tags from the patterns."""
    secret, traits, out = Overlaps(*_parts(text)), file_features(text), []
    for tokens, able in stretches(text):
        tags, last = [], None
        for (a, b), ok in zip(tokens, able, strict=True):
            part = secret.first(a, b) if ok else None
            tags.append(OUTSIDE if part is None else INSIDE if part == last else BEGIN)
            last = part
        out.append((features(text, tokens, traits, hide), able, tags))
    return out


def fit(docs: DataFrame, texts: int = TRAIN_TEXTS, sequences: int = SEQUENCES) -> Model:
    """Train on at most ``texts`` texts of ``docs`` (doc_id, text), half of them with an assignment or key in them.

    Of their stretches at most ``sequences`` different ones are learnt, half of them with a secret, the most frequent first.
    """
    words = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]|AKIA[A-Z0-9]{12}|[0-9a-f]{32}"
    known = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), "text")
    marked = known.select("doc_id", F.col("text").rlike(words).alias("hit"), F.col("text").rlike("[A-Za-z+/_.=-]*[0-9][A-Za-z0-9+/_.=-]{7}|[A-Za-z0-9+/_.=-]{7}[0-9]|[A-Z]{8}").alias("able"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    some = [marked.where(c).select("doc_id").orderBy(*order).limit(texts // 2) for c in ("hit", "able and not hit")]
    few = F.broadcast(some[0].union(some[1]).distinct())  # at most ``texts`` ids

    def list_sequences(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for text in frame["text"]:
                for hide in (False, True):
                    for feats, able, tags in tagged(text, hide):
                        for at in range(0, len(tags), 40):
                            end = at + 40
                            rows.append((feats[at:end], able[at:end], tags[at:end]))
            yield pd.DataFrame(rows, columns=["feats", "able", "tags"])

    schema = "feats array<array<int>>, able array<boolean>, tags array<int>"
    seen = known.join(few, "doc_id").mapInPandas(list_sequences, schema)
    counted = cut(seen.groupBy("feats", "able", "tags").count())
    secret = F.exists("tags", lambda t: t != OUTSIDE)
    first = [F.desc("count"), F.xxhash64("tags", "feats"), "tags", "feats"]
    few = [counted.where(c).orderBy(*first).limit(sequences // 2) for c in (secret, ~secret)]
    return train([(r.feats, r.able, r.tags) for part in few for r in part.collect()])


def field_spans(model: Model, text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans that the field adds: runs of begin and inside, likely enough, that do not meet a base span."""
    traits, out = None, []
    taken = Overlaps(*[[(a, b) for k, a, b in base if k == kind] for kind in KINDS[:3]])
    for tokens, able in stretches(text):
        traits = traits or file_features(text)
        scores = model.scores(features(text, tokens, traits), able)
        tags = model.viterbi(scores)
        if not any(tags):
            continue
        sure = 1 - model.marginals(scores)[:, OUTSIDE]
        i = 0
        while i < len(tags):
            j = i + 1
            if tags[i]:
                while j < len(tags) and tags[j] == INSIDE:
                    j += 1
                a, b = tokens[i][0], tokens[j - 1][1]
                if sure[i:j].mean() >= CONFIDENCE and taken.first(a, b) is None:
                    out.append(("crf", a, b))
            i = j
    return out


SCHEMA = "doc_id long, spans array<struct<kind:string,start:int,end:int>>"


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and all spans (kind, start, end in code points) of every row of ``docs``, in the order of ``printed``.

    Null and empty texts have no spans. Null ids and repeated rows stay; an empty table gives no rows; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = [_ordered(all_spans(sent.value, t)) for t in part["text"].to_pylist()]
                rows = [[{"kind": k, "start": a, "end": b} for k, a, b in spans] for spans in out]
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(rows, kind)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def all_spans(model: Model, text: str | None) -> list[tuple[str, int, int]]:
    base = base_spans(text or "")
    return base + field_spans(model, text or "", base)


def _ordered(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def redact(docs: DataFrame, model: Model, mask: str = "<SECRET>") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mask``; overlapping spans are replaced as one.

    Of an assignment only the value is replaced. All rows and columns stay; null texts stay null.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = [masked(sent.value, t, mask) for t in part["text"].to_pylist()]
                yield part.set_column(at, "text", pa.array(texts, part["text"].type))

    return docs.mapInArrow(run, docs.schema)


def masked(model: Model, text: str | None, mask: str) -> str | None:
    if not text:
        return text
    parts = secret_parts(text) + [(a, b) for _, a, b in field_spans(model, text, base_spans(text))]
    out, done = [], 0
    for a, b in sorted(parts):
        if a >= done:
            out += [text[done:a], mask]
        done = max(done, b)
    return "".join([*out, text[done:]])


def digest(spans: list[tuple[str, int, int]]) -> str:
    """sha256 of the printed base spans."""
    return hashlib.sha256(printed([s for s in spans if s[0] != "crf"]).encode()).hexdigest()
