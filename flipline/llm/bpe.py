"""Byte-level BPE by backtracking from longest matches.

A tokeniser's ranks are read from a file of base64 tokens with their ids. Bytes are mapped to Latin-1 characters, so an
Aho-Corasick automaton lists in one pass the longest token at every byte. From the left, the longest token is taken;
if it may not stand beside the token before it, or leads to a place from which nothing goes on, the next shorter
prefix token is tried, and if none is left the last token is given up. A place given up is never entered again, since
a text before it has only one encoding, so the work is linear in the text.

Two tokens may stand side by side if merging the bytes of both would have kept the border between them. That is read
off the merge histories of the two tokens where they face each other, and remembered per pair.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flipline.llm.pieces import PieceEncoder, slices

RANKS = "byte_bpe_50k.tiktoken"
#: Pairs remembered by a worker; a full memo starts anew, which changes no result.
PAIRS = 300_000
#: Words, and pieces, of each generation that a worker remembers.
MEMO = 120_000
NEVER = 1 << 62


class Bpe:
    """Encoder and decoder for one file of ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.text_of = {i: b for b, i in ranks.items()}
        self.parts: dict[int, tuple[int, int]] = {}
        self.memo_pairs: dict[int, bool] = {}
        self.shorter: dict[int, int] = {}
        automaton = ahocorasick.Automaton()
        for token, i in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) == 1 or self._divide(token, i):
                automaton.add_word(token.decode("latin-1"), (i, len(token)))
        automaton.make_automaton()
        for i in self.parts:
            token = self.text_of[i]
            prefixes = (ranks.get(token[:end]) for end in range(len(token) - 1, 0, -1))
            self.shorter[i] = next(x for x in prefixes if x is not None and (x in self.parts or len(self.text_of[x]) == 1))
        self.matches = automaton.iter
        self.texts = PieceEncoder(self._learn, "<u4", memo=MEMO)

    def _divide(self, token: bytes, i: int) -> bool:
        """Find the pair from whose merge a token comes; False if plain merging never makes it."""
        for at in range(1, len(token)):
            a, b = self.ranks.get(token[:at]), self.ranks.get(token[at:])
            if a is None or b is None or (at > 1 and a not in self.parts) or (len(token) - at > 1 and b not in self.parts):
                continue
            if self._border_holds(a, b, i):
                self.parts[i] = (a, b)
                return True
        return False

    def _facing(self, token: int, side: int) -> list[int]:
        """The tokens that in turn lay at one end while ``token`` was merged, first the single byte."""
        chain = [token]
        while (pair := self.parts.get(chain[-1])) is not None:
            chain.append(pair[side])
        return chain[::-1]

    def _border_holds(self, a: int, b: int, before: int = NEVER) -> bool:
        """No merge of rank below ``before`` crosses the border of a and b while both are being merged.

        Tokens that face each other stay until they are merged into their next ones. A crossing merge comes first
        if its rank is below that of the merge on its left, which wins ties, and not above that on its right.
        """
        left, right = self._facing(a, 1), self._facing(b, 0)
        i = j = 0
        while True:
            until_left = left[i + 1] if i + 1 < len(left) else before
            until_right = right[j + 1] if j + 1 < len(right) else before
            crossing = self.ranks.get(self.text_of[left[i]] + self.text_of[right[j]])
            if crossing is not None and crossing < until_left and (crossing <= until_right < before or crossing < until_right):
                return False
            if i + 1 < len(left) and (until_left <= until_right or j + 1 == len(right)):
                i += 1
            elif j + 1 < len(right):
                j += 1
            else:
                return True

    def compatible(self, a: int, b: int) -> bool:
        key = a << 32 | b
        known = self.memo_pairs.get(key)
        if known is None:
            if len(self.memo_pairs) >= PAIRS:
                self.memo_pairs.clear()
            known = self.memo_pairs[key] = self._border_holds(a, b)
        return known

    def encode_bytes(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        longest = [0] * len(piece)
        for end, (token, size) in self.matches(piece.decode("latin-1")):
            longest[end - size + 1] = token
        sizes, shorter, compatible = self.text_of, self.shorter, self.compatible
        dead = bytearray(len(piece) + 1)
        found: list[int] = []
        start, token = 0, longest[0]
        while True:
            end = start + len(sizes[token])
            if not dead[end] and (not found or compatible(found[-1], token)):
                found.append(token)
                if end == len(piece):
                    return found
                start, token = end, longest[end]
                continue
            token = shorter.get(token, -1)
            if token < 0:
                dead[start] = 1
                token = found.pop()
                start -= len(sizes[token])

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        return {p: array("I", self.encode_bytes(p.encode("utf-8", "surrogatepass"))).tobytes() for p in pieces}

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers; none for a null or empty text."""
        return self.texts.encode(texts)

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.text_of.__getitem__, memoryview(packed).cast("I")))


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    """The encoder of a file, made once per worker."""
    with open(path, "rb") as lines:
        return Bpe({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})


def encode_documents(docs: DataFrame, path: str | None = None, ids: bool = True) -> DataFrame:
    """Encode whole texts and decode the ids again: doc_id, n_tokens, ids_sha256, decoded_sha256, and the ids.

    A null text counts as empty: no ids, hashes of nothing. Repeated rows stay; a null doc_id stays null; an empty
    table gives no rows. ``ids`` leaves out the packed ids (little-endian unsigned 32-bit).
    """
    path = path or public_tokenizers.path(RANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for part in slices(batch, size=4_000_000):
                packed = bpe.encode(part["text"])
                columns = {
                    "doc_id": part["doc_id"],
                    "n_tokens": pa.array([len(x) // 4 for x in packed], pa.int64()),
                    "ids_sha256": [hashlib.sha256(x).hexdigest() for x in packed],
                    "decoded_sha256": [hashlib.sha256(bpe.decode(x)).hexdigest() for x in packed],
                    "ids": pa.array(packed if ids else [None] * len(packed), pa.binary()),
                }
                yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary"
    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
    return out if ids else out.drop("ids")
