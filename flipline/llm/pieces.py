"""Cuts texts into pieces by a tokeniser's pattern and remembers the ids of pieces and words."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Words, and pieces, of each of the two generations that a worker remembers; this changes no result.
MEMO = 300_000
#: Longer words are not remembered.
LONG = 48
SPACES = r"[\s\x0b\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Some space is not followed by a word, or follows other white space, so a piece need not begin at each space.
UNEVEN = rf"\A |{SPACES} | {SPACES}| \z"


class Memory:
    """What is known of texts. When the young generation is full it becomes the old one, whose entries return when asked for."""

    def __init__(self, size: int):
        self.size = size
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def unknown(self, keys: Iterable[str]) -> list[str]:
        """The keys not known; all others are now in the young generation."""
        young, old, out = self.young, self.old, []
        for key in [k for k in keys if k not in young]:
            value = old.get(key)
            if value is None:
                out.append(key)
            else:
                young[key] = value
        return out

    def settle(self, fresh: Iterable[str]) -> None:
        """To be called when a slice is done: forgets long keys among the fresh ones, and ages."""
        for key in fresh:
            if len(key) > LONG:
                self.young.pop(key, None)
        if len(self.young) > self.size:
            self.old, self.young = self.young, {}


class PieceEncoder:
    """Encodes whole texts with ``learn``, which gives the packed ids of pieces.

    The pattern must keep a run of letters and the space before it together. No id spans two pieces. Where single spaces part words, a piece begins at every space; so each different word of a
    slice of texts is looked up once, words not yet known are cut into pieces, and pieces not yet known are learnt. Other
    texts are cut into pieces as a whole.
    """

    def __init__(
        self,
        learn: Callable[[list[str]], dict[str, bytes]],
        dtype: str,
        pattern: str = public_tokenizers.PATTERN,
        memo: int = MEMO,
    ):
        self.learn = learn
        self.dtype = np.dtype(dtype)
        self.find = regex.compile(pattern).findall
        self.words = Memory(memo)
        self.pieces = Memory(memo)

    def _known(self, wanted: Iterable[str]) -> list[str]:
        """Learn the pieces not yet known; returns them."""
        fresh = self.pieces.unknown(set(wanted))
        self.pieces.young.update(self.learn(fresh))
        return fresh

    def _look_up(self, cut: list[list[str]]) -> list[bytes]:
        fresh = self._known(chain.from_iterable(cut))
        known = self.pieces.young
        found = [b"".join(map(known.__getitem__, c)) for c in cut]
        self.pieces.settle(fresh)
        return found

    def _new_words(self, fresh: list[str]) -> None:
        """Add words to the memo; one of letters only is one piece with the space before it."""
        plain = [w for w in fresh if w.isalpha()]
        pieces = [" " + w for w in plain]
        learnt = self._known(pieces)
        self.words.young.update(zip(plain, map(self.pieces.young.__getitem__, pieces), strict=True))
        self.pieces.settle(learnt)
        mixed = [w for w in fresh if not w.isalpha()]
        cut = [self.find(w[1:] if w[0] == "\n" else " " + w) for w in mixed]
        self.words.young.update(zip(mixed, self._look_up(cut), strict=True))

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The packed ids of each text of a slice; a null text is empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if not len(texts):
            return []
        odd = pc.match_substring_regex(texts, UNEVEN)
        # The line feed marks the first word, which no space precedes; no other word begins with white space.
        empty, mark = pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string())
        marked = pc.binary_join_element_wise(mark, pc.if_else(odd, empty, texts), empty)
        lists = pc.split_pattern(marked, " ")
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        fresh = self.words.unknown(words)
        self._new_words(fresh)
        packed = list(map(self.words.young.__getitem__, words))
        self.words.settle(fresh)
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // self.dtype.itemsize
        first = np.cumsum(sizes) - sizes
        index = coded.indices.to_numpy()
        taken = sizes[index]
        ends = np.cumsum(taken)
        place = np.repeat(first[index] - (ends - taken), taken) + np.arange(ends[-1])
        ids = np.frombuffer(b"".join(packed), self.dtype)[place]
        borders = np.concatenate([[0], ends])[np.asarray(lists.offsets) - lists.offsets[0].as_py()].tolist()
        out = [ids[a:b].tobytes() for a, b in zip(borders, borders[1:], strict=False)]
        uneven = np.flatnonzero(np.asarray(odd)).tolist()
        for i, whole in zip(uneven, self._look_up([self.find(texts[i].as_py()) for i in uneven]), strict=True):
            out[i] = whole
        return out


def slices(batch: pa.RecordBatch, column: str = "text", rows: int = 2048, size: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a slice holds at most ``rows`` rows and about ``size`` bytes of text, or one row."""
    lengths = pc.binary_length(batch[column]).fill_null(0).to_numpy(zero_copy_only=False)
    at = 0
    while at < len(lengths):
        fit = int(np.searchsorted(np.cumsum(lengths[at : at + rows]), size, "right"))
        yield batch.slice(at, max(1, fit))
        at += max(1, fit)
