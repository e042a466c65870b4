"""Removal of lines that many documents share, with two Bloom filters for hashes seen once and seen twice.

Tasks hash the lines of their documents into a filter of hashes seen and, where one was there before, into a second filter.
Filters of different tasks merge slice by slice: what both have seen once is seen twice. A key held by two documents is
always in the second filter. Only lines found there are shuffled, with their texts: they are counted exactly, so what the filter
suspects wrongly costs time but changes nothing. The lines to drop go back to their documents by a join.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flipline.llm.common import join_counted, stored

LEAST_CHARS = 40
LEAST_DOCS = 5
BLANK = b" \t\n\x0b\x0c\r"
#: Bytes of text for each bit of a filter, and the most bits it has: 64 MB. A fuller filter suspects more lines, no fewer.
BYTES_A_BIT = 16
MOST_BITS = 1 << 29
#: Bits set for a hash; bits of a slice.
PROBES = 4
SLICE_BITS = 1 << 16
#: Keys with more than one row in SPREAD of the suspects are hot: fewer than SPREAD, and the side of them is broadcast.
SPREAD = 1_000


def keys_of(text: str | None, least_chars: int = LEAST_CHARS) -> list[tuple[int, bytes]]:
    """(line number, key) of the lines whose key, stripped and with A-Z lower-cased, has enough code points."""
    found = []
    for at, line in enumerate((text or "").encode("utf-8", "surrogatepass").lower().split(b"\n")):
        key = line.strip(BLANK)
        if len(key) >= least_chars and (len(key) >= 4 * least_chars or key.isascii() or len(key.decode("utf-8", "surrogatepass")) >= least_chars):
            found.append((at, key))
    return found


def _bits(hashes: np.ndarray, size: int) -> np.ndarray:
    """The places of each hash in a filter of ``size`` bits, a power of two; one row per hash."""
    step = (hashes >> np.uint64(29)) | np.uint64(1)
    return (hashes[:, None] + step[:, None] * np.arange(PROBES, dtype=np.uint64)) & np.uint64(size - 1)


class Filter:
    """Bits by which hashes are found again; it may find others too."""

    def __init__(self, size: int) -> None:
        self.size, self.bits = size, np.zeros(size // 8, np.uint8)

    def add(self, hashes: np.ndarray) -> None:
        places = _bits(hashes, self.size).ravel()
        np.bitwise_or.at(self.bits, (places >> np.uint64(3)).astype(np.int64), np.uint8(1) << (places & np.uint64(7)).astype(np.uint8))

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        places = _bits(hashes, self.size)
        found = self.bits[(places >> np.uint64(3)).astype(np.int64)] >> (places & np.uint64(7)).astype(np.uint8)
        return (found & np.uint8(1)).all(axis=1)


def _hashes(keys: set[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys))


def _see(once: Filter, twice: Filter, hashes: np.ndarray) -> None:
    """Add the hashes of some documents, one for each document and key."""
    own, counts = np.unique(hashes, return_counts=True)
    twice.add(own[(counts > 1) | once.holds(own)])
    once.add(own)


def repeated_filter(docs: DataFrame, size: int, least_chars: int = LEAST_CHARS) -> Filter:
    """The filter of the hashes of keys that at least two rows of ``docs`` hold."""
    width = min(SLICE_BITS, size) // 8

    def see(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = Filter(size), Filter(size)
        for batch in batches:
            held: list[np.ndarray] = []
            for text in batch.column(0):
                held.append(_hashes({k for _, k in keys_of(text.as_py(), least_chars)}))
                if sum(map(len, held)) > 100_000:
                    _see(once, twice, np.concatenate(held))
                    held = []
            if held:
                _see(once, twice, np.concatenate(held))
        rows = once.bits.reshape(-1, width), twice.bits.reshape(-1, width)
        for at in np.flatnonzero(rows[0].any(axis=1)).tolist():
            parts = [pa.array([zlib.compress(r[at].tobytes(), 1)], pa.binary()) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), *parts], ["slice", "once", "twice"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, once, twice = None, None, None
        for batch in batches:
            for row in batch.to_pylist():
                more_once, more_twice = (np.frombuffer(zlib.decompress(row[k]), np.uint8) for k in ("once", "twice"))
                if row["slice"] != now:
                    if now is not None and twice.any():
                        yield _slice(now, twice)
                    now, once, twice = row["slice"], np.zeros(width, np.uint8), np.zeros(width, np.uint8)
                twice |= more_twice | (once & more_once)
                once |= more_once
        if now is not None and twice.any():
            yield _slice(now, twice)

    seen = docs.select("text").mapInArrow(see, "slice int, once binary, twice binary")
    merged = seen.repartition("slice").sortWithinPartitions("slice").mapInArrow(merge, "slice int, twice binary")
    out = Filter(size)
    rows = out.bits.reshape(-1, width)
    for row in merged.collect():
        rows[row["slice"]] = np.frombuffer(zlib.decompress(row["twice"]), np.uint8)
    return out


def _slice(at: int, bits: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([zlib.compress(bits.tobytes(), 1)], pa.binary())], ["slice", "twice"])


def filter_size(docs: DataFrame) -> int:
    """Bits of a filter for these texts, a power of two between SLICE_BITS and MOST_BITS."""
    held = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(MOST_BITS, max(SLICE_BITS, 1 << (held // BYTES_A_BIT).bit_length()))


def _row_key() -> Column:
    """A row by its id and text; rows that agree in both have the same result."""
    return F.unhex(F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))), 256))


def _row_digest(doc_id: int | None, text: str | None) -> bytes:
    return hashlib.sha256(f"{'' if doc_id is None else doc_id}:{text or ''}".encode("utf-8", "surrogatepass")).digest()


def suspects(docs: DataFrame, twice: Filter, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(row_key, doc_id, key, places) of the keys that the filter finds: one row per row of ``docs`` and key."""
    shared = docs.sparkSession.sparkContext.broadcast((twice.size, twice.bits))
    names = ["row_key", "doc_id", "key", "places"]
    kinds = [pa.binary(), pa.int64(), pa.string(), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, bits = shared.value
        own = Filter.__new__(Filter)
        own.size, own.bits = size, bits
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                places: dict[bytes, list[int]] = {}
                for at, key in keys_of(text, least_chars):
                    places.setdefault(key, []).append(at)
                if not places:
                    continue
                found = own.holds(_hashes(places))
                if found.any():
                    digest = _row_digest(doc_id, text)
                    out += [(digest, doc_id, key.decode("utf-8", "surrogatepass"), at) for (key, at), f in zip(places.items(), found, strict=True) if f]
                if len(out) >= 2_000:
                    yield _batch(out, names, kinds)
                    out = []
            if out:
                yield _batch(out, names, kinds)

    return docs.select("doc_id", "text").mapInArrow(run, "row_key binary, doc_id long, key string, places array<int>")


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, sizes, drops = [], [], []
        for text, places in zip(batch.column("text"), batch.column("places"), strict=True):
            lines = (text.as_py() or "").split("\n")
            gone = set(places.as_py() or ())
            sizes.append(len(lines))
            drops.append(len(gone))
            kept.append("\n".join([line for at, line in enumerate(lines) if at not in gone]) if gone else text.as_py() or "")
        columns = [batch.column("doc_id"), pa.array(kept, pa.string()), pa.array(sizes, pa.int64()), pa.array(drops, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "n_lines", "n_dropped"])


def drop_shared_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped) of every row of ``docs``, without the lines that enough documents share.

    Lines end at a line feed; a null or empty text is one empty line. A line's key is the line stripped of ASCII white
    space with A-Z lower-cased. A key of at least ``least_chars`` code points held by at least ``least_docs`` documents
    loses its lines in all of them but the one with the largest doc_id, which keeps all its lines of that key. Rows
    that repeat a doc_id are one document in this count, and so are all rows without a doc_id, which comes before any
    other. Repeated rows stay repeated. An empty table gives no rows; other columns are ignored.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = stored(suspects(slim, repeated_filter(slim, filter_size(slim), least_chars), least_chars))
    counted = found.groupBy("key", "doc_id").agg(F.count("*").alias("n"))
    shared = counted.groupBy("key").agg(F.count("*").alias("held"), F.max("doc_id").alias("last"), F.sum("n").alias("n"))
    shared = stored(shared.where(F.col("held") >= least_docs).drop("held"))
    met = join_counted(found, shared, "key", "n", found.count(), SPREAD)
    gone = met.where(F.col("doc_id").isNull() | (F.col("doc_id") < F.col("last"))).select("row_key", F.explode("places").alias("place"))
    places = gone.groupBy("row_key").agg(F.collect_set("place").alias("places"))
    joined = slim.withColumn("row_key", _row_key()).join(places, "row_key", "left").select("doc_id", "text", "places")
    return joined.mapInArrow(_without, "doc_id long, text string, n_lines long, n_dropped long")
