"""Token ids in raw binary shards, found by document key through a minimal perfect hash.

Documents are dealt to shards by ranges of doc_id and sorted within them. A shard is two files:

* ``NNNNN.ids``: the ids of all its documents one after the other, little-endian, 16 bits wide if the vocabulary
  allows it, else 32;
* ``NNNNN.mph``: five little-endian 64-bit counts (version, id width in bytes, records, keys, buckets), then per record
  its key (int64), a byte that is 1 for a null key, and its first id in the shard (int64, and one more for the end);
  then per bucket a displacement (uint32); then per slot the record of its key (uint32) and the key's fingerprint
  (uint32).

A key's bucket gives a displacement, key and displacement give its slot among exactly as many slots as there are
keys, the stored fingerprint rejects a foreign key (one in 2^32 passes and is then told apart by the record's key),
and the record gives the place in the payload: a constant number of steps. Records with the same key stand together;
the slot points to the first. Null keys are stored but not found by key.

Every file is written under a name of the task's attempt and then moved into place; its content depends on the input
alone, so a task that runs again after a lost executor replaces it by the same bytes.
"""

from __future__ import annotations

import os
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs  # noqa: F401
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flipline.llm.pieces import PieceEncoder, slices
from flipline.session import checkpoint_root

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
#: Keys per bucket on average.
LOAD = 2
GOLDEN = 0x9E3779B97F4A7C15
ALL = (1 << 64) - 1


class LibraryEncoder:
    """Whole texts through the tokenizers library, which sees a piece once while it is remembered.

    Pieces not yet known are strung together, parted as the pattern parts them, for one call whose ids are cut at the
    pieces' bytes.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        added = sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.added = "|".join(map(re.escape, added))
        self.dtype = np.dtype("<u2" if max(vocabulary.values()) < 1 << 16 else "<u4")
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.sizes[i] = len(token)  # the vocabulary writes each byte as one character
        self.encode = PieceEncoder(self._learn, self.dtype.str).encode

    def encode_default(self, texts: pa.Array) -> list[bytes]:
        """The packed ids of each text as the library's own call gives them, which knows the added tokens in a text.

        Only texts that hold one go to the library whole, since no piece of the others does.
        """
        texts = texts.cast(pa.large_string()).fill_null("")
        if not self.added or not len(texts):
            return self.encode(texts)
        held = pc.match_substring_regex(texts, self.added)
        out = self.encode(pc.if_else(held, pa.scalar("", pa.large_string()), texts))
        self.tokenizer.encode_special_tokens = False
        try:
            for i in np.flatnonzero(np.asarray(held)).tolist():
                out[i] = self._ids(texts[i].as_py()).tobytes()
        finally:
            self.tokenizer.encode_special_tokens = True
        return out

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        """The packed ids of pieces. A piece that begins with a space parts itself; a line feed parts the others."""
        solid = [p for p in pieces if not p[-1].isspace()]
        learnt = {p: self._ids(p).tobytes() for p in set(pieces).difference(solid)} if len(solid) < len(pieces) else {}
        for between, group in (("", [p for p in solid if p[0] == " "]), ("\n", [p for p in solid if p[0] != " "])):
            for at in range(0, len(group), 2000):
                some = group[at : at + 2000]
                ids = self._ids(between.join(some))
                sizes = np.array([len(p.encode()) for p in some])
                ends = np.cumsum(sizes + len(between)) - len(between)
                bytes_before = np.cumsum(self.sizes[ids])
                first = np.searchsorted(bytes_before, ends - sizes, "right").tolist()
                last = np.searchsorted(bytes_before, ends, "right").tolist()
                learnt.update((p, ids[a:b].tobytes()) for p, a, b in zip(some, first, last, strict=True))
        return learnt


@lru_cache(maxsize=2)
def library(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads their bits."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _slots(hashes: np.ndarray, displacement: np.ndarray | int, n: int) -> np.ndarray:
    step = np.asarray(displacement, np.uint64) * np.uint64(GOLDEN)
    return (mix(hashes + step) % np.uint64(n)).astype(np.int64)


def build(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Displacements per bucket and the slot of each of the distinct int64 keys; slots are 0 to len(keys) - 1.

    The fullest buckets choose first: the least displacement at which all their keys meet free slots. A bucket with one
    key names its slot itself, in a displacement with the top bit set.
    """
    n = len(keys)
    buckets = max(1, -(-n // LOAD))
    hashes = mix(keys.view(np.uint64) ^ np.uint64(GOLDEN))
    home = ((hashes >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(home, kind="stable")
    sizes = np.bincount(home, minlength=buckets)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    moved, slots, taken = np.zeros(buckets, np.uint32), np.zeros(n, np.int64), bytearray(n)
    for bucket in np.argsort(-sizes, kind="stable").tolist():
        members = order[starts[bucket] : starts[bucket + 1]]
        if len(members) < 2:
            break
        own, first = hashes[members], 1
        while True:
            tried = _slots(own[None, :], np.arange(first, first + 32, dtype=np.uint64)[:, None], n).tolist()
            fit = next((k for k, t in enumerate(tried) if len(set(t)) == len(t) and not any(taken[s] for s in t)), -1)
            if fit >= 0:
                break
            first += 32
        moved[bucket], slots[members] = first + fit, tried[fit]
        for s in tried[fit]:
            taken[s] = 1
    free = np.flatnonzero(np.frombuffer(taken, np.uint8) == 0)
    single = np.flatnonzero(sizes == 1)
    moved[single] = free.astype(np.uint32) | np.uint32(1 << 31)
    slots[order[starts[single]]] = free
    return moved, slots


def _fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(mix(keys.view(np.uint64))) >> np.uint64(32)).astype("<u4")


class Shard:
    """One shard opened for reading."""

    def __init__(self, folder: str, name: str):
        fs, base = pa.fs.FileSystem.from_uri(folder)
        with fs.open_input_file(posixpath.join(base, f"{name}.mph")) as f:
            raw = f.read()
        version, self.width, records, keys, buckets = np.frombuffer(raw, "<i8", 5).tolist()
        if version != 1:
            raise ValueError(f"unknown version {version} of {name}")
        at = 40
        fields = []
        for kind, n in (("<i8", records), ("u1", records), ("<i8", records + 1), ("<u4", buckets), ("<u4", keys), ("<u4", keys)):
            fields.append(np.frombuffer(raw, kind, n, at))
            at += fields[-1].nbytes
        self.keys, self.nulls, self.starts, self.moved, self.records, self.prints = fields
        self.payload = fs.open_input_file(posixpath.join(base, f"{name}.ids"))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The first record of each key, -1 if the shard does not hold it."""
        keys, n = np.asarray(keys, np.int64), len(self.records)
        if not n:
            return np.full(len(keys), -1)
        hashes = mix(keys.view(np.uint64) ^ np.uint64(GOLDEN))
        moved = self.moved[((hashes >> np.uint64(32)) % np.uint64(len(self.moved))).astype(np.int64)]
        named = moved >= np.uint32(1 << 31)
        slots = np.where(named, moved & np.uint32((1 << 31) - 1), _slots(hashes, moved, n)).astype(np.int64)
        records = self.records[slots].astype(np.int64)
        return np.where((self.prints[slots] == _fingerprints(keys)) & (self.keys[records] == keys), records, -1)

    def ids(self, record: int) -> np.ndarray:
        a, b = int(self.starts[record]), int(self.starts[record + 1])
        raw = self.payload.read_at((b - a) * self.width, a * self.width)
        return np.frombuffer(raw, f"<u{self.width}")


def _write_shard(folder: str, name: str, attempt: int, batches: Iterator[pa.RecordBatch], path: str, added: bool) -> tuple[int, int]:
    encoder = library(path)
    encode = encoder.encode_default if added else encoder.encode
    fs, base = pa.fs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    keys, nulls, sizes = [], [], [0]
    end = np.array([END_ID], encoder.dtype).tobytes()
    made = {x: posixpath.join(base, f"_{name}.{attempt}.{x}") for x in ("ids", "mph")}
    with fs.open_output_stream(made["ids"]) as out:
        for batch in batches:
            for part in slices(batch):
                packed = encode(part["text"])
                for ids in packed:
                    out.write(ids + end)
                    sizes.append(len(ids) // encoder.dtype.itemsize + 1)
                ids = part["doc_id"]
                nulls.append(np.asarray(ids.is_null()).astype("u1"))
                keys.append(np.asarray(ids.fill_null(0), np.int64))
    key, null = np.concatenate(keys), np.concatenate(nulls)
    starts = np.cumsum(sizes)
    held = np.flatnonzero(null == 0)
    distinct, first = np.unique(key[held], return_index=True)
    moved, slots = build(distinct)
    records, prints = np.zeros(len(distinct), "<u4"), np.zeros(len(distinct), "<u4")
    records[slots], prints[slots] = held[first], _fingerprints(distinct)
    head = np.array([1, encoder.dtype.itemsize, len(key), len(distinct), len(moved)], "<i8")
    with fs.open_output_stream(made["mph"]) as out:
        for part in (head, key.astype("<i8"), null, starts.astype("<i8"), moved.astype("<u4"), records, prints):
            out.write(part.tobytes())
    for x, temporary in made.items():
        fs.move(temporary, posixpath.join(base, f"{name}.{x}"))
    return len(key), int(starts[-1])


def write(docs: DataFrame, folder: str, path: str | None = None, added: bool = False) -> DataFrame:
    """Write the ids of whole texts, with an end id each, as shards in ascending doc_id order; returns the manifest.

    The manifest (shard, n_docs, n_ids, start: ids in all shards before it) has one row per shard and is kept in the
    folder. Null keys come first; a null text has only the end id. Repeated keys stay, ordered by text. An empty table
    gives no shard. ``folder`` must be a path that all executors share, such as ``hdfs://`` or ``s3://``.
    With ``added`` the name of an added token in a text, such as ``<|endoftext|>``, is that token, as in the library's default call;
    else it is encoded as plain characters.
    """
    path = path or public_tokenizers.path(TOKENIZER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = (b for b in batches if b.num_rows)
        head = next(filled, None)
        if head is None:
            return
        task = TaskContext.get()
        shard = task.partitionId()

        def chained() -> Iterator[pa.RecordBatch]:
            yield head
            yield from filled

        n_docs, n_ids = _write_shard(folder, f"{shard:05d}", task.taskAttemptId(), chained(), path, added)
        yield pa.RecordBatch.from_pydict({"shard": [shard], "n_docs": [n_docs], "n_ids": [n_ids]})

    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id")
    written = ordered.sortWithinPartitions("doc_id", "text").mapInArrow(run, "shard long, n_docs long, n_ids long")
    written.write.parquet(f"{folder}/manifest.parquet")
    return manifest(docs.sparkSession, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    return spark.read.parquet(f"{folder}/manifest.parquet").withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Every document of the store by its key: doc_id, start, n_tokens, ids_crc32 (of the ids as 32-bit integers)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                shard = Shard(folder, f"{row.shard:05d}")
                found = shard.find(shard.keys)
                for at in range(0, len(found), 10_000):
                    out = []
                    for i in range(at, min(at + 10_000, len(found))):
                        record = i
                        if not shard.nulls[i]:
                            record = int(found[i])  # the first record of the key; later ones of the key follow it
                            if record < 0 or shard.keys[record] != shard.keys[i]:
                                raise ValueError(f"key {shard.keys[i]} is not found in shard {row.shard}")
                            record = max(record, i)
                        ids = shard.ids(record)
                        key = None if shard.nulls[i] else int(shard.keys[i])
                        out.append((key, row.start + int(shard.starts[record]), len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    frame = pd.DataFrame(out, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
                    yield frame.astype({"doc_id": "Int64"})

    held = manifest(spark, folder).select("shard", "start")
    shards = held.repartition(max(1, held.count()))  # a task for each shard
    return shards.mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(keys: DataFrame, folder: str) -> DataFrame:
    """(doc_id, ids) of the keys in ``keys`` that the store holds, found through the index of every shard.

    Each task opens the shards it needs one after the other; repeated records of a key all come back.
    """
    spark = keys.sparkSession
    names = [r[0] for r in spark.read.parquet(f"{folder}/manifest.parquet").select("shard").collect()]  # one per shard

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            wanted = frame["doc_id"].dropna().to_numpy(np.int64)
            for name in names:
                shard = Shard(folder, f"{name:05d}")
                for record in shard.find(wanted):
                    while 0 <= record < len(shard.keys):
                        yield pd.DataFrame({"doc_id": [shard.keys[record]], "ids": [shard.ids(record).astype(int).tolist()]})
                        record += 1
                        if record == len(shard.keys) or shard.keys[record] != shard.keys[record - 1]:
                            break

    return keys.select(F.col("doc_id").cast("long")).distinct().mapInPandas(run, "doc_id long, ids array<int>")


def new_folder(spark: SparkSession) -> str:
    """A folder of its own for a store, in the shared checkpoint folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/token-store-{uuid.uuid4().hex}"
