"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints that differ in at most ``radius`` bits are linked. The 64 bits are grouped into parts of correlated bits
and each part gets its own threshold, so that the thresholds sum to ``radius - parts + 1``. Then of any two
fingerprints within the radius at least one part differs by no more than its threshold. A dynamic program over
candidate counts, estimated from a bounded sample, chooses the thresholds. Fingerprints meet in the keys of a part
within its threshold and are verified on all bits.

A key on which very many different fingerprints meet would give all pairs of them. Fingerprints of such keys are
linked by another exact way without pairs: each lists the points within half the radius (for 2: itself and its 64
neighbours); two of them are within the radius exactly if they share such a point, and every fingerprint on a point is linked to the least one.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flipline.llm.common import cut, join_counted, map_texts
from flipline.llm.components import components

SHINGLE = 3
RADIUS = 2
SEED = 42
#: Fingerprints from which bit groups and thresholds are chosen; the choice never changes results.
SAMPLE = 2048
#: A key with more rows than this is linked without pairs.
CROWD = 64
PARTS = (2, 3, 4)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text: A-Z lower-cased, split at ASCII white space, word shingles with repeats.

    Fewer words than a shingle count as one shingle; no words, an empty or a null text give 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(line, SEED)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    digest = xxhash.xxh64_digest
    hashes = b"".join(
        [digest(line[a:b], SEED) for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist(), strict=False)]
    )
    return _majority(np.frombuffer(hashes, np.uint8).reshape(-1, 8))


def _majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the big-endian hashes; counted in blocks, so the memory is bounded."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        counts += np.unpackbits(hashes[at : at + 65536], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        values = [fingerprint(t, shingle) for t in frame["text"]]
        signed = np.array(values, np.uint64).astype(np.int64)
        return pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "fp": signed})

    return map_texts(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, fp long", rows=2048)


def group_bits(sample: np.ndarray, parts: int) -> list[list[int]]:
    """Deal the 64 bits into equal parts so that correlated bits come together."""
    bits = ((sample[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(float)
    spread = bits.std(axis=0) + 1e-9
    tie = np.abs((bits - bits.mean(axis=0)).T @ (bits - bits.mean(axis=0)) / max(len(bits), 1) / np.outer(spread, spread))
    left, groups = list(range(64)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        group = [left.pop(0)]
        while len(group) < size:
            best = max(left, key=lambda b: (tie[b, group].sum(), -b))
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


def _probes(bits: int, threshold: int) -> int:
    return sum(math.comb(bits, r) for r in range(threshold + 1))


def allocate(sample: np.ndarray, groups: list[list[int]], radius: int, rows: int) -> tuple[float, list[int]]:
    """The thresholds of least cost (probe rows plus estimated candidates) that sum to ``radius - parts + 1``.

    -1 leaves a part out. Found by dynamic programming over parts and the sum so far.
    """
    scale = (rows / max(len(sample), 1)) ** 2
    costs = []
    for group in groups:
        mask = np.uint64(sum(1 << b for b in group))
        part = sample & mask
        near = np.zeros(radius + 1)
        for at in range(0, len(part), 256):
            apart = np.bitwise_count(part[at : at + 256, None] ^ part[None, :])
            near += [np.count_nonzero(apart <= t) for t in range(radius + 1)]
        near = (near - len(part)) / 2
        costs.append([0.0] + [rows * _probes(len(group), t) + scale * near[t] for t in range(radius + 1)])
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        grown: dict[int, tuple[float, list[int]]] = {}
        for total, (paid, chosen) in best.items():
            for t in range(-1, radius + 1):
                entry = (paid + cost[t + 1], [*chosen, t])
                if total + t not in grown or entry < grown[total + t]:
                    grown[total + t] = entry
        best = grown
    return best[radius - len(groups) + 1]


def plan(sample: np.ndarray, rows: int, radius: int = RADIUS) -> list[tuple[list[int], int]]:
    """Parts with their thresholds, for the number of parts that costs least."""
    options = []
    for parts in PARTS:
        groups = group_bits(sample, parts)
        cost, thresholds = allocate(sample, groups, radius, rows)
        options.append((cost, parts, groups, thresholds))
    _, _, groups, thresholds = min(options)
    return [(g, t) for g, t in zip(groups, thresholds, strict=True) if t >= 0]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _flips(bits: list[int], threshold: int) -> list[int]:
    """Masks with up to ``threshold`` of the bits set."""
    masks = [0]
    for _ in range(threshold):
        masks = sorted({m | (1 << b) for m in masks for b in bits} | set(masks))
    return [_signed(m) for m in masks]


def _keys(part: int, group: list[int], threshold: int) -> Column:
    """Structs of the part's number, a key within the threshold, and whether it is the fingerprint's own."""
    masked = F.col("fp").bitwiseAND(F.lit(_signed(sum(1 << b for b in group))))
    flips = F.array(*[F.lit(m).cast("long") for m in _flips(group, threshold)])
    return F.transform(
        flips,
        lambda m: F.struct(F.lit(part).alias("part"), masked.bitwiseXOR(m).alias("key"), (m == 0).alias("own")),
    )


def links(distinct: DataFrame, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """Edges (u, v) between different fingerprints within the radius; enough of them to reach all that are linked.

    ``distinct`` has one row per fingerprint in a column fp. The radius must be even: the way without pairs needs a
    point halfway.
    """
    if radius % 2:
        raise ValueError("the radius must be even")
    rows = distinct.count()
    sampled = distinct.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()
    sample = np.array([r[0] for r in sampled] or [0], np.int64).astype(np.uint64)
    chosen = plan(sample, rows, radius)
    listed = F.flatten(F.array(*[_keys(i, group, t) for i, (group, t) in enumerate(chosen)]))
    keyed = distinct.select("fp", F.explode(listed).alias("k")).select("fp", "k.*")
    sizes = keyed.groupBy("part", "key").agg(F.count("*").alias("n"), F.max("own").alias("any_own"))
    met = cut(keyed.join(sizes.where((F.col("n") > 1) & F.col("any_own")), ["part", "key"]))
    few = met.where(F.col("n") <= crowd)
    a = few.where("own").select("part", "key", F.col("fp").alias("u"))
    b = few.select("part", "key", F.col("fp").alias("v"))
    pairs = a.join(b, ["part", "key"]).where(
        (F.col("u") != F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius)
    )
    crowded = met.where(F.col("n") > crowd).select("fp").distinct()
    flips = F.array(*[F.lit(m).cast("long") for m in _flips(list(range(64)), radius // 2)])
    points = crowded.select("fp", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("point"))
    least = points.groupBy("point").agg(F.min("fp").alias("v"), F.count("*").alias("n")).where("n > 1")
    stars = points.join(least, "point").where(F.col("fp") != F.col("v")).select(F.col("fp").alias("u"), "v")
    return pairs.select("u", "v").unionByName(stars)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs``: the least doc_id reachable over links, itself included.

    Equal fingerprints are linked, also those of empty and null texts, which are 0. Repeated rows stay repeated. A
    null doc_id stays null and counts as no id. An empty table gives no rows. Other columns are ignored.
    """
    prints = cut(fingerprints(docs, shingle))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    rooted = components(links(distinct, radius, crowd)).withColumnRenamed("u", "fp")
    joined = cut(distinct.join(rooted, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    least = joined.groupBy("root").agg(F.min("rep").alias("component_id"), F.count("*").alias("n_fp"))
    classes = cut(join_counted(joined, least, "root", "n_fp", joined.count()).select("fp", "n", "component_id"))
    total = distinct.agg(F.sum("n")).first()[0] or 0
    return join_counted(prints, classes, "fp", "n", total).select("doc_id", "fp", "component_id")
