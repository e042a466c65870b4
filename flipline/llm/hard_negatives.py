"""Hard negatives: for each anchor its nearest rows of the same label, and the rows of other labels in a score window below each.

Scores are integer inner products. The usable rows are packed into blocks, the anchors among them into tiles, both of
a fixed size. A cell is one tile with a slab of a few blocks; each cell's products come from Strassen's recursion on
int64 matrices, padded with zeros to even sides. Its additions and products are exact (modulo 2**64, so a score that
fits a long is right whatever happens between). Every cell keeps small sorted heaps, of positives per anchor and then of
negatives per positive. Heaps merge: block by block inside a cell, then over cells by rank in Spark. So a cell holds
one tile, one block and their product, and no label, anchor or copy of a vector gathers the rows of a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flipline.llm.common import stored
from flipline.llm.vectors import matrix, quantised, usable

POSITIVES = 5
NEGATIVES = 10
#: Rows of a block, anchors of a tile, and blocks of a slab.
BLOCK = 2048
TILE = 2048
SLAB = 4
#: A side this small or smaller is multiplied plainly.
LEAF = 16
#: Columns of a heap entry, in order of comparison: empty, inverted score, without id, id, block and place in it.
ENTRY = ("empty", "low", "unnamed", "id", "block", "at")

PACK = "n int, dims int, anchors int, ids binary, unnamed binary, labels binary, picked binary, x binary, kind string"
TILED = "tile int, n int, dims int, ids binary, unnamed binary, labels binary, blocks binary, at binary, x binary, kind string"


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a times the transpose of b, both int64 with as many columns, modulo 2**64."""
    if min(*a.shape, len(b)) <= leaf:
        return a @ b.T
    rows, cols = len(a), len(b)
    a, b = (np.pad(x, [(0, side % 2) for side in x.shape]) if any(s % 2 for s in x.shape) else x for x in (a, b))
    i, j, k = len(a) // 2, len(b) // 2, a.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :k], a[:i, k:], a[i:, :k], a[i:, k:]
    b11, b21, b12, b22 = b[:j, :k], b[:j, k:], b[j:, :k], b[j:, k:]
    m1 = strassen(a11 + a22, b11 + b22, leaf)
    m2 = strassen(a21 + a22, b11, leaf)
    m3 = strassen(a11, b12 - b22, leaf)
    m4 = strassen(a22, b21 - b11, leaf)
    m5 = strassen(a11 + a12, b22, leaf)
    m6 = strassen(a21 - a11, b11 + b12, leaf)
    m7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * i, 2 * j), np.int64)
    out[:i, :j] = m1 + m4 - m5 + m7
    out[:i, j:] = m3 + m5
    out[i:, :j] = m2 + m4
    out[i:, j:] = m1 - m2 + m3 + m6
    return out[:rows, :cols]


class Heaps:
    """Many sorted lists of the ``size`` best entries; an entry is a row of ENTRY, the lesser the better."""

    def __init__(self, lists: int, size: int) -> None:
        self.size = size
        self.kept = np.zeros((lists, size, len(ENTRY)), np.int64)
        self.kept[:, :, 0] = 1

    def merge(self, lists: np.ndarray | slice, more: np.ndarray) -> None:
        both = np.concatenate([self.kept[lists], more], axis=1)
        order = np.lexsort(tuple(both[:, :, i] for i in range(len(ENTRY) - 1, -1, -1)), axis=1)
        self.kept[lists] = np.take_along_axis(both, order[:, : self.size, None], axis=1)


class Rows:
    """A block or tile, unpacked."""

    def __init__(self, row: dict, dims: int, order: bool) -> None:
        self.ids, self.labels = (np.frombuffer(row[k], np.int64) for k in ("ids", "labels"))
        self.unnamed = np.frombuffer(row["unnamed"], np.bool_).astype(np.int64)
        x = np.frombuffer(row["x"], row["kind"]).reshape(row["n"], row["dims"])
        self.x = np.zeros((row["n"], dims), np.int64)
        self.x[:, : row["dims"]] = x
        self.at = np.arange(row["n"])
        if order:
            by = np.lexsort((self.ids, self.unnamed))
            self.ids, self.labels, self.unnamed, self.x, self.at = (v[by] for v in (self.ids, self.labels, self.unnamed, self.x, self.at))

    def entries(self, chosen: np.ndarray, scores: np.ndarray, empty: np.ndarray, block: int) -> np.ndarray:
        parts = (empty, ~scores, self.unnamed[chosen], self.ids[chosen], np.full_like(chosen, block), self.at[chosen])
        out = np.stack([np.asarray(p, np.int64) for p in parts], axis=-1)
        out[empty, 1:] = 0
        return out


def _packed(x: np.ndarray) -> tuple[bytes, str]:
    """The matrix in the narrowest integers that hold it."""
    for kind in ("int16", "int32"):
        info = np.iinfo(kind)
        if not x.size or (x.min() >= info.min and x.max() <= info.max):
            return x.astype(kind).tobytes(), kind
    return x.astype(np.int64).tobytes(), "int64"


def _blocks(rows: DataFrame) -> DataFrame:
    """Rows (vec_id, label, picked, x) as a stored table of blocks with a number each."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    struct = _parse_datatype_string(PACK)
    schema = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                lists = part.column("x")
                dims = int(np.diff(lists.offsets.to_numpy()).max())
                x, kind = _packed(matrix(lists, dims))
                picked = part.column("picked").to_numpy(zero_copy_only=False).astype(np.bool_)
                made = {
                    "n": part.num_rows,
                    "dims": dims,
                    "anchors": int(picked.sum()),
                    "ids": part.column("vec_id").fill_null(0).to_numpy().astype(np.int64).tobytes(),
                    "unnamed": part.column("vec_id").is_null().to_numpy(zero_copy_only=False).tobytes(),
                    "labels": part.column("label").to_numpy().astype(np.int64).tobytes(),
                    "picked": picked.tobytes(),
                    "x": x,
                    "kind": kind,
                }
                yield pa.RecordBatch.from_pylist([made], schema)

    return stored(rows.mapInArrow(run, struct).withColumn("block", F.monotonically_increasing_id()))


def _tiles(blocks: DataFrame, tiles: int, dims: int) -> DataFrame:
    """The anchors of all blocks, dealt evenly to ``tiles`` tiles; a stored table."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    struct = _parse_datatype_string(TILED)
    schema = to_arrow_schema(struct)
    single = "id long, unnamed boolean, label long, block long, at long, x binary"

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rows = Rows(row, dims, order=False)
                at = np.flatnonzero(np.frombuffer(row["picked"], np.bool_))
                columns = [rows.ids[at], rows.unnamed[at] > 0, rows.labels[at], np.full(len(at), row["block"]), at]
                columns.append([rows.x[i].tobytes() for i in at])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns[:5]] + [pa.array(columns[5], pa.binary())], ["id", "unnamed", "label", "block", "at", "x"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        x, kind = _packed(np.frombuffer(b"".join(table["x"].to_pylist()), np.int64).reshape(-1, dims))
        longs = lambda name: table[name].to_numpy().astype(np.int64).tobytes()
        made = {
            "tile": TaskContext.get().partitionId(),
            "n": table.num_rows,
            "dims": dims,
            "ids": longs("id"),
            "unnamed": table["unnamed"].to_numpy().astype(np.bool_).tobytes(),
            "labels": longs("label"),
            "blocks": longs("block"),
            "at": longs("at"),
            "x": x,
            "kind": kind,
        }
        yield pa.RecordBatch.from_pylist([made], schema)

    anchors = blocks.where("anchors > 0").mapInArrow(pick, single)
    return stored(anchors.repartition(tiles).mapInArrow(pack, struct))


def _cells(blocks: DataFrame, tiles: DataFrame, count: int, slabs: int, run: Callable, schema: str) -> DataFrame:
    """Apply ``run`` to the cells: a tile's row first, then the rows of the blocks of one slab."""
    slab = F.pmod(F.xxhash64("block"), F.lit(slabs)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    right = blocks.drop("anchors", "picked").select("*", slab.alias("slab"), every(count).alias("tile"))
    both = tiles.select("*", every(slabs).alias("slab")).unionByName(right, allowMissingColumns=True)
    dealt = both.repartition(count * slabs, "tile", "slab").sortWithinPartitions("tile", "slab", F.col("block").asc_nulls_first())
    return dealt.mapInArrow(run, schema)


def _walk(batches: Iterator[pa.RecordBatch], start: Callable, step: Callable, end: Callable) -> Iterator[pa.RecordBatch]:
    """Call ``start`` with each tile's row, ``step`` with each block's of its cell, and yield ``end`` of each cell.

    A tile without a row here has nothing to be compared, so its blocks are passed over.
    """
    state, cell = None, None
    for batch in batches:
        for at in range(batch.num_rows):
            row = batch.slice(at, 1).to_pylist()[0]
            if row["block"] is None:
                if state is not None:
                    yield end(state)
                state, cell = start(row), (row["tile"], row["slab"])
            elif cell == (row["tile"], row["slab"]):
                step(state, row)
    if state is not None:
        yield end(state)


def _positives(blocks: DataFrame, tiles: DataFrame, count: int, slabs: int, dims: int, size: int) -> DataFrame:
    """(tile, anchor, positive_rank, score, id): the first ``size`` rows of each anchor's label."""

    def start(row: dict) -> tuple:
        rows = Rows(row, dims, order=False)
        own = np.frombuffer(row["blocks"], np.int64), np.frombuffer(row["at"], np.int64)
        return row["tile"], rows, own, Heaps(row["n"], size)

    def step(state: tuple, row: dict) -> None:
        _, anchors, (own_block, own_at), heaps = state
        rows = Rows(row, dims, order=True)
        for label in np.intersect1d(anchors.labels, rows.labels):
            mine, theirs = np.flatnonzero(anchors.labels == label), np.flatnonzero(rows.labels == label)
            scores = strassen(anchors.x[mine], rows.x[theirs])
            same = (own_block[mine, None] == row["block"]) & (own_at[mine, None] == rows.at[theirs])
            order = np.argsort(np.where(same, np.iinfo(np.int64).max, ~scores), axis=1, kind="stable")[:, :size]
            top = np.take_along_axis(scores, order, axis=1)
            empty = np.take_along_axis(same, order, axis=1)
            heaps.merge(mine, rows.entries(theirs[order], top, empty, row["block"]))

    def end(state: tuple) -> pa.RecordBatch:
        tile, _, _, heaps = state
        anchor, place = np.nonzero(heaps.kept[:, :, 0] == 0)
        found = heaps.kept[anchor, place]
        columns = {"tile": pa.array(np.full(len(anchor), tile, np.int32)), "anchor": pa.array(anchor.astype(np.int32))}
        columns["score"] = pa.array(~found[:, 1])
        columns["id"] = pa.array(found[:, 3], mask=found[:, 2] > 0)
        columns |= {"block": pa.array(found[:, 4]), "at": pa.array(found[:, 5])}
        return pa.RecordBatch.from_pydict(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _walk(batches, start, step, end)

    found = _cells(blocks, tiles, count, slabs, run, "tile int, anchor int, score long, id long, block long, at long")
    best = Window.partitionBy("tile", "anchor").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "block", "at")
    ranked = found.withColumn("positive_rank", F.row_number().over(best)).where(F.col("positive_rank") <= size)
    return stored(ranked.select("tile", "anchor", "positive_rank", "score", "id"))


def bounds(positive: np.ndarray, low: tuple[int, int], high: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest integer score between the fractions ``low`` and ``high`` of each positive score."""
    share = lambda p, q, up: p // q[1] * q[0] + (p % q[1] * q[0] + up * (q[1] - 1)) // q[1]
    return share(positive, low, 1), share(positive, high, 0)


def mine(
    table: DataFrame,
    anchor: Column,
    column: str = "embedding",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: tuple[int, int] = (3, 10),
    high: tuple[int, int] = (9, 10),
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows where ``anchor`` holds.

    ``table`` has vec_id, label and the vectors; other columns are ignored. Rows without a label or vector, or with a
    null or non-finite entry, take no part. Each row is its own: of rows that repeat a vec_id each is an anchor,
    positive or negative by itself, and an anchor is never its own positive. Ties go to the smaller vec_id; rows without
    a vec_id come after all others of their score, and where ``anchor`` is null for them they are no anchors. Vectors
    shorter than the longest count as filled up with zeros. An empty table, and anchors without positives or without
    rows in a window, give no rows.
    """
    names = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark = table.sparkSession
    rows = table.where(usable(column) & F.col("label").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("long").alias("label"),
        F.coalesce(anchor, F.lit(False)).alias("picked"),
        quantised(column).alias("x"),
    )
    blocks = _blocks(rows)
    held, anchors, dims = blocks.agg(F.count("*"), F.sum("anchors"), F.max("dims")).first()
    if not anchors:
        return spark.createDataFrame([], names)
    count, slabs, dims = -(-anchors // TILE), -(-held // SLAB), max(dims, 1)
    tiles = _tiles(blocks, count, dims)
    best = _positives(blocks, tiles, count, slabs, dims, positives)
    listed = best.groupBy("tile").agg(F.collect_list(F.struct("anchor", "positive_rank", "score", "id")).alias("positives"))

    def start(row: dict) -> tuple:
        given = row["positives"]
        at = np.array([p["anchor"] for p in given])
        scores = np.array([p["score"] for p in given], np.int64)
        return row["tile"], Rows(row, dims, order=False), given, at, bounds(scores, low, high), Heaps(len(given), negatives)

    def step(state: tuple, row: dict) -> None:
        _, anchors, _, at, (least, most), heaps = state
        rows = Rows(row, dims, order=True)
        some = np.unique(at)
        scores = strassen(anchors.x[some], rows.x)
        alike = anchors.labels[some, None] == rows.labels
        keys = np.where(alike, np.iinfo(np.int64).max, ~scores)
        order = np.argsort(keys, axis=1, kind="stable")
        keys = np.take_along_axis(keys, order, axis=1)
        free = (~alike).sum(axis=1)
        line = np.searchsorted(some, at)
        first = np.array([np.searchsorted(keys[i], ~m, "left") for i, m in zip(line, most, strict=True)])
        last = np.array([np.searchsorted(keys[i], ~m, "right") for i, m in zip(line, least, strict=True)])
        place = first[:, None] + np.arange(negatives)
        empty = place >= np.minimum(last, free[line])[:, None]
        chosen = order[line[:, None], np.minimum(place, len(rows.ids) - 1)]
        heaps.merge(slice(None), rows.entries(chosen, scores[line[:, None], chosen], empty, row["block"]))

    def end(state: tuple) -> pa.RecordBatch:
        tile, anchors, given, at, _, heaps = state
        pair, place = np.nonzero(heaps.kept[:, :, 0] == 0)
        found = heaps.kept[pair, place]
        columns = {"tile": pa.array(np.full(len(pair), tile, np.int32)), "anchor": pa.array(at[pair].astype(np.int32))}
        columns["positive_rank"] = pa.array([given[i]["positive_rank"] for i in pair], pa.int32())
        columns["anchor_id"] = pa.array(anchors.ids[at[pair]], mask=anchors.unnamed[at[pair]] > 0)
        columns["positive_id"] = pa.array([given[i]["id"] for i in pair], pa.int64())
        columns["positive_score"] = pa.array([given[i]["score"] for i in pair], pa.int64())
        columns["negative_id"] = pa.array(found[:, 3], mask=found[:, 2] > 0)
        columns["negative_score"] = pa.array(~found[:, 1])
        columns |= {"block": pa.array(found[:, 4]), "at": pa.array(found[:, 5])}
        return pa.RecordBatch.from_pydict(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _walk(batches, start, step, end)

    schema = "tile int, anchor int, positive_rank int, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long, block long, at long"
    found = _cells(blocks, tiles.join(listed, "tile"), count, slabs, run, schema)
    nearest = Window.partitionBy("tile", "anchor", "positive_rank").orderBy(
        F.desc("negative_score"), F.col("negative_id").asc_nulls_last(), "block", "at"
    )
    ranked = found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
