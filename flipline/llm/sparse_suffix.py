"""Repeated passages by sparse suffix arrays.

Of all suffixes of a text only those are kept that begin at a minimiser: the least k-gram hash of GAP neighbouring ones, the
leftmost of equal ones. Any passage of PASSAGE words has a kept suffix within its first GAP words, and two copies of a passage
keep the same ones. Suffixes are ordered by the hash of their first PASSAGE - GAP + 1 words; one whose neighbour in that order has
the same words is shared. A shared suffix is extended to the right, to a run of PASSAGE words from it. Where that run is not
repeated, or the suffix before is too far away or its run is not repeated, it is extended to the left as well, in every text that
has it: the runs that begin up to GAP - 1 words earlier. Runs that occur more than once are joined to spans. So the spans cover exactly the words of passages
of PASSAGE words that occur at least twice: a run has a first kept suffix in it, which is shared, and either the run is tested, or
that suffix and the one before it begin repeated runs which cover its words.

Equal words mean equal 64-bit rolling hashes of the words' hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flipline.llm.common import HOT_KEYS, stored
from flipline.llm.pieces import slices

PASSAGE = 50
GAP = 20
GRAM = 5
#: An odd number, so it has an inverse among 64-bit words.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, base, np.uint64)]), dtype=np.uint64)


def words_of(text: str | None) -> list[bytes]:
    """The words of a text: what ASCII white space parts."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)


def rolled(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of ``size`` words, from sums over all words so far; spread, since neighbours differ little."""
    n = len(hashes) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(hashes * _powers(BASE, len(hashes) - 1), dtype=np.uint64)])
    h = (sums[size:] - sums[:-size]) * _powers(INVERSE, n - 1)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def minimisers(grams: np.ndarray, gap: int) -> np.ndarray:
    """Positions of the least of each ``gap`` neighbours, the leftmost of equal ones, in order."""
    low = np.uint64((1 << 31) - 1)
    packed = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    span, least = 1, packed
    while span < gap and len(least) > 1:
        step = min(span, gap - span)
        least = np.minimum(least[: len(least) - step], least[step:])
        span += step
    return np.unique(least & low).astype(np.int64) if len(grams) >= gap else np.zeros(0, np.int64)


def anchors(words: list[bytes], passage: int, gap: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kept suffixes of a text: positions, hashes of their first ``passage - gap + 1`` words, and of their first ``passage``.

    The latter is 0 where the text ends before.
    """
    if len(words) < passage:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    hashes = word_hashes(words)
    heads = rolled(hashes, passage - gap + 1)
    at = minimisers(rolled(hashes, gram), gap)
    at = at[at < len(heads)]
    runs = np.concatenate([rolled(hashes, passage), np.zeros(gap, np.uint64)])
    return at, heads[at], runs[at]


def _counted(rows: DataFrame, key: str, holds: Column, name: str) -> DataFrame:
    """(key, n, name): how many rows a key has, and what ``holds``, an aggregate, says of them."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), holds.alias(name))


def _tell(rows: DataFrame, counts: DataFrame, key: str, name: str, total: int) -> DataFrame:
    """The ``total`` rows with what ``counts`` says of their key in a column ``name``.

    Frequent keys, of which there are fewer than HOT_KEYS, are broadcast to their rows, whatever is said of them; only rows of
    other keys move.
    """
    hot = F.col("n") * F.lit(HOT_KEYS) > F.lit(total)
    frequent = F.broadcast(counts.where(hot).select(key, name))
    few = counts.where(~hot & F.col(name)).select(key, name)
    rest = rows.join(frequent.select(key), key, "left_anti").join(few, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return rows.join(frequent, key).unionByName(rest)


def _shared(rows: DataFrame, key: str, total: int) -> DataFrame:
    """The rows with whether their key occurs at least twice, in a column ``shared``."""
    return _tell(rows, _counted(rows, key, F.count("*") > 1, "shared"), key, "shared", total)


def repeated_passages(docs: DataFrame, passage: int = PASSAGE, gap: int = GAP, gram: int = GRAM) -> DataFrame:
    """doc_id, row_key, start, end (code points), n_words and class_id of every repeated span of every document.

    A span is a longest run of words each in a passage of ``passage`` words that occurs at least twice, in this document or
    another. class_id names the first passage of the span; spans that begin with the same passage share it. Rows equal in id and
    text are copies of each other, so all their passages are repeated, and their spans are listed once. Null ids are allowed; null,
    empty and shorter texts have no spans; an empty table gives no rows; other columns are ignored.
    """
    if passage - gap + 1 < gram or gap < 1:
        raise ValueError("a passage must hold its minimiser")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.length("text") >= 2 * passage - 1)
    texts = texts.withColumn("row_key", F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.col("doc_id").isNull(), "text"))

    def list_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                keys, places, heads, runs = [], [], [], []
                for key, text in zip(part["row_key"].to_pylist(), part["text"].to_pylist(), strict=True):
                    at, head, run = anchors(words_of(text), passage, gap, gram)
                    keys.append(np.full(len(at), key, np.int64))
                    places.append(at.astype(np.int32))
                    heads.append(head.view(np.int64))
                    runs.append(run.view(np.int64))
                columns = {"row_key": keys, "pos": places, "head": heads, "run": runs}
                columns = {c: np.concatenate(v) for c, v in columns.items()}
                yield pa.RecordBatch.from_pydict(columns)

    kept = stored(texts.select("row_key", "text").mapInArrow(list_anchors, "row_key long, pos int, head long, run long"))
    near = stored(_shared(kept, "head", kept.count()).where("shared").drop("shared"))
    right = _shared(near, "run", near.count()).withColumn("sure", F.col("shared") & (F.col("run") != 0))
    order = Window.partitionBy("row_key").orderBy("pos")  # suffixes or runs of one text
    covered = F.lag("sure").over(order) & (F.col("pos") - F.lag("pos").over(order) <= passage)
    placed = stored(right.select("row_key", "pos", "head", "sure", (~F.coalesce(F.col("sure") & covered, F.lit(False))).alias("open")))
    # What one text needs to have tested must be listed for all texts with the same suffix.
    left = _tell(placed, _counted(placed, "head", F.bool_or("open"), "wide"), "head", "wide", placed.count())
    listed = left.groupBy("row_key").agg(F.array_sort(F.collect_set(F.struct("pos", "sure", "wide"))).alias("at"))  # of one text

    def list_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield _runs(part, passage, gap)

    found = texts.join(listed, "row_key")
    schema = "doc_id long, row_key long, pos int, run long, sure boolean, start int, end int"
    runs = stored(found.select("doc_id", "row_key", "text", "at").mapInArrow(list_runs, schema))
    open_runs = runs.where(~F.col("sure")).select("row_key", "pos", "run")
    # An open run is repeated if another open one or a known one is the same: settled run by run, then told to its rows.
    known = runs.where("sure").select("run").distinct().withColumn("known", F.lit(True))
    counts = _counted(open_runs, "run", F.count("*") > 1, "again").join(known, "run", "left")
    counts = counts.select("run", "n", (F.col("again") | F.coalesce("known", F.lit(False))).alias("again"))
    again = _tell(open_runs, counts, "run", "again", open_runs.count()).where("again").select("row_key", "pos").distinct()
    good = runs.where("sure").unionByName(runs.where(~F.col("sure")).join(again, ["row_key", "pos"], "left_semi"))
    apart = F.coalesce(F.col("pos") - F.lag("pos").over(order) > passage, F.lit(True)).cast("int")
    spans = good.withColumn("apart", apart).withColumn("span", F.sum("apart").over(order))
    return spans.groupBy("row_key", "span").agg(
        F.first("doc_id").alias("doc_id"),
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        (F.max("pos") - F.min("pos") + passage).alias("n_words"),
        F.min_by("run", "pos").alias("class_id"),
    ).select("doc_id", "row_key", "start", "end", "n_words", "class_id")


def _runs(part: pa.RecordBatch, passage: int, gap: int) -> pa.RecordBatch:
    """The runs to test, and those known to be repeated, of the texts of a slice, each with its code points."""
    columns: list[list] = [[] for _ in range(7)]
    for doc, key, text, at in zip(*(part[c].to_pylist() for c in ("doc_id", "row_key", "text", "at")), strict=True):
        run = rolled(word_hashes(words_of(text)), passage)
        pos, sure = np.array([x["pos"] for x in at]), np.array([x["sure"] for x in at])
        wide = pos[np.array([x["wide"] for x in at])]
        starts = np.unique((wide[:, None] - np.arange(gap)[None, :]).ravel())
        starts = np.union1d(starts[(starts >= 0) & (starts < len(run))], pos[sure])
        places = word_places(text)
        n = len(starts)
        values = ([doc] * n, [key] * n, starts, run[starts].view(np.int64), np.isin(starts, pos[sure]))
        for column, value in zip(columns, (*values, places[starts, 0], places[starts + passage - 1, 1]), strict=True):
            column.extend(value if isinstance(value, list) else value.tolist())
    names = ["doc_id", "row_key", "pos", "run", "sure", "start", "end"]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def word_places(text: str) -> np.ndarray:
    """First and last-plus-one code point of each word."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    inside = ~((points == 32) | ((points >= 9) & (points <= 13)))
    return np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))).reshape(-1, 2)
