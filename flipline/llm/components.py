"""Connected components of a graph given as edges, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flipline.llm.common import cut


def _star(edges: DataFrame, both: DataFrame) -> DataFrame:
    """Join every edge (u, v) of ``both`` with the least node beside u or u itself."""
    least = edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    hung = _star(both, both).where(F.col("v") > F.col("u"))
    return hung.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    hung = _star(edges, edges)
    moved = hung.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(hung.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """The least node reachable from each node that has a link: rows (u, root), roots left out.

    ``edges`` has long columns u and v. Self loops and repeats do no harm. Each round hangs neighbours under the
    least node in reach (large star), then the smaller ones (small star), so a path shortens by a factor each round
    and no pairs within a component arise: there are never more edges than at the start. Each round is written to
    the shared checkpoint folder. No edges give no rows.
    """
    pairs = edges.where(F.col("u") != F.col("v"))
    now = cut(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before, state = None, _state(now)
    while state != before:
        now = cut(_small_star(_large_star(now)))
        before, state = state, _state(now)
    return now.select("u", F.col("v").alias("root"))
