"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flipline.session import checkpoint_root

#: A key that holds more than one row in HOT_KEYS of a table is hot; so a table has fewer than HOT_KEYS hot keys.
HOT_KEYS = 10_000


def crc32_mod(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % F.lit(modulus)


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and go on from there, with no lineage behind them."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(checkpoint_root(spark))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write the rows as a table in the shared checkpoint folder and read them back; smaller on disk than ``cut``."""
    path = f"{checkpoint_root(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_counted(
    left: DataFrame, right: DataFrame, on: str, rows: str, total: int, spread: int = HOT_KEYS
) -> DataFrame:
    """Inner join of ``left`` with ``right``, unique in ``on`` and telling in ``rows`` how many rows of ``left`` a key has.

    ``total`` is the number of rows of ``left``. Keys with more than ``total / spread`` rows are fewer than
    ``spread``, so their side is broadcast within a proven bound and their rows stay where they are. Only the keys
    below that size are shuffled, and none of them can fill a task. Null keys match nothing.
    """
    hot = F.col(rows) * F.lit(spread) > F.lit(total)
    slim = right.drop(rows)
    hot_side = F.broadcast(right.where(hot).drop(rows))
    hot_keys = F.broadcast(right.where(hot).select(on))
    cold_side = slim.join(hot_keys, on, "left_anti")
    return left.join(hot_side, on).unionByName(left.join(hot_keys, on, "left_anti").join(cold_side, on))


def once(value: Column, fn: Callable[[Column], Column]) -> Column:
    """Apply ``fn`` to a value that is worked out once, however often ``fn`` names it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def map_texts(
    df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, rows: int = 512, chars: int = 4_000_000
) -> DataFrame:
    """Apply ``fn`` to slices of at most ``rows`` rows and about ``chars`` characters of a column ``text``, in Arrow.

    One row always fits a slice, however long its text is, so the memory of a task follows its longest text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = batch.to_pandas()
            sizes = frame["text"].str.len().fillna(0).to_numpy()
            at = 0
            while at < len(frame):
                end, held = at, 0
                while end < len(frame) and end - at < rows and (end == at or held + sizes[end] <= chars):
                    held += sizes[end]
                    end += 1
                yield from _as_batches(fn(frame.iloc[at:end]), arrow_schema)
                at = end

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    struct = _parse_datatype_string(schema)
    arrow_schema = to_arrow_schema(struct)
    return df.mapInArrow(run, struct)


def _as_batches(frame: pd.DataFrame, schema: pa.Schema) -> list[pa.RecordBatch]:
    return pa.Table.from_pandas(frame, schema=schema, preserve_index=False).to_batches()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
