"""Integer vectors from embeddings, shared by the operators on vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: An entry c becomes floor(SCALE * c).
SCALE = 256


def usable(column: str) -> Column:
    """Whether the vector and all its entries are there and finite; an empty vector is."""
    fine = F.forall(column, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.col(column).isNotNull() & fine


def quantised(column: str, scale: int = SCALE) -> Column:
    """The vector of floor(scale * c), c as double; entries beyond a long become the nearest long."""
    return F.transform(column, lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("long"))


def widest(df: DataFrame, column: str) -> int:
    """The largest number of entries; 0 for an empty table."""
    return df.agg(F.max(F.size(column))).first()[0] or 0


def matrix(lists: pa.ListArray, dims: int) -> np.ndarray:
    """Rows of longs as a matrix; vectors shorter than ``dims`` are filled up with zeros."""
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if (sizes == dims).all():
        return flat.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims), np.int64)
    out[np.arange(dims) < sizes[:, None]] = flat
    return out
