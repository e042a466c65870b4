"""Ordered look-behind and look-ahead that survive a hot key.

A window over one key puts all rows of that key into one task. Here the ordered rows of a key are cut into
blocks of a fixed position range; windows run inside (key, block), one small row per block carries what later
or earlier blocks need, and those rows alone are ordered per key. With ``n`` positions in a key a task sees at
most ``block_rows`` rows, and the carry window ``n / block_rows`` rows. Positions must be non-negative, unique
within a key and roughly dense; any spacing is right, very sparse ones only make blocks smaller.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 1_000_000
#: Rows of a task that sorts them by several windows.
TASK_ROWS = 100_000
_BLK = "__blk"


def tasks_for(df: DataFrame, rows: int = TASK_ROWS) -> int:
    """Tasks over which to deal tables of about the size of ``df``, so that none gets many more than ``rows`` rows.

    Told to ``repartition`` with keys, it is kept: partitions are not merged by their bytes, which say little of the memory
    that sorted rows take. There are as many tasks as shuffle partitions at least.
    """
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(df.count() / rows))


def _names(keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def with_block(df: DataFrame, pos: str, block_rows: int) -> DataFrame:
    return df.withColumn(_BLK, F.expr(f"`{pos}` div {int(block_rows)}"))


def over(fn: str, arg: str, keys: list[str], pos: str) -> Column:
    """``fn(arg) IGNORE NULLS`` over rows of the keys in position order; one sort serves lag and lead."""
    part = ", ".join(f"`{k}`" for k in keys)
    return F.expr(f"{fn}(`{arg}`) IGNORE NULLS OVER (PARTITION BY {part} ORDER BY `{pos}`)")


def nearest(
    df: DataFrame,
    keys,
    pos: str,
    before: dict[str, Column] | None = None,
    after: dict[str, Column] | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add, per name, the nearest non-null value strictly before or after each row of the same keys.

    Key columns must not be null. A value that is never null (a struct) gives the previous or next row.
    """
    keys, before, after = _names(keys), before or {}, after or {}
    vb = {f"__b{i}": (n, c) for i, (n, c) in enumerate(before.items())}
    va = {f"__a{i}": (n, c) for i, (n, c) in enumerate(after.items())}
    d = with_block(df, pos, block_rows).withColumns({v: c for v, (_, c) in {**vb, **va}.items()})
    part = [*keys, _BLK]
    here = d.withColumns(
        {
            **{n: over("lag", v, part, pos) for v, (n, _) in vb.items()},
            **{n: over("lead", v, part, pos) for v, (n, _) in va.items()},
        }
    ).drop(*vb, *va)
    # max_by and min_by skip rows whose ordering value is null, so null values never become a carry.
    held = lambda v: F.when(F.col(v).isNotNull(), F.col(pos))
    edge = d.groupBy(*part).agg(
        *[F.max_by(v, held(v)).alias(v) for v in vb], *[F.min_by(v, held(v)).alias(v) for v in va]
    )
    carry = edge.select(
        *part,
        *[over("lag", v, keys, _BLK).alias(f"{v}c") for v in vb],
        *[over("lead", v, keys, _BLK).alias(f"{v}c") for v in va],
    )
    joined = here.join(carry, part, "left")
    return joined.withColumns(
        {n: F.coalesce(F.col(n), F.col(f"{v}c")) for v, (n, _) in {**vb, **va}.items()}
    ).drop(_BLK, *[f"{v}c" for v in {**vb, **va}])


def positions(df: DataFrame, keys, pos: str, name: str, block_rows: int = BLOCK_ROWS, start: int = 0) -> DataFrame:
    """Add the dense rank of each row in its key, counted across blocks."""
    keys = _names(keys)
    part = [*keys, _BLK]
    d = with_block(df, pos, block_rows)
    here = d.withColumn(name, F.row_number().over(Window.partitionBy(*part).orderBy(pos)))
    earlier = Window.partitionBy(*keys).orderBy(_BLK).rowsBetween(Window.unboundedPreceding, -1)
    base = d.groupBy(*part).agg(F.count(F.lit(1)).alias("__n")).select(
        *part, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__base")
    )
    total = (F.col(name) + F.col("__base") + (start - 1)).cast("bigint")
    return here.join(base, part).withColumn(name, total).drop(_BLK, "__base")


def first_of(df: DataFrame, keys, pos: str, columns: list[str] | None = None) -> DataFrame:
    """Row with the lowest position per key, as a partial aggregate rather than a window."""
    return _pick(df, keys, pos, columns, F.min_by)


def last_of(df: DataFrame, keys, pos: str, columns: list[str] | None = None) -> DataFrame:
    """Row with the highest position per key."""
    return _pick(df, keys, pos, columns, F.max_by)


def _pick(df: DataFrame, keys, pos: str, columns, pick) -> DataFrame:
    keys = _names(keys)
    rest = columns or [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys).agg(pick(F.struct(*rest), F.col(pos)).alias("__row")).select(*keys, *[f"__row.{c}" for c in rest])
    )


def top_per_key(df: DataFrame, keys, order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key. Spark trims each map task to ``k`` rows per key before the shuffle."""
    w = Window.partitionBy(*_names(keys)).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def in_lists(df: DataFrame, key: str, columns: list[str], name: str, size: int = 1000, salts: int = 32) -> DataFrame:
    """(key, name): the rows of a key as arrays of structs, to be met by one long text per key.

    A text joined to these is copied once for each array, not for each row. Rows are dealt to ``salts`` lists per key;
    lists so short that all of a key's together have no more than ``size`` rows are merged, so most keys have one array,
    and a key with very many rows has one for each salt.
    """
    salt = F.pmod(F.xxhash64(*columns), F.lit(salts)).alias("__salt")
    dealt = df.groupBy(key, salt).agg(F.collect_list(F.struct(*columns)).alias("__rows"))
    own = F.when(F.size("__rows") * salts > size, F.col("__salt")).otherwise(-1).alias("__salt")
    return dealt.groupBy(key, own).agg(F.flatten(F.collect_list("__rows")).alias(name)).drop("__salt")
