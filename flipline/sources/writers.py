"""Sinks: fixed-column CSV, entry and header JSON, versioned rewrites of the result table."""

from __future__ import annotations

import json
import math
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIST_SEPARATOR = " ; "


def csv_columns(df: DataFrame, columns: list[str]) -> list[Column]:
    """Columns in fixed order; lists joined, absent ones empty."""
    types = {f.name: f.dataType for f in df.schema.fields}

    def one(c: str) -> Column:
        if c not in types:
            return F.lit("").alias(c)
        if isinstance(types[c], T.ArrayType):
            return F.concat_ws(LIST_SEPARATOR, F.col(c)).alias(c)
        return F.col(c)

    return [one(c) for c in columns]


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """CSV with a header in every part file; quotes are doubled so that other readers understand them."""
    out = df.select(*csv_columns(df, columns))
    out.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_summary_json(entries: DataFrame, header: DataFrame, path: str, facts: dict | None = None) -> None:
    """Entries as JSON lines and one header document with counters beside them."""
    entries.write.mode("overwrite").json(f"{path}/entries")
    named = {k: F.lit(v if isinstance(v, (int, float, str, bool)) else json.dumps(v)) for k, v in (facts or {}).items()}
    header.withColumns(named).coalesce(1).write.mode("overwrite").json(f"{path}/header")


def _versions(spark: SparkSession, root: str) -> list[int]:
    """Complete versions under a table folder, found by the marker Spark leaves when a write has succeeded."""
    jvm = spark._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{root}/v*/_SUCCESS")
    fs = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(pattern) or []
    return sorted(int(str(s.getPath().getParent().getName())[1:]) for s in found)


def read_current(spark: SparkSession, root: str) -> DataFrame:
    done = _versions(spark, root)
    if not done:
        raise FileNotFoundError(f"no complete version under {root}")
    return spark.read.parquet(f"{root}/v{done[-1]:06d}")


def overlay_write(df: DataFrame, root: str) -> str:
    """Write a new version of a table beside the old one; readers switch once it is complete.

    The rows go to a folder of their own, which takes the next free number by one rename. So a lost job leaves the last
    complete version in place, and of two writers each gets a number: a rename that comes second lands inside the
    version that the other has just set down, where readers skip it, and is moved on to the next number.
    """
    spark = df.sparkSession
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    name = f"_new-{uuid.uuid4().hex}"
    staged = f"{root}/{name}"
    df.write.parquet(staged)
    fs = path_of(staged).getFileSystem(spark._jsc.hadoopConfiguration())
    done = _versions(spark, root)
    number = (done[-1] if done else 0) + 1
    while True:
        path = f"{root}/v{number:06d}"
        number += 1
        if fs.exists(path_of(path)):
            continue
        if not fs.rename(path_of(staged), path_of(path)):
            if fs.exists(path_of(path)):
                continue
            raise OSError(f"cannot move {staged} to {path}")
        if not fs.exists(path_of(f"{path}/{name}")):
            return path
        staged = f"{path}/{name}"


def write_folders(df: DataFrame, path: str, folder: str, value: str, order: str | None = None, rows: int = 2000) -> None:
    """Write text files, one per value of ``folder``: ``path/folder=value/part-0.txt`` with its lines, by ``order`` if named.

    Spark deals the folders over a task for each ``rows`` rows, whatever their bytes, and sorts them; a task streams its
    rows into one open file after another. A file system that pyarrow does not know is written by Spark's text writer.
    """
    names = [F.col(folder).cast("string").alias("folder"), F.col(value).alias("value"), *([F.col(order).alias("order")] if order else [])]
    tasks = max(1, math.ceil(df.count() / rows))
    d = df.select(*names).repartition(tasks, "folder").sortWithinPartitions("folder", *(["order"] if order else [])).select("folder", "value")
    uri = re.sub("^file:/+", "/", path)
    try:
        fs.FileSystem.from_uri(uri)
    except (OSError, ValueError):
        d.write.partitionBy("folder").text(path)
        return

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, root = fs.FileSystem.from_uri(uri)
        now, out, files = None, None, 0
        for batch in batches:
            for name, line in zip(batch["folder"].to_pylist(), batch["value"].to_pylist(), strict=True):
                name = "__HIVE_DEFAULT_PARTITION__" if name in (None, "") else quote(name, safe=" -_.~,;@+()&!$")
                if name != now:
                    if out:
                        out.close()
                    target.create_dir(f"{root}/folder={name}")
                    now, out, files = name, target.open_output_stream(f"{root}/folder={name}/part-0.txt"), files + 1
                out.write(f"{line or ''}\n".encode())
        if out:
            out.close()
        yield pa.RecordBatch.from_pydict({"files": pa.array([files], pa.int64())})

    # A task that runs again writes the same files again.
    d.mapInArrow(run, "files long").write.format("noop").mode("overwrite").save()
