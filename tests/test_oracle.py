"""Every registered query against its SQL on DuckDB at the smallest scale, and the shape of its plan."""

import glob
import os

import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry_points

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")

QUERIES, ORACLES = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def cell(x):
    if x is None or x is pd.NA or x is pd.NaT:
        return "NULL"
    if isinstance(x, (bool, np.bool_)):
        return str(bool(x))
    if isinstance(x, (int, np.integer)):
        return str(int(x))
    if isinstance(x, (float, np.floating)):
        return "NULL" if x != x else str(int(x)) if abs(x) < 1e15 and x == int(x) else f"{x:.9g}"
    return str(x)


def canonical(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(cell(v) for v in row) for row in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name
    got = df.toPandas()
    if name in ORACLES:
        want = con.execute(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert canonical(got) == canonical(want)


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
