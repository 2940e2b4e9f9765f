"""Every query with a DuckDB statement gives the same rows on the smallest tables; the others run."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't here")
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def _norm(v):
    if v is pd.NaT or v is None:
        return None
    if isinstance(v, float):
        return None if v != v else round(v, 5)
    return pd.Timestamp(v).isoformat() if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    ours = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    result = duck.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    theirs = sorted((tuple(_norm(r[names.index(c)]) for c in cols) for r in result.fetchall()), key=repr)
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {n for n in QUERIES if n.startswith("p")}))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
