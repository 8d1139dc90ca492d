"""Every registered query of the rest of the library against its SQL in DuckDB."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

import __spark_entry__ as registry
from posegrid.plans import catalogue


def shown(v):
    if isinstance(v, float):
        return "nan" if v != v else f"{v:.6g}"
    if hasattr(v, "__len__") and not isinstance(v, (str, bytes)):
        return "[" + ",".join(map(shown, v)) + "]"
    return str(v)


@pytest.fixture(scope="module")
def tables(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_matches_sql(spark, sf_dir, tables, name):
    df = catalogue.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    found = tables.execute(catalogue.oracle_sql()[name])
    theirs = [c[0] for c in found.description]
    assert sorted(theirs) == columns
    at = [theirs.index(c) for c in columns]
    want = sorted(tuple(shown(r[k]) for k in at) for r in found.fetchall())
    got = sorted(tuple(shown(r[c]) for c in columns) for r in df.collect())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs_without_sql(spark, sf_dir, name):
    """What they compute is held against numpy in test_numeric and test_whole_views."""
    rows = catalogue.queries()[name](spark, sf_dir).collect()
    assert rows and all(any(v is not None for v in r) for r in rows)


def test_entry(spark):
    assert registry.entry(spark).columns
    assert set(registry.oracle_sql()) <= set(registry.queries())
