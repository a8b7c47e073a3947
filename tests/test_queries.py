"""Every query with SQL beside it, on the smallest test tables."""

import os
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from countweave.plans import catalogue

D = os.environ.get("COUNTWEAVE_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


def cells(df):
    df = df[sorted(df.columns)].astype(object)

    def cell(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return None
        if isinstance(v, bool) or not isinstance(v, (int, float)) and not (hasattr(v, "dtype") and v.dtype.kind in "iuf"):
            return str(v)
        return round(float(v), 3) + 0.0

    return sorted((tuple(cell(v) for v in r) for r in df.itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(D).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return c


def test_names_agree():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    a = catalogue.queries()[name](spark, D).toPandas()
    b = con.execute(catalogue.oracle_sql()[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert cells(a) == cells(b)
