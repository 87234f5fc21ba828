"""Every catalogue query against its SQL."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from geoloom.plans.catalog import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


def rows(df):
    """Rows as sorted tuples of text, columns by name, numbers rounded."""
    cols = sorted(df.columns)
    def text(x):
        if x is None or x is pd.NA or x is pd.NaT or x != x:
            return "null"
        return repr(round(float(x), 6)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return cols, sorted(tuple(text(x) for x in r) for r in df[cols].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name in ORACLES:
        assert rows(got) == rows(db.execute(ORACLES[name]).df())
    else:
        assert len(got) > 0
