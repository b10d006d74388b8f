"""Every registered query of the library against its SQL in DuckDB."""

import glob
import os

import duckdb
import pandas as pd
import pytest
from hazardframe import plans

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    show = lambda v: "null" if v is None or v is pd.NA or v != v else repr(float(v)) if isinstance(v, float) else str(v)
    return sorted(tuple(map(show, r)) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    got = plans.QUERIES[name](spark, FOLDER).toPandas()
    if name not in plans.ORACLE_SQL:
        assert len(got)
        return
    want = duck.sql(plans.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    for c in got.columns:
        if got[c].dtype.kind in "iu" or want[c].dtype.kind in "iu":
            got[c], want[c] = got[c].astype("Int64"), want[c].astype("Int64")
    assert plain(got) == plain(want)
