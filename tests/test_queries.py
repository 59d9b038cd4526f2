"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from sedge.plans import catalogue

DATA = "/root/testdata/sf0.001"


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    clean = lambda x: None if pd.isna(x) else round(float(x), 5) if isinstance(x, float) else x
    return sorted((tuple(map(clean, r)) for r in df.itertuples(index=False, name=None)), key=repr)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, name):
    got = catalogue.QUERIES[name](spark, DATA).toPandas()
    if name not in catalogue.ORACLE_SQL:
        assert len(got)
        return
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    want = con.execute(catalogue.ORACLE_SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
