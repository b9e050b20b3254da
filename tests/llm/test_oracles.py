"""Queries of the training-data operators that have SQL, against DuckDB on the same small tables."""

import duckdb
import pytest

from gridlark.llm.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
    res = con.execute(ORACLES[name])
    cols = [c[0] for c in res.description]
    df = QUERIES[name](spark, DIR)
    assert sorted(df.columns) == sorted(cols)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    assert got == sorted(res.fetchall(), key=repr)
