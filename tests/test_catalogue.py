"""Every query that has SQL, against DuckDB on the same small tables."""

import datetime
import math
import os

import duckdb
import pytest

import gridlark.catalogue_collections  # noqa: F401  (registers its queries)
import gridlark.catalogue_deliveries  # noqa: F401
from gridlark.catalogue import ORACLES, QUERIES

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return float(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    rows = df.collect()
    assert rows
    if name in ORACLES:
        res = duck.execute(ORACLES[name])
        cols = [c[0] for c in res.description]
        want = res.fetchall()
        assert sorted(cols) == sorted(df.columns)
        at = [cols.index(c) for c in sorted(cols)]
        key = lambda row: tuple((x is None, str(type(x)), x if x is not None else 0) for x in row)
        a = sorted((tuple(norm(r[c]) for c in sorted(cols)) for r in rows), key=key)
        b = sorted((tuple(norm(r[i]) for i in at) for r in want), key=key)
        assert len(a) == len(b)
        assert a == b, next((x, y) for x, y in zip(a, b, strict=True) if x != y)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan
        if name != "preflight_report":
            assert "BroadcastNestedLoopJoin" not in plan
