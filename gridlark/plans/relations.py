"""Derived relations over the driver tables, so that grid and point operators meet data of their own kind.

Each is one portable projection, used as a DataFrame here and as a common table expression in the oracle SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridlark.runtime import table

D = "CAST({} AS DOUBLE)".format

RELATIONS: dict[str, tuple[str, list[str]]] = {
    # points on the globe with a year
    "pts": ("orders", ["CAST(o_orderkey AS STRING) AS sample_id", "o_orderkey AS ord", f"{D(-180)} + {D('o_orderkey * 7919 % 360000')} / {D(1000)} AS lon", f"{D(-80)} + {D('o_custkey * 104729 % 160000')} / {D(1000)} AS lat", "CAST(year(o_orderdate) + 22 AS INT) AS year", "o_orderpriority AS split", "o_custkey AS cust"]),
    # the same with bad coordinates and ids
    "badpts": ("orders", ["CASE WHEN o_orderkey % 83 = 0 THEN '' ELSE CAST(o_orderkey % 14000 AS STRING) END AS sample_id", "o_orderkey AS ord", f"CASE WHEN o_orderkey % 97 = 0 THEN {D(999)} ELSE {D(-180)} + {D('o_orderkey * 7919 % 36000')} / {D(100)} END AS lon", f"CASE WHEN o_orderkey % 89 = 0 THEN CAST('NaN' AS DOUBLE) ELSE {D(-80)} + {D('o_custkey * 104729 % 160')} END AS lat", "o_orderpriority AS split", "o_orderstatus AS label"]),
    # points in metres over the raster below
    "loc": ("orders", ["o_orderkey AS ord", f"{D(500000)} + {D('o_orderkey % 400')} AS x", f"{D(10000000)} - {D('o_custkey % 300')} AS y", "CAST(year(o_orderdate) + 22 AS INT) AS year"]),
    # a raster, 25 pixels wide, of embedding vectors
    "pix": ("embeddings", ["CAST(floor(vec_id / 25) AS BIGINT) AS row", "CAST(vec_id % 25 AS BIGINT) AS col", "CAST(floor(floor(vec_id / 25) / 8) AS BIGINT) AS tile", "vec_id", "embedding", "label"]),
    # 25 boxes of ten by twenty degrees
    "tiles": ("nation", ["n_name AS grid_id", "n_nationkey AS k", f"{D('-180 + 10 * n_nationkey')} AS x0", f"{D('-170 + 10 * n_nationkey')} AS x1", f"{D('-50 + 20 * n_regionkey')} AS y0", f"{D('-30 + 20 * n_regionkey')} AS y1", "n_regionkey AS region_id"]),
    # vectors as points with weights and polygons
    "vecs": ("embeddings", ["CAST(vec_id AS STRING) AS sample_id", "vec_id", "label AS polygon_id", "embedding", f"{D('1 + vec_id % 5')} AS weight"]),
    "dups": ("lineitem", ["concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS sample_id", "l_orderkey AS ord", "l_returnflag AS split", "l_quantity AS lon", "l_discount AS lat"]),
    "reqlog": ("events", ["event_id", "ts", "user_id AS worker", "CASE event_type WHEN 'error' THEN 'request_failed' WHEN 'click' THEN 'request_succeeded' WHEN 'view' THEN 'request_retry' WHEN 'signup' THEN 'request_started' ELSE 'request_timeout' END AS event", "value AS latency", "props"]),
}


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, exprs = RELATIONS[name]
    return table(spark, sf_dir, source).selectExpr(*exprs)


def with_sql(*names: str) -> str:
    """WITH clause that defines the named relations for the oracle."""
    return "WITH " + ", ".join(f"{n} AS (SELECT {', '.join(RELATIONS[n][1])} FROM {RELATIONS[n][0]})" for n in names)
