"""Connected components over a links table, by repeated star contraction; few links are contracted by the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.runtime import materialize


def forest(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as (node, root) pairs, of the graph of links (i, j) on n nodes."""
    root = np.arange(n)
    while True:
        a, b = root[i], root[j]
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        if (lo == hi).all():
            break
        np.minimum.at(root, hi, lo)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    node = np.nonzero(root != np.arange(n))[0]
    return node, root[node]


#: Links, of 16 bytes each, up to which rounds on the cluster cost more than sending them to the driver.
FEW = 200_000


def components(links: DataFrame, few: int = 0) -> DataFrame:
    """(node, root) for every node of links (a, b) but the roots, root the smallest node reachable.

    Links that are counted to be no more than few (ids must be whole numbers then) are contracted by the driver.

    More alternate large-star and small-star steps until no link changes. Every step
    first finds each node's smallest neighbour (a minimum, pre-aggregated per task)
    and then re-hangs links below it, so a node with many links is never gathered
    in one place. Each round is checkpointed.
    """
    e = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if few and e.count() <= few:
        ends = e.toArrow()
        names, at = np.unique(np.concatenate([ends["a"].to_numpy(), ends["b"].to_numpy()]), return_inverse=True)
        node, root = forest(len(names), at[: len(ends)], at[len(ends) :])
        return links.sparkSession.createDataFrame(pa.table({"node": names[node], "root": names[root]}))
    before = None
    while True:
        # large star: neighbours above a node hang below the smallest of its neighbourhood
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("__m")).select(F.col("a").alias("__n"), F.least("a", "__m").alias("__m"))
        up = both.where("b > a").join(least, F.col("a") == F.col("__n")).select(F.col("b").alias("a"), F.col("__m").alias("b"))
        e2 = up.where("a <> b").distinct()
        # small star: a node's smaller neighbours, and itself, hang below the smallest of them
        least = e2.groupBy("a").agg(F.min("b").alias("__m")).withColumnRenamed("a", "__n")
        down = e2.join(least, F.col("a") == F.col("__n")).select(F.col("b").alias("a"), F.col("__m").alias("b")).where("a <> b")
        hung = least.select(F.col("__n").alias("a"), F.col("__m").alias("b"))
        e = materialize(down.unionByName(hung).distinct())
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).collect()[0]
        if now == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
