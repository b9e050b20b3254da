"""Exact ranks and percentiles of large groups: by range partitions and their sizes, never by one task's buffer of a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlark.runtime import materialize


def percentiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """by and one column for each share: the value at that share of the sorted values, interpolated in a line. Nulls are left out.

    Rows are sorted once over all tasks; equal values are split by their place in the input, so none is too many for a task.
    Of the sorted rows only those at a share's places go on.
    """
    keys = [f"__k{i}" for i in range(len(by))]
    rows = df.where(F.col(value).isNotNull()).select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.col(value).cast("double").alias("__v"), F.monotonically_increasing_id().alias("__t"))
    dealt = materialize(rows.repartitionByRange(*keys, "__v", "__t").withColumn("__p", F.spark_partition_id()))
    parts = dealt.groupBy(*keys, "__p").agg(F.count(F.lit(1)).alias("__n"))
    order = Window.partitionBy(*keys).orderBy("__p")
    before = F.coalesce(F.sum("__n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("__from", before).withColumn("__all", F.sum("__n").over(Window.partitionBy(*keys)))  # a row per task and group
    at = lambda q: (F.col("__all") - 1) * F.lit(float(q))
    wanted = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(at(q)), F.ceil(at(q))) for q in shares.values()])))
    asked = parts.withColumn("__at", F.explode(wanted)).where("__at >= __from AND __at < __from + __n").select(*keys, "__p", (F.col("__at") - F.col("__from") + 1).cast("int").alias("__i"), "__at", "__all")
    placed = dealt.withColumn("__i", F.row_number().over(Window.partitionBy("__p", *keys).orderBy("__v", "__t"))).select(*keys, "__p", "__i", "__v")
    same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in keys] + [a["__p"] == b["__p"], a["__i"] == b["__i"]]
    hit = asked.join(placed, same(asked, placed)).select(*[asked[k] for k in keys], "__at", "__all", "__v")
    one = lambda f, q: F.max(F.when(F.col("__at") == f(at(q)), F.col("__v")))
    ends = hit.groupBy(*keys).agg(F.max("__all").alias("__all"), *[one(f, q).alias(f"__{s}{i}") for i, q in enumerate(shares.values()) for s, f in (("lo", F.floor), ("hi", F.ceil))])
    part = lambda i, q: F.col(f"__lo{i}") + (F.col(f"__hi{i}") - F.col(f"__lo{i}")) * (at(q) - F.floor(at(q)))
    return ends.select(*[F.col(k).alias(c) for c, k in zip(by, keys, strict=True)], *[part(i, q).alias(n) for i, (n, q) in enumerate(shares.items())])


def joined(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """left with right's further columns, matched by `by`, nulls alike; without keys both are one row."""
    if not by:
        return left.select("*", *[right.select(c).scalar().alias(c) for c in right.columns])
    names = [f"__j{i}" for i in range(len(by))]
    other = right.select(*[F.col(c).alias(n) for c, n in zip(by, names, strict=True)], *[c for c in right.columns if c not in by])
    return left.join(other, [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(by, names, strict=True)], "left").drop(*names)
