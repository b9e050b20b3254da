"""Exact dedup by content sort, in DataFrame operations only.

Sampled splitters range-partition the rows by their normalised content: its first
characters, then a content hash that separates texts with a common beginning. An
external sort by the full content places equal texts next to each other; each row's
whole text is compared with its neighbour's, rows that differ head a run, and a run's
smallest identifier and length are its group's.

A range cannot split equal keys, so groups counted as hot (over a share of all rows that
bounds their number) also carry a salt of the id. Their runs, one a salt, are merged the
same way: the heads' texts, one a run, are sorted and compared in full with their neighbours.
Digests are results only; they decide nothing.

Defined cases: null texts count as empty; ids that are null sort last, so such a row
stays only where all ids of its group are null (keep_id is null then); of repeated
rows with the same id and text one stays, and such rows share a salt; repeated ids with
different texts are rows of their own; very long texts are sorted and compared whole;
an empty table gives an empty result; only id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlark.runtime import materialize, parallelism

from .common import SPACES, only_rows, slight

#: A group is hot with more than HOT rows and more than one row in SHARE; so there are fewer than SHARE hot groups.
HOT = 256
SHARE = 20_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def hot_groups(docs: DataFrame, text_col: str, hot: int = HOT, share: int = SHARE) -> DataFrame:
    """Content hashes of hot groups, with the number of salts that cuts each into runs of at most the limit, about."""
    least = max(hot, docs.count() // share)
    counts = docs.select(F.xxhash64(normalised(F.col(text_col))).alias("__hot")).groupBy("__hot").agg(F.count(F.lit(1)).alias("__n"))
    return materialize(counts.where(F.col("__n") > least).select("__hot", F.ceil(F.col("__n") / least).cast("int").alias("__salts")))


def sorted_rows(docs: DataFrame, id_col: str, text_col: str, hot: int = HOT, share: int = SHARE) -> DataFrame:
    """One slim row per row of docs: __id, __hash, __salt (null: not hot), __run, __keep and __size of the run,
    __sha, __first (first of rows equal in id and text), and __text of the heads of salted runs."""
    many = F.broadcast(hot_groups(docs, text_col, hot, share))  # fewer than `share` rows
    rows = docs.select(F.col(id_col).alias("__id"), normalised(F.col(text_col)).alias("__text")).withColumn("__hash", F.xxhash64("__text"))
    rows = rows.join(many, F.col("__hash") == F.col("__hot"), "left")
    rows = rows.select("__id", "__text", F.substring("__text", 1, 32).alias("__start"), "__hash", F.pmod(F.xxhash64("__id"), F.col("__salts")).alias("__salt"))
    key = ["__start", "__hash", "__salt"]
    dealt = rows.repartitionByRange(parallelism(docs.sparkSession), *key)
    order = Window.partitionBy(*key).orderBy("__text", F.col("__id").asc_nulls_last())
    same_text = (F.row_number().over(order) > 1) & F.lag("__text").over(order).eqNullSafe(F.col("__text"))
    same_id = F.lag("__id").over(order).eqNullSafe(F.col("__id"))
    seen = dealt.withColumn("__head", ~same_text).withColumn("__first", ~(same_text & same_id))
    seen = seen.withColumn("__run", F.sum(F.col("__head").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    seen = seen.select("__id", "__start", "__hash", "__salt", "__run", "__first", F.sha2("__text", 256).alias("__sha"), F.when(F.col("__head") & F.col("__salt").isNotNull(), F.col("__text")).alias("__text"))
    run = Window.partitionBy(*key, "__run")  # the same ranges: no shuffle
    return seen.select("__id", "__hash", "__salt", "__run", F.min("__id").over(run).alias("__keep"), F.count(F.lit(1)).over(run).alias("__size"), "__sha", "__first", "__text")


def merged_runs(rows: DataFrame) -> DataFrame:
    """(hash, salt, run) of salted runs with the group's smallest id and size, by neighbouring full comparison of the heads."""
    heads = rows.where("__text is not null").select("__hash", "__salt", "__run", "__keep", "__size", "__text")
    order = Window.partitionBy("__hash").orderBy("__text", "__salt", "__run")
    differs = F.when(F.lag("__text").over(order).eqNullSafe(F.col("__text")), 0).otherwise(1)
    group = Window.partitionBy("__hash", "__group")
    heads = heads.withColumn("__differs", differs).withColumn("__group", F.sum("__differs").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return heads.select(F.col("__hash").alias("__h"), F.col("__salt").alias("__s"), F.col("__run").alias("__r"), F.min("__keep").over(group).alias("__least"), F.sum("__size").over(group).alias("__total"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, share: int = SHARE) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256."""
    rows = materialize(sorted_rows(docs, id_col, text_col, hot, share))
    runs = slight(merged_runs(rows))
    met = rows.join(runs, (F.col("__hash") == F.col("__h")) & (F.col("__salt") == F.col("__s")) & (F.col("__run") == F.col("__r")), "left")
    keep = F.when(F.col("__salt").isNull(), F.col("__keep")).otherwise(F.col("__least"))
    return met.select(
        F.col("__id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("__total", "__size").alias("group_size"),
        (F.col("__first") & F.col("__id").eqNullSafe(keep)).alias("kept"),
        F.col("__sha").alias("text_sha256"),
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, share: int = SHARE) -> DataFrame:
    """docs with one row of each group of equal texts; all columns stay."""
    found = groups(docs, id_col, text_col, hot, share).where(~F.col("kept"))
    named = found.select(F.col(id_col).alias("__id"), F.col("text_sha256").alias("__key"), F.col(id_col).eqNullSafe(F.col("keep_id")).alias("stays"))
    return only_rows(docs, named, id_col, F.sha2(normalised(F.col(text_col)), 256))


ORACLE = """
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS s FROM documents),
g AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY s) AS keep_id, count(*) OVER (PARTITION BY s) AS group_size, sha256(s) AS text_sha256 FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
