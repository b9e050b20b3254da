"""What the training-data operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.runtime import materialize, ship

#: White space of the contracts: space and tab to carriage return, as a regular expression class.
SPACES = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"


def per_text(fn_maker: Callable[[], Callable[[list[str]], dict]], schema: str):
    """An Arrow-batched UDF: text column to a struct column.

    fn_maker runs once per task and returns a function from a list of texts
    (null becomes the empty text) to a dict of equally long columns. Batches
    are worked off in slices of bounded size, so memory does not follow the
    batch but the longest text.
    """
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    @F.pandas_udf(schema)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        fn = fn_maker()
        for s in batches:
            parts = [pd.DataFrame(fn(texts), columns=names) for texts in slices(s)]
            yield pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(fn([]), columns=names)
        del fn
        give_back()

    return run


def give_back() -> None:
    """Return freed memory to the system, since Python workers live on between tasks."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to trim
        pass


def slices(texts: Iterable, most: int = 1_000_000) -> Iterator[list[str]]:
    """Lists of whole texts of about `most` characters each (one text at least)."""
    part: list[str] = []
    size = 0
    for t in texts:
        t = t if isinstance(t, str) else ""
        part.append(t)
        size += len(t) + 50
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def annotate(df: DataFrame, udf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and the struct's fields; other columns of df are neither read nor returned."""
    ship(df.sparkSession)
    return df.select(F.col(id_col).alias(id_col), udf(text(text_col)).alias("__r")).select(id_col, "__r.*")


def text(name: str = "text") -> Column:
    """The text column with null as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


#: Rows up to which a slim table is broadcast.
BROADCAST = 2_000_000


def slight(slim: DataFrame) -> DataFrame:
    """A table of ids and digests, marked for broadcast where it is counted to be short, so that texts need not be shuffled."""
    slim = materialize(slim)
    return F.broadcast(slim) if slim.count() <= BROADCAST else slim


def digest_of(text: Column) -> Column:
    """What tells rows of one id apart."""
    return F.md5(text.cast("binary"))


def only_rows(docs: DataFrame, named: DataFrame, id_col: str, key: Column) -> DataFrame:
    """docs without the rows that named (__id, __key, stays) lists; of repeated rows listed as staying, one stays.

    Rows are known by id and key (a digest of the text), not by id alone, so rows that share an id don't go together.
    """
    named = materialize(named.select("__id", "__key", "stays").distinct())
    same = lambda other: docs[id_col].eqNullSafe(other["__id"]) & (key == other["__key"])
    gone = slight(named.select("__id", "__key"))
    out = docs.join(gone, same(gone), "left_anti")
    again = named.where("stays").select("__id", "__key")
    if not again.isEmpty():
        again = slight(again)
        back = docs.join(again, same(again), "left_semi").withColumn("__of", key)
        out = out.unionByName(back.dropDuplicates([id_col, "__of"]).drop("__of"))
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, sample: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[str], list[int]]:
    """Texts and labels (0, 1) of at most `sample` documents of each label.

    Ids and hashes are ranked, texts are fetched for the chosen rows only: what reaches the
    driver is at most 2 * sample whole texts, whatever repeats. An id with two labels counts as the larger.
    """
    marks = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y")).dropna().groupBy("__id").agg(F.max("__y").alias("__y"))
    # Ids are ranked by hash before texts are joined, so a bounded number of ids is broadcast.
    few = lambda y: marks.where(F.col("__y") == y).orderBy(F.xxhash64("__id"), "__id").limit(sample)
    ids = few(0).unionByName(few(1))
    rows = docs.select(F.col(id_col).alias("__id"), text(text_col).alias("__t"))
    met = rows.join(F.broadcast(ids), "__id").select("__id", "__y", "__t")
    rank = [F.xxhash64("__id"), F.col("__id"), digest_of(F.col("__t"))]
    # Of rows that share an id only as many as fit the bound are taken; an order by digest makes that the same on every run.
    out = []
    for y in (0, 1):
        out += met.where(F.col("__y") == y).orderBy(*rank).limit(sample).collect()
    return [r["__t"] for r in out], [r["__y"] for r in out]
