"""A corpus pipeline of five stages: toxicity, exact dedup, near dedup, mixing, encoding.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor
kept. run() writes each stage's result as Parquet into the cluster's shared folder
and reads it again as the next stage's docs; a stage's input is deleted once its result
is written. All stages but the last return the columns of documents.

Defined cases: null and empty texts count as empty, are equal to each other and take no
part in the mix; null ids sort last; rows are known by id and text, so repeated ids with
different texts stay apart and repeated rows are copies; null sources are a source;
very long texts go through whole; an empty table gives an empty result; further columns
are carried along up to the mix.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from gridlark.llm import exact, mixing, nearcopies, piece, toxicity
from gridlark.llm.queries import model_path
from gridlark.runtime import drop_folder, shared_folder, short_batches, table


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on labelled rows that are not held out, lets pass."""
    short_batches(spark)
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact.dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: SimHash comparison of 5-word shingles, verified to a Jaccard similarity of 0.8."""
    short_batches(spark)
    return nearcopies.dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's words as documents: one row for each document and pass over its source."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every mixed document."""
    short_batches(spark)
    return piece.encode_digests(docs, model_path())


STAGES = [("toxicity", clean), ("exact dedup", exact_dedup), ("near dedup", near_dedup), ("mixing", mix), ("encoding", encode)]

#: No SQL: the model, the fingerprints and the tokenizer have no counterpart there.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if k:
            drop_folder(spark, f"{folder}/{k - 1}")
    return docs
