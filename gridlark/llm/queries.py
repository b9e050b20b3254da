"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.runtime import table

from . import exact, licenses, mixing, piece, pii, quality, simhash, substrings, tokencount, toxicity

MODEL = "piece_bpe_32k.model"


def model_path(name: str = MODEL) -> str:
    """Path of a public tokenizer file, as installed on the driver."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), model_path())


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.quality_rules(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_bytes(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.groups(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.takes(table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece.encode_digests(table(spark, sf_dir, "documents"), model_path())


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.find_pii(docs, pii.train(docs))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


# ---- the parts of the results above that SQL can express


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and base verdict of op3, through its operator."""
    return quality.quality_rules(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


QUALITY_BASE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w FROM d),
l AS (SELECT doc_id, count(*) - count(DISTINCT s) AS dups FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS s FROM d) WHERE regexp_matches(s, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
i AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2),
k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM i),
p AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM k, (SELECT unnest([0, 1, 2]) AS o) WHERE n > 1 GROUP BY doc_id),
r AS (SELECT doc_id, len(w)::bigint AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dups, 0) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words FROM w LEFT JOIN l USING (doc_id) LEFT JOIN p USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM r
"""


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and targets by source, as op6 uses them."""
    sizes = table(spark, sf_dir, "documents").select("source", mixing.size_of(F.col("text")).alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"))
    return mixing.targets(sizes).select("source", "source_size", F.round("target", 6).alias("target"))


MIXING_TARGETS = """
WITH s AS (SELECT source, sum(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')))::bigint AS n FROM documents GROUP BY source),
r AS (SELECT source, n, ([5, 2, 1])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::int] AS w FROM s),
c AS (SELECT 2.0 * n / w AS level FROM r WHERE n > 0),
f AS (SELECT level, (SELECT sum(least(2.0 * n, w * level)) FROM r) AS filled FROM c),
b AS (SELECT max(level) FILTER (filled <= t) AS low, max(filled) FILTER (filled <= t) AS held FROM f, (SELECT 1.5 * sum(n) AS t FROM r)),
x AS (SELECT coalesce(low, 0) + (1.5 * (SELECT sum(n) FROM r) - coalesce(held, 0)) / nullif((SELECT sum(w) FROM r WHERE n > 0 AND 2.0 * n / w > coalesce(low, 0)), 0) AS level FROM b)
SELECT source, n AS source_size, round(CASE WHEN level IS NULL THEN 2.0 * n ELSE least(2.0 * n, w * level) END, 6)::double AS target FROM r, x
"""


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pattern counts of op9, through its operator."""
    return pii.find_pii(table(spark, sf_dir, "documents")).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


PII_BASE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+') AS e, regexp_extract_all(t, '[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)') AS i,
  regexp_extract_all(t, '[0-9]([\\x20-]?[0-9])+') AS c, regexp_extract_all(t, '\\+[0-9][\\x20().0-9-]+[0-9]') AS p FROM d),
z AS (SELECT doc_id, len(e)::bigint AS n_email, list_transform(i, lambda x: list_transform(string_split(x, '.'), lambda y: ltrim(y, '0'))) AS i, list_transform(c, lambda x: reverse(regexp_replace(x, '[^0-9]', '', 'g'))) AS c, list_transform(p, lambda x: length(regexp_replace(x, '[^0-9]', '', 'g'))) AS p FROM m)
SELECT doc_id, n_email, len(list_filter(i, lambda x: list_max(list_transform(x, lambda y: CASE WHEN length(y) > 3 THEN 999 WHEN y = '' THEN 0 ELSE y::int END)) <= 255))::bigint AS n_ip,
  len(list_filter(c, lambda x: length(x) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(x) + 1), lambda k: CASE WHEN k % 2 = 1 THEN substr(x, k, 1)::int ELSE (substr(x, k, 1)::int * 2) // 10 + (substr(x, k, 1)::int * 2) % 10 END)) % 10 = 0))::bigint AS n_card,
  len(list_filter(p, lambda x: x BETWEEN 9 AND 15))::bigint AS n_phone FROM z
"""


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrase hits of op10, through its operator."""
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


LICENSE_BASE = """
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w),
h AS (SELECT doc_id, i - 1 AS i, label FROM i, (VALUES ('gnu general public license', 'gpl'), ('apache license', 'apache'), ('cc by', 'cc-by'), ('mit license', 'mit')) p(phrase, label) WHERE array_to_string(w[i : i + len(string_split(phrase, ' ')) - 1], ' ') = phrase),
g AS (SELECT doc_id, count(*) AS n, min(i) AS a, max(i) AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS l FROM h GROUP BY doc_id)
SELECT w.doc_id, len(w)::bigint AS n_words, coalesce(n, 0) AS n_base, a AS first_word, b AS last_word, coalesce(l, '') AS base_labels FROM w LEFT JOIN g USING (doc_id)
"""

_ALL = (op1_token_counts, op2_toxicity, op3_quality_rules, op4_suffix_dedup, op5_exact_dedup, op6_mixing, op7_sentencepiece, op8_simhash, op9_pii, op10_licenses)
QUERIES = {f.__name__: f for f in (*_ALL, quality_base, mixing_targets, pii_base, license_base)}
ORACLES = {"op5_exact_dedup": exact.ORACLE, "quality_base": QUALITY_BASE, "mixing_targets": MIXING_TARGETS, "pii_base": PII_BASE, "license_base": LICENSE_BASE}
