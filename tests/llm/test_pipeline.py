"""The pipeline's stages, each against a plain version of what it has to do to its own input."""

import re
from collections import Counter
from itertools import combinations

import pandas as pd
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from gridlark.llm import toxicity
from gridlark.llm.queries import model_path
from gridlark.runtime import table

DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages(spark, tmp_path):
    docs = table(spark, DIR, "documents")
    columns, ins, outs = docs.columns, [], []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        ins.append([r.asDict() for r in docs.collect()])
        out = stage(spark, docs, DIR)
        assert k == 4 or out.columns == columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        outs.append([r.asDict() for r in docs.collect()])
    ids = lambda rows: sorted(r["doc_id"] for r in rows)

    run = toxicity.scorer(toxicity.train(table(spark, DIR, "documents"), table(spark, DIR, "labels")))
    assert ids(outs[0]) == sorted(r["doc_id"] for r in ins[0] if run([r["text"] or ""])["predicted"][0] == 0)

    first = {}
    for r in sorted(ins[1], key=lambda r: r["doc_id"]):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or ""), r["doc_id"])
    assert ids(outs[1]) == sorted(first.values())

    sets = {}
    for r in ins[2]:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))
        sets[r["doc_id"]] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    near = [(i, j) for (i, a), (j, b) in combinations(sets.items(), 2) if not (a or b) or 5 * len(a & b) >= 4 * len(a | b)]
    least = {d: d for d in sets}
    for _ in sets:
        for i, j in near:
            least[i] = least[j] = min(least[i], least[j])
    assert ids(outs[2]) == sorted(d for d, c in least.items() if c == d)

    words = lambda rows: sum((Counter({r["doc_id"]: len(WORD.findall(r["text"] or ""))}) for r in rows), Counter())
    size, taken = words(ins[3]), words(outs[3])
    assert all(taken[d] <= 2 * size[d] for d in taken)
    assert abs(sum(taken.values()) - 1.5 * sum(size.values())) < 0.1 * sum(size.values())
    whole = {r["doc_id"]: Counter(WORD.findall(r["text"] or "")) for r in ins[3]}
    assert all(set(WORD.findall(r["text"])) <= set(whole[r["doc_id"]]) and r["n_chars"] == len(r["text"]) for r in outs[3])

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path())
    assert sorted((r["doc_id"], r["n_tokens"]) for r in outs[4]) == sorted((r["doc_id"], len(sp.encode(r["text"]))) for r in ins[4])


def test_run_has_the_last_stages_rows(spark):
    assert corpus_pipeline.run(spark, DIR).count() > 100


def test_stages_take_an_empty_table_and_null_columns(spark):
    for rows in ([], [(1, None, None, None, None), (2, "some text", None, None, None), (None, "x", "en", "s", 1)]):
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, DIR).count() >= 0


def test_python_gets_short_batches(spark):
    """After a stage that runs Python no batch of texts holds thousands of rows; a number that the session's owner named stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    size = F.pandas_udf(lambda s: pd.Series([len(s)] * len(s)), "int")
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit("en").alias("lang"), F.lit("web").alias("source"), F.lit(9).alias("n_chars")).coalesce(1)
    try:
        corpus_pipeline.encode(spark, docs, "")
        assert docs.select(F.max(size("text"))).first()[0] <= 1000
        spark.conf.set(name, 2000)
        corpus_pipeline.encode(spark, docs, "")
        assert docs.select(F.max(size("text"))).first()[0] == 2000
    finally:
        spark.conf.unset(name)
