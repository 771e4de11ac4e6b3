"""Texts are encoded once where their pieces and what is read back from them are both wanted."""

import pytest

import corpus_pipeline
from reportmill.llm import queries, sentencepiece

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["pipeline", "op2_sentencepiece"])
def test_one_call_for_pieces_and_text(spark, name):
    found = queries.op2_sentencepiece(spark, SMALL) if name != "pipeline" else corpus_pipeline.encode(spark, spark.read.parquet(f"{SMALL}/documents.parquet"), SMALL)
    calls = [x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "ArrowEvalPython" in x]
    assert len(calls) == 1 and calls[0].count("(text") == 1


def test_read_back_is_both_functions(spark):
    v = sentencepiece.vocabulary(sentencepiece.model_path(spark))
    (to_ids, to_text), both = sentencepiece.coders(v, spark), sentencepiece.read_back(v, spark)
    texts = [None, "", "same", "same", "a ▁ 日本\x00", " two  spaces \n", "long text " * 60_000, "some words " * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = df.select("text", both("text").alias("s"), to_ids("text").alias("ids")).select("text", "s.*", "ids", to_text("ids").alias("back")).toDF("x", "found", "text", "ids", "back").collect()
    assert all(r.found == r.ids and r.text == r.back == r.x for r in rows)
