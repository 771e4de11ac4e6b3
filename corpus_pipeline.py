"""A corpus pipeline over ``documents``: each stage works on what the one before it kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, and all but the last
return the columns of ``documents``. The result is one row for each document copy that the mix takes, encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportmill.llm import exact_dedup, mixing, near_sets, sentencepiece, simhash, toxicity
from reportmill.llm.common import discard, materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; the classifier learns from all labels."""
    scored = toxicity.score_toxicity(docs.select(F.struct("*").alias("row"), "doc_id", "text"), table(spark, sf_dir, "labels"), F.lit(True))
    return scored.filter(F.col("score") < toxicity.THRESHOLD).select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies by SimHash (op9's trees and components); of these, one of each group of texts whose five-word
    shingles are similar by 0.8 or more, which fingerprints alone do not find."""
    return near_sets.drop_near_copies(simhash.drop_near_copies(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, 0 to 3 times each, so that sources meet their target weights."""
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_pieces, ids (pieces of the text) and decoded_sha256 (of the text read back from them)."""
    both = sentencepiece.read_back(sentencepiece.vocabulary(sentencepiece.model_path(spark)), spark)
    coded = docs.select("doc_id", "source", both("text").alias("s"))
    return coded.select("doc_id", "source", F.size("s.ids").cast("long").alias("n_pieces"), "s.ids", F.sha2("s.text", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near),
    ("mixing sources", mix),
    ("SentencePiece", encode),
]

#: The classifier, fingerprints and pieces have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{k}")
            discard(before)
    return docs
