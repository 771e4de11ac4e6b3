"""Queries over the driver's tables, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reportmill.llm import chat, exact_dedup, filter_audit, jaccard_join, katz, mixing, periodic, quality, sentencepiece, simhash, suffix_dedup, toxicity, warc
from reportmill.llm.common import table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_sentencepiece(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    vocabulary = sentencepiece.vocabulary(model or sentencepiece.model_path(spark))
    both = sentencepiece.read_back(vocabulary, spark)
    coded = table(spark, sf_dir, "documents").select("doc_id", "text", both("text").alias("s"))
    coded = coded.select("doc_id", "text", "s.ids", F.col("s.text").alias("decoded"))
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_pieces"), sentencepiece.byte_pieces(F.col("ids"), vocabulary).cast("long").alias("n_byte_pieces"),
        F.xxhash64("ids").alias("ids_hash"), F.sha2("decoded", 256).alias("decoded_sha256"), F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"),
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_quality(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(said))
    back = chat.read_chat(chat.format_chat(turns.union(extra)))
    lines = F.transform("turns", lambda x: F.concat(F.coalesce(x["role"], F.lit("")), F.lit("\n"), x["text"], F.lit("\n")))
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def fold(modulus: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(modulus))


def op5_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score_corpus(table(spark, sf_dir, "documents"), fold(7) == 2)


def op6_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = warc.capture_histories(table(spark, sf_dir, "pages"))
    return merged.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "position")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = fold(3) == 1
    scored = toxicity.score_toxicity(docs.select("doc_id", "text"), labels, ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passage_words")


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = filter_audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = periodic.repeat_tail(F.col("text"), F.crc32(F.col("doc_id").cast("string")))
    found = periodic.periodic_runs(table(spark, sf_dir, "documents").select("doc_id", text.alias("text")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period"))))
    found = found.select("doc_id", "runs", "collapsed", best.alias("best"))
    lines = F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.n")).alias("length"), F.col("best.period").alias("period"),
        F.floor(-1000 * F.col("best.n") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


OP8_SQL = r"""
with d as (
  select doc_id, length(coalesce(text, '')) as n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256 from documents)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by text_sha256) as group_size,
  row_number() over w = 1 as kept, text_sha256
from d window w as (partition by text_sha256 order by n desc, doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mix_sources": op1_mix_sources,
        "op2_sentencepiece": op2_sentencepiece,
        "op3_quality_rules": op3_quality_rules,
        "op4_chat_format": op4_chat_format,
        "op5_katz_scores": op5_katz_scores,
        "op6_warc_archive": op6_warc_archive,
        "op7_toxicity": op7_toxicity,
        "op8_exact_dedup": op8_exact_dedup,
        "op9_simhash": op9_simhash,
        "op10_suffix_dedup": op10_suffix_dedup,
        "op11_jaccard_join": op11_jaccard_join,
        "op12_filter_audit": op12_filter_audit,
        "op13_periodic_runs": op13_periodic_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mix_sources": mixing.SQL, "op3_quality_rules": quality.SQL, "op4_chat_format": chat.SQL, "op6_warc_archive": warc.SQL, "op8_exact_dedup": OP8_SQL, "op10_suffix_dedup": suffix_dedup.SQL,
        "op11_jaccard_join": jaccard_join.SQL, "op12_filter_audit": filter_audit.SQL, "op13_periodic_runs": periodic.SQL,
    }
