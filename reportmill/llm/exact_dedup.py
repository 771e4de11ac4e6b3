"""Exact deduplication with a heavy-hitter split.

A Misra-Gries frequent-items summary (``approx_top_k``) names candidate digests in one pass and
bounded memory. Their groups are then counted and decided exactly, and the few verified winners are
broadcast, so rows of frequent digests never enter a shuffle. All other digests take the ordinary
shuffle, where no group is large. Everything is built from DataFrame and SQL functions.

Defined results: null text counts as empty; all empty texts are one group; null ids order last; rows
that agree in id and text are copies of each other of which one stays; extra columns are ignored by
:func:`exact_dedup` and carried by :func:`drop_exact_copies`; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportmill.llm.common import SEPARATORS, materialize, remaining

#: Candidates asked of the summary, and counters that it may hold: both bound what is broadcast.
TOP, COUNTERS = 1000, 10_000


def text_digest(text: Column) -> Column:
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SEPARATORS + "+", ""), 256)


def _preference() -> Column:
    """Smallest is best: most code points, then smallest id."""
    return F.struct((-F.col("len")).alias("neg"), F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("rid").alias("rid"))


def _decide(base: DataFrame, heavy_rows: int) -> DataFrame:
    """base: id, digest, len, rid. Adds keep_id, keep_rid and group_size."""
    top = base.select(F.explode(F.expr(f"approx_top_k(digest, {TOP}, {COUNTERS})")).alias("top")).select(F.col("top.item").alias("digest"))
    winners = materialize(
        base.join(F.broadcast(top), "digest").groupBy("digest").agg(F.count("*").alias("group_size"), F.min(_preference()).alias("best"))
        .filter(F.col("group_size") >= heavy_rows).select("digest", "group_size", F.col("best.id").alias("keep_id"), F.col("best.rid").alias("keep_rid")),
        "dedup-winners",
    )
    heavy = base.join(F.broadcast(winners), "digest")
    group = Window.partitionBy("digest")
    light = (
        base.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
        .withColumns({"group_size": F.count("*").over(group), "best": F.min(_preference()).over(group)})
        .withColumns({"keep_id": F.col("best.id"), "keep_rid": F.col("best.rid")}).drop("best")
    )
    return heavy.select(*light.columns).unionAll(light)


def exact_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", heavy_rows: int = 64) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = materialize(docs.select(F.col(id_col).alias("id"), text_digest(text).alias("digest"), F.char_length(text).alias("len"), F.monotonically_increasing_id().alias("rid")), "dedup-digests")
    return _decide(base, heavy_rows).select(
        F.col("id").alias(id_col), "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), F.col("digest").alias("text_sha256")
    )


def drop_exact_copies(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", heavy_rows: int = 64) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    row, text = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(text_col), F.lit(""))
    packed = docs.select(row, F.col(id_col).alias("id"), text_digest(text).alias("digest"), F.char_length(text).alias("len"))
    base = materialize(packed.select("id", "digest", "len").withColumn("rid", F.monotonically_increasing_id()), "dedup-digests")
    decided = _decide(base, heavy_rows)
    # A loser may agree with its winner in id, digest and length; of such rows, which nothing tells apart, one is taken.
    key = F.struct("id", "digest", "len").alias("key")
    lost, won = F.col("rid") != F.col("keep_rid"), F.col("rid") == F.col("keep_rid")
    marks = decided.groupBy(key).agg(F.bool_or(lost).alias("lost"), F.bool_or(won).alias("twins")).filter("lost").select("key", "twins")
    return remaining(packed.select("row", key), marks, "key").select("row.*")
