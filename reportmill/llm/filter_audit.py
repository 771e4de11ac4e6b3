"""What filters of a corpus do to each other, whatever their order.

Every document has a mask of the filters that it fails. Documents are counted by part and mask, which leaves at most 2^filters cells a
part; only these cells are set against the steps of all orders (long form: cell, order, step). A running bit-or over the steps of an order
tells what a cell failed before, conditional sums give the metrics of a step, and totals over a filter's steps its Shapley value.

Defined results: null text is empty and a null part the empty string; a text fails as a copy if a smaller id has the same text, wherever;
a row without an id is never a copy, nor is another a copy of it; repeated rows count each; of several labels of an id any counts; documents
without labels are neither good nor toxic; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import permutations
from string import ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportmill.llm.common import words

LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 50, 65, 5, r"[#$%&*|]"
#: The copies' filter is the last one; what it says depends on other rows.
FILTERS = "ABCDE"


def text_filters(text: Column) -> dict[str, Column]:
    """The filters that look at a text alone: whether it fails."""
    text = F.coalesce(text, F.lit(""))
    found = words(text)
    capitals = F.char_length(text) - F.char_length(F.translate(text, ascii_uppercase, ""))
    return {
        "A": F.size(found) < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(found)) < LEAST_DISTINCT * F.size(found),
        "C": 100 * capitals.cast("long") > MOST_CAPITALS * F.char_length(text),
        "D": text.rlike(SYMBOLS),
    }


def mask_cells(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", part_col: str = "source") -> DataFrame:
    """part, mask (bit k: fails filter k), docs, good, toxic: one row for each part and mask.

    Copies are decided by digest. Rows of one digest, part and label are counted together before they meet, so a text that a third of
    all rows has is no more than a few rows by then."""
    mask = sum((F.when(fails, F.lit(1 << k)).otherwise(0) for k, fails in enumerate(text_filters(F.col(text_col)).values())), F.lit(0))
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), mask.cast("int").alias("mask"), F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("digest"))
    marks = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(*[F.coalesce(F.bool_or(F.col(c) == 1), F.lit(False)).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))])
    # Rows without an id have no label; by their digest they are spread over tasks.
    spread = F.when(F.col("id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0)).alias("spread")
    told = rows.select("*", spread).join(marks.withColumn("spread", F.lit(0).cast("long")), ["id", "spread"], "left")
    key = ["digest", "part", "mask", "good", "toxic"]
    told = told.select("id", "digest", "part", "mask", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])
    by_id = told.groupBy(*key, "id").agg(F.count("*").alias("n"))
    alike = by_id.groupBy(*key).agg(
        F.sum("n").alias("n"), F.min("id").alias("first"), F.min_by("n", "id").alias("n_first"), F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("n_null"))
    least = F.min("first").over(Window.partitionBy("digest"))
    alike = alike.withColumn("originals", F.col("n_null") + F.when(F.col("first") == least, F.col("n_first")).otherwise(0))
    copy = F.lit(1 << FILTERS.index("E"))
    split = F.array(F.struct(F.col("mask").alias("mask"), F.col("originals").alias("n")), F.struct(F.col("mask").bitwiseOR(copy).alias("mask"), (F.col("n") - F.col("originals")).alias("n")))
    cells = alike.select("part", "good", "toxic", F.explode(split).alias("c")).select("part", "good", "toxic", "c.mask", "c.n").filter("n > 0")
    return cells.groupBy("part", "mask").agg(F.sum("n").alias("docs"), *[F.coalesce(F.sum(F.when(F.col(c), F.col("n"))), F.lit(0)).alias(c) for c in ("good", "toxic")])


def audit(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """cells: part, mask, docs, good, toxic. One row for each part, order of the filters and step:
    kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley, as counts of documents."""
    orders = F.array(*[F.lit("".join(x)) for x in permutations(filters)])
    steps = F.transform(F.sequence(F.lit(1), F.lit(len(filters))), lambda k: k.cast("int"))
    # One exchange serves the windows over steps and the sums; no part or order is more than 2^filters cells.
    long = cells.select("*", F.explode(orders).alias("filter_order")).repartition("part", "filter_order").select("*", F.explode(steps).alias("step"))
    long = long.withColumn("filter", F.substr(F.col("filter_order"), F.col("step"), F.lit(1)))
    bit = F.element_at(F.create_map(*[F.lit(x) for k, c in enumerate(filters) for x in (c, 1 << k)]), F.col("filter"))
    long = long.withColumn("failing", F.col("mask").bitwiseAND(bit)).withColumn("only", F.col("mask") == bit)
    before = Window.partitionBy("part", "filter_order", "mask").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    long = long.withColumn("earlier", F.coalesce(F.bit_or("failing").over(before), F.lit(0)))
    fails, gone = F.col("failing") != 0, F.col("earlier") != 0

    def total(of: str, where: Column) -> Column:
        return F.coalesce(F.sum(F.when(where, F.col(of))), F.lit(0)).cast("long")

    found = long.groupBy("part", "filter_order", "step", "filter").agg(
        total("docs", ~fails & ~gone).alias("kept"), total("docs", fails & ~gone).alias("removed"), total("docs", fails & gone).alias("redundant"), total("docs", F.col("only")).alias("unique_fails"),
        total("good", fails & ~gone).alias("good_lost"), total("toxic", fails & ~gone).alias("toxic_lost"))
    return found.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter")))


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters: part, filter_order, step, filter and the metrics."""
    return audit(mask_cells(docs, labels))


SQL = r"""
with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
l as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id),
m as (select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic, {'A': len(w) < 50, 'B': 100 * len(list_distinct(w)) < 65 * len(w), 'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t),
    'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(doc_id > min(doc_id) over (partition by t), false)} as f from d left join l using (doc_id)),
x as (select unnest(['A', 'B', 'C', 'D', 'E']) as c),
o as (select a.c || b.c || c.c || d.c || e.c as filter_order, unnest([1, 2, 3, 4, 5])::int as step from x a, x b, x c, x d, x e where len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
g as (select part, good, toxic, f, count(*) as n from m group by all),
s as (select part, filter_order, step, filter_order[step] as c, n, good, toxic, list_contains(map_values(v), true) as x, map_extract_value(v, filter_order[step]) as fails,
    list_bool_or([false] || [map_extract_value(v, filter_order[k]) for k in range(1, step)]) as gone, len(list_filter(map_values(v), lambda y: y)) = 1 as one
  from (select *, map {'A': f.A, 'B': f.B, 'C': f.C, 'D': f.D, 'E': f.E} as v from g) cross join o),
r as (select part, filter_order, step, c, coalesce(sum(n) filter (not fails and not gone), 0)::bigint as kept, coalesce(sum(n) filter (fails and not gone), 0)::bigint as removed,
    coalesce(sum(n) filter (fails and gone), 0)::bigint as redundant, coalesce(sum(n) filter (fails and one), 0)::bigint as unique_fails,
    coalesce(sum(n) filter (fails and not gone and good), 0)::bigint as good_lost, coalesce(sum(n) filter (fails and not gone and toxic), 0)::bigint as toxic_lost
  from s group by all)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) over (partition by part, c)::bigint as shapley from r
"""
