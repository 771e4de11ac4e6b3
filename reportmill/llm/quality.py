"""Quality rules: a threshold table compiled into one Spark projection.

Each rule is a row of :data:`RULES`: a named measure and the range in which a document passes. The
table is compiled to one boolean expression next to the measures that it reads; no user function runs
and no shuffle is needed, so a document of any length is decided where it is read.

Defined results: null text has no words; texts without words fail (fewer than ``MIN_WORDS`` words);
ratios of texts without words or lines are 0; repeated rows are decided alike; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportmill.llm.common import words

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 50, 50, 3

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in a is that for it as with was on be by this are at from or not have has he she they "
    "le la de et les des en un une du que dans pour qui sur par au avec ne pas ce il elle est "
    "der die und das den von zu mit sich dem nicht ein eine im ist auf für auch es "
    "el los las y por con para del se su al lo como más una no"
).split()

#: measure: least, most; None leaves that side open.
RULES: dict[str, tuple[float | None, float | None]] = {
    "mean_word_chars": (2.5, 12.0),
    "symbols_per_word": (None, 0.1),
    "stop_word_ratio": (0.06, None),
    "dup_line_ratio": (None, 0.5),
}


def compile_rules(rules: dict[str, tuple[float | None, float | None]]) -> Column:
    """True where every measure lies in its range."""
    passed = F.lit(True)
    for measure, (least, most) in rules.items():
        if least is not None:
            passed = passed & (F.col(measure) >= least)
        if most is not None:
            passed = passed & (F.col(measure) <= most)
    return passed


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def repeated_words(windows: Column) -> Column:
    """Words in windows that occur twice or more. windows: sorted array of (words, position)."""
    first = F.filter(windows, lambda x, k: (F.get(windows, k - 1)["w"] == x["w"]) | (F.get(windows, k + 1)["w"] == x["w"]))
    starts = F.transform(first, lambda x: x["i"])
    return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(*[i + k for k in range(WINDOW)])))))


def score_quality(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", rules: dict | None = None) -> DataFrame:
    """One row per document: id, the counts, the rules' measures, base_failed and kept."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.col(id_col).alias("id"), text.alias("text"), words(F.col(text_col)).alias("words"))
    has_word = r"[^\x20\x09-\x0D]"
    grams = F.when(F.size("words") >= WINDOW, F.sequence(F.lit(0), F.size("words") - WINDOW)).otherwise(F.array().cast("array<int>"))
    df = df.select(
        "id", "text", "words", F.size("words").cast("long").alias("n_words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(has_word)).alias("lines"),
        F.sort_array(F.transform(grams, lambda i: F.struct(F.concat_ws(" ", *[F.get(F.col("words"), i + k) for k in range(WINDOW)]).alias("w"), i.alias("i")))).alias("windows"),
    )
    df = df.select(
        "id", "n_words",
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("windows")).cast("long").alias("n_repeat_words"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
    )
    df = df.withColumns({
        "mean_word_chars": _ratio(F.col("word_chars"), F.col("n_words")), "symbols_per_word": _ratio(F.col("n_symbols"), F.col("n_words")),
        "stop_word_ratio": _ratio(F.col("n_stop_words"), F.col("n_words")), "dup_line_ratio": _ratio(F.col("n_dup_lines"), F.col("n_lines")),
        "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
    })
    return df.withColumn("kept", ~F.col("base_failed") & compile_rules(rules or RULES)).withColumnRenamed("id", id_col)


SQL = r"""
with base as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
grams as (
  select doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as w
  from (select doc_id, words, unnest(range(1, len(words) - 1)) as i from base where len(words) >= 3)),
dup as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, w) as c from grams) where c > 1),
rep as (
  select doc_id, count(distinct p) as n from (
    select doc_id, i as p from dup union all select doc_id, i + 1 from dup union all select doc_id, i + 2 from dup) group by doc_id),
lines as (
  select doc_id, count(*) as n_lines, count(*) - count(distinct line) as n_dup from (
    select doc_id, unnest(string_split(text, chr(10))) as line from base) where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id),
stops as (
  select doc_id, count(*) as n from (select doc_id, unnest(words) as w from base) where lower(w) in (%s) group by doc_id),
counted as (
  select b.doc_id, len(b.words)::bigint as n_words, length(array_to_string(b.words, ''))::bigint as word_chars,
         len(regexp_extract_all(b.text, '[#*$%%&|<>]'))::bigint as n_symbols, coalesce(l.n_lines, 0)::bigint as n_lines,
         coalesce(l.n_dup, 0)::bigint as n_dup_lines, coalesce(r.n, 0)::bigint as n_repeat_words, coalesce(s.n, 0)::bigint as n_stop_words
  from base b left join lines l using (doc_id) left join rep r using (doc_id) left join stops s using (doc_id)),
failed as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from counted)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and word_chars::double / n_words >= 2.5 and word_chars::double / n_words <= 12.0 and n_symbols::double / n_words <= 0.1
  and n_stop_words::double / n_words >= 0.06 and (n_lines = 0 or n_dup_lines::double / n_lines <= 0.5) as kept
from failed
""" % ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
