"""Why plugins were left out by rules whose names they matched."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _why(rules: list[dict]) -> Column:
    """The filter in words, with what it asks for; one literal for each rule and filter."""
    words = {
        "plugin_families": "the family is none of {}", "exclude_families": "the family is one of {}", "exclude_name_patterns": "the name matches one of {}",
        "plugin_output_patterns": "the output does not match {} of {}", "exclude_plugin_output_patterns": "the output matches {} of {}",
    }
    pairs = []
    for r in rules:
        for kind, text in words.items():
            asked = r["filters"].get(kind) or []
            every = "all" if r["filters"].get(kind.replace("patterns", "require_all")) else "any"
            pairs += [F.lit(f"{r['rule_name']}/{kind}"), F.lit(text.format(every, asked) if text.count("{}") == 2 else text.format(asked))] if asked else []
    found = F.concat_ws("/", "rule_name", "reason")
    return F.coalesce(F.try_element_at(F.create_map(*pairs), found), F.col("reason")) if pairs else F.col("reason")


def exclusions(evaluation: DataFrame, rules: list[dict]) -> DataFrame:
    """One row for each plugin and rule whose name filter it passed and a later one excluded it: filter and reason."""
    rows = evaluation.filter("reason is not null").withColumn("why", _why(rules))
    return rows.select("file_id", "rule_ord", "rule_name", "plugin_ord", "plugin_id", "name", F.col("reason").alias("filter"), "why")


def log_lines(excluded: DataFrame) -> DataFrame:
    """value: one line of text for each exclusion."""
    return excluded.select("file_id", "rule_ord", "plugin_ord", F.format_string("Rule '%s': plugin %s '%s' matched the name but was excluded by %s: %s", "rule_name", "plugin_id", F.coalesce("name", F.lit("")), "filter", "why").alias("value"))


def write_log(evaluation: DataFrame, rules: list[dict], folder: str, at: datetime | None = None) -> str:
    """Text files of all exclusions in order of file, rule and plugin, written by the executors; returns their folder's path."""
    path = f"{folder.rstrip('/')}/reportmill-exclusions-{at or datetime.now():%Y%m%d_%H%M%S}.log"
    log_lines(exclusions(evaluation, rules)).orderBy("file_id", "rule_ord", "plugin_ord").select("value").write.text(path)
    return path
