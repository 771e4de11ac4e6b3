"""Report-ready findings and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportmill.functions.scalars import in_order, strip

#: Stands for the list of entities where there are more than the limit.
TRUNCATED = "<p>The affected systems are listed in an external document.</p>"
REQUIRED = ("type", "finding_id", "affected_entities")


class FormatterError(Exception):
    """Findings could not be formatted."""


def checked_limit(limit: int | None) -> int | None:
    if limit is not None and limit < 1:
        raise FormatterError("the limit of entities must be at least 1")
    return limit


def entities(services: DataFrame, limit: int | None = None) -> DataFrame:
    """Ordered distinct entities of each file and rule: a service's name (if any), then its address and port.

    limit: one more entity than that is kept at most, which is enough to tell; of each rule no task holds more."""
    place = F.when(F.coalesce(F.col("port"), F.lit("")) != "", F.concat_ws(":", "ip", "port")).otherwise(F.col("ip"))
    name = strip(F.coalesce(F.col("fqdn"), F.lit("")))
    named = F.filter(F.array(name, place), lambda x: x.isNotNull() & (x != ""))
    if limit is None:
        return services.groupBy("file_id", "rule_ord").agg(F.array_distinct(F.flatten(in_order(named, F.col("first_seen")))).alias("entities"))
    seen = services.select("file_id", "rule_ord", "first_seen", F.posexplode(named).alias("pos", "entity"))
    seen = seen.groupBy("file_id", "rule_ord", "entity").agg(F.min(F.struct("first_seen", "pos")).alias("at"))
    first = seen.withColumn("rank", F.row_number().over(Window.partitionBy("file_id", "rule_ord").orderBy("at"))).filter(F.col("rank") <= limit + 1)
    return first.groupBy("file_id", "rule_ord").agg(in_order(F.col("entity"), F.col("rank")).alias("entities"))


def html(entities: Column, limit: int | None = None) -> Column:
    text = F.concat(F.lit("<p>"), F.array_join(entities, "<br />"), F.lit("</p>"))
    return text if limit is None else F.when(F.size(entities) > limit, F.lit(TRUNCATED)).otherwise(text)


def findings(entries: DataFrame, services: DataFrame, limit: int | None = None) -> DataFrame:
    """type, finding_id and affected_entities of rules that have an internal id and affect anything."""
    checked_limit(limit)
    rows = entries.filter("has_internal_id").select("file_id", "rule_ord", "internal_id").join(entities(services, limit).filter(F.size("entities") > 0), ["file_id", "rule_ord"])
    return rows.select("file_id", "rule_ord", F.lit("stock").alias("type"), F.col("internal_id").alias("finding_id"), html(F.col("entities"), limit).alias("affected_entities"))


def renamed(findings: DataFrame, names: dict[str, str]) -> DataFrame:
    return findings.withColumnsRenamed(names)


def summary(findings: DataFrame) -> DataFrame:
    """Findings, distinct ids, entities (a truncated list counts 1) and the sorted ids."""
    return findings.groupBy("file_id").agg(
        F.count("*").alias("total_findings"), F.count_distinct("finding_id").alias("unique_ids"),
        F.sum(F.size(F.split("affected_entities", "<br />"))).alias("total_entities"), F.array_sort(F.collect_set("finding_id")).alias("finding_ids"))


def display_summary(findings: DataFrame) -> DataFrame:
    """As the console shows it: truncated findings apart, and without their entities."""
    cut = F.col("affected_entities") == TRUNCATED
    return findings.groupBy("file_id").agg(F.count("*").alias("total_findings"), F.count_if(cut).alias("truncated"), F.coalesce(F.sum(F.when(~cut, F.size(F.split("affected_entities", "<br />")))), F.lit(0)).alias("total_entities"))


def invalid(findings: DataFrame) -> DataFrame:
    """Findings that lack something, with ``problem``: the first field that is missing. Raises where a column is missing or of a wrong type."""
    kinds = dict(findings.dtypes)
    missing = [c for c in REQUIRED if c not in kinds]
    if missing:
        raise FormatterError(f"missing: {', '.join(missing)}")
    if kinds["finding_id"] not in ("string", "int", "bigint", "smallint", "tinyint"):
        raise FormatterError("finding_id is neither text nor an integer")
    if kinds["affected_entities"] != "string":
        raise FormatterError("affected_entities is no text")
    return findings.withColumn("problem", F.coalesce(*[F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED])).filter("problem is not null")


def valid(findings: DataFrame) -> bool:
    """Whether all findings have what a finding needs."""
    try:
        return invalid(findings).isEmpty()
    except FormatterError:
        return False


def consolidation_summary(metadata: DataFrame, entries: DataFrame) -> DataFrame:
    categories = entries.groupBy("file_id").agg(F.count("*").alias("categories"))
    joined = metadata.join(categories, "file_id", "left").withColumn("categories", F.coalesce("categories", F.lit(0)))
    return joined.select("file_id", "original_plugins_count", "consolidated_count", "categories", (F.col("original_plugins_count") - F.col("consolidated_count") + F.col("categories")).alias("final_count"))
