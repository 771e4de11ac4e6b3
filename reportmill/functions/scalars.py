"""Scalar functions of reports, each from columns to a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITIES = {4: "Critical", 3: "High", 2: "Medium", 1: "Low", 0: "None"}
RISK_ORDER = {"Critical": 4, "High": 3, "Medium": 2, "Low": 1}


def severity_label(severity: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for pair in SEVERITIES.items() for x in pair])
    return F.coalesce(F.try_element_at(labels, severity.cast("int")), F.lit("None"))


def risk_priority(risk: Column) -> Column:
    order = F.create_map(*[F.lit(x) for pair in RISK_ORDER.items() for x in pair])
    return F.coalesce(F.try_element_at(order, F.coalesce(risk, F.lit(""))), F.lit(0))


def port_key(port: Column, protocol: Column) -> Column:
    """``443/tcp``; null unless both parts are there."""
    return F.when((port != "") & (protocol != ""), F.concat_ws("/", port, protocol))


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def lines(x: Column) -> Column:
    """Stripped lines that are not empty."""
    return F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), "\n"), strip), lambda s: s != "")


def host_names(listed: Column, single: Column) -> Column:
    """Names of a JSON list of ``{"FQDN": name}``, or else the single name."""
    parsed = F.from_json(F.replace(listed, F.lit("&quot;"), F.lit('"')), "array<struct<FQDN:string>>")
    names = F.coalesce(F.filter(F.transform(parsed, lambda e: e["FQDN"]), lambda n: n.isNotNull()), F.array().cast("array<string>"))
    return F.when(F.size(names) > 0, names).when(single != "", F.array(single)).otherwise(F.array().cast("array<string>"))


def report_time(x: Column) -> Column:
    """Epoch seconds, or ``Tue Nov 14 22:13:20 2023``; null where it is neither."""
    spelled = F.try_to_timestamp(F.substring(F.regexp_replace(F.trim(x), " +", " "), 5, 30), F.lit("MMM d HH:mm:ss yyyy"))
    return F.when(x.rlike("^[0-9]+$"), F.timestamp_seconds(x.try_cast("long"))).otherwise(spelled)


def time_text(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "dd-MM-yyyy HH:mm:ss"), F.lit(""))


def clock(seconds: Column) -> Column:
    """``1:01:01``, ``1 day, 2:03:04``, ``-1 day, 23:59:59``; empty for null."""
    days, rest = F.floor(seconds / 86400), F.pmod(seconds, F.lit(86400))
    time = F.format_string("%d:%02d:%02d", F.floor(rest / 3600), F.floor(F.pmod(rest, F.lit(3600)) / 60), F.pmod(rest, F.lit(60)))
    named = F.concat(days.cast("string"), F.when(F.abs(days) == 1, " day, ").otherwise(" days, "), time)
    return F.coalesce(F.when(days == 0, time).otherwise(named), F.lit(""))


def spoken(seconds: Column) -> Column:
    """``1h 2m 3s``, ``2m 3s``, ``3s``; empty for null. Hours round down and are left out unless positive: -5 is ``59m 55s``."""
    h, m, s = F.floor(seconds / 3600), F.floor(F.pmod(seconds, F.lit(3600)) / 60), F.pmod(seconds, F.lit(60))
    text = F.when(h > 0, F.format_string("%dh %dm %ds", h, m, s)).when(m > 0, F.format_string("%dm %ds", m, s)).otherwise(F.format_string("%ds", s))
    return F.when(seconds.isNull(), "").otherwise(text)


def flag(x: Column) -> Column:
    return F.coalesce(F.lower(x) == "true", F.lit(False))


def combined_info(product: Column, version: Column) -> Column:
    none = F.lit("")
    return F.nullif(F.concat_ws(" ", F.nullif(product, none), F.nullif(version, none)), none)


def file_name(x: Column) -> Column:
    """A name without characters that file systems refuse."""
    name = F.regexp_replace(F.regexp_replace(x, r'[<>:"/\\|?*]', "_"), "_+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(name, "^[_ ]+|[_ ]+$", ""), F.lit("")), F.lit("output"))


def sniff(content: Column) -> Column:
    """Kind of report by its first characters: ``net``, ``vuln`` or null."""
    head = F.lower(F.substring(content, 1, 1024))
    kind = F.when(head.contains("nmaprun"), "net").when(head.contains("nessusclientdata"), "vuln").when(head.contains("<report") & head.contains("<policy"), "vuln")
    return F.when(head.contains("<?xml"), kind)


def in_order(value: Column, ord_: Column) -> Column:
    """Aggregate: values in order of ``ord_``."""
    return F.transform(F.array_sort(F.collect_list(F.struct(ord_.alias("o"), value.alias("v")))), lambda x: x["v"])


def distinct_in_order(value: Column, ord_: Column) -> Column:
    """Aggregate: distinct values by first sight, nulls left out."""
    return F.array_distinct(F.filter(in_order(value, ord_), lambda v: v.isNotNull()))
