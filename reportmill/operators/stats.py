"""Statistics over the canonical tables.

``items``: file_id, host_ord, ord (orderable: document order within the file), plugin_id, port, protocol, svc_name, severity, name, family
and the other attributes of findings. ``hosts``: file_id, host_ord, ip, fqdns, credentialed, has_properties. ``ports`` (of port
scans): file_id, host_ord, ord, port_id, protocol, status, service_name, product, version. Every key starts with file_id, so one
call serves one report or a directory of them, and each aggregate shuffles on its key once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportmill.functions.scalars import SEVERITIES, in_order, port_key, severity_label


def first_wins(rows: DataFrame, keys: list[str], ord_: str = "ord") -> DataFrame:
    """The first row of each key in document order. Partial minima combine before the shuffle; each column has its own, so that those not asked for are never read."""
    found = rows.groupBy(*_sorted_by(keys)).agg(*[(F.min(ord_) if c == ord_ else F.min_by(F.col(c), F.col(ord_))).alias(c) for c in rows.columns if c not in keys])
    return found.select(*keys, *[c for c in rows.columns if c not in keys])


def _sorted_by(keys: list[str]) -> list[str]:
    """Rows are sorted by keys to find firsts. A sort compares by the first key's first bytes, so the file, which many rows share, comes last."""
    return [k for k in keys if k != "file_id"] + [k for k in keys if k == "file_id"]


def first_rows(rows: DataFrame, keys: list[str], columns: list[str], ord_: str = "ord") -> DataFrame:
    """:func:`first_wins` with the columns named, which all are read: rows are compared once, and not once for each column."""
    # Keys are read from the rows that are found: what one reader asks of keys then does not part its aggregate from that of another reader.
    first = F.min(F.struct(ord_, *keys, *[c for c in columns if c != ord_])).alias("_first")
    return rows.groupBy(*_sorted_by(keys)).agg(first).select(*[F.col(f"_first.{c}") for c in (*keys, ord_, *[c for c in columns if c != ord_])])


def last_wins(rows: DataFrame, keys: list[str], ord_: str = "ord") -> DataFrame:
    found = rows.groupBy(*_sorted_by(keys)).agg(*[(F.max(ord_) if c == ord_ else F.max_by(F.col(c), F.col(ord_))).alias(c) for c in rows.columns if c not in keys])
    return found.select(*keys, *[c for c in rows.columns if c not in keys])


def numbered(rows: DataFrame, order: list[str], name: str, first: Column | None = None) -> DataFrame:
    """Adds ``name``: the place in the order of the file, from 1 (or from ``first``, a column). ``order`` begins with host_ord, which counts a file's hosts.

    Places are ranks within groups of hosts and the sums of the groups before, so that a file of any size is numbered by many tasks."""
    grouped = rows.withColumn("_group", F.floor(F.col("host_ord") / HOSTS_OF_A_TASK))
    before = Window.partitionBy("file_id").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    sums = grouped.groupBy("file_id", "_group").agg(F.count("*").alias("_n")).select("file_id", "_group", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = grouped.withColumn("_rank", F.row_number().over(Window.partitionBy("file_id", "_group").orderBy(*order)))
    return ranked.join(sums, ["file_id", "_group"]).withColumn(name, F.col("_before") + F.col("_rank") + (F.lit(0) if first is None else first)).drop("_group", "_before", "_rank")


#: Values that are joined at once.
PIECE = 1 << 15


def joined_in_order(rows: DataFrame, keys: list[str], value: str, order: list[str], by: str = "|") -> DataFrame:
    """keys and ``value``: of each key the values, joined in order (nulls left out).

    Rows are dealt by ranges and sorted, then joined in pieces of at most PIECE rows, and the pieces once more. So the values of one key
    are shared out over tasks, none of which holds more of them than the text that they make."""
    # Ids grow with the rows' order, within a range and from one to the next.
    dealt = rows.select(*keys, *order, value).repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    placed = dealt.select(*keys, value, F.monotonically_increasing_id().alias("_at")).withColumn("_piece", F.floor(F.col("_at") / PIECE))
    text = F.when(F.count(value) > 0, F.array_join(in_order(F.col(value), F.col("_at")), by))
    pieces = placed.groupBy("_piece", *keys).agg(text.alias(value))
    return pieces.groupBy(*keys).agg(F.array_join(in_order(F.col(value), F.col("_piece")), by).alias(value))


#: Hosts whose rows are numbered by one task.
HOSTS_OF_A_TASK = 1000


def plugins(items: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """columns: those wanted besides the keys and ord, if not all."""
    keys = ["file_id", "plugin_id"]
    return first_wins(items, keys) if columns is None else first_rows(items, keys, columns)


def plugin_hosts(items: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One port a plugin and host: the first. columns: as of :func:`plugins`."""
    keys = ["file_id", "plugin_id", "host_ord"]
    return first_wins(items, keys) if columns is None else first_rows(items, keys, columns)


def severity_counts(plugins: DataFrame) -> DataFrame:
    """All five labels for each file, with 0 where none."""
    counted = plugins.groupBy("file_id").agg(*[F.count_if(severity_label(F.col("severity")) == label).alias(label) for label in SEVERITIES.values()])
    return counted.unpivot("file_id", list(SEVERITIES.values()), "severity", "n_plugins")


def family_counts(plugins: DataFrame) -> DataFrame:
    return plugins.groupBy("file_id", "family").agg(F.count("*").alias("n_plugins"))


def host_severities(items: DataFrame) -> DataFrame:
    """Distinct plugins of each host and label, by each item's own severity. The labels of a plugin on a host are first put into one mask of bits."""
    label, labels = severity_label(F.col("severity")), list(SEVERITIES.values())
    bit = reduce(lambda other, k: F.when(label == labels[k], F.lit(1 << k)).otherwise(other), range(len(labels)), F.lit(0))
    masks = items.filter(F.col("plugin_id").isNotNull()).groupBy("file_id", "host_ord", "plugin_id").agg(F.bit_or(bit).alias("mask"))
    return masks.groupBy("file_id", "host_ord").agg(*[F.count_if(F.col("mask").bitwiseAND(1 << k) != 0).alias(x.lower()) for k, x in enumerate(labels)])


def host_ports(items: DataFrame) -> DataFrame:
    """Each host's ports: the first service, and plugins by first sight. Rows of a plugin are reduced to the first before they are listed.

    Plugins hardly repeat on a port, so rows are dealt by port once, for both steps."""
    keyed = items.withColumn("port_key", port_key(F.col("port"), F.col("protocol"))).filter("port_key is not null")
    keyed = keyed.select("file_id", "host_ord", "port_key", "plugin_id", "ord", "svc_name").repartition("file_id", "host_ord", "port_key")
    first = keyed.groupBy("file_id", "host_ord", "port_key", "plugin_id").agg(F.min("ord").alias("ord"), F.min_by("svc_name", "ord").alias("svc_name"))
    return first.groupBy("file_id", "host_ord", "port_key").agg(F.min_by("svc_name", "ord").alias("service"), in_order(F.col("plugin_id"), F.col("ord")).alias("plugin_ids"))


def discovered_ports(items: DataFrame) -> DataFrame:
    keyed = items.select("file_id", port_key(F.col("port"), F.col("protocol")).alias("port_key")).filter("port_key is not null").distinct()
    return keyed.groupBy("file_id").agg(F.count("*").alias("total"), F.array_sort(F.collect_list("port_key")).alias("ports"))


def _served(items: DataFrame) -> DataFrame:
    return items.filter((F.col("port") != "") & (F.col("protocol") != "") & (F.col("svc_name") != ""))


def service_instances(items: DataFrame) -> DataFrame:
    """Distinct (host, port, protocol) of each service."""
    return _served(items).groupBy("file_id", "svc_name").agg(F.count_distinct("host_ord", "port", "protocol").alias("n_instances"))


def service_findings(items: DataFrame) -> DataFrame:
    """Items of severity 1 to 4 of each service."""
    return _served(items).filter(F.col("severity").between(1, 4)).groupBy("file_id", "svc_name").agg(F.count("*").alias("n_findings"))


def host_stats(hosts: DataFrame) -> DataFrame:
    has = hosts.filter("has_properties")
    names = has.select("file_id", F.explode("fqdns").alias("name")).groupBy("file_id").agg(F.count_distinct("name").alias("total_fqdns"))
    counts = has.groupBy("file_id").agg(
        F.count("*").alias("total"), F.count_distinct(F.nullif("ip", F.lit(""))).alias("total_ips"),
        F.count_if(F.size("fqdns") > 1).alias("multi_fqdn_hosts"), F.count_if("credentialed").alias("credentialed_checks"),
    )
    return counts.join(names, "file_id", "left").withColumn("total_fqdns", F.coalesce("total_fqdns", F.lit(0)))


def affected_ids(hosts: DataFrame) -> DataFrame:
    """affected_host_id: numbering that goes on after all hosts, over those with properties."""
    total = hosts.groupBy("file_id").agg(F.count("*").alias("n"))
    return numbered(hosts.filter("has_properties").join(total, "file_id"), ["host_ord"], "affected_host_id", F.col("n")).select("file_id", "host_ord", "affected_host_id")


def top(rows: DataFrame, count: str, name: str, n: int | None = 10) -> DataFrame:
    ordered = rows.orderBy(F.col(count).desc(), F.col(name).asc())
    return ordered.limit(n) if n else ordered


# Port scans


def with_status(ports: DataFrame, status: str = "all") -> DataFrame:
    """Exact status, or all."""
    return ports if status == "all" else ports.filter(F.col("status") == status)


def scanned_hosts(hosts: DataFrame) -> DataFrame:
    """Hosts, distinct addresses and distinct names that are not empty."""
    return hosts.groupBy("file_id").agg(F.count("*").alias("total"), F.count_distinct(F.nullif("ip", F.lit(""))).alias("unique_ips"), F.count_distinct(F.nullif("hostname", F.lit(""))).alias("unique_hostnames"))


def last_ports(ports: DataFrame) -> DataFrame:
    """Of a host's ports with one protocol and number the last."""
    return last_wins(ports, ["file_id", "host_ord", "protocol", "port_id"])


def port_summary(ports: DataFrame) -> DataFrame:
    known = ["open", "closed", "filtered"]
    return ports.groupBy("file_id", "host_ord").agg(*[F.count_if(F.col("status") == s).alias(s) for s in known], F.count_if(~F.coalesce(F.col("status"), F.lit("")).isin(known)).alias("other"))


def named_services(ports: DataFrame) -> DataFrame:
    return ports.filter(F.col("service_name") != "")


def service_ids(ports: DataFrame) -> DataFrame:
    """``service_<n>`` for ports with a service, in document order of their file."""
    return numbered(named_services(ports), ["host_ord", "ord"], "_number").withColumn("service_id", F.concat(F.lit("service_"), F.col("_number").cast("string"))).drop("_number")


def count_by(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy("file_id", *keys).agg(F.count("*").alias("n"))


def flat_ports(hosts: DataFrame, ports: DataFrame, status: str = "all") -> DataFrame:
    """One row a port, with its host's fields."""
    label = F.concat_ws("/", F.upper("protocol"), "port_id").alias("port")
    return with_status(ports, status).join(hosts.select("file_id", "host_ord", "ip", "hostname", "host_status"), ["file_id", "host_ord"]).select("file_id", "host_ord", "ord", "ip", "hostname", "host_status", label, "status", "service_name", "service_details", "script_output")


def rollup(counts: DataFrame, key: str, value: str) -> DataFrame:
    """Over all files of a batch."""
    return counts.groupBy(key).agg(F.sum(value).alias(value))


def column_counts(df: DataFrame, *columns: Column) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n"))
