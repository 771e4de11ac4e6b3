"""The built-in kinds of reports, registered on import: vulnerability reports (``vuln``) and port scans (``net``)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from reportmill.operators import stats
from reportmill.sources import xml
from reportmill.sources.adapters import Adapter, register


def vulnerability_statistics(r: xml.Report) -> dict[str, DataFrame]:
    found = stats.plugins(r.items)
    return {"hosts": stats.host_stats(r.hosts), "ports": stats.discovered_ports(r.items), "service_instances": stats.service_instances(r.items), "service_findings": stats.service_findings(r.items), "by_severity": stats.severity_counts(found), "by_family": stats.family_counts(found), "host_severities": stats.host_severities(r.items), "host_ports": stats.host_ports(r.items)}


def scan_statistics(r: xml.Report) -> dict[str, DataFrame]:
    named = stats.named_services(r.ports)
    return {"hosts": stats.scanned_hosts(r.hosts), "by_host_status": stats.count_by(r.hosts, "host_status"), "ports_by_status": stats.count_by(named, "status"), "ports_by_port": stats.count_by(named, "port_id"), "services": stats.count_by(named, "service_name"), "port_summary": stats.port_summary(r.ports)}


VULN = register(Adapter(
    "vuln", "vulnerability reports in XML", (".nessus",), ("NessusClientData_v2", "NessusClientData"),
    lambda spark, path, options: xml.read_vulnerabilities(spark, path, options.get("strict", False)), vulnerability_statistics,
    lambda head: "nmaprun" not in head and ("nessusclientdata" in head or ("<report" in head and "<policy" in head)),
    ("parsing", "consolidation", "findings", "entity limit", "exclusion log")))
NET = register(Adapter(
    "net", "port scans in XML", (".xml",), ("nmaprun",),
    lambda spark, path, options: xml.read_scans(spark, path, options.get("port_status", "all")), scan_statistics,
    lambda head: "nmaprun" in head, ("parsing", "port status", "flat ports")))
