"""Summaries for the console, as text made from the tables of statistics of one report. Only counts and top lists come to the driver."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportmill import api
from reportmill.functions.scalars import SEVERITIES
from reportmill.operators import report as P
from reportmill.operators import stats

#: Characters of a line; reports that are summarised at once.
WIDTH, MOST_REPORTS = 60, 20
CODES = {"red": 31, "green": 32, "yellow": 33, "magenta": 35, "cyan": 36, "bold": 1, "orange": "38;5;214"}
RISKS = {"Critical": "magenta", "High": "red", "Medium": "orange", "Low": "yellow", "None": "green"}


def paint(text: object, code: str, colour: bool = True) -> str:
    return f"\033[{CODES[code]}m{text}\033[0m" if colour else str(text)


def banner(version: str, colour: bool = True) -> str:
    """Name and version in a box."""
    line = f"reportmill {version}: scanner reports to tables"
    return paint("\n".join(("+" + "-" * (len(line) + 2) + "+", f"| {line} |", "+" + "-" * (len(line) + 2) + "+")), "green", colour)


def _titled(title: str, sections: list[tuple[str, list[str]]], colour: bool) -> str:
    """Sections without lines are left out."""
    out = [paint("=" * WIDTH, "cyan", colour), paint(title, "bold", colour), paint("-" * WIDTH, "cyan", colour)]
    for name, lines in sections:
        out += [paint(f"{name}:", "bold", colour), *[f"  - {x}" for x in lines], ""] if lines else []
    return "\n".join([*out[: len(out) - (not out[-1])], paint("=" * WIDTH, "cyan", colour)])


def _severity(severity: int | None) -> str:
    return RISKS[SEVERITIES.get(min(severity or 0, 3), "None")]


def _first(df: DataFrame) -> dict:
    row = df.first()
    return row.asDict() if row else {}


def _counts(df: DataFrame, name: str, count: str, n: int | None = None) -> list[tuple[str, int]]:
    return [(r[name], r[count]) for r in stats.top(df, count, name, n).toLocalIterator()]


def vulnerability_summary(r, found: dict[str, DataFrame], colour: bool = True) -> str:
    """Context, assets, severities, all services by instances and the ten services with most findings."""
    context, hosts, ports = _first(r.context), _first(found["hosts"]), _first(found["ports"])
    severities = {x["severity"]: x["n_plugins"] for x in found["by_severity"].collect()}
    return _titled("VULNERABILITY REPORT", [
        ("Scan", [f"{k}: {context.get(c) or ''}" for k, c in (("start", "scan_start"), ("end", "scan_end"), ("duration", "scan_duration"), ("policy", "policy_name"))]),
        ("Assets", [f"{k}: {x.get(c, 0)}" for k, x, c in (("hosts", hosts, "total"), ("hosts of several names", hosts, "multi_fqdn_hosts"), ("addresses", hosts, "total_ips"), ("names", hosts, "total_fqdns"), ("ports", ports, "total"), ("hosts checked with credentials", hosts, "credentialed_checks"))]),
        ("Findings by severity", [paint(f"{x}: {severities.get(x, 0)}", code, colour) for x, code in RISKS.items()]),
        ("Services", [f"{s}: {n}" for s, n in _counts(found["service_instances"], "svc_name", "n_instances")]),
        ("Most affected services", [f"{s}: {paint(n, 'red', colour)} findings" for s, n in _counts(found["service_findings"], "svc_name", "n_findings", 10)]),
    ], colour)


def scan_summary(r, found: dict[str, DataFrame], colour: bool = True) -> str:
    """Context, hosts, ports by state, and the ten services on most ports (of equal ones, those seen first)."""
    context, hosts = _first(r.context), _first(found["hosts"])
    top = stats.named_services(r.ports).groupBy("service_name").agg(F.count("*").alias("n"), F.min(F.struct("host_ord", "ord")).alias("first"))
    services = [(x.service_name, x.n) for x in top.orderBy(F.col("n").desc(), "first").limit(10).collect()]
    states = _counts(found["ports_by_status"], "status", "n")
    return _titled("PORT SCAN", [
        ("Scan", [f"{k}: {context.get(c) or ''}" for k, c in (("scanner", "scanner_version"), ("start", "scan_start"), ("end", "scan_end"), ("duration", "scan_duration"), ("type", "scan_type"))]),
        ("Hosts", [f"{k}: {hosts.get(c, 0)}" for k, c in (("total", "total"), ("addresses", "unique_ips"), ("names", "unique_hostnames"))] + [paint(f"{s.title()}: {n}", "green" if s == "up" else "yellow", colour) for s, n in _counts(found["by_host_status"], "host_status", "n")]),
        ("Ports", [paint(f"{s.title()} ports: {n}", {"open": "green", "filtered": "yellow"}.get(s, "red"), colour) for s, n in states]),
        ("Services", [f"total: {sum(n for _, n in states)}", *[f"{s}: {n}" for s, n in services]]),
    ], colour)


def consolidation_summary(done, colour: bool = True) -> str:
    """What consolidation saved, the rules and, for each category, its plugins and services. Empty where nothing matched."""
    categories = done.entries.select("file_id", "rule_ord", "title", "severity", F.size("consolidated_plugins").alias("plugins"))
    services = done.services.groupBy("file_id", "rule_ord").agg(F.count("*").alias("services"))
    rows = categories.join(services, ["file_id", "rule_ord"], "left").orderBy("file_id", "rule_ord").collect()
    if not rows:
        return ""
    total, applied = _first(P.consolidation_summary(done.metadata, done.entries)), _first(done.metadata)["rules_applied"]
    return _titled("CONSOLIDATION", [
        ("Effect", [f"{k}: {total[c]}" for k, c in (("findings before", "original_plugins_count"), ("consolidated", "consolidated_count"), ("categories", "categories"), ("findings after", "final_count"))]),
        ("Rules", applied),
        ("Categories", [f"{paint(x.title, _severity(x.severity), colour)}: {x.plugins} plugins, {x.services or 0} services" for x in rows]),
    ], colour)


def findings_summary(findings: DataFrame, colour: bool = True) -> str:
    """Findings, ids and entities (those of truncated findings apart), and how many rules share an id. Empty without findings."""
    total = _first(P.display_summary(findings))
    if not total:
        return ""
    ids = [(r.finding_id, r.n) for r in findings.groupBy("finding_id").agg(F.count("*").alias("n")).orderBy("finding_id").collect()]
    cut = [f"over the limit of entities: {total['truncated']}"] if total["truncated"] else []
    return _titled("FINDINGS", [
        ("Written", [f"findings: {total['total_findings']}", f"ids: {len(ids)}", f"affected entities: {total['total_entities']}", *cut]),
        ("Ids", [f"{paint(i, 'green', colour)}{f' ({n} rules)' if n > 1 else ''}" for i, n in ids]),
    ], colour)


SUMMARIES = {"vuln": vulnerability_summary, "net": scan_summary}


def summaries(results: dict[str, object], colour: bool | None = None) -> str:
    """All summaries that the results of ``process`` give, by the report's kind; of several reports, those of the first ``MOST_REPORTS``, each under its name."""
    colour = sys.stdout.isatty() if colour is None else colour
    files = api.files_of(results, MOST_REPORTS + 1)
    if len(files) < 2:
        return _summaries(results, colour)
    out = [f"{paint(f, 'bold', colour)}\n\n{_summaries(api.of_file(results, f), colour)}" for f in files[:MOST_REPORTS]]
    if len(files) > MOST_REPORTS:
        out.append(f"{results['report'].context.count() - MOST_REPORTS} more reports")
    return "\n\n".join(out)


def _summaries(results: dict[str, object], colour: bool) -> str:
    r = results["report"]
    out = [SUMMARIES[r.kind](r, results["stats"], colour)] if r.kind in SUMMARIES else []
    if results.get("consolidated"):
        out.append(consolidation_summary(results["consolidated"], colour))
    if results.get("findings") is not None:
        out.append(findings_summary(results["findings"], colour))
    return "\n\n".join(x for x in out if x)
