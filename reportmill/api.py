"""Processing of report files: detect, read, count, consolidate, format and write."""

from __future__ import annotations

import logging
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import fields, is_dataclass, replace
from datetime import datetime
from pathlib import Path
from urllib.parse import unquote

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportmill import kinds  # noqa: F401 (registers the built-in kinds)
from reportmill.functions.scalars import port_key
from reportmill.operators import consolidate as C
from reportmill.operators import exclusions, stats
from reportmill.operators import report as P
from reportmill.plans import rules as R
from reportmill.sources import adapters, detect, documents, large, xml

log = logging.getLogger("reportmill")

#: Results that are written at the same time; damaged elements that an error names.
WRITERS, SHOWN_DAMAGE = 8, 5
#: Reports whose documents are written in one call, at most.
MOST_DOCUMENTS = 1000
#: Columns of findings that are no plugin's, and of entries that are none of their documents'.
NOT_OF_A_PLUGIN = ("file_id", "host_ord", "ord", "plugin_id", "port", "protocol", "svc_name", "plugin_output")
NOT_OF_AN_ENTRY = ("file_id", "rule_ord", "rule_name", "title", "internal_id", "has_internal_id", "grouping", "consolidated_plugins")


def setup_logging(level: int = logging.INFO, format_string: str = "%(asctime)s - %(levelname)s - %(message)s") -> logging.Logger:
    logging.basicConfig(format=format_string, level=level, datefmt="%d-%m-%y %H:%M:%S")
    log.setLevel(level)
    return log


def set_log_level(level: int) -> None:
    log.setLevel(level)


def enable_logging(on: bool = True) -> None:
    log.disabled = not on


def statistics(r: xml.Report) -> dict[str, DataFrame]:
    return adapters.adapter(r.kind).statistics(r)


def ignored_options(kind: str, options: dict[str, object]) -> list[str]:
    """Options that are set but mean nothing for a kind."""
    other = {"net": ("consolidate", "api_format", "rules_file", "entity_limit", "log_exclusions"), "vuln": ("flat_json",)}
    return [x for x in other.get(kind, ()) if options.get(x)]


def process(spark: SparkSession, path: str, kind: str = "auto", port_status: str = "all", consolidate: bool = False, api_format: bool = False, rules_file: str | None = None, entity_limit: int | None = None, output_dir: str | None = None, output_name: str | None = None, flat_json: bool = False, strict: bool = False, log_exclusions: bool = False, documents_too: bool | str = False, keep: bool = True, damage: str = "raise") -> dict[str, object]:
    """Results by name: report, stats, and where asked for consolidated, findings and flat. Options of the other kind are ignored.

    path: a file, a folder or a pattern, in any store. strict: also checks suffixes, roots and what lies outside of hosts. damage: elements that
    cannot be read raise a ValueError, or ("report") are left out, logged and given as the table ``Parsed_damaged``. log_exclusions: writes why plugins
    were left out beside the results (or to the current folder). documents_too: also writes single JSON documents, for reports that fit the
    driver, or ("large") for those of any size. keep: the parsed tables are kept on the executors (in memory, else on disk), since all results read them; ``release`` lets them go."""
    P.checked_limit(entity_limit)
    if kind == "auto":
        kind = detect.detect(path) if Path(path).is_file() else detect.detect_in_store(spark, path)
    adapter = adapters.adapter(kind)
    if strict and Path(path).is_file():
        detect.check(path, kind)
    elif strict:
        detect.check_in_store(spark, path, kind)
    r = adapter.read(spark, path, {"strict": strict, "port_status": port_status})
    if keep:
        for df in _read_often(r):
            df.persist(StorageLevel.MEMORY_AND_DISK)
    _look_for_damage(r, damage)
    results: dict[str, object] = {"kind": kind, "report": r, "stats": adapter.statistics(r)}
    if kind == "vuln" and consolidate:
        rules = R.load(rules_file)
        done = C.consolidate(r.items, r.hosts, rules, keep)
        results["consolidated"] = done
        if done and api_format:
            results["findings"] = P.findings(done.entries, done.services, entity_limit)
        if done and log_exclusions:
            results["exclusion_log"] = exclusions.write_log(done.evaluation, R.enabled(rules), output_dir or ".")
    if kind == "net" and flat_json:
        results["flat"] = stats.flat_ports(r.hosts, r.ports)
    if output_dir:
        results["written"] = write(results, path, output_dir, output_name)
        if documents_too:
            put = write_large_documents if documents_too == "large" else write_documents
            results["written"] |= put(results, path, output_dir, output_name)
    return results


def _read_often(r: xml.Report) -> list[DataFrame]:
    return [df for df in (r.elements, r.hosts, r.items, r.ports) if df is not None]


def _look_for_damage(r: xml.Report, damage: str) -> None:
    """Raises, or logs, what the files have that cannot be read."""
    if damage not in ("raise", "report"):
        raise ValueError(f"damage is 'raise' or 'report', not {damage!r}")
    if r.damaged is None:
        return
    found = r.damaged.limit(SHOWN_DAMAGE + 1).collect()
    said = [f"{x.file_id}, {'outside of hosts' if x.host_ord is None else f'host {x.host_ord}'}: {x.cause}" for x in found[:SHOWN_DAMAGE]] + ["and more"] * (len(found) > SHOWN_DAMAGE)
    if found and damage == "raise":
        raise ValueError(f"the report is damaged; {'; '.join(said)}")
    for x in said:
        log.error("left out: %s", x)


def release(results: dict[str, object]) -> None:
    """Let the parsed tables go that ``process`` keeps."""
    r, done = results["report"], results.get("consolidated")
    for df in (*_read_often(r), *([done.judged] if done else [])):
        df.unpersist()


def files_of(results: dict[str, object], most: int) -> list[str]:
    """The files that the results are of, in order, ``most`` of them at most."""
    return [r.file_id for r in results["report"].context.select("file_id").orderBy("file_id").limit(most).collect()]


def of_file(results: dict[str, object], file_id: str) -> dict[str, object]:
    """The results of one of several files."""

    def mine(x: object) -> object:
        if isinstance(x, DataFrame):
            return x.filter(F.col("file_id") == file_id) if "file_id" in x.columns else x
        if isinstance(x, dict):
            return {k: mine(v) for k, v in x.items()}
        return replace(x, **{f.name: mine(getattr(x, f.name)) for f in fields(x)}) if is_dataclass(x) else x

    return mine(results)


def tables(results: dict[str, object]) -> dict[str, DataFrame]:
    """All tables of the results by the name they are written under."""
    r, done = results["report"], results.get("consolidated")
    found = {"Parsed_hosts": r.hosts, "Parsed_context": r.context, "Parsed_damaged": r.damaged, "Parsed_items": r.items, "Parsed_ports": None if r.ports is None else stats.last_ports(r.ports), "Flat": results.get("flat"), "API_Ready": results.get("findings")}
    found |= {f"Stats_{k}": v for k, v in results["stats"].items()}
    found |= {f"Consolidated_{k}": getattr(done, k) for k in ("entries", "services", "outputs", "metadata", "evaluation")} if done else {}
    return {k: df for k, df in found.items() if df is not None}


def write(results: dict[str, object], source: str, output_dir: str, name: str | None = None) -> dict[str, bool]:
    """One folder of JSON lines for each table, written by the executors, several at a time. Says which were written; what is there already is never replaced."""
    stem = Path(name).stem if name else f"{datetime.now():%d-%m-%y_%H-%M-%S}_{Path(source).stem}"

    def put(suffix: str, df: DataFrame) -> bool:
        try:
            # Flat rows leave out what a port does not have; the others keep their nulls.
            df.write.mode("error").option("ignoreNullFields", str(suffix == "Flat").lower()).json(f"{output_dir.rstrip('/')}/{stem}_{suffix}")
        except Exception as e:  # one table that fails does not keep the others from being written
            log.error("%s_%s could not be written: %s", stem, suffix, str(e).split("\n", 1)[0])
            return False
        return True

    found = tables(results)
    with ThreadPoolExecutor(WRITERS) as pool:
        return dict(zip(found, pool.map(put, found.keys(), found.values()), strict=True))


def _by_name(rows: list[dict], key: str, value: str) -> dict:
    return {r[key]: r[value] for r in rows}


def _one(df: DataFrame) -> dict:
    return {k: v for k, v in (documents.rows(df) or [{}])[0].items() if k != "file_id"}


def _net_counts(s: dict[str, DataFrame], services: int) -> dict:
    return {"hosts": _one(s["hosts"]) | {"by_status": _by_name(documents.rows(s["by_host_status"]), "host_status", "n")}, "ports": {"by_status": _by_name(documents.rows(s["ports_by_status"]), "status", "n"), "by_port": _by_name(documents.rows(s["ports_by_port"]), "port_id", "n")}, "services": {"total": services, "by_service": _by_name(documents.rows(s["services"]), "service_name", "n")}}


def _vuln_counts(s: dict[str, DataFrame], plugins: int) -> dict:
    return {"hosts": _one(s["hosts"]), "ports": _one(s["ports"]), "services": {"unique_counts": _by_name(documents.rows(s["service_instances"]), "svc_name", "n_instances"), "findings_counts": _by_name(documents.rows(s["service_findings"]), "svc_name", "n_findings")}, "vulnerabilities": {"total": plugins, "by_severity": _by_name(documents.rows(s["by_severity"]), "severity", "n_plugins"), "by_family": _by_name(documents.rows(s["by_family"]), "family", "n_plugins")}}


def _affected_hosts(r: xml.Report) -> DataFrame:
    affected = stats.plugin_hosts(r.items).join(stats.affected_ids(r.hosts), ["file_id", "host_ord"]).join(r.hosts.select("file_id", "host_ord", "ip", "fqdn"), ["file_id", "host_ord"])
    return affected.select("plugin_id", "affected_host_id", "ord", "ip", "fqdn", port_key(F.col("port"), F.col("protocol")).alias("port"), "plugin_output")


def parsed_document(results: dict[str, object]) -> dict:
    """Context, statistics, hosts and findings or ports of one report as a nested object."""
    r, s = results["report"], results["stats"]
    context = _one(r.context)
    if r.kind == "net":
        hosts = {str(h["host_ord"]): {"ip": h["ip"], "hostname": h["hostname"], "status": h["host_status"], "ports": {}} for h in documents.rows(r.hosts, "host_ord")}
        for p in documents.rows(stats.last_ports(r.ports), "host_ord", "ord"):
            details = None if p["service_details"] is None else documents.json.loads(p["service_details"])
            hosts[str(p["host_ord"])]["ports"][f"{p['protocol']}/{p['port_id']}"] = {"status": p["status"], "service": p["service_name"], "details": details, "scripts": p["script_output"]}
        for p in documents.rows(s["port_summary"]):
            hosts[str(p["host_ord"])]["port_summary"] = {x: p[x] for x in ("open", "closed", "filtered")}
        services = {x["service_id"]: {"host": x["host_ord"], "port": x["port_id"], "protocol": x["protocol"], "status": x["status"], "name": x["service_name"]} for x in documents.rows(stats.service_ids(r.ports).select("service_id", "host_ord", "ord", "port_id", "protocol", "status", "service_name"), "host_ord", "ord")}
        counts = _net_counts(s, len(services))
        return {"context": context, "stats": counts, "hosts": hosts, "services": services}
    hosts = {str(h["host_ord"]): {k: h[k] for k in ("ip", "fqdns", "os", "scan_start", "scan_end", "credentialed")} | {"vulnerabilities": {}, "ports": {}} for h in documents.rows(r.hosts.filter("has_properties"), "host_ord")}
    for x in documents.rows(s["host_severities"]):
        hosts[str(x["host_ord"])]["vulnerabilities"] = {k: v for k, v in x.items() if k not in ("file_id", "host_ord")}
    for x in documents.rows(s["host_ports"], "host_ord", "port_key"):
        hosts[str(x["host_ord"])]["ports"][x["port_key"]] = {"service": x["service"], "vulnerabilities": x["plugin_ids"]}
    found = {x["plugin_id"]: {k: v for k, v in x.items() if k not in NOT_OF_A_PLUGIN} | {"affected_hosts": {}} for x in documents.rows(stats.plugins(r.items), "ord")}
    for x in documents.rows(_affected_hosts(r), "ord"):
        found[x["plugin_id"]]["affected_hosts"][str(x["affected_host_id"])] = {"ip": x["ip"], "fqdn": x["fqdn"], "ports": [x["port"]] if x["port"] else [], "plugin_output": x["plugin_output"]}
    counts = _vuln_counts(s, len(found))
    return {"context": context, "stats": counts, "hosts": hosts, "vulnerabilities": found}


def consolidated_document(done: C.Consolidated) -> dict:
    metadata = {k: v for k, v in (documents.rows(done.metadata) or [{}])[0].items() if k != "file_id"} | {"consolidated_at": f"{datetime.now():%Y-%m-%d %H:%M:%S}"}
    out = {}
    for e in documents.rows(done.entries, "rule_ord"):
        rest = {k: v for k, v in e.items() if k not in NOT_OF_AN_ENTRY}
        named = {"internal_vulnerability_id": e["internal_id"]} if e["has_internal_id"] else {}
        out[e["rule_name"]] = {"rule_name": e["rule_name"], "title": e["title"], **named, **rest, "consolidated_plugins": {p["id"]: p["name"] for p in e["consolidated_plugins"]}, "affected_services": {}}
    for x in documents.rows(C.with_outputs(done.services, done.outputs), "rule_ord", "first_seen"):
        out[x["rule_name"]]["affected_services"][x["service_key"]] = {k: x[k] for k in ("ip", "fqdn", "port", "issues_found", "plugin_outputs")}
    return {"consolidation_metadata": metadata, "consolidated_vulnerabilities": out}


def _ports_of_hosts(df: DataFrame, key: Column, value: Column) -> DataFrame:
    """file_id, host_ord, ports: a text of JSON. A host has at most as many ports as there are."""
    listed = F.array_sort(F.collect_list(F.struct("ord", large.member(key, value).alias("text"))))
    members = F.array_join(F.transform(listed, lambda x: x["text"]), "")
    return df.groupBy("file_id", "host_ord").agg(F.concat(F.lit("{"), F.substring(members, F.lit(2), F.length(members)), F.lit("}")).alias("ports"))


def large_document(results: dict[str, object], kind: str) -> list[str | large.Rows]:
    """The sections of a document of one report (``Parsed``, ``Consolidated``, ``API_Ready`` or ``Flat``) for ``large.write``; as JSON they are what
    the documents on the driver are."""
    r, s, done = results["report"], results["stats"], results.get("consolidated")
    key, dump = ["file_id", "host_ord"], documents.json.dumps
    if kind == "API_Ready":
        return ["[", large.Rows(results["findings"], ("rule_ord",), F.concat(F.lit(","), large.as_json(F.struct(*P.REQUIRED)))), "]"]
    if kind == "Flat":
        df = results["flat"]
        # Rows leave out what a port does not have.
        row = F.to_json(F.struct(*[c for c in df.columns if c not in ("file_id", "host_ord", "ord")]))
        return ["[", large.Rows(df, ("host_ord", "ord"), F.concat(F.lit(","), row)), "]"]
    if kind == "Consolidated":
        rows = done.entries.withColumn("plugins", F.map_from_entries("consolidated_plugins")).withColumn("ord", F.col("rule_ord"))
        rest = [c for c in done.entries.columns if c not in NOT_OF_AN_ENTRY]

        def fields(*named: Column) -> Column:
            return large.as_json(F.struct("rule_name", "title", *named, *rest, F.col("plugins").alias("consolidated_plugins")))

        # Rules without an internal id have no such member.
        rows = rows.withColumn("json", F.when(F.col("has_internal_id"), fields(F.col("internal_id").alias("internal_vulnerability_id"))).otherwise(fields()))
        services = C.with_outputs(done.services, done.outputs).withColumn("ord", F.col("first_seen"))
        listed = large.nested(rows, services, ["file_id", "rule_ord"], "affected_services", F.col("rule_name"), F.col("json"), F.col("service_key"), F.struct("ip", "fqdn", "port", "issues_found", "plugin_outputs"))
        metadata = _one(done.metadata) | {"consolidated_at": f"{datetime.now():%Y-%m-%d %H:%M:%S}"}
        return [f'{{"consolidation_metadata":{dump(metadata)},"consolidated_vulnerabilities":{{', listed, "}}"]
    empty, json_of = F.lit("{}"), large.as_json
    if r.kind == "net":
        value = F.concat(F.lit('{"status":'), large.quoted(F.col("status")), F.lit(',"service":'), large.quoted(F.col("service_name")), F.lit(',"details":'), F.coalesce("service_details", F.lit("null")), F.lit(',"scripts":'), json_of(F.col("script_output")), F.lit("}"))
        ports = _ports_of_hosts(stats.last_ports(r.ports), F.concat_ws("/", "protocol", "port_id"), value)
        hosts = r.hosts.join(ports, key, "left").join(s["port_summary"].select(*key, json_of(F.struct("open", "closed", "filtered")).alias("summary")), key, "left")
        summary = F.coalesce(F.concat(F.lit(',"port_summary":'), "summary"), F.lit(""))
        head = json_of(F.struct("ip", "hostname", F.col("host_status").alias("status")))
        text = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"ports":'), F.coalesce("ports", empty), summary, F.lit("}"))
        services = stats.service_ids(r.ports)
        of_service = F.struct(F.col("host_ord").alias("host"), F.col("port_id").alias("port"), "protocol", "status", F.col("service_name").alias("name"))
        top = dump(_one(r.context)), dump(_net_counts(s, services.count()))
        return [f'{{"context":{top[0]},"stats":{top[1]},"hosts":{{', large.Rows(hosts, ("host_ord",), large.member(F.col("host_ord"), text)), '},"services":{', large.Rows(services, ("host_ord", "ord"), large.member(F.col("service_id"), json_of(of_service))), "}}"]
    ports = _ports_of_hosts(s["host_ports"].withColumn("ord", F.col("port_key")), F.col("port_key"), json_of(F.struct("service", F.col("plugin_ids").alias("vulnerabilities"))))
    severities = s["host_severities"]
    severities = severities.select(*key, json_of(F.struct(*[c for c in severities.columns if c not in key])).alias("severities"))
    hosts = r.hosts.filter("has_properties").join(ports, key, "left").join(severities, key, "left")
    head = json_of(F.struct("ip", "fqdns", "os", "scan_start", "scan_end", "credentialed"))
    text = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"vulnerabilities":'), F.coalesce("severities", empty), F.lit(',"ports":'), F.coalesce("ports", empty), F.lit("}"))
    found = stats.plugins(r.items)
    of_host = F.struct("ip", "fqdn", F.when(F.col("port") != "", F.array("port")).otherwise(F.array().cast("array<string>")).alias("ports"), "plugin_output")
    fields = F.struct(*[c for c in found.columns if c not in NOT_OF_A_PLUGIN])
    listed = large.nested(found, _affected_hosts(r), ["plugin_id"], "affected_hosts", F.col("plugin_id"), json_of(fields), F.col("affected_host_id"), of_host)
    top = dump(_one(r.context)), dump(_vuln_counts(s, found.count()))
    return [f'{{"context":{top[0]},"stats":{top[1]},"hosts":{{', large.Rows(hosts, ("host_ord",), large.member(F.col("host_ord"), text)), '},"vulnerabilities":{', listed, "}}"]


def _each_report(results: dict[str, object], source: str, name: str | None) -> Iterator[tuple[str, dict[str, object], str, str | None]]:
    """Results of one report after the other, with what goes before the kinds of its documents, and its source and name.

    Of several reports each has its own documents, named by its file as well."""
    files = files_of(results, MOST_DOCUMENTS + 1)
    if len(files) > MOST_DOCUMENTS:
        raise ValueError(f"documents of more than {MOST_DOCUMENTS} reports are not written at once; write the tables instead")
    if len(files) < 2:
        yield "", results, source, name
        return
    for k, file_id in enumerate(files, 1):
        # Files of different folders may have one name.
        stem = f"{k}_{Path(unquote(file_id)).stem}"
        yield f"{stem}_", of_file(results, file_id), stem, f"{Path(name).stem}_{stem}.json" if name else None


def write_documents(results: dict[str, object], source: str, output_dir: str, name: str | None = None) -> dict[str, bool]:
    """Single JSON documents, those of one report each, whose results have to fit the driver. Says which were written."""
    return {before + kind: done for before, *report in _each_report(results, source, name) for kind, done in _write_documents(report[0], report[1], output_dir, report[2]).items()}


def write_large_documents(results: dict[str, object], source: str, output_dir: str, name: str | None = None) -> dict[str, bool]:
    """The same documents, of any size and in any store: the executors write their parts. Says which were written; what is there already stays as it is."""
    written = {}
    for before, one, of, named in _each_report(results, source, name):
        for kind, result in (("Parsed", "report"), ("Consolidated", "consolidated"), ("API_Ready", "findings"), ("Flat", "flat")):
            if one.get(result) is None:
                continue
            path = f"{output_dir.rstrip('/')}/{documents.custom_name(kind, named) if named else documents.output_name(kind, of, one['kind'])}"
            try:
                large.write(one["report"].hosts.sparkSession, large_document(one, kind), path)
                written[f"{before}{kind}.json"] = True
            except Exception as e:  # one document that fails does not keep the others from being written
                log.error("%s could not be written: %s", path, str(e).split("\n", 1)[0])
                written[f"{before}{kind}.json"] = False
    return written


def _write_documents(results: dict[str, object], source: str, output_dir: str, name: str | None) -> dict[str, bool]:
    folder, found = documents.ensure_directory(output_dir), {"Parsed": parsed_document(results)}
    if results.get("consolidated"):
        found["Consolidated"] = consolidated_document(results["consolidated"])
    if results.get("findings") is not None:
        found["API_Ready"] = [{k: x[k] for k in P.REQUIRED} for x in documents.rows(results["findings"], "rule_ord")]
    if results.get("flat") is not None:
        found["Flat"] = [{k: v for k, v in x.items() if k not in ("file_id", "host_ord", "ord")} for x in documents.rows(results["flat"], "host_ord", "ord", nulls=False)]
    return {f"{kind}.json": documents.write_json(data, folder / (documents.custom_name(kind, name) if name else documents.output_name(kind, source, results["kind"]))) for kind, data in found.items() if data}
