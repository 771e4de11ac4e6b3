"""Reports in XML as canonical tables. Every leaf is read as a string and cast later.

Hosts are most of a report and independent of each other. So a file is read as text whose rows end where a host's closing tag begins, which Spark
splits over tasks however large the file is; each host is then parsed by itself. What lies outside of hosts is put together again to a small
document, which has the context. Where rows end is settled in :mod:`scan`: neither comments, character data sections and instructions
that hold such tags, nor other encodings, move a boundary.

Ordinals are taken where a row is read (file, block, running id), before any shuffle, so they follow document order. Hosts are numbered
by block: ranks within the blocks, and the sums of the blocks before. Elements that are damaged keep their number, are in no other table, and
have a row in ``damaged`` each.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reportmill.functions import scalars as S
from reportmill.functions.scalars import in_order
from reportmill.sources import scan

_CHILDREN = "risk_factor cvss_base_score cvss_temporal_score cvss_vector cvss3_base_score cvss3_temporal_score cvss3_vector description synopsis solution plugin_output".split()
_ATTRIBUTES = "pluginID pluginName pluginFamily severity port protocol svc_name".split()
_ITEM = {f"_{a}": "string" for a in _ATTRIBUTES} | dict.fromkeys(_CHILDREN, "string") | dict.fromkeys(("see_also", "cve", "cwe", "xref"), "array<string>")
PROPERTIES = "HostProperties struct<tag: array<struct<_name: string, _VALUE: string>>>"
#: What columns of items come from; the others are of a field with their own name.
_SOURCES = {"plugin_id": ["_pluginID"], "port": ["_port"], "protocol": ["_protocol"], "svc_name": ["_svc_name"], "severity": ["_severity"], "name": ["_pluginName"], "family": ["_pluginFamily"]}
_SOURCES |= {c: [f"{c}_base_score", f"{c}_temporal_score", f"{c}_vector"] for c in ("cvss", "cvss3")}


def vuln_host(wanted: list[str] | None = None) -> str:
    """The schema of a host. wanted: columns of items, all unless given."""
    fields = list(_ITEM) if wanted is None else [f for c in wanted for f in _SOURCES.get(c, [c])]
    return f"{PROPERTIES}, ReportItem array<struct<{', '.join(f'{f}: {_ITEM[f]}' for f in fields)}>>"


VULN_HOST = vuln_host()
NET_HOST = (
    "status struct<_state: string>, address array<struct<_addr: string, _addrtype: string>>, hostnames struct<hostname: array<struct<_name: string>>>, "
    "ports struct<port: array<struct<_portid: string, _protocol: string, state: struct<_state: string>, "
    "service: struct<_name: string, _product: string, _version: string, _extrainfo: string, _method: string, _conf: string>, script: array<struct<_id: string, _output: string>>>>>"
)


@dataclass
class Report:
    """Lazy tables of a report or of many: context, hosts and items (vulnerability reports) or ports (port scans).

    damaged: file_id, host_ord (null for what is no host), cause and start (how the element begins) of what could not be read.
    elements: what all but the context is made of, parsed once where it is kept. root: file_id and the root's name; reading it
    parses what lies outside of hosts. located: items or ports with ``ip``, their host's address, for what would read both tables only to join them."""

    kind: str
    context: DataFrame
    hosts: DataFrame
    items: DataFrame | None = None
    ports: DataFrame | None = None
    damaged: DataFrame | None = None
    elements: DataFrame | None = None
    root: DataFrame | None = None
    located: DataFrame | None = None


#: A start tag's attributes, whose values may hold any character but their quotes and "<".
_ATTRIBUTE = r"""(\s+[\w:.-]+\s*=\s*("[^"]*"|'[^']*'))*\s*"""
#: Characters of a damaged element that its row shows.
SHOWN = 200
FOREIGN = "not in the encoding it says"
#: A character that XML does not have.
LAST = "\0"


def _pieces(spark: SparkSession, path: str | list[str], tag: str) -> DataFrame:
    """file_id, place, parted (whether the file has other blocks), valid (whether it is in its encoding), pieces: text up to a closing tag of ``tag``, cut before each of its start tags. The first
    piece lies outside of all."""
    rows = scan.rows(spark, path, tag)
    text = F.when(scan.marked(F.col("value")), scan.plain(F.col("value"))).otherwise(F.col("value"))
    # The line break keeps a start tag at the very beginning from being taken for the first piece.
    outside = F.concat(F.lit("\n"), F.regexp_replace(text, r"^\s*>", ""), F.lit(LAST))
    return rows.select("file_id", "place", "parted", F.is_valid_utf8("value").alias("valid"), F.split(outside, rf"(?=<{tag}[\s/>])").alias("pieces"))


def _alone(tag: str) -> str:
    return rf"^<{tag}{_ATTRIBUTE}/>"


def _numbered(pieces: DataFrame, tag: str, schema: str) -> DataFrame:
    """One row for each start tag: file_id, place, valid, host_ord (from 1 in document order), start (how the element begins), e (its fields) and open, if it has no end.

    Elements are parsed by the tasks that read them, so that fields are shuffled to be numbered, and not the text."""
    found = pieces.select("file_id", "place", "parted", "valid", F.posexplode("pieces").alias("pos", "x"))
    # What lies outside of elements is left as a row without text, by which the last row of a block is known.
    element = F.col("pos") > 0
    final = F.col("x").endswith(LAST)
    alone = F.col("x").rlike(_alone(tag))
    # Of a row only the last element can have an end tag behind it.
    options = {"ignoreSurroundingSpaces": "false", "columnNameOfCorruptRecord": "_corrupt"}
    cut = found.select(
        "file_id", "parted", "valid", "pos", F.struct("place.block", "place.id", "pos").alias("place"),
        F.when(element, F.when(alone, F.regexp_extract("x", _alone(tag), 0)).otherwise(F.concat(F.rtrim("x", F.lit(LAST)), F.lit(f"</{tag}>")))).alias("x"),
        (~alone & ~final).alias("open"), alone.alias("alone"))
    # Exploded, since conditions on fields of an expression are else pushed down with it, and each parses the text once more.
    number = cut.withColumn("start", F.left("x", F.lit(SHOWN))).withColumn("e", F.explode(F.array(F.from_xml("x", f"{schema}, _corrupt string", options)))).drop("x")
    # A file of one block is numbered by its ranks; only the others are read for the sums of the blocks before.
    blocks = pieces.filter("parted").groupBy("file_id", "place.block").agg(F.sum(F.size("pieces") - 1).alias("n"), F.max("place.id").alias("last"))
    upto = Window.partitionBy("file_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    at_end = F.max("block").over(Window.partitionBy("file_id")) == F.col("block")
    blocks = blocks.select("file_id", "block", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"), F.when(at_end, F.col("last")).alias("last"))
    of_block = Window.partitionBy("file_id", "block")
    ranked = number.withColumn("block", F.col("place.block")).withColumn("rank", F.count_if(F.col("pos") > 0).over(of_block.orderBy("place"))).withColumn("own_last", F.max("place.id").over(of_block))
    joined = ranked.filter("pos > 0").join(blocks, ["file_id", "block"], "left")
    last = F.when(F.col("parted"), F.col("last")).otherwise(F.col("own_last"))
    ended = F.col("open") | (~F.col("alone") & F.coalesce(F.col("place.id") == last, F.lit(False)))
    return joined.select("file_id", "place", "valid", (F.coalesce("before", F.lit(0)) + F.col("rank")).cast("long").alias("host_ord"), "start", "e", ended.alias("open"))


def _elements(pieces: DataFrame, tag: str, schema: str) -> DataFrame:
    """One row for each element: file_id, host_ord, cause (null for those that are whole), start (how a damaged one begins) and its fields."""
    cause = F.when(F.col("open"), f"no end tag of {tag}").when(~F.col("valid"), FOREIGN).when(F.col("e._corrupt").isNotNull(), "not well-formed")
    named = _numbered(pieces, tag, schema).withColumn("cause", cause)
    return named.select("file_id", "host_ord", "cause", F.when(F.col("cause").isNotNull(), F.col("start")).alias("start"), "e.*").drop("_corrupt")


def _whole(elements: DataFrame) -> DataFrame:
    return elements.filter("cause is null").drop("cause", "start")


def _damaged(pieces: DataFrame, elements: DataFrame, tag: str) -> DataFrame:
    """file_id, host_ord, cause, start: elements that are not whole, and end tags that end nothing."""
    last = pieces.groupBy("file_id").agg(F.max("place").alias("last"))
    # A row without an open element that is not the file's last ends with a tag too many.
    idle = (F.size("pieces") < 2) | F.element_at("pieces", -1).rlike(_alone(tag))
    stray = pieces.filter(idle).select("file_id", "place", F.left(F.element_at("pieces", -1), F.lit(SHOWN)).alias("start")).join(last, "file_id").filter("place < last")
    outside = stray.withColumn("cause", F.lit(f"an end tag of {tag} without a start"))
    foul = pieces.filter(~F.col("valid") & (F.size("pieces") < 2)).select("file_id", F.left(F.get("pieces", 0), F.lit(SHOWN)).alias("start"), F.lit(FOREIGN).alias("cause"))
    stray = outside.select("file_id", "start", "cause").unionByName(foul).withColumn("host_ord", F.lit(None).cast("long"))
    return elements.filter("cause is not null").select("file_id", "host_ord", "cause", "start").unionByName(stray)


def _context(pieces: DataFrame, tag: str) -> DataFrame:
    """file_id and x, the file without its elements of ``tag``."""
    alone = _alone(tag)
    outside = F.concat(F.get("pieces", 0), F.array_join(F.transform(F.filter(F.slice("pieces", 2, F.size("pieces")), lambda x: x.rlike(alone)), lambda x: F.regexp_replace(x, alone, "")), ""))
    joined = pieces.select("file_id", "place", F.replace(outside, F.lit(LAST), F.lit("")).alias("x")).filter(r"x rlike '\\S'").groupBy("file_id").agg(F.array_join(in_order(F.col("x"), F.col("place")), "").alias("x"))
    return joined.withColumn("x", F.regexp_replace("x", r"^\s*\uFEFF|<!DOCTYPE[^>\[]*(\[[^\]]*\])?\s*>", ""))


def _root(outside: DataFrame) -> DataFrame:
    """file_id, root: the name of each file's root element; what is not well-formed raises."""
    return outside.select("file_id", F.xpath_string("x", F.lit("name(/*)")).alias("root"))


def _at(path: str) -> Column:
    """The first text or attribute of an XPath, null where there is none."""
    return F.get(F.xpath("x", F.lit(path)), 0)


def _tag(name: str) -> Column:
    """Text of the first tag of that name: '' without one, null where it is empty."""
    found = F.filter(F.coalesce(F.col("HostProperties.tag"), F.array().cast("array<struct<_name:string,_VALUE:string>>")), lambda t: t["_name"] == name)
    return F.when(F.size(found) == 0, "").otherwise(F.get(found, 0)["_VALUE"])


def _number(x: Column, strict: bool) -> Column:
    return F.when(x.isNull(), F.lit(0.0)).otherwise(x.cast("double") if strict else x.try_cast("double"))


def read_vulnerabilities(spark: SparkSession, path: str | list[str], strict: bool = False, wanted: list[str] | None = None) -> Report:
    """Vulnerability reports. strict: numbers that are none raise, else they are null. wanted: columns of items besides file_id, host_ord and ord, all unless
    given; what the others come from is not read."""
    pieces = _pieces(spark, path, "ReportHost")
    elements = _elements(pieces, "ReportHost", vuln_host(wanted))
    hosts = _whole(elements)
    start, end = S.report_time(_tag("HOST_START")), S.report_time(_tag("HOST_END"))
    table = hosts.select(
        "file_id", "host_ord", _tag("host-ip").alias("ip"), _tag("host-fqdn").alias("fqdn"), S.host_names(_tag("host-fqdns"), _tag("host-fqdn")).alias("fqdns"),
        _tag("operating-system").alias("os"), S.time_text(start).alias("scan_start"), S.time_text(end).alias("scan_end"),
        S.flag(_tag("Credentialed_Scan")).alias("credentialed"), F.col("HostProperties").isNotNull().alias("has_properties"))
    exploded = hosts.filter(F.col("HostProperties").isNotNull()).select("file_id", "host_ord", _tag("host-ip").alias("ip"), F.posexplode("ReportItem").alias("pos", "i"))

    def text(name: str) -> Column:
        return F.coalesce(F.col(f"i.{name}"), F.lit(""))

    def score(prefix: str) -> Column:
        return F.struct(_number(F.col(f"i.{prefix}_base_score"), strict).alias("base_score"), _number(F.col(f"i.{prefix}_temporal_score"), strict).alias("temporal_score"), text(f"{prefix}_vector").alias("vector"))

    columns = {
        "plugin_id": text("_pluginID"), "port": text("_port"), "protocol": text("_protocol"), "svc_name": text("_svc_name"),
        "severity": F.coalesce((F.col("i._severity").cast("int") if strict else F.col("i._severity").try_cast("int")), F.lit(0)), "name": text("_pluginName"), "family": text("_pluginFamily"),
        "risk_factor": text("risk_factor"), "cvss": score("cvss"), "cvss3": score("cvss3"), **{c: text(c) for c in ("description", "synopsis", "solution", "plugin_output")},
        "see_also": S.lines(F.get("i.see_also", 0)), **{c: F.coalesce(F.col(f"i.{c}"), F.array().cast("array<string>")) for c in ("cve", "cwe", "xref")}}
    located = exploded.select("file_id", "host_ord", F.struct("host_ord", "pos").alias("ord"), *[x.alias(c) for c, x in columns.items() if wanted is None or c in wanted], "ip")
    outside = _context(pieces, "ReportHost")
    context = outside.select(
        "file_id", _at("//Report/@name").alias("scan_name"), _at("//Policy//policyName/text()").alias("policy_name"),
        *[S.report_time(_at(f"(//preference[name='scan_{x}_timestamp'])[last()]/value/text()")).alias(x) for x in ("start", "end")])
    seconds = F.unix_timestamp("end") - F.unix_timestamp("start")
    context = context.select("file_id", "scan_name", "policy_name", S.time_text(F.col("start")).alias("scan_start"), S.time_text(F.col("end")).alias("scan_end"), S.clock(seconds).alias("scan_duration"))
    return Report("vuln", context, table, items=located.drop("ip"), located=located, damaged=_damaged(pieces, elements, "ReportHost"), elements=elements, root=_root(outside))


def read_scans(spark: SparkSession, path: str | list[str], status: str = "all") -> Report:
    """Port scans; hosts without an IPv4 address keep their number but are left out. status: exact state of the ports, or all."""
    pieces = _pieces(spark, path, "host")
    elements = _elements(pieces, "host", NET_HOST)
    hosts = _whole(elements)
    ip = F.get(F.filter("address", lambda a: a["_addrtype"] == "ipv4"), 0)["_addr"]
    hosts = hosts.withColumn("ip", ip).filter("ip <> ''")
    table = hosts.select("file_id", "host_ord", "ip", F.coalesce(F.get("hostnames.hostname", 0)["_name"], F.lit("")).alias("hostname"), F.coalesce("status._state", F.lit("unknown")).alias("host_status"))
    listed = F.col("ports.port") if status == "all" else F.filter("ports.port", lambda p: p["state"]["_state"] == status)
    exploded = hosts.select("file_id", "host_ord", "ip", F.posexplode(listed).alias("ord", "p"))
    s = {c: F.nullif(F.col(f"p.service._{c}"), F.lit("")) for c in ("product", "version", "extrainfo", "method", "conf")}
    details = F.to_json(F.struct(*[x.alias(c) for c, x in s.items()], S.combined_info(F.col("p.service._product"), F.col("p.service._version")).alias("combined_info")))
    # Of scripts with one id the last counts.
    scripts = F.filter(F.coalesce(F.col("p.script"), F.array().cast("array<struct<_id:string,_output:string>>")), lambda x: F.coalesce(x["_id"], F.lit("")) != "")
    lasts = F.filter(scripts, lambda x, k: ~F.exists(F.slice(scripts, k + 2, F.size(scripts)), lambda y: y["_id"] == x["_id"]))
    located = exploded.select(
        "file_id", "host_ord", "ord", F.coalesce("p._portid", F.lit("")).alias("port_id"), F.lower(F.coalesce("p._protocol", F.lit(""))).alias("protocol"), F.coalesce("p.state._state", F.lit("")).alias("status"),
        F.coalesce("p.service._name", F.lit("")).alias("service_name"), details.alias("service_details"), F.map_from_entries(lasts).alias("script_output"), "ip")
    # Without a finish, or where a time is no number, there is no duration; a finish without a time counts as 0.
    finished = F.size(F.xpath("x", F.lit("/nmaprun/runstats/finished"))) > 0
    seconds = F.coalesce(_at("/nmaprun/runstats/finished/@time"), F.lit("0")).try_cast("long") - _at("/nmaprun/@start").try_cast("long")
    outside = _context(pieces, "host")
    context = outside.select("file_id", *[F.coalesce(_at(f"/nmaprun/{x}"), F.lit("")).alias(name) for name, x in (("scanner_version", "@version"), ("scan_command", "@args"), ("scan_type", "scaninfo/@type"), ("scan_start", "@startstr"), ("scan_end", "runstats/finished/@timestr"))], S.spoken(F.when(finished, seconds)).alias("scan_duration"))
    return Report("net", context, table, ports=located.drop("ip"), located=located, damaged=_damaged(pieces, elements, "host"), elements=elements, root=_root(outside))
