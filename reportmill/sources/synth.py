"""The canonical tables made from the driver's star-schema tables, for queries that SQL can check."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reportmill.functions.scalars import in_order


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").join(_table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(_lines(spark, sf_dir))


def _items(rows: DataFrame) -> DataFrame:
    quantity, none = F.col("l_quantity").cast("int"), F.array().cast("array<string>")
    base = (F.col("p_size") % 11).cast("double")
    output = F.when(quantity % 3 == 0, "").otherwise(F.concat(F.lit("Installed version : "), (quantity % 9).cast("string"), F.lit(".1\nFixed version : 9.0")))

    def scores(score):
        return F.struct(score.alias("base_score"), F.lit(0.0).alias("temporal_score"), F.concat(F.lit("AV:N/"), F.col("p_brand")).alias("vector"))

    return rows.select(
        F.lit("synthetic").alias("file_id"), F.col("l_suppkey").alias("host_ord"),
        F.struct("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey").alias("ord"),
        F.col("l_partkey").cast("string").alias("plugin_id"), (1000 + F.col("l_linenumber")).cast("string").alias("port"),
        F.when(F.col("l_linestatus") == "F", "tcp").otherwise("udp").alias("protocol"),
        F.when(F.col("l_returnflag") == "A", "www").when(F.col("l_returnflag") == "R", "ssh").otherwise("").alias("svc_name"),
        ((F.col("p_size") + F.col("l_linenumber")) % 5).cast("int").alias("severity"), F.col("p_name").alias("name"), F.col("p_type").alias("family"),
        F.when(quantity % 5 == 4, "Critical").when(quantity % 5 == 3, "High").when(quantity % 5 == 2, "Medium").when(quantity % 5 == 1, "Low").otherwise("").alias("risk_factor"),
        scores(base).alias("cvss"), scores(base - 1).alias("cvss3"), output.alias("plugin_output"),
        F.concat(F.lit(" Upgrade to "), F.col("p_brand"), F.lit(" ")).alias("solution"),
        F.array(F.concat(F.lit("CVE-"), (F.col("p_size") % 7).cast("string"))).alias("cve"), none.alias("cwe"), none.alias("xref"), none.alias("see_also"),
    )


def hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    fqdn = F.when(key % 5 == 0, "").otherwise(F.concat(F.lit("h"), key.cast("string"), F.lit(".example")))
    names = F.when(key % 7 == 0, F.array(F.concat(F.lit("a"), key.cast("string")), F.concat(F.lit("b"), key.cast("string")))).when(fqdn != "", F.array(fqdn)).otherwise(F.array().cast("array<string>"))
    ip = F.concat(F.lit("10.0."), F.col("s_nationkey").cast("string"), F.lit("."), (key % 50).cast("string"))
    return _table(spark, sf_dir, "supplier").select(
        F.lit("synthetic").alias("file_id"), key.alias("host_ord"), ip.alias("ip"), fqdn.alias("fqdn"), names.alias("fqdns"),
        (key % 3 == 0).alias("credentialed"), (key % 4 != 3).alias("has_properties"))


def net_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return _table(spark, sf_dir, "customer").select(
        F.lit("synthetic").alias("file_id"), key.alias("host_ord"), F.concat(F.lit("10.1."), F.col("c_nationkey").cast("string"), F.lit("."), (key % 200).cast("string")).alias("ip"),
        F.when(key % 3 == 0, "").otherwise(F.col("c_name")).alias("hostname"), F.when(key % 10 == 0, "down").otherwise("up").alias("host_status"))


def net_ports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _net_ports(_table(spark, sf_dir, "orders"))


def _net_ports(rows: DataFrame) -> DataFrame:
    key = F.col("o_orderkey")
    names = F.create_map(*[F.lit(x) for k, s in enumerate(["", "http", "ssh", "ftp", "smtp", "dns", "ntp", "snmp"]) for x in (k, s)])
    product = F.when(key % 4 == 0, "").otherwise(F.concat(F.lit("prod"), (key % 4).cast("string")))
    version = F.when(key % 3 == 0, "").otherwise(F.concat(F.lit("1."), (key % 3).cast("string")))
    script = F.when(key % 6 == 0, F.lit("")).otherwise(F.concat(F.lit("out"), (key % 6).cast("string")))
    return rows.select(
        F.lit("synthetic").alias("file_id"), F.col("o_custkey").alias("host_ord"), key.alias("ord"), (key % 1024).cast("string").alias("port_id"),
        F.when(key % 2 == 0, "tcp").otherwise("udp").alias("protocol"),
        F.when(F.col("o_orderstatus") == "F", "open").when(F.col("o_orderstatus") == "O", "closed").otherwise("filtered").alias("status"),
        F.element_at(names, (key % 8).cast("int")).alias("service_name"), product.alias("product"), version.alias("version"), script.alias("script"),
        F.to_json(F.struct(F.nullif(product, F.lit("")).alias("product"), F.nullif(version, F.lit("")).alias("version"))).alias("service_details"), script.alias("script_output"),
    )


#: Hosts of a written report.
HOSTS_OF_A_FILE = 25


def _escaped(x: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(raw), F.lit(safe))
    return x


def said(items: DataFrame) -> Column:
    """An output with characters that XML keeps for itself, and with tags."""
    return F.concat(F.col("plugin_output"), F.lit(" <&> </ReportHost><ReportHost> "), F.col("plugin_id"))


def address(host_ord: Column) -> Column:
    """One for each host."""
    return F.concat_ws(".", F.lit("10"), F.floor(host_ord / 65536), F.floor(host_ord / 256) % 256, host_ord % 256)


def _file(host_ord: Column) -> Column:
    """The report that a host goes to."""
    return F.floor(host_ord / HOSTS_OF_A_FILE)


def _dealt(rows: DataFrame, host_ord: str) -> DataFrame:
    """Rows of tables by report. They are dealt once, as what they are: text is made where it is written."""
    return rows.repartition(_file(F.col(host_ord)))


def _written(spark: SparkSession, hosts: DataFrame, before: str, after: str) -> str:
    """hosts: file, host_ord, x (an element). A folder with compressed reports of some hosts each, without white space between them."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and spark.sparkContext.master.startswith("local["):
        root = tempfile.mkdtemp(prefix="reportmill-")
    folder = f"{(root or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/reports-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    files = hosts.groupBy("file").agg(F.array_join(in_order(F.col("x"), F.col("host_ord")), "").alias("x"))
    # One row is one report; all lie in one folder, which is listed at once.
    files.select(F.concat(F.lit(before), "x", F.lit(after)).alias("value")).write.option("maxRecordsPerFile", 1).option("compression", "gzip").text(folder)
    return folder


def write_vulnerabilities(spark: SparkSession, sf_dir: str) -> str:
    """The findings as reports in XML; returns their folder. Outputs are escaped or in character data sections, and comments hold tags."""
    rows = _items(_dealt(_lines(spark, sf_dir), "l_suppkey"))
    n = F.col("ord.l_linenumber")
    attributes = [F.concat(F.lit(f' {a}="'), _escaped(F.col(c).cast("string")), F.lit('"')) for a, c in (("port", "port"), ("svc_name", "svc_name"), ("protocol", "protocol"), ("severity", "severity"), ("pluginID", "plugin_id"), ("pluginName", "name"), ("pluginFamily", "family"))]
    output = F.when(n % 2 == 0, F.concat(F.lit("<![CDATA["), said(rows), F.lit("]]>"))).otherwise(_escaped(said(rows)))
    aside = F.when(n % 3 == 0, "<!-- </ReportHost><ReportHost name='none'> -->").when(n % 3 == 1, "\n").otherwise("")
    element = F.concat(aside, F.lit("<ReportItem"), *attributes, F.lit("><plugin_output>"), output, F.lit("</plugin_output></ReportItem>"))
    found = rows.groupBy(_file(F.col("host_ord")).alias("file"), "host_ord").agg(F.array_join(in_order(element, F.col("ord")), "").alias("items"))
    head = F.concat(F.lit('<ReportHost name="h"><HostProperties><tag name="host-ip">'), address(F.col("host_ord")), F.lit("</tag></HostProperties>"))
    hosts = found.select("file", "host_ord", F.concat(head, "items", F.lit("</ReportHost>")).alias("x"))
    return _written(spark, hosts, '<?xml version="1.0"?><NessusClientData_v2><Report name="r">', "</Report></NessusClientData_v2>")


def write_scans(spark: SparkSession, sf_dir: str) -> str:
    """The ports as port scans in XML; returns their folder."""
    rows = _net_ports(_dealt(_table(spark, sf_dir, "orders"), "o_custkey"))
    service = F.when(F.col("service_name") != "", F.concat(F.lit('<service name="'), "service_name", F.lit('" product="'), "product", F.lit('" version="'), "version", F.lit('"/>'))).otherwise("")
    element = F.concat(F.lit('<port protocol="'), "protocol", F.lit('" portid="'), "port_id", F.lit('"><state state="'), "status", F.lit('"/>'), service, F.lit("</port>"))
    found = rows.groupBy(_file(F.col("host_ord")).alias("file"), "host_ord").agg(F.array_join(in_order(element, F.col("ord")), "").alias("ports"))
    hosts = found.select("file", "host_ord", F.concat(F.lit('<host><status state="up"/><address addr="'), address(F.col("host_ord")), F.lit('" addrtype="ipv4"/><ports>'), "ports", F.lit("</ports></host>")).alias("x"))
    return _written(spark, hosts, '<?xml version="1.0"?><nmaprun start="1" version="7">', '<runstats><finished time="61"/></runstats></nmaprun>')


#: The same tables in SQL.
SQL = r"""
items as (
  select l_suppkey as host_ord, row_number() over (order by l_suppkey, l_shipdate, l_orderkey, l_linenumber, l_partkey) as ord,
    cast(l_partkey as varchar) as plugin_id, cast(1000 + l_linenumber as varchar) as port, case when l_linestatus = 'F' then 'tcp' else 'udp' end as protocol,
    case l_returnflag when 'A' then 'www' when 'R' then 'ssh' else '' end as svc_name, (p_size + l_linenumber) % 5 as severity, p_name as name, p_type as family,
    case cast(l_quantity as int) % 5 when 4 then 'Critical' when 3 then 'High' when 2 then 'Medium' when 1 then 'Low' else '' end as risk_factor,
    cast(p_size % 11 as double) as base_score, 'AV:N/' || p_brand as vector,
    case when cast(l_quantity as int) % 3 = 0 then '' else 'Installed version : ' || (cast(l_quantity as int) % 9) || '.1' || chr(10) || 'Fixed version : 9.0' end as plugin_output,
    ' Upgrade to ' || p_brand || ' ' as solution, 'CVE-' || (p_size % 7) as cve
  from lineitem join part on l_partkey = p_partkey),
hosts as (
  select s_suppkey as host_ord, '10.0.' || s_nationkey || '.' || (s_suppkey % 50) as ip, case when s_suppkey % 5 = 0 then '' else 'h' || s_suppkey || '.example' end as fqdn,
    s_suppkey % 3 = 0 as credentialed, s_suppkey % 4 <> 3 as has_properties
  from supplier),
net_hosts as (
  select c_custkey as host_ord, '10.1.' || c_nationkey || '.' || (c_custkey % 200) as ip, case when c_custkey % 3 = 0 then '' else c_name end as hostname,
    case when c_custkey % 10 = 0 then 'down' else 'up' end as host_status
  from customer),
net_ports as (
  select o_custkey as host_ord, o_orderkey as ord, cast(o_orderkey % 1024 as varchar) as port_id, case when o_orderkey % 2 = 0 then 'tcp' else 'udp' end as protocol,
    case o_orderstatus when 'F' then 'open' when 'O' then 'closed' else 'filtered' end as status,
    case o_orderkey % 8 when 0 then '' when 1 then 'http' when 2 then 'ssh' when 3 then 'ftp' when 4 then 'smtp' when 5 then 'dns' when 6 then 'ntp' else 'snmp' end as service_name,
    case when o_orderkey % 4 = 0 then '' else 'prod' || (o_orderkey % 4) end as product, case when o_orderkey % 3 = 0 then '' else '1.' || (o_orderkey % 3) end as version,
    case when o_orderkey % 6 = 0 then '' else 'out' || (o_orderkey % 6) end as script
  from orders),
plugins as (select * from (select *, row_number() over (partition by plugin_id order by ord) as rn from items) where rn = 1),
plugin_hosts as (select * from (select *, row_number() over (partition by plugin_id, host_ord order by ord) as rn from items) where rn = 1),
outputs as (select plugin_id, string_agg(plugin_output, chr(10) order by ord) as outputs from plugin_hosts where plugin_output <> '' group by plugin_id)
"""
