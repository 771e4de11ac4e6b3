"""Reports as they arrive in a folder: a row for each host, one micro-batch after the other. Each file is read once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportmill.sources import xml


def _rows(spark: SparkSession, directory: str, tag: str, schema: str, per_batch: int) -> DataFrame:
    stream = spark.readStream.format("xml").option("rowTag", tag).option("ignoreSurroundingSpaces", "false").option("maxFilesPerTrigger", per_batch)
    return stream.schema(schema).load(directory).withColumn("file_id", F.col("_metadata.file_path"))


def vulnerability_hosts(spark: SparkSession, directory: str, per_batch: int = 100) -> DataFrame:
    """file_id, ip, n_items of the hosts of vulnerability reports; hosts without properties have the ip ''."""
    rows = _rows(spark, directory, "ReportHost", xml.VULN_HOST, per_batch)
    return rows.select("file_id", xml._tag("host-ip").alias("ip"), F.coalesce(F.size("ReportItem"), F.lit(0)).alias("n_items"))


def scan_hosts(spark: SparkSession, directory: str, per_batch: int = 100) -> DataFrame:
    """file_id, ip, host_status, n_ports and n_open of the hosts of port scans that have an IPv4 address."""
    rows = _rows(spark, directory, "host", xml.NET_HOST, per_batch).withColumn("ip", F.get(F.filter("address", lambda a: a["_addrtype"] == "ipv4"), 0)["_addr"])
    ports = F.coalesce(F.col("ports.port"), F.array().cast(rows.schema["ports"].dataType["port"].dataType))
    n_open = F.size(F.filter(ports, lambda p: p["state"]["_state"] == "open"))
    return rows.filter("ip <> ''").select("file_id", "ip", F.coalesce("status._state", F.lit("unknown")).alias("host_status"), F.size(ports).alias("n_ports"), n_open.alias("n_open"))
