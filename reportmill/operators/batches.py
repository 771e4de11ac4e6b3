"""Rollups over reports that keep arriving: what a file counts is kept, and only new files are read.

The state is a folder. ``counts`` has, for each batch, every file's counts by its digest; ``files`` has the files that were seen, with their digests and
batch. A batch counts once its files are written, which is the last step and one file, so a run that ends early leaves nothing behind
that counts, and is done again by the next one. A file is known by its place, size and time, or else by its content, so copies and moved
files count once; a file that changes counts anew, and what it counted before goes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reportmill.sources import adapters

_FILES = "file_id string, modified timestamp, size long, digest string, batch string, seen timestamp"
_COUNTS = "digest string, name string, key string, value long, batch string"


def _state(spark: SparkSession, folder: str, table: str, schema: str) -> DataFrame:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{table}")
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(schema).parquet(at.toString()) if there else spark.createDataFrame([], schema)


def _now(files: DataFrame) -> DataFrame:
    """Each file as it was seen last."""
    last = F.row_number().over(Window.partitionBy("file_id").orderBy(F.desc("seen"), "batch"))
    return files.withColumn("last", last).filter("last = 1").drop("last")


def digests(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file_id, digest: of each file's lines, by sums of hashes that splits add up, in whatever order."""
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file_id"), "value")
    sums = [F.sum(F.xxhash64("value", F.lit(k)).cast("decimal(38,0)")).cast("string") for k in (0, 1)]
    return lines.groupBy("file_id").agg(F.sha2(F.concat_ws("/", F.count("*").cast("string"), *sums), 256).alias("digest"))


def counts(spark: SparkSession, paths: list[str], kind: str) -> DataFrame:
    """file_id, name, key, value: the tables of a kind's statistics that have one key and one count a row."""
    found = adapters.adapter(kind).statistics(adapters.adapter(kind).read(spark, paths, {"strict": False, "port_status": "all"}))
    out = None
    for name, df in found.items():
        others = [c for c in df.columns if c != "file_id"]
        numbers = [c for c in others if dict(df.dtypes)[c] in ("bigint", "int")]
        texts = [c for c in others if dict(df.dtypes)[c] == "string"]
        if len(others) != 2 or len(numbers) != 1 or len(texts) != 1:
            continue
        (key,) = texts
        rows = df.select("file_id", F.lit(name).alias("name"), F.col(key).alias("key"), F.col(numbers[0]).cast("long").alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return out


def update(spark: SparkSession, path: str, kind: str, folder: str) -> DataFrame:
    """Reads the files of ``path`` that the state in ``folder`` does not have, and returns the rollup: name, key, value."""
    listed = spark.read.format("binaryFile").load(path).select("path", F.col("_metadata.file_path").alias("file_id"), F.col("_metadata.file_modification_time").alias("modified"), F.col("_metadata.file_size").alias("size"))
    known = _state(spark, folder, "files", _FILES)
    fresh = listed.join(_now(known).select("file_id", "modified", "size"), ["file_id", "modified", "size"], "left_anti")
    # The driver has listed the files already.
    paths = [r.path for r in fresh.select("path").toLocalIterator()]
    if paths:
        batch = uuid.uuid4().hex
        seen = fresh.join(digests(spark, paths), "file_id", "left").withColumn("digest", F.coalesce("digest", F.lit("")))
        seen = seen.select("path", "file_id", "modified", "size", "digest", F.lit(batch).alias("batch"), F.current_timestamp().alias("seen"))
        seen.select(*[c.split()[0] for c in _FILES.split(", ")], "path").write.parquet(f"{folder.rstrip('/')}/pending/{batch}")
        seen = spark.read.parquet(f"{folder.rstrip('/')}/pending/{batch}")
        counted = known.select("digest").distinct()
        new = seen.join(counted, "digest", "left_anti").groupBy("digest").agg(F.min_by(F.struct("path", "file_id"), "file_id").alias("f"))
        new_paths = [r.path for r in new.select("f.path").toLocalIterator()]
        if new_paths:
            rows = counts(spark, new_paths, kind).join(new.select("digest", F.col("f.file_id").alias("file_id")), "file_id")
            rows.select("digest", "name", "key", "value", F.lit(batch).alias("batch")).write.mode("append").parquet(f"{folder.rstrip('/')}/counts")
        seen.drop("path").coalesce(1).write.mode("append").parquet(f"{folder.rstrip('/')}/files")
    return rollup(spark, folder)


def rollup(spark: SparkSession, folder: str) -> DataFrame:
    """name, key, value over all files as they were seen last; files of one content count once."""
    files = _state(spark, folder, "files", _FILES)
    # Counts of a batch that did not end are of no use; the batch that did has them again.
    kept = _state(spark, folder, "counts", _COUNTS).join(files.select("batch").distinct(), "batch", "left_semi").join(_now(files).select("digest").distinct(), "digest", "left_semi")
    return kept.groupBy("name", "key").agg(F.sum("value").alias("value"))
