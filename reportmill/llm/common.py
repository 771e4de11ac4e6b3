"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of characters other than these six.
SEPARATORS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Keys that are joined by broadcast have this many rows at least, and there are so many of them at most.
HOT_ROWS, HOT_KEYS = 1000, 2000
#: Keys of rows (ids and hashes) that are broadcast at most. Beyond that, rows are shuffled to meet them.
MOST_BROADCAST = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the words of ``text``; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SEPARATORS + "+"), lambda w: w != "")


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset, a folder beside the warehouse, which a cluster
    shares as well, or on one machine a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        held = context._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/.reportmill"
        root = _LOCAL.setdefault(context.applicationId, "") or tempfile.mkdtemp(prefix="reportmill-")
        _LOCAL[context.applicationId] = root
    return root


_LOCAL: dict[str, str] = {}
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def _store(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new place in the shared folder. What is left there goes when the application ends."""
    own = f"{scratch_root(spark).rstrip('/')}/reportmill/{spark.sparkContext.applicationId}"
    store, at = _store(spark, own)
    store.mkdirs(at)
    store.deleteOnExit(at)
    return f"{own}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str, by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors.

    The files stay until the application ends, since the returned frame is lazy, or until ``discard``. by: columns that the files are parted by."""
    path = scratch_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").partitionBy(*(by or [])).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the files of materialised frames that nothing reads any more."""
    for df in frames:
        if path := _PATHS.pop(df, None):
            store, at = _store(df.sparkSession, path)
            store.delete(at, True)


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, rows: int = 1000, megabytes: int = 8) -> None:
    """Let Python workers take at most so many rows and bytes at once. Texts can be long, and the defaults of 10,000 rows and 64 MB are much for several copies.

    This stays set in the session: frames are lazy, and the settings count when they run. Smaller ones are kept."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(key, None)  # from Spark 4.1 on
    if held and not 0 < int(held.rstrip("b")) <= megabytes << 20:
        spark.conf.set(key, f"{megabytes << 20}b")


def join_hot(rows: DataFrame, keyed: DataFrame, key: list[str], total: int) -> DataFrame:
    """rows join keyed, which has each key once and in ``n`` the number of its rows; those of ``total`` rows with many are broadcast."""
    limit = max(HOT_ROWS, -(-total // HOT_KEYS))
    hot = F.broadcast(keyed.filter(F.col("n") >= limit))
    cold = rows.join(F.broadcast(keyed.filter(F.col("n") >= limit).select(*key)), key, "left_anti").join(keyed.filter(F.col("n") < limit), key)
    return rows.join(hot, key).unionByName(cold)



def remaining(rows: DataFrame, marks: DataFrame, key: str) -> DataFrame:
    """marks: key and twins, each key once. The rows whose key has no mark, and of those whose mark says ``twins`` one for each key.

    Few marks are broadcast, so rows stay where they are; their number is counted for that."""
    marks = materialize(marks, "marks")
    marked = rows.join(F.broadcast(marks) if marks.count() <= MOST_BROADCAST else marks, key, "left")
    first = marked.filter("twins").groupBy(key).agg(F.first("row").alias("row"))
    return marked.filter(F.col("twins").isNull()).select("row").unionAll(first.select("row"))


def one_of_each(docs: DataFrame, link: Callable[[DataFrame], DataFrame], text_col: str, id_col: str) -> DataFrame:
    """link: from rows (key, text) to key and component_id, the least key of its component. Of each component the row with the smallest id (null
    ids last; of rows with one id any one), with all its columns.

    Rows are told apart by id and text, so ids may be null or repeated; of rows that agree in both one is taken."""
    small_batches(docs.sparkSession)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    key = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text")).alias("key")
    found = link(docs.select(key, F.col(text_col).alias("text")))
    seen = found.groupBy("key").agg(F.min("component_id").alias("first"), F.count("*").alias("n"))
    marks = seen.filter("key <> first or n > 1").select("key", (F.col("key") == F.col("first")).alias("twins"))
    return remaining(docs.select(row, key), marks, "key").select("row.*")
