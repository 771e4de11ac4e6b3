"""JSON documents of any size: executors write ordered parts, which are then joined in the store that holds them.

A document is a list of sections: literal texts, and rows in an order. Rows are sorted and written by the executors, each as one line of JSON behind a comma,
and nothing but those lines' bytes passes through the driver, as a stream, when the parts become one file. What is on the driver is bounded by
the kinds of things in a report (ports, services, families), never by its hosts or findings.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that are copied at once where parts are joined.
COPIED = 1 << 20


@dataclass
class Rows:
    """Texts of a section in the order of columns: each text begins with a comma, of which the first is left out."""

    df: DataFrame
    order: tuple[str, ...]
    text: Column


def as_json(value: Column) -> Column:
    """JSON of a struct, map or array with all its nulls; of null as well."""
    return F.coalesce(F.to_json(value, {"ignoreNullFields": "false"}), F.lit("null"))


def quoted(value: Column) -> Column:
    """JSON of one value."""
    text = F.to_json(F.array(value), {"ignoreNullFields": "false"})
    return F.substring(text, F.lit(2), F.length(text) - 2)


def member(key: Column, value: Column) -> Column:
    """A member of an object, behind a comma; value: a text of JSON."""
    return F.concat(F.lit(","), quoted(key.cast("string")), F.lit(":"), value)


def nested(parents: DataFrame, children: DataFrame, keys: list[str], name: str, key: Column, fields: Column, child_key: Column, child: Column) -> Rows:
    """Objects that have children by name, any number each. Parents and children have ``keys`` and ``ord``; fields: a text of JSON, an object with a member at least; child: a struct.

    Parents open and close in rows of their own, so that no task holds the children of one."""
    inside = children.select(*keys, F.col("ord").alias("_child"), child_key.cast("string").alias("_key"), as_json(child).alias("_json"))
    first = inside.groupBy(*keys).agg(F.min("_child").alias("_first"))
    at = parents.select(*keys, F.col("ord").alias("_parent"))
    placed = inside.join(at, keys).join(first, keys)
    row = member(F.col("_key"), F.col("_json"))
    text = F.when(F.col("_child") == F.col("_first"), F.substring(row, F.lit(2), F.length(row) - 1)).otherwise(row)
    rows = placed.select("_parent", F.lit(1).alias("_part"), "_child", text.alias("_text"))
    begin = F.concat(member(key, F.substring(fields, F.lit(1), F.length(fields) - 1)), F.lit(f",{json.dumps(name)}:{{"))
    none = F.lit(None).cast(inside.schema["_child"].dataType)
    for part, parent_text in ((0, begin), (2, F.lit("}}"))):
        rows = rows.unionByName(parents.select(F.col("ord").alias("_parent"), F.lit(part).alias("_part"), none.alias("_child"), parent_text.alias("_text")))
    return Rows(rows, ("_parent", "_part", "_child"), F.col("_text"))


def write(spark: SparkSession, sections: list[str | Rows], path: str) -> str:
    """Writes one document to a path in any store and returns the path; what is there already is never replaced (FileExistsError).

    A document that cannot be finished leaves nothing: it is joined beside its place and renamed."""
    hadoop = spark._jvm.org.apache.hadoop
    at = hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.exists(at):
        raise FileExistsError(path)
    work = hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.parts")
    try:
        store.mkdirs(work)
        for k, x in enumerate(sections):
            if isinstance(x, Rows):
                x.df.select(*x.order, x.text.alias("value")).orderBy(*x.order).select("value").write.text(f"{work}/{k}")
        whole = hadoop.fs.Path(work, "whole")
        out = store.create(whole, False)
        try:
            for k, x in enumerate(sections):
                if isinstance(x, str):
                    out.write(bytearray(x.encode()))
                    continue
                parts = sorted((f.getPath() for f in store.listStatus(hadoop.fs.Path(f"{work}/{k}")) if f.getPath().getName().startswith("part-") and f.getLen()), key=lambda f: f.getName())
                for n, part in enumerate(parts):
                    read = store.open(part)
                    try:
                        read.seek(int(n == 0))
                        hadoop.io.IOUtils.copyBytes(read, out, COPIED, False)
                    finally:
                        read.close()
        finally:
            out.close()
        if not store.rename(whole, at):
            raise FileExistsError(path)
    finally:
        store.delete(work, True)
    return path
