"""Kinds of report files: by their suffix and root element, else by their first characters.

``detect`` and ``check`` read a local file on the driver; ``detect_in_store`` reads the first bytes of a file or folder in any store, and
``check_in_store`` has the executors check whole files.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from reportmill import kinds  # noqa: F401 (registers the built-in kinds)
from reportmill.sources import adapters

#: Elements that a vulnerability report has whatever its root is called.
PARTS = {"Report", "Policy"}


def root(path: str | Path) -> str | None:
    """The root element, from the beginning of the file alone; None for what is no XML."""
    try:
        for _, element in ET.iterparse(path, events=("start",)):
            return element.tag
    except ET.ParseError:
        pass
    return None


def _tags(path: str | Path, wanted: set[str]) -> set[str]:
    """Which of the wanted elements the file has, read as a stream. Raises ParseError."""
    found = set()
    for _, element in ET.iterparse(path):
        if element.tag in wanted:
            found.add(element.tag)
        element.clear()
    return found


def is_vulnerability_report(path: str | Path) -> bool:
    """By its root element, or else by a report and a policy anywhere in it, for which the whole file is read."""
    try:
        return root(path) == "NessusClientData_v2" or _tags(path, PARTS) == PARTS
    except (ET.ParseError, OSError):
        return False


def check(path: str | Path, kind: str) -> None:
    """Strict checks of a file before it is read: it exists, has the kind's suffix and is well-formed; port scans also need their root.

    Row tags alone would accept a cut file. Raises FileNotFoundError or ValueError."""
    path, adapter = Path(path), adapters.adapter(kind)
    if not path.exists():
        raise FileNotFoundError(path)
    if path.suffix.lower() not in adapter.suffixes:
        raise ValueError(f"{path} does not end in {' or '.join(adapter.suffixes)}")
    try:
        _tags(path, set())
    except ET.ParseError as e:
        raise ValueError(f"{path} is not well-formed: {e}") from e
    if kind == "net" and root(path) not in adapter.roots:
        raise ValueError(f"{path} is no port scan")


def detect(path: str | Path) -> str:
    """The kind of a file. Raises FileNotFoundError, or ValueError where it is of none."""
    path = Path(path)
    if not path.exists():
        raise FileNotFoundError(path)
    suffix = path.suffix.lower()
    if suffix == ".nessus" and is_vulnerability_report(path):
        return "vuln"
    if suffix != ".nessus" and (found := adapters.by_root(root(path))):
        return found.kind
    with path.open(encoding="utf-8", errors="replace") as f:
        if found := adapters.by_head(f.read(1024)):
            return found.kind
    raise ValueError(f"{path} is no report of a known kind")


def _files(spark: SparkSession, path: str) -> list:
    """The files of a path, folder or pattern in any store, sorted; hidden ones and those of folders within are left out."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = list(fs.globStatus(at) or [])
    files = [f for x in found for f in (fs.listStatus(x.getPath()) if x.isDirectory() else [x]) if f.isFile() and not f.getPath().getName().startswith((".", "_"))]
    if not files:
        raise FileNotFoundError(path)
    return sorted((f.getPath() for f in files), key=lambda f: f.toString())


def head(spark: SparkSession, path: str, n: int = 1024) -> str:
    """The first n bytes of a file in any store that Spark reads, or of the first file of a folder or pattern. Raises FileNotFoundError."""
    at = _files(spark, path)[0]
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        return bytes(b & 255 for b in spark._jvm.org.apache.commons.io.IOUtils.toByteArray(spark._jvm.org.apache.commons.io.input.BoundedInputStream(stream, n))).decode("utf-8", "replace")
    finally:
        stream.close()


def check_in_store(spark: SparkSession, path: str, kind: str) -> None:
    """The strict checks of files in any store. Hosts are checked by those tasks that read them, and what lies outside of them as a document of its own,
    so files of any size are. Raises FileNotFoundError or ValueError."""
    adapter, files = adapters.adapter(kind), _files(spark, path)
    for f in files:
        if not f.getName().lower().endswith(tuple(adapter.suffixes)):
            raise ValueError(f"{f.toString()} does not end in {' or '.join(adapter.suffixes)}")
    r = adapter.read(spark, path, {"strict": False, "port_status": "all"})
    if r.damaged is not None and (bad := r.damaged.first()):
        raise ValueError(f"{bad.file_id} is not well-formed: {bad.cause}")
    try:
        rows = [] if r.root is None else r.root.collect()
    except (PySparkException, Py4JJavaError) as e:
        if "SAXParseException" not in str(e):
            raise
        raise ValueError(f"{path} is not well-formed outside of hosts") from e
    if kind == "net" and (other := [x.file_id for x in rows if x.root not in adapter.roots]):
        raise ValueError(f"{other[0]} is no port scan")


def detect_in_store(spark: SparkSession, path: str) -> str:
    """The kind of a file, or of a folder by its first file, in any store; by its first characters."""
    if found := adapters.by_head(head(spark, path)):
        return found.kind
    raise ValueError(f"{path} is no report of a known kind")


def find_reports(directory: str | Path, kinds: tuple[str, ...] = ("vuln", "net"), recursive: bool = False) -> dict[str, list[Path]]:
    """Reports of a folder by kind, sorted. Vulnerability reports go by their suffix, port scans by their root; kinds that are unknown have none."""
    directory = Path(directory)
    if not directory.is_dir():
        return {}
    found: dict[str, list[Path]] = {k: [] for k in kinds}
    for path in sorted(directory.rglob("*") if recursive else directory.glob("*")):
        if path.suffix.lower() == ".nessus" and "vuln" in found:
            found["vuln"].append(path)
        elif path.suffix.lower() == ".xml" and "net" in found and (a := adapters.by_root(root(path))) and a.kind == "net":
            found["net"].append(path)
    return found
