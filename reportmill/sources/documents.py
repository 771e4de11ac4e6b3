"""JSON documents on the driver: bounded results as single files, their names and folders.

Tables of any size are written by the executors (``api.write``); a document is for one report whose results fit the driver, and says so if they do not.
"""

from __future__ import annotations

import json
import logging
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame

log = logging.getLogger("reportmill")

#: Rows of a table that go into one document, at most.
DOCUMENT_ROWS = 1_000_000
KINDS = ("Parsed", "Consolidated", "API_Ready", "Flat")


def ensure_directory(path: str | Path) -> Path:
    """The folder of a path, made where it is missing. What has a suffix is taken for a file, whose parent counts."""
    path = Path(path)
    folder = path.parent if path.suffix else path
    folder.mkdir(parents=True, exist_ok=True)
    return folder


def output_name(kind: str, source: str | Path, report: str | None = None, at: datetime | None = None) -> str:
    """``<dd-mm-yy_HH-MM-SS>_<stem>_<kind>[_<Report>].json``; consolidated findings without a report's kind end in ``_Findings``."""
    if kind not in KINDS:
        raise ValueError(f"{kind!r} is none of {', '.join(KINDS)}")
    last = f"_{report.title()}" if report else "_Findings" if kind == "Consolidated" else ""
    return f"{at or datetime.now():%d-%m-%y_%H-%M-%S}_{Path(source).stem}_{kind}{last}.json"


def custom_name(kind: str, name: str) -> str:
    """Names beside one that the user gives: it stands for the parsed report, the others add their kind to its stem."""
    return name if kind == "Parsed" else f"{Path(name).stem}_{'Consolidated_Findings' if kind == 'Consolidated' else kind}.json"


def pretty(data: object, indent: int = 2) -> str:
    return json.dumps(data, indent=indent, ensure_ascii=False)


def write_json(data: object, path: str | Path, indent: int = 2) -> bool:
    """Whether the document could be written; folders are made, failures are logged and not raised."""
    try:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(pretty(data, indent), encoding="utf-8")
    except (OSError, TypeError, ValueError) as e:
        log.error("%s could not be written: %s", path, e)
        return False
    return True


def read_json(path: str | Path) -> object:
    """Raises FileNotFoundError, or ValueError (with the place) for what is no JSON."""
    path = Path(path)
    if not path.exists():
        raise FileNotFoundError(path)
    try:
        return json.loads(path.read_text(encoding="utf-8"))
    except json.JSONDecodeError as e:
        raise ValueError(f"{path} is not JSON: {e}") from e


def has_keys(data: object, keys: list[str]) -> bool:
    """Whether it is an object with all these keys; what is missing is logged."""
    missing = [k for k in keys if k not in data] if isinstance(data, dict) else list(keys)
    if missing:
        log.error("missing: %s", ", ".join(missing))
    return isinstance(data, dict) and not missing


def rows(df: DataFrame, *order: str, nulls: bool = True) -> list[dict]:
    """The rows of a bounded table in order. nulls: whether fields without a value stay."""
    df = df.orderBy(*order) if order else df
    found = [json.loads(x) for x in df.limit(DOCUMENT_ROWS + 1).select(_json(df, nulls)).toPandas()["j"]]
    if len(found) > DOCUMENT_ROWS:
        raise ValueError(f"over {DOCUMENT_ROWS} rows are no document; write the tables instead")
    return found


def _json(df: DataFrame, nulls: bool):
    from pyspark.sql import functions as F

    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": str(not nulls).lower()}).alias("j")
