"""Kinds of reports. A kind is an adapter in a registry: how it is told, checked, read and counted.

A new kind needs one ``register`` call; detection, ``process`` and the command line then know it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Adapter:
    """kind: its name; suffixes and roots (XML root elements) of its files; read: (spark, path, options) to a report;
    statistics: of a report, by name; sniff: whether the first characters, in lower case, tell it; features: what ``process`` can do for it."""

    kind: str
    description: str
    suffixes: tuple[str, ...]
    roots: tuple[str, ...]
    read: Callable[[SparkSession, str, dict], object]
    statistics: Callable[[object], dict[str, DataFrame]]
    sniff: Callable[[str], bool]
    features: tuple[str, ...] = field(default=())


_ADAPTERS: dict[str, Adapter] = {}


def register(adapter: Adapter) -> Adapter:
    """Later adapters of a kind replace earlier ones; a root or suffix belongs to one kind."""
    for other in _ADAPTERS.values():
        if other.kind != adapter.kind and (taken := (set(other.roots) & set(adapter.roots)) | (set(other.suffixes) & set(adapter.suffixes))):
            raise ValueError(f"{', '.join(sorted(taken))} belongs to {other.kind}")
    _ADAPTERS[adapter.kind] = adapter
    return adapter


def unregister(kind: str) -> None:
    _ADAPTERS.pop(kind, None)


def adapter(kind: str) -> Adapter:
    if kind not in _ADAPTERS:
        raise ValueError(f"unknown kind {kind!r}, not one of {', '.join(_ADAPTERS)}")
    return _ADAPTERS[kind]


def adapters() -> list[Adapter]:
    return list(_ADAPTERS.values())


def by_root(root: str | None) -> Adapter | None:
    return next((a for a in adapters() if root in a.roots), None)


def by_suffix(suffix: str) -> Adapter | None:
    return next((a for a in adapters() if suffix.lower() in a.suffixes), None)


def by_head(head: str) -> Adapter | None:
    """By the first characters of a file, in the order of registration; only XML is looked at."""
    head = head[:1024].lower()
    return next((a for a in adapters() if "<?xml" in head and a.sniff(head)), None)


def supported() -> dict[str, dict]:
    return {a.kind: {"description": a.description, "extensions": list(a.suffixes), "features": list(a.features)} for a in adapters()}
