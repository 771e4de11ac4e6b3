"""Rule files of many patterns: rules by the name patterns that let a plugin in, so that only those are judged which a plugin may fit."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from reportmill.plans import rules as R
from reportmill.plans.prefilter import together

#: Patterns from which on rules are judged this way. Both ways give the same rows.
MANY = 200

VERDICTS = "array<struct<rule_ord:int,matched:boolean,reason:string>>"


def patterns_of(rules: list[dict]) -> set[str]:
    return {p for r in rules for kind in R.PATTERNS for p in r["filters"].get(kind) or []}


class Rules:
    """Rules as (filters, name patterns, name patterns that exclude), and by the name patterns that they have."""

    def __init__(self, rules: tuple[tuple[str, ...], ...]):
        self.filters = [json.loads(x) for x in rules]
        kinds = ("name_patterns", "exclude_name_patterns")
        self.patterns = tuple(sorted({p for f in self.filters for kind in kinds for p in f.get(kind) or []}))
        place = {p: k for k, p in enumerate(self.patterns)}
        self.excluding = [{place[p] for p in f.get("exclude_name_patterns") or []} for f in self.filters]
        self.families = [[set(f.get(kind) or []) for kind in ("plugin_families", "exclude_families")] for f in self.filters]
        self.named: dict[int, list[int]] = {}
        for k, f in enumerate(self.filters):
            for p in f.get("name_patterns") or []:
                self.named.setdefault(place[p], []).append(k)
        self.unnamed = [k for k, f in enumerate(self.filters) if not f.get("name_patterns")]
        self.readers = {k for k, f in enumerate(self.filters) if R.reads_output({"filters": f})}

    def opened(self, name: str, family: str | None) -> list[tuple[int, str | None]]:
        """Rules whose name patterns a plugin fits, in order, each with the first filter of names and families that excludes it."""
        found = set(together(self.patterns, re.IGNORECASE).found(name))
        out = []
        for k in sorted({*self.unnamed, *(k for p in found for k in self.named.get(p, ()))}):
            of, but = self.families[k]
            if of and family not in of:
                reason = "plugin_families"
            elif but and (family is None or family in but):
                reason = "exclude_families"
            else:
                reason = "exclude_name_patterns" if found & self.excluding[k] else None
            out.append((k, reason))
        return out

    def judged(self, name: str, family: str | None, spoken: bool, held: set[str]) -> list[tuple[int, bool, str | None]]:
        """rule_ord, matched, reason of the rules that match or exclude a plugin for a reason worth a note."""
        out = []
        for k, reason in self.opened(name, family):
            f = self.filters[k]
            if reason is None and k in self.readers:
                for kind, wanted in (("plugin_output_patterns", True), ("exclude_plugin_output_patterns", False)):
                    asked = f.get(kind)
                    test = all if f.get(kind.replace("patterns", "require_all")) else any
                    if asked and (spoken and test(p in held for p in asked)) is not wanted:
                        reason = kind
                        break
            if reason is None or f.get("name_patterns") or reason != "plugin_families":
                out.append((k, reason is None, reason))
        return out


@lru_cache(maxsize=16)
def compiled(rules: tuple[str, ...]) -> Rules:
    """One of a kind in each Python worker."""
    return Rules(rules)


def _filters(rules: list[dict]) -> tuple[str, ...]:
    return tuple(json.dumps(r["filters"]) for r in rules)


def may_read(name: Column, family: Column, rules: list[dict]) -> Column:
    """Whether a rule that reads outputs lets a plugin through so far."""
    asked = _filters(rules)

    @F.pandas_udf("boolean")
    def wanted(name: pd.Series, family: pd.Series) -> pd.Series:
        r = compiled(asked)
        return pd.Series([any(reason is None and k in r.readers for k, reason in r.opened(n, f)) for n, f in zip(name, family, strict=True)], dtype=bool)

    return wanted(name, family)


def verdicts(name: Column, family: Column, spoken: Column, held: Column, rules: list[dict], patterns: list[str]) -> Column:
    """Of each rule that matches or has a reason: rule_ord, matched, reason. held: places in ``patterns`` of those that the outputs match."""
    asked = _filters(rules)

    @F.pandas_udf(VERDICTS)
    def judged(name: pd.Series, family: pd.Series, spoken: pd.Series, held: pd.Series) -> pd.Series:
        r = compiled(asked)
        rows = zip(name, family, spoken, held, strict=True)
        return pd.Series([[dict(zip(("rule_ord", "matched", "reason"), x, strict=True)) for x in r.judged(n, f, bool(s), {patterns[k] for k in h})] for n, f, s, h in rows])

    return judged(name, family, spoken, held)
