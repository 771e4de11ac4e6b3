"""Consolidation rules: loading, validation and compilation to columns.

Rules are few and live on the driver; findings never are. All rules become one array of (rule, matched, reason) that a single
projection computes, so matching needs no join.
"""

from __future__ import annotations

import json
import re
from functools import reduce
from importlib import resources
from pathlib import Path
from re import _constants, _parser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LISTS = ("plugin_families", "name_patterns", "exclude_families", "exclude_name_patterns", "plugin_output_patterns", "exclude_plugin_output_patterns")
FLAGS = ("plugin_output_require_all", "exclude_plugin_output_require_all")
PATTERNS = tuple(x for x in LISTS if x.endswith("patterns"))
GROUPINGS = ("ip", "port", "service")


class ConsolidationError(Exception):
    """Consolidation could not be carried out."""


def default_path() -> Path:
    return Path(str(resources.files("reportmill") / "config" / "rules.json"))


def load(path: str | Path | None = None) -> list[dict] | None:
    """Rules of a file, or None where it is missing; broken JSON raises."""
    path = Path(path) if path else default_path()
    if not path.exists():
        return None
    try:
        return json.loads(path.read_text(encoding="utf-8"))["consolidation_rules"]
    except json.JSONDecodeError as e:
        raise ConsolidationError(f"{path} is not JSON: {e}") from e


def problems(rules: object) -> list[str]:
    """What is wrong with the structure of rules, disabled ones included; empty if nothing."""
    if not isinstance(rules, list):
        return ["consolidation_rules is not a list"]
    found, names = [], set()
    for k, rule in enumerate(rules):
        if not isinstance(rule, dict):
            found.append(f"rule {k} is not an object")
            continue
        where = rule.get("rule_name", f"rule {k}")
        found += [f"{where}: {x} is missing" for x in ("rule_name", "title", "filters", "grouping_criteria") if x not in rule]
        if where in names:
            found.append(f"{where}: the name is taken")
        names.add(where)
        filters = rule.get("filters", {})
        if not isinstance(filters, dict):
            found.append(f"{where}: filters is not an object")
            continue
        found += [f"{where}: {x} is not a list" for x in LISTS if not isinstance(filters.get(x, []), list)]
        found += [f"{where}: {x} is not true or false" for x in FLAGS if not isinstance(filters.get(x, False), bool)]
        if not isinstance(rule.get("grouping_criteria", []), list):
            found.append(f"{where}: grouping_criteria is not a list")
        for kind in PATTERNS:
            for pattern in filters.get(kind, []) if isinstance(filters.get(kind, []), list) else []:
                try:
                    re.compile(pattern)
                except (re.error, TypeError) as e:
                    found.append(f"{where}: {kind} has {pattern!r}: {e}")
    return found


def warnings(rules: list[dict]) -> list[str]:
    return [f"{r['rule_name']}: unknown grouping {g!r}" for r in rules for g in r["grouping_criteria"] if g not in GROUPINGS]


def enabled(rules: list[dict]) -> list[dict]:
    return [r for r in rules if r.get("enabled", True)]


def java_pattern(pattern: str) -> str:
    """A pattern of Python's dialect in Java's."""
    out = re.sub(r"\(\?P<", "(?<", re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", pattern))
    return re.sub(r"(?<!\\)\{,(\d+)\}", r"{0,\1}", re.sub(r"(?<!\\)((?:\\\\)*)\\Z", r"\1\\z", out))


def _matches(text: Column, patterns: list[str], flags: str, every: bool = False) -> Column:
    tests = [text.rlike(f"(?{flags}){java_pattern(p)}") for p in patterns]
    return reduce((lambda a, b: a & b) if every else (lambda a, b: a | b), tests)


def name_filters(rule: dict, name: Column, family: Column) -> tuple[Column, list[tuple[str, Column]]]:
    """Whether the name passes, and the later filters in order, as (filter, passes)."""
    f = rule["filters"]
    passes = _matches(name, f["name_patterns"], "iUd") if f.get("name_patterns") else F.lit(True)
    later = []
    if f.get("plugin_families"):
        later.append(("plugin_families", family.isin(f["plugin_families"])))
    if f.get("exclude_families"):
        later.append(("exclude_families", ~family.isin(f["exclude_families"])))
    if f.get("exclude_name_patterns"):
        later.append(("exclude_name_patterns", ~_matches(name, f["exclude_name_patterns"], "iUd")))
    return F.coalesce(passes, F.lit(False)), [(k, F.coalesce(x, F.lit(False))) for k, x in later]


def output_patterns(rule: dict) -> list[str]:
    f = rule["filters"]
    return [*(f.get("plugin_output_patterns") or []), *(f.get("exclude_plugin_output_patterns") or [])]


def within_a_line(pattern: str) -> bool:
    """Whether a match surely has no line break and depends on nothing beyond its line; what may have one is never said to be within."""
    return not re.search(r"\\[nrRsSWDHVvfxuUZzAGBNpPXkQE0-9]|\[\^|\(\?|\n|\r", pattern)


#: Spellings of a stretch of any text, line ends included; the first is the one that is tested.
GAPS = (r"[\s\S]*?", r"[\s\S]*", *(f"{group}{body}){again}{rest}" for group in ("(", "(?:") for body, rest in ((r".*\n", ".*"), (r".|\n", "")) for again in ("*?", "*")))


def halves(pattern: str) -> tuple[str, str] | None:
    """What a pattern asks for before and after any text, if that is all it asks for; each lies within a line, but that the first may end in white space
    and one line break."""
    parts, depth, at = [""], 0, 0
    while at < len(pattern):
        gap = max((g for g in GAPS if pattern.startswith(g, at)), key=len, default="") if depth == 0 else ""
        if gap:
            parts.append("")
            at += len(gap)
            continue
        c = pattern[at]
        end = at + 1
        if c == "\\":
            end = at + 2
        elif c == "[":
            end = pattern.index("]", at + (3 if pattern.startswith("[^", at) else 2)) + 1
            if "[" in pattern[at + 1 : end] or "\\]" in pattern[at:end]:
                return None
        elif c == "|" and depth == 0:
            return None
        depth += (c == "(") - (c == ")")
        parts[-1] += pattern[at:end]
        at = end
    if len(parts) != 2 or not all(parts):
        return None
    line = re.sub(r"(\\s\*\??)?(\\n)?$", "", parts[0])
    return (parts[0], parts[1]) if line and within_a_line(line) and within_a_line(parts[1]) and not recursive(parts[0]) and not recursive(parts[1]) else None


def recursive(pattern: str) -> bool:
    """Whether a group may be repeated without end. Java's matcher goes a call deeper each time and fails on long texts; Python's does not."""

    def within(tree) -> bool:
        for op, arg in tree:
            if op in (_constants.MAX_REPEAT, _constants.MIN_REPEAT, _constants.POSSESSIVE_REPEAT):
                least, most, body = arg
                one = len(body) == 1 and body[0][0] in (_constants.LITERAL, _constants.NOT_LITERAL, _constants.ANY, _constants.IN, _constants.CATEGORY)
                if (most == _constants.MAXREPEAT or most > DEEPEST) and not one or within(body):
                    return True
            elif op is _constants.BRANCH:
                if any(within(x) for x in arg[1]):
                    return True
            elif isinstance(arg, tuple) and any(within(x) for x in arg if isinstance(x, _parser.SubPattern)):
                return True
            elif isinstance(arg, _parser.SubPattern) and within(arg):
                return True
        return False

    return within(_parser.parse(pattern))


#: Repetitions of a group that are left to Java.
DEEPEST = 200


def python_matches(text: Column, patterns: list[str]) -> Column:
    """Array: of each pattern, whether a text matches it. For those that are too deep for Java."""
    found = [re.compile(p, re.IGNORECASE | re.MULTILINE) for p in patterns]

    @F.pandas_udf("array<boolean>")
    def matches(text: pd.Series) -> pd.Series:
        return pd.Series([[bool(p.search(x or "")) for p in found] for x in text])

    return matches(text)


def output_match(output: Column, pattern: str) -> Column:
    return _matches(output, [pattern], "imUd")


def output_filters(rule: dict, spoken: Column, held: dict[str, Column]) -> list[tuple[str, Column]]:
    """spoken: whether any affected host has an output; held: of each pattern, whether the outputs match it."""
    f, later = rule["filters"], []

    def found(kind: str) -> Column:
        tests = [held[p] for p in f[kind]]
        every = f.get(kind.replace("patterns", "require_all"), False)
        return spoken & reduce((lambda a, b: a & b) if every else (lambda a, b: a | b), tests)

    if f.get("plugin_output_patterns"):
        later.append(("plugin_output_patterns", found("plugin_output_patterns")))
    if f.get("exclude_plugin_output_patterns"):
        later.append(("exclude_plugin_output_patterns", ~found("exclude_plugin_output_patterns")))
    return later


def reads_output(rule: dict) -> bool:
    return bool(rule["filters"].get("plugin_output_patterns") or rule["filters"].get("exclude_plugin_output_patterns"))


def verdict(rule: dict, name: Column, family: Column, spoken: Column, held: dict[str, Column]) -> Column:
    """Empty where the name does not pass, null where the rule matches, or else the filter that excluded the plugin."""
    passes, later = name_filters(rule, name, family)
    later = later + output_filters(rule, spoken, held)
    reason = F.coalesce(*[F.when(~ok, F.lit(k)) for k, ok in later]) if later else F.lit(None).cast("string")
    return F.when(~passes, F.lit("")).otherwise(reason)


def result(rule_ord: int, rule: dict, found: Column) -> Column:
    """Of a verdict, the struct: rule_ord, rule_name, matched, reason (the filter that excluded a plugin whose name passed)."""
    reason = F.nullif(found, F.lit(""))
    # Without name patterns, plugins of other families are no exclusions worth a note.
    logged = reason if rule["filters"].get("name_patterns") else F.nullif(reason, F.lit("plugin_families"))
    return F.struct(F.lit(rule_ord).alias("rule_ord"), F.lit(rule["rule_name"]).alias("rule_name"), found.isNull().alias("matched"), logged.alias("reason"))


def rules_frame(spark: SparkSession, rules: list[dict]) -> DataFrame:
    rows = [(k, r["rule_name"], r["title"], None if r.get("internal_vulnerability_id") is None else str(r["internal_vulnerability_id"]), "internal_vulnerability_id" in r, list(r["grouping_criteria"])) for k, r in enumerate(rules)]
    return spark.createDataFrame(rows, "rule_ord int, rule_name string, title string, internal_id string, has_internal_id boolean, grouping array<string>")
