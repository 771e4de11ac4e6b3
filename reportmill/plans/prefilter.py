"""Many patterns in one pass over a text: those alone are tried of whose required literals the text holds one.

Which literals a pattern requires is read from its syntax, and one automaton looks for those of all patterns at once. That is for rule files of hundreds
or thousands of patterns; a few are faster as expressions (``rules.output_match``).
"""

from __future__ import annotations

import re
from functools import lru_cache
from re import _constants as C
from re import _parser

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters beyond ASCII that match one of ASCII where case is ignored.
ALIKE = {0x130: "i", 0x131: "i", 0x17F: "s", 0x212A: "k"}
#: Shorter literals are in most texts, so they hold nothing back.
SHORTEST = 3


def folded(text: str) -> str:
    """Two texts of which one matches the other's ASCII letters, whatever their case, have these in common."""
    return text.translate(ALIKE).lower()


def _least(literals: list[str] | None) -> int:
    return min(map(len, literals)) if literals else 0


def _required(tree: _parser.SubPattern) -> list[str] | None:
    best, run = None, ""
    for op, arg in [*tree, (None, None)]:
        if op is C.LITERAL and arg < 128:
            run += chr(arg).lower()
            continue
        found, run = [run] if len(run) >= SHORTEST else None, ""
        inner = None
        if op is C.SUBPATTERN:
            inner = _required(arg[-1])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and arg[0] > 0:
            inner = _required(arg[2])
        elif op is C.ATOMIC_GROUP:
            inner = _required(arg)
        elif op is C.BRANCH:
            branches = [_required(x) for x in arg[1]]
            inner = None if None in branches else sorted({x for b in branches for x in b})
        best = max(best, found, inner, key=_least)
    return best


def required(pattern: str) -> list[str] | None:
    """Folded literals of which every match holds one at least; None where the syntax shows none of SHORTEST letters or more.

    Branches need one each; what may be left out, looks ahead or behind, or refers back requires nothing."""
    return _required(_parser.parse(pattern))


class Patterns:
    """Patterns that are looked for together; compiled once a text first holds what they require."""

    def __init__(self, patterns: tuple[str, ...], flags: int):
        self.patterns, self.flags, self.compiled = patterns, flags, {}
        needed = [required(p) for p in patterns]
        self.always = [k for k, x in enumerate(needed) if x is None]
        by_literal: dict[str, list[int]] = {}
        for k, literals in enumerate(needed):
            for x in literals or ():
                by_literal.setdefault(x, []).append(k)
        self.automaton = ahocorasick.Automaton()
        for x, ks in by_literal.items():
            self.automaton.add_word(x, ks)
        if by_literal:
            self.automaton.make_automaton()

    def candidates(self, text: str) -> set[int]:
        some = set(self.always)
        if len(self.automaton):
            for _, ks in self.automaton.iter(folded(text)):
                some.update(ks)
        return some

    def found(self, text: str) -> list[int]:
        """Places of the patterns that the text matches, in order."""
        return [k for k in sorted(self.candidates(text)) if self._compiled(k).search(text)]

    def _compiled(self, k: int) -> re.Pattern:
        if k not in self.compiled:
            self.compiled[k] = re.compile(self.patterns[k], self.flags)
        return self.compiled[k]


@lru_cache(maxsize=16)
def together(patterns: tuple[str, ...], flags: int = re.IGNORECASE | re.MULTILINE) -> Patterns:
    """One of a kind in each Python worker."""
    return Patterns(patterns, flags)


def hits(text: Column, patterns: list[str], added: str = "") -> Column:
    """array<int>: which patterns the text (null: empty) matches with ``added`` behind it."""
    asked = tuple(patterns)

    @F.pandas_udf("array<int>")
    def found(text: pd.Series) -> pd.Series:
        p = together(asked)
        return pd.Series([p.found((x or "") + added) for x in text])

    return found(text)
