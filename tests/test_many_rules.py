"""Rules of many patterns: the literals that hold them back, and the same rows as by expressions."""

import random
import re
import sys

from hypothesis import given, settings
from hypothesis import strategies as st

from reportmill.operators import consolidate as C
from reportmill.plans import many, prefilter
from reportmill.plans import rules as R

FLAGS = re.IGNORECASE | re.MULTILINE


def _rule(name, **filters):
    return {"rule_name": name, "title": "t", "internal_vulnerability_id": 1, "filters": filters, "grouping_criteria": ["ip"]}


def test_letters_that_match_ascii():
    """No letter beyond ASCII matches one of ASCII but those that are folded to it."""
    for c in "abcdefghijklmnopqrstuvwxyz0123456789_":
        for x in map(chr, range(128, sys.maxunicode + 1)) if c in "iksa" else ():
            if re.fullmatch(c, x, re.I):
                assert prefilter.folded(x) == c, (x, c)
    others = re.compile("[a-hj-jl-rt-z0-9_]", re.I)
    assert not any(others.fullmatch(chr(x)) for x in range(128, sys.maxunicode + 1))


def test_required_literals():
    assert prefilter.required("Open(SSH|SSL) v1") == ["open"] and prefilter.required("(cat|horse)s") == ["cat", "horse"]
    assert prefilter.required("(?:apache|x)") is None and prefilter.required("(apache)?") is None and prefilter.required("(apache){2}") == ["apache"]
    assert prefilter.required("(?=apache)a") is None and prefilter.required("(?!apache)nginx") == ["nginx"] and prefilter.required(r"\d+\.\d") is None
    assert prefilter.required("(?x) apa che  # php") == ["apache"] and prefilter.required("école") == ["cole"] and prefilter.required("") is None


PIECES = st.sampled_from(["abc", "Abk", "isk", "x", "(abc|isk)", "(abc|x)?", "(?:isk){2}", "[abc]", ".", r"\s", "^", "$", "(?=abc)", "(?!isk)", "é", ".*", "a+", "(?i:KIS)", "|", "\n"])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(PIECES, min_size=1, max_size=5).map("".join), min_size=1, max_size=8), st.lists(st.text("abcABCxisKİıſKé \n", max_size=12) | st.lists(st.sampled_from(["ABC", "ıſK", "isk", "x", " ", "\n", "İſk", "kis"]), max_size=6).map("".join), max_size=6))
def test_patterns_together(patterns, texts):
    found = prefilter.Patterns(tuple(patterns), FLAGS)
    for text in texts:
        assert found.found(text) == [k for k, p in enumerate(patterns) if re.search(p, text, FLAGS)]


def _plugins(spark, rows):
    return spark.createDataFrame(rows, "file_id string, plugin_id string, name string, family string, ord int")


def _hosts(spark, rows):
    return spark.createDataFrame(rows, "file_id string, plugin_id string, host_ord int, ord int, plugin_output string")


def test_both_ways_give_the_same_rows(spark):
    """Null names and families, plugins without outputs, halves in different outputs, and patterns over line ends."""
    rng = random.Random(5)
    names = [None, "", "OpenSSH old", "openssl", "Web server\nold", "a plain name", "ſſh K"]
    plugins = [("f", str(k), rng.choice(names), rng.choice([None, "Web", "General", ""]), k) for k in range(120)]
    words = ["x.js\n", "installed version : 1", "left", "right\n", "middle", " ", "ab"]
    hosts = [("f", str(k), h, h, rng.choice([None, "", *["".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(4)]])) for k in range(120) for h in range(rng.randint(0, 4))]
    outputs = [["left"], ["left[\\s\\S]*?right", "nothing"], ["left\\s+right"], ["(ab)+\\nx"], ["^installed version", "left"], [r"\.js\s*\n[\s\S]*?installed version"]]
    rules = []
    for k, asked in enumerate(outputs):
        for kind in ("plugin_output", "exclude_plugin_output"):
            for every in (False, True):
                filters = {f"{kind}_patterns": asked, f"{kind}_require_all": every}
                rules.append(_rule(f"{k}{kind}{every}", **filters))
                rules.append(_rule(f"{k}{kind}{every}n", name_patterns=rng.choice([["ssh"], ["^open", "old$"]]), **filters, plugin_families=["Web", "General"]))
    rules += [_rule("all"), _rule("families", plugin_families=["Web"]), _rule("no families", exclude_families=["Web"]), _rule("no names", name_patterns=["o"], exclude_name_patterns=["^openssl$", "plain"], exclude_families=[""])]
    assert not R.problems(rules) and len(many.patterns_of(rules)) < many.MANY
    parts = (_plugins(spark, plugins), _hosts(spark, hosts), rules)
    key = lambda rows: sorted(map(repr, rows))
    few, lots = C.evaluate_rules(*parts).collect(), C.evaluate_many(*parts)
    assert lots.columns == C.evaluate_rules(*parts).columns and len(few) == 120 * len(rules) and any(r.matched for r in few)
    assert key(lots.collect()) == key(few)
    assert key(C.evaluate_many(*parts, noted=True).collect()) == key(r for r in few if r.matched or r.reason)
    assert C.evaluate_many(parts[0].limit(0), parts[1].limit(0), rules).isEmpty()


def test_thousands_of_patterns(spark):
    """5,000 rules in one pass: each text is tried against the few patterns that it may match, and all that it does match are found."""
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(5000)]
    rules = [_rule(str(k), **{("name_patterns", "plugin_output_patterns")[k % 2]: [rf"{w}\s+v[0-9]+"]}) for k, w in enumerate(words)]
    said = [(rng.randrange(5000), rng.choice([" v1", "  V22", " none"])) for _ in range(600)]
    texts = [words[a].upper() + b + " and " + words[rng.randrange(5000)] for a, b in said]
    plugins = _plugins(spark, [("f", str(k), x, "g", k) for k, x in enumerate(texts)])
    hosts = _hosts(spark, [("f", str(k), 0, k, texts[-k - 1]) for k in range(600)])
    found = {(r.plugin_id, r.rule_ord) for r in C.evaluate_rules(plugins, hosts, rules, noted=True).filter("matched").collect()}
    want = {(str(k), a) for k, (a, b) in enumerate(said) if a % 2 == 0 and b != " none"} | {(str(599 - k), a) for k, (a, b) in enumerate(said) if a % 2 and b != " none"}
    assert found == want
    together = prefilter.together(tuple(p for r in rules for f in r["filters"].values() for p in f))
    assert not together.always and max(len(together.candidates(x)) for x in texts) <= 4
