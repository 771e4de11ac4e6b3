"""Consolidations find the first rows of plugins once, whatever reads them."""

import pytest

from reportmill import catalogue
from reportmill.operators import consolidate as C
from reportmill.sources import synth

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["q_cons_union", "q_cons_cvss_argmax", "q_cons_severity_risk", "q_cons_metadata", "q_rules_enabled", "q_exclusion_log"])
def test_items_are_read_for_plugins_and_for_outputs(spark, name):
    found = catalogue.QUERIES[name](spark, SMALL)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("lineitem.parquet") == 2 and "size(array" not in plan


def test_fields_are_those_of_whole_entries(spark):
    items, hosts = synth.items(spark, SMALL), synth.hosts(spark, SMALL)
    whole = {r.rule_name: r for r in C.consolidate(items, hosts, catalogue.RULES).entries.collect()}
    some = C.consolidate(items, hosts, catalogue.RULES, fields=["cve", "solutions"]).entries.collect()
    assert len(some) == len(whole) > 0 and "cvss" not in some[0]
    assert all(r[c] == whole[r.rule_name][c] for r in some for c in ("cve", "solutions", "consolidated_plugins", "title"))
