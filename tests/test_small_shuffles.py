"""Reports are written compressed, from rows that are dealt once, and read back without moving their text."""

import os

import pytest

from reportmill import catalogue
from reportmill.sources import synth, xml

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["q_xml_vulnerabilities", "q_xml_scans"])
def test_fields_are_numbered_and_not_text(spark, name):
    lines = catalogue.QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    window, parsed = (next(k for k, x in enumerate(lines) if y in x) for y in ("Window [", "from_xml("))
    assert parsed > window and sum(x.lstrip(" :+-").startswith("Aggregate") for x in lines[:window]) == 1


@pytest.mark.parametrize("write", [synth.write_vulnerabilities, synth.write_scans])
def test_reports_are_compressed(spark, write):
    folder = write(spark, SMALL).removeprefix("file:")
    names = [x for x in os.listdir(folder) if not x.startswith((".", "_"))]
    assert names and all(x.endswith(".gz") for x in names)


def test_wanted_columns_are_those_of_whole_items(spark):
    folder = synth.write_vulnerabilities(spark, SMALL)
    whole, some = xml.read_vulnerabilities(spark, folder), xml.read_vulnerabilities(spark, folder, wanted=["severity", "plugin_id", "cvss"])
    assert some.items.columns == ["file_id", "host_ord", "ord", "plugin_id", "severity", "cvss"]
    rows = some.located.collect()
    assert rows and sorted(map(repr, rows)) == sorted(map(repr, whole.located.select(*some.located.columns).collect()))
