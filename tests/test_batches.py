"""Rollups over files that arrive, change, are copied, and runs that end early."""

import pytest
from test_reports import NET, VULN

from reportmill.operators import batches


def table(df):
    return {(r.name, r.key): r.value for r in df.collect()}


def test_only_new_files_count(spark, tmp_path, monkeypatch):
    reports, state = tmp_path / "in", str(tmp_path / "state")
    reports.mkdir()
    read = []
    counts = batches.counts
    monkeypatch.setattr(batches, "counts", lambda spark, paths, kind: read.append(sorted(p.rsplit("/", 1)[1] for p in paths)) or counts(spark, paths, kind))

    def update():
        return table(batches.update(spark, str(reports), "vuln", state))

    (reports / "a 1.nessus").write_text(VULN)
    one = update()
    assert one[("by_severity", "Medium")] == 1 and one[("service_findings", "www")] == 2 and one[("service_instances", "www")] == 3
    assert update() == one and read == [["a 1.nessus"]]
    (reports / "copy.nessus").write_text(VULN)
    assert update() == one and len(read) == 1
    (reports / "b.nessus").write_text(VULN.replace('svc_name="www"', 'svc_name="web"'))
    two = update()
    assert read[1:] == [["b.nessus"]] and two[("service_findings", "web")] == 2 and two[("by_severity", "Medium")] == 2
    # A changed file counts anew; the copy of what it was still counts.
    (reports / "a 1.nessus").write_text(VULN.replace('severity="2"', 'severity="4"') + "\n")
    three = update()
    assert three[("by_severity", "Critical")] == 1 and three[("by_severity", "Medium")] == 2 and read[2:] == [["a 1.nessus"]]
    assert table(batches.rollup(spark, state)) == three


def test_a_run_that_ends_early_counts_nothing(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "n.xml").write_text(NET)
    state = str(tmp_path / "state")
    with monkeypatch.context() as m:
        m.setattr("pyspark.sql.DataFrame.coalesce", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")), raising=False)
        m.setattr("pyspark.sql.classic.dataframe.DataFrame.coalesce", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            batches.update(spark, str(tmp_path / "in"), "net", state)
    assert table(batches.rollup(spark, state)) == {}
    got = table(batches.update(spark, str(tmp_path / "in"), "net", state))
    assert got[("ports_by_status", "open")] == 1 and got[("by_host_status", "up")] == 1
