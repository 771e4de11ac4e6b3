"""Issues and outputs of services are found without lists that grow with the input."""

import duckdb
import pytest
from pyspark.sql import functions as F

from reportmill import catalogue
from reportmill.operators import consolidate as C
from reportmill.operators import stats

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["q_issues_found", "q_plugin_outputs_last_wins"])
def test_no_list_is_sorted_by_items(spark, monkeypatch, name):
    monkeypatch.setattr(stats, "PIECE", 4, raising=False)
    found = catalogue.QUERIES[name](spark, SMALL)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # Of plugins only the numbers of the rules they match are gathered, and of issues ids by place, in pieces.
    assert "host_item" not in "".join(x for x in plan.splitlines() if "collect_list(" in x) and "plugin_outputs" not in plan
    assert ("collect_list(" in plan.split("rules#")[0]) == (name == "q_issues_found")
    with duckdb.connect() as c:
        for t in ("lineitem", "part", "supplier"):
            c.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
        wanted = c.execute(catalogue.ORACLE[name]).fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(wanted)


def test_issues_and_outputs_are_those_of_services(spark):
    done = catalogue._consolidated(spark, SMALL)
    listed = {(r.rule_ord, r.service_key): [x.id for x in r.issues_found] for r in done.services.collect()}
    rows = {}
    for r in done.issues.orderBy("plugin_ord").collect():
        rows.setdefault((r.rule_ord, r.service_key), []).append(r.plugin_id)
    assert rows == listed
    maps = C.with_outputs(done.services, done.outputs).select("rule_ord", "service_key", F.explode("plugin_outputs").alias("plugin_id", "plugin_output"))
    assert sorted(map(tuple, maps.collect())) == sorted(map(tuple, done.outputs.select(*maps.columns).collect()))


def test_joined_in_order(spark, monkeypatch):
    monkeypatch.setattr(stats, "PIECE", 3)
    rows = [(k % 3, 100 - k, None if k % 7 == 0 or k % 3 == 2 else f"v{k}") for k in range(60)]
    df = spark.createDataFrame(rows, "k int, o int, v string").repartition(5)
    found = {r.k: r.v for r in stats.joined_in_order(df, ["k"], "v", ["o"], ",").collect()}
    assert found == {k: ",".join(v for n, _, v in sorted(rows, key=lambda x: x[1]) if n == k and v) for k in range(3)}
