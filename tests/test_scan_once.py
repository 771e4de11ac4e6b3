"""Reports are parsed once, and what the tasks walk over agrees with the states of columns."""

import random

from pyspark.sql import functions as F

from reportmill import catalogue
from reportmill.sources import scan

SMALL = "/root/testdata/sf0.001"


def test_hosts_are_parsed_once(spark):
    for name in ("q_xml_vulnerabilities", "q_xml_scans"):
        plan = catalogue.QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_xml(") == 1, name


def test_walk_and_plain(spark):
    rng, marks = random.Random(5), ["<!--", "-->", "<![CDATA[", "]]>", "<?", "?>", "x", "<a b='>'>", "&"]
    texts = ["".join(rng.choices(marks, k=rng.randint(0, 8))) for _ in range(200)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.array(*[scan.after(F.col("t"), k) for k in range(4)]).alias("ends"), scan.plain(F.col("t")).alias("plain")).collect()
    for r in rows:
        assert r.ends == [scan.walked(r.t.encode(), k) for k in range(4)]
    said = {r.t: r.plain for r in rows} | {r.t: r.plain for r in spark.createDataFrame([("a<![CDATA[<!-- & -->]]>b<!-- <![CDATA[ -->c<? > ?>d<e>",)], "t string").select("t", scan.plain(F.col("t")).alias("plain")).collect()}
    assert said["a<![CDATA[<!-- & -->]]>b<!-- <![CDATA[ -->c<? > ?>d<e>"] == "a&lt;!-- &amp; --&gt;bcd<e>"
