"""Documents whose parts the executors write are the documents that the driver writes."""

import json
import random
from xml.sax.saxutils import quoteattr

import pytest
from pyspark.sql import functions as F

from reportmill import api
from reportmill.sources import large

ITEM = '<ReportItem port="{port}" svc_name="www" protocol="tcp" severity="{severity}" pluginID="{id}" pluginName={name} pluginFamily="Web"><cve>CVE-1</cve><plugin_output>{output}</plugin_output></ReportItem>'


def _vulnerabilities(hosts: int) -> str:
    """Hosts without properties, without findings, and findings of which such hosts come first; names and outputs that JSON escapes."""
    rng = random.Random(hosts)
    out = []
    for h in range(hosts):
        items = "".join(ITEM.format(port=rng.choice([0, 80, 443]), severity=rng.randrange(5), id=k, name=quoteattr(f'a "{k}" \\ é'), output=rng.choice(["", "x.js\nInstalled &quot;version&quot;\t: 1", "ü"])) for k in rng.sample(range(12), rng.randint(0, 6)))
        properties = "" if h % 3 == 0 else f'<HostProperties><tag name="host-ip">10.0.0.{h}</tag>' + f'<tag name="host-fqdn">h{h}.x</tag>' * (h % 2) + "</HostProperties>"
        out.append(f'<ReportHost name="{h}">{properties}{items}</ReportHost>')
    return f'<?xml version="1.0"?><NessusClientData_v2><Report name="w &quot;1&quot;">{"".join(out)}</Report></NessusClientData_v2>'


def _scan(hosts: int) -> str:
    rng = random.Random(hosts)
    port = lambda k: f'<port protocol="{rng.choice(["tcp", "udp"])}" portid="{k}"><state state="{rng.choice(["open", "closed", "open|filtered"])}"/>' + rng.choice(["", '<service name="http" product="n &quot;x&quot;" version="1"/>']) + rng.choice(["", '<script id="s" output="1&#10;2"/>']) + "</port>"
    listed = "".join(f'<host><status state="up"/><address addr="10.0.0.{h}" addrtype="ipv4"/>' + ("<ports>" + "".join(port(k) for k in rng.sample(range(90), 4)) + "</ports>") * (h % 3 > 0) + "</host>" for h in range(hosts))
    return f'<?xml version="1.0"?><nmaprun start="1700000000" version="7">{listed}<runstats><finished time="1700003723"/></runstats></nmaprun>'


def _document(path) -> object:
    return json.loads(path.read_text(encoding="utf-8"))


@pytest.mark.parametrize("hosts", [0, 17])
def test_vulnerability_documents(spark, tmp_path, hosts):
    (tmp_path / "r.nessus").write_text(_vulnerabilities(hosts), encoding="utf-8")
    rules = [{"rule_name": n, "title": 't "x"', "filters": f, "grouping_criteria": g} | extra for n, f, g, extra in (("all", {}, ["ip", "port"], {"internal_vulnerability_id": None}), ('q"', {"name_patterns": ["[24]"]}, ["port"], {"internal_vulnerability_id": 7}), ("none", {"name_patterns": ["zz"]}, ["ip"], {}), ("no id", {"name_patterns": ["3"]}, ["ip"], {}))]
    (tmp_path / "rules.json").write_text(json.dumps({"consolidation_rules": rules}))
    done = api.process(spark, str(tmp_path / "r.nessus"), consolidate=True, api_format=True, rules_file=str(tmp_path / "rules.json"))
    written = api.write_large_documents(done, "r.nessus", f"file://{tmp_path}/out", "x.json")
    assert sorted(x.name for x in (tmp_path / "out").iterdir() if not x.name.startswith(".")) == ["x.json", "x_API_Ready.json", "x_Consolidated_Findings.json"] and written == dict.fromkeys(["Parsed.json", "Consolidated.json", "API_Ready.json"], True)
    assert _document(tmp_path / "out" / "x.json") == api.parsed_document(done)
    got, want = _document(tmp_path / "out" / "x_Consolidated_Findings.json"), api.consolidated_document(done["consolidated"])
    for x in (got, want):
        x["consolidation_metadata"].pop("consolidated_at")
    assert got == want and len(got["consolidated_vulnerabilities"]) == (3 if hosts else 0)
    assert [list(x["affected_services"]) for x in got["consolidated_vulnerabilities"].values()] == [list(x["affected_services"]) for x in want["consolidated_vulnerabilities"].values()]
    assert _document(tmp_path / "out" / "x_API_Ready.json") == [{k: x[k] for k in ("type", "finding_id", "affected_entities")} for x in api.documents.rows(done["findings"], "rule_ord")]
    before = (tmp_path / "out" / "x.json").read_bytes()
    assert not any(api.write_large_documents(done, "r.nessus", f"file://{tmp_path}/out", "x.json").values()) and (tmp_path / "out" / "x.json").read_bytes() == before
    api.release(done)


def test_scan_documents(spark, tmp_path):
    """Of two reports of a folder, each with its own."""
    (tmp_path / "in").mkdir()
    for k in (8, 13):
        (tmp_path / "in" / f"r{k}.xml").write_text(_scan(k))
    done = api.process(spark, str(tmp_path / "in"), flat_json=True, output_dir=f"file://{tmp_path}/out", output_name="x.json", documents_too="large")
    assert all(done["written"].values()) and {"1_r13_Parsed.json", "2_r8_Flat.json"} <= set(done["written"])
    for k, file_id in enumerate(api.files_of(done, 3), 1):
        one, stem = api.of_file(done, file_id), f"x_{k}_r{(13, 8)[k - 1]}"
        assert _document(tmp_path / "out" / f"{stem}.json") == api.parsed_document(one)
        assert _document(tmp_path / "out" / f"{stem}_Flat.json") == [{k: v for k, v in x.items() if k not in ("file_id", "host_ord", "ord")} for x in api.documents.rows(one["flat"], "host_ord", "ord", nulls=False)]
    api.release(done)


def test_over_a_million_rows(spark, tmp_path):
    """More rows than a document on the driver may have, in order, over several parts; a failed document leaves nothing."""
    df = spark.range(1_200_000).select("id", (F.col("id") * 7919 % 1_200_000).alias("place")).repartition(6)
    text = F.concat(F.lit(","), F.to_json(F.struct("place")))
    path = large.write(spark, ["[", large.Rows(df, ("place",), text), "]"], f"{tmp_path}/all.json")
    with open(path) as f:
        assert [x["place"] for x in json.load(f)] == list(range(1_200_000))
    bad = large.Rows(df, ("place",), F.when(F.col("place") > 1_100_000, F.raise_error(F.lit("no"))).otherwise(text))
    with pytest.raises(Exception, match="no"):
        large.write(spark, ["[", bad, "]"], f"{tmp_path}/bad.json")
    assert sorted(x.name for x in tmp_path.iterdir() if not x.name.startswith(".")) == ["all.json"]
