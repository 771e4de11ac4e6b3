"""Reports on hand-written fixtures."""

import json
import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

import reportmill
from reportmill import api, cli, display
from reportmill.operators import consolidate as C
from reportmill.operators import report, stats
from reportmill.plans import rules as R
from reportmill.sources import adapters, detect, documents, xml
from reportmill.streaming import reports

VULN = """<?xml version="1.0"?>
<NessusClientData_v2><Policy><policyName>Full</policyName><Preferences>
<preference><name>scan_start_timestamp</name><value>1700000000</value></preference>
<preference><name>scan_end_timestamp</name><value>1700090061</value></preference></Preferences></Policy>
<Report name="weekly">
<ReportHost name="a"><HostProperties><tag name="host-ip">10.0.0.1</tag><tag name="host-fqdns">[{&amp;quot;FQDN&amp;quot;: &amp;quot;a.x&amp;quot;}, {&amp;quot;FQDN&amp;quot;: &amp;quot;b.x&amp;quot;}]</tag><tag name="Credentialed_Scan">true</tag></HostProperties>
<ReportItem port="443" svc_name="www" protocol="tcp" severity="2" pluginID="100" pluginName="A B" pluginFamily="Web"><cvss_base_score>5.0</cvss_base_score><cve>CVE-1</cve><solution> Fix </solution><see_also>u1
 u2 </see_also><plugin_output>lib.js</plugin_output></ReportItem>
<ReportItem port="8443" svc_name="www" protocol="tcp" severity="3" pluginID="100" pluginName="A B" pluginFamily="Web"/></ReportHost>
<ReportHost name="none"><ReportItem port="1" protocol="tcp" severity="1" pluginID="7"/></ReportHost>
<ReportHost name="c"><HostProperties><tag name="host-ip">10.0.0.3</tag><tag name="host-fqdn">c.x</tag></HostProperties>
<ReportItem port="443" svc_name="www" protocol="tcp" severity="0" pluginID="100" pluginName="other" pluginFamily="Web"><cvss_base_score></cvss_base_score><plugin_output>Installed version: 1</plugin_output></ReportItem>
<ReportItem port="0" svc_name="general" severity="1" pluginID="200" pluginName="A (B)" pluginFamily="Misc"/></ReportHost>
</Report></NessusClientData_v2>"""

NET = """<?xml version="1.0"?><nmaprun start="1700000000" startstr="s" args="x" version="7"><scaninfo type="syn"/>
<host><status state="up"/><address addr="10.0.0.1" addrtype="ipv4"/><hostnames><hostname name="h1"/></hostnames><ports>
<port protocol="tcp" portid="80"><state state="open"/><service name="http" product="nginx" version="1.1"/><script id="s" output="1"/><script id="s" output="2"/></port>
<port protocol="tcp" portid="22"><state state="closed"/></port><port protocol="udp" portid="53"><state state="open|filtered"/></port></ports></host>
<host><status state="up"/><address addr="::1" addrtype="ipv6"/></host>
<host><address addr="10.0.0.3" addrtype="ipv4"/></host>
<runstats><finished time="1700003723" timestr="e"/></runstats></nmaprun>"""


@pytest.fixture
def vuln(spark, tmp_path):
    path = tmp_path / "r.nessus"
    path.write_text(VULN)
    return path


@pytest.fixture
def net(spark, tmp_path):
    path = tmp_path / "r.xml"
    path.write_text(NET)
    return path


def test_vulnerability_report(spark, vuln):
    assert detect.detect(vuln) == "vuln"
    r = xml.read_vulnerabilities(spark, str(vuln))
    c = r.context.first()
    assert (c.scan_name, c.policy_name, c.scan_start, c.scan_duration) == ("weekly", "Full", "14-11-2023 22:13:20", "1 day, 1:01:01")
    hosts = {h.host_ord: h for h in r.hosts.collect()}
    assert [hosts[k].has_properties for k in (1, 2, 3)] == [True, False, True]
    assert hosts[1].fqdns == ["a.x", "b.x"] and hosts[3].fqdns == ["c.x"] and hosts[1].credentialed
    assert sorted(x.affected_host_id for x in stats.affected_ids(r.hosts).collect()) == [4, 5]
    first = {x.plugin_id: x for x in stats.plugins(r.items).collect()}
    assert first["100"].name == "A B" and first["100"].severity == 2 and first["100"].see_also == ["u1", "u2"]
    severe = {x.host_ord: x for x in stats.host_severities(r.items).collect()}
    assert (severe[1].medium, severe[1].high) == (1, 1)
    assert {(x.port_key, tuple(x.plugin_ids)) for x in stats.host_ports(r.items).collect() if x.host_ord == 1} == {("443/tcp", ("100",)), ("8443/tcp", ("100",))}
    assert [(x.svc_name, x.n_instances) for x in stats.service_instances(r.items).collect()] == [("www", 3)]
    assert [(x.svc_name, x.n_findings) for x in stats.service_findings(r.items).collect()] == [("www", 2)]
    assert r.items.filter("plugin_id = 100 and host_ord = 3").first().cvss.base_score is None
    with pytest.raises(Exception):
        xml.read_vulnerabilities(spark, str(vuln), strict=True).items.collect()


def _rule(**filters):
    return {"rule_name": "r", "title": "t", "internal_vulnerability_id": 1, "filters": filters, "grouping_criteria": ["ip", "port"]}


def test_rules(spark, vuln):
    r = xml.read_vulnerabilities(spark, str(vuln))

    def matched(rule):
        return sorted(x.plugin_id for x in C.consolidate(r.items, r.hosts, [rule]).evaluation.filter("matched").collect())

    assert matched(_rule()) == ["100", "200"]
    assert matched(_rule(name_patterns=["a (b)"])) == ["100"]  # parentheses are a group
    assert matched(_rule(plugin_output_patterns=[r"\.js\n.*installed version"])) == ["100"]  # across hosts
    done = C.consolidate(r.items, r.hosts, [_rule()])
    assert {x.service_key for x in done.services.collect()} == {"10.0.0.1:443/tcp", "10.0.0.3:443/tcp"}
    e = done.entries.first()
    assert (e.severity, e.cvss.base_score, e.cve, e.solutions) == (2, 5.0, ["CVE-1"], ["Fix"])
    found = report.findings(done.entries, done.services).first()
    assert found.affected_entities == "<p>10.0.0.1:443/tcp<br />c.x<br />10.0.0.3:443/tcp</p>"
    assert report.findings(done.entries, done.services, 2).first().affected_entities == report.TRUNCATED
    with pytest.raises(report.FormatterError):
        report.findings(done.entries, done.services, 0)


def test_rule_problems(tmp_path):
    assert not R.problems(R.load())
    assert R.problems([_rule(name_patterns=["("]) | {"enabled": False}])
    assert R.load(tmp_path / "missing.json") is None
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(R.ConsolidationError):
        R.load(tmp_path / "bad.json")
    assert R.java_pattern(r"(?P<a>x)(?P=a){,3}\Z") == r"(?<a>x)\k<a>{0,3}\z"


def test_port_scan(spark, net):
    assert detect.detect(net) == "net"
    r = xml.read_scans(spark, str(net))
    assert [(h.host_ord, h.host_status) for h in r.hosts.orderBy("host_ord").collect()] == [(1, "up"), (3, "unknown")]
    s = stats.port_summary(r.ports).first()
    assert (s.open, s.closed, s.filtered, s.other) == (1, 1, 0, 1)
    p = r.ports.filter("port_id = 80").first()
    assert '"combined_info":"nginx 1.1"' in p.service_details and p.script_output == {"s": "2"}
    assert xml.read_scans(spark, str(net), "filtered").ports.count() == 0
    assert r.context.first().scan_duration == "1h 2m 3s"


def test_process(spark, vuln, tmp_path):
    done = api.process(spark, str(vuln), consolidate=True, api_format=True, output_dir=str(tmp_path / "out"), output_name="x")
    assert done["consolidated"] is not None and (tmp_path / "out" / "x_API_Ready").exists()
    assert api.process(spark, f"{tmp_path}/*.nessus")["kind"] == "vuln"
    with pytest.raises(FileNotFoundError):
        api.process(spark, str(tmp_path / "no.nessus"))
    cut = tmp_path / "cut.nessus"
    cut.write_text(VULN[:-40])
    with pytest.raises(ValueError):
        api.process(spark, str(cut), kind="vuln", strict=True)


def test_strict_checks(spark, vuln, net, tmp_path):
    (tmp_path / "v.xml").write_text(VULN)
    (tmp_path / "n.nessus").write_text(NET)
    (tmp_path / "other.nessus").write_text("<?xml version='1.0'?><x><Policy/><Report/></x>")
    (tmp_path / "other.xml").write_text("<x/>")
    (tmp_path / "sniffed.txt").write_text(NET)
    detect.check(vuln, "vuln")
    detect.check(net, "net")
    assert [detect.detect(tmp_path / x) for x in ("v.xml", "n.nessus", "other.nessus", "sniffed.txt")] == ["vuln", "net", "vuln", "net"]
    for name, kind in (("v.xml", "vuln"), ("n.nessus", "net"), ("other.xml", "net")):
        with pytest.raises(ValueError):
            detect.check(tmp_path / name, kind)
    with pytest.raises(FileNotFoundError):
        detect.check(tmp_path / "no.xml", "net")
    with pytest.raises(ValueError):
        detect.detect(tmp_path / "other.xml")
    assert detect.detect_in_store(spark, f"file://{net}") == "net" and len(detect.head(spark, str(vuln), 30)) == 30
    assert detect.detect_in_store(spark, f"{tmp_path}/r.*") == "vuln" and detect.detect_in_store(spark, str(tmp_path)) == "net"  # n.nessus comes first
    for missing in ("file:///no/such.file", f"{tmp_path}/*.none"):
        with pytest.raises(FileNotFoundError):
            detect.detect_in_store(spark, missing)
    found = detect.find_reports(tmp_path)
    assert [p.name for p in found["vuln"]] == ["n.nessus", "other.nessus", "r.nessus"] and [p.name for p in found["net"]] == ["r.xml"]
    assert detect.find_reports(tmp_path / "no") == {} and detect.find_reports(tmp_path, ("other",)) == {"other": []}


def test_hosts_of_large_files(spark, tmp_path):
    """Files that are cut into many splits; self-closed hosts count, and what is cut off is left out."""
    hosts = [f'<ReportHost name="h{k}"/>' if k % 7 == 3 else f'<ReportHost name="h>{k}"><HostProperties><tag name="host-ip">10.0.{k // 250}.{k % 250}</tag></HostProperties><ReportItem port="1" protocol="tcp" severity="1" pluginID="{k}"><description>{"d" * 900} &lt;/ReportHost&gt;</description></ReportItem></ReportHost>' for k in range(300)]
    text = VULN[: VULN.index("<ReportHost")] + "\n".join(hosts) + VULN[VULN.index("</Report></Ness") :]
    for name in ("a", "b"):
        (tmp_path / f"{name}.nessus").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 20_000)
    try:
        r = xml.read_vulnerabilities(spark, str(tmp_path / "*.nessus"))
        rows = r.items.join(r.hosts, ["file_id", "host_ord"]).select("file_id", "host_ord", "plugin_id", "ip").collect()
        assert xml._pieces(spark, str(tmp_path / "*.nessus"), "ReportHost").rdd.getNumPartitions() > 20 and r.hosts.count() == 600
        (tmp_path / "cut.nessus").write_text(text[: text.index('pluginID="200"')])
        assert xml.read_vulnerabilities(spark, str(tmp_path / "cut.nessus")).items.agg({"host_ord": "max"}).first()[0] == 199
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == 2 * sum(k % 7 != 3 for k in range(300)) and len({x.file_id for x in rows}) == 2
    assert all(x.host_ord == int(x.plugin_id) + 1 and x.ip == f"10.0.{int(x.plugin_id) // 250}.{int(x.plugin_id) % 250}" for x in rows)
    assert {c.scan_name for c in r.context.collect()} == {"weekly"} and r.context.count() == 2


def test_stream(spark, vuln, net, tmp_path):
    def seen(rows, name):
        rows.writeStream.format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
        return sorted(tuple(r)[1:] for r in spark.table(name).collect())

    for name, text in (("v", VULN), ("n", NET)):
        (tmp_path / name).mkdir()
        for k in range(2):
            (tmp_path / name / f"{k}.xml").write_text(text)
    assert seen(reports.vulnerability_hosts(spark, str(tmp_path / "v"), 1), "seen_v") == sorted(2 * [("", 1), ("10.0.0.1", 2), ("10.0.0.3", 2)])
    assert seen(reports.scan_hosts(spark, str(tmp_path / "n"), 1), "seen_n") == sorted(2 * [("10.0.0.1", "up", 3, 1), ("10.0.0.3", "unknown", 0, 0)])


def test_negative_and_missing_durations(spark, tmp_path):
    def duration(finish, start="1000"):
        (tmp_path / "d.xml").write_text(f'<?xml version="1.0"?><!DOCTYPE nmaprun><nmaprun start="{start}" version="7"><runstats>{finish}</runstats></nmaprun>')
        return xml.read_scans(spark, str(tmp_path / "d.xml")).context.first().scan_duration

    assert duration('<finished time="995"/>') == "59m 55s" and duration('<finished time="x"/>') == "" and duration("") == ""
    assert duration("<finished/>") == "43m 20s" and duration('<finished time="1000"/>', "") == ""


def test_exclusions(spark, vuln, tmp_path):
    rules = [_rule(name_patterns=["a"], exclude_families=["Web"]), _rule(plugin_output_patterns=["nothing"], plugin_families=["Web"]) | {"rule_name": "o"}]
    (tmp_path / "rules.json").write_text(json.dumps({"consolidation_rules": rules}))
    done = api.process(spark, str(vuln), consolidate=True, rules_file=str(tmp_path / "rules.json"), output_dir=str(tmp_path / "out"), log_exclusions=True)
    lines = spark.read.text(done["exclusion_log"]).collect()
    assert [x.value for x in lines] == [
        "Rule 'r': plugin 100 'A B' matched the name but was excluded by exclude_families: the family is one of ['Web']",
        "Rule 'o': plugin 100 'A B' matched the name but was excluded by plugin_output_patterns: the output does not match any of ['nothing']",
    ]


def test_documents(spark, vuln, net, tmp_path):
    out = tmp_path / "out"
    done = api.process(spark, str(vuln), consolidate=True, api_format=True, output_dir=str(out), output_name="x.json", documents_too=True)
    assert all(done["written"].values()) and not all(api.write(done, str(vuln), str(out), "x.json").values())  # nothing is replaced
    parsed, consolidated = documents.read_json(out / "x.json"), documents.read_json(out / "x_Consolidated_Findings.json")
    assert parsed["context"]["scan_name"] == "weekly" and parsed["hosts"]["1"]["ports"]["443/tcp"] == {"service": "www", "vulnerabilities": ["100"]}
    assert parsed["vulnerabilities"]["100"]["affected_hosts"]["4"]["ports"] == ["443/tcp"] and parsed["stats"]["vulnerabilities"]["by_severity"]["Medium"] == 1
    assert consolidated["consolidation_metadata"]["original_plugins_count"] == 2 and documents.has_keys(consolidated, ["consolidated_vulnerabilities"])
    api.release(done)
    scan = api.process(spark, str(net), flat_json=True, output_dir=str(out), output_name="n", documents_too=True)
    ports = documents.read_json(out / "n")["hosts"]["1"]["ports"]
    assert ports["tcp/80"]["details"]["combined_info"] == "nginx 1.1" and ports["tcp/80"]["scripts"] == {"s": "2"}
    flat = documents.read_json(out / "n_Flat.json")
    assert [x["port"] for x in flat] == ["TCP/80", "TCP/22", "UDP/53"] and flat[0]["status"] == "open"
    assert "PORT SCAN" in display.summaries(scan, False) and "Services:" in display.summaries(scan, False)
    at = datetime(2024, 3, 9, 1, 2, 3)
    assert documents.output_name("Parsed", "a/b.nessus", None, at) == "09-03-24_01-02-03_b_Parsed.json"
    assert documents.output_name("Consolidated", "b.x", None, at).endswith("_b_Consolidated_Findings.json") and documents.output_name("Flat", "b.xml", "net", at).endswith("_b_Flat_Net.json")
    assert documents.ensure_directory(tmp_path / "new.v1") == tmp_path and documents.ensure_directory(tmp_path / "d" / "e").is_dir()
    assert documents.pretty({"a": "é"}) == '{\n  "a": "é"\n}' and not documents.write_json({"a": object()}, tmp_path / "bad.json")
    (tmp_path / "broken.json").write_text("{")
    with pytest.raises(ValueError):
        documents.read_json(tmp_path / "broken.json")
    with pytest.raises(FileNotFoundError):
        documents.read_json(tmp_path / "none.json")
    assert not documents.has_keys([], ["a"]) and not documents.has_keys({}, ["a"])


def test_findings_are_checked(spark):
    whole = spark.createDataFrame([("stock", "1", "<p>a</p>")], "type string, finding_id string, affected_entities string")
    assert report.valid(whole) and not report.valid(whole.drop("type")) and not report.valid(whole.selectExpr("type", "finding_id", "1 as affected_entities"))
    assert not report.valid(whole.selectExpr("null as type", "finding_id", "affected_entities")) and not report.valid(whole.selectExpr("type", "1.5 as finding_id", "affected_entities"))


def test_command_line(vuln, tmp_path, capsys, caplog):
    out = str(tmp_path / "cli")
    assert cli.main(["-i", str(vuln), "-c", "-a", "-of", out, "--log-exclusions", "--documents", "--no-colour"]) == 0
    said = capsys.readouterr().out
    assert "VULNERABILITY REPORT" in said and "kind: vuln" in said and "www: 2 findings" in said and "Medium: 1" in said
    assert any(p.name.endswith("_Parsed_Vuln.json") for p in (tmp_path / "cli").iterdir())
    assert cli.main(["-i", str(vuln), "-a"]) == 1 and cli.main(["-i", str(vuln), "-el", "0"]) == 1 and cli.main(["-i", "no.xml", "--no-output"]) == 1
    assert cli.main(["-i", str(vuln), "-t", "vuln", "-fj", "--no-output"]) == 0 and "--flat-json" in caplog.text
    with pytest.raises(SystemExit):
        cli.main(["--version"])


def test_registry(spark, tmp_path):
    read = lambda spark, path, options: xml.Report("lines", spark.range(0), spark.read.text(path))
    mine = adapters.Adapter("lines", "lines of text", (".lines",), ("lines",), read, lambda r: {"n": r.hosts.groupBy().count()}, lambda head: "<lines" in head)
    adapters.register(mine)
    try:
        (tmp_path / "x.lines").write_text("<?xml version='1.0'?>\n<lines/>")
        assert detect.detect(tmp_path / "x.lines") == "lines" and "lines" in reportmill.supported_kinds()
        assert api.process(spark, str(tmp_path / "x.lines"))["stats"]["n"].first()["count"] == 2
        with pytest.raises(ValueError):
            adapters.register(adapters.Adapter("more", "", (".nessus",), (), read, mine.statistics, mine.sniff))
    finally:
        adapters.unregister("lines")
    assert reportmill.version_info()["supported_formats"] == ["vuln", "net"]
    with pytest.raises(ValueError):
        adapters.adapter("lines")


def test_default_rules(spark):
    """Findings of each class go to their rule and to no other; informational ones to none."""
    wanted = {
        "SSL Version 2 and 3 Protocol Detection": "tls_protocols", "TLS Version 1.0 Protocol Detection": "tls_protocols", "SSL Certificate Expiry": "certificates", "SSL Self-Signed Certificate": "certificates",
        "SSL Certificate Signed Using Weak Hashing Algorithm": "certificates", "SSL Medium Strength Cipher Suites Supported (SWEET32)": "ciphers", "SSL RC4 Cipher Suites Supported (Bar Mitzvah)": "ciphers",
        "SSH Server CBC Mode Ciphers Enabled": "ssh", "SSH Weak Key Exchange Algorithms Enabled": "ssh", "Unencrypted Telnet Server": "cleartext", "FTP Supports Cleartext Authentication": "cleartext",
        "Apache 2.4.x < 2.4.58 Multiple Vulnerabilities": "outdated_software", "PHP Unsupported Version Detection": "outdated_software", "Microsoft Windows XP Unsupported Installation Detection": "unsupported_os",
        "TLS Version 1.2 Protocol Detection": None, "SSL Certificate Information": None, "SSH Server Type and Version Information": None, "Service Detection": None, "Ping the remote host": None,
    }
    rows = [(n, k) for n, k in enumerate(wanted)]
    base = spark.createDataFrame(rows, "n int, name string")
    plugins = base.selectExpr("'f' as file_id", "cast(n as string) as plugin_id", "name", "'General' as family", "n as ord")
    hosts = plugins.selectExpr("file_id", "plugin_id", "0 as host_ord", "ord", "case when plugin_id = '18' then '/js/app.js\n Installed version : 1.0' when plugin_id = '12' then 'Fixes may be back: backported security patches' else '' end as plugin_output")
    found = C.evaluate_rules(plugins, hosts, R.enabled(R.load())).filter("matched").collect()
    matched = {}
    for r in found:
        matched.setdefault(r.name, set()).add(r.rule_name)
    expected = {k: {v} for k, v in wanted.items() if v}
    expected["Ping the remote host"] = {"javascript"}
    del expected["PHP Unsupported Version Detection"]
    assert matched == expected and not R.problems(R.load()) and not R.warnings(R.load())


def test_several_reports(spark, vuln, tmp_path):
    """Two reports of one folder keep their own summaries and documents."""
    other = VULN.replace('name="weekly"', 'name="other"').replace('severity="3"', 'severity="1"').replace("10.0.0.1<", "10.9.9.9<")
    (tmp_path / "s.nessus").write_text(other)
    rules = tmp_path / "rules.json"
    rules.write_text(json.dumps({"consolidation_rules": [_rule()]}))
    out = tmp_path / "out"
    done = api.process(spark, f"{tmp_path}/*.nessus", consolidate=True, api_format=True, rules_file=str(rules), output_dir=str(out), output_name="x.json", documents_too=True)
    said = display.summaries(done, False)
    first, second = said.split("s.nessus\n")
    assert "r.nessus" in first and all(x.count("VULNERABILITY REPORT") == 1 and "categories: 1" in x and "hosts: 2" in x for x in (first, second))
    docs = {p.name: documents.read_json(p) for p in out.iterdir() if p.is_file()}
    assert len(docs) == 6 and all(done["written"].values())
    assert [docs[f"x_{k}.json"]["context"]["scan_name"] for k in ("1_r", "2_s")] == ["weekly", "other"]
    assert [docs[f"x_{k}.json"]["hosts"]["1"]["ip"] for k in ("1_r", "2_s")] == ["10.0.0.1", "10.9.9.9"]
    assert [docs[f"x_{k}.json"]["hosts"]["1"]["vulnerabilities"]["high"] for k in ("1_r", "2_s")] == [1, 0]
    assert "10.9.9.9" in docs["x_2_s_API_Ready.json"][0]["affected_entities"] and "10.9.9.9" not in docs["x_1_r_API_Ready.json"][0]["affected_entities"]
    api.release(done)


PATTERNS = [
    r"aa", r"^a b$", r"b\sa", r"a\nb", r"a\s*\n[\s\S]*?b", r"a\n(.*\n)*?.*b a", r"^b[\s\S]*a$", r"b(.|\n)*c", r"(ab)+c", r"(a|b)*c", r"a[\s\S]*b[\s\S]*c", r"c|a[\s\S]*b", r"[^a]b", r"(?=a)ab", r"a\n[\s\S]*\nb",
    r"a$[\s\S]*^b", r"\Aa", r"c\Z", r"[]a][\s\S]*c", r"a{2,}[\s\S]*?c", r"((a b)+\n)+c",
]


def test_output_patterns_as_of_the_joined_text(spark):
    """However a pattern is tested, its result is that of the outputs one after the other."""
    rng = random.Random(12)
    outputs = [["".join(rng.choices(["a", "b", "c", " ", "\n", "a b", "ab", "c\n"], k=rng.randint(0, 7))) for _ in range(rng.randint(0, 5))] for _ in range(150)]
    rows = [("f", str(k), h, h, x) for k, texts in enumerate(outputs) for h, x in enumerate(texts)]
    plugins = spark.createDataFrame([("f", str(k), "n", "g", k) for k in range(len(outputs))], "file_id string, plugin_id string, name string, family string, ord int")
    hosts = spark.createDataFrame(rows, "file_id string, plugin_id string, host_ord int, ord int, plugin_output string")
    rules = [_rule(plugin_output_patterns=[p]) | {"rule_name": str(k)} for k, p in enumerate(PATTERNS)]
    assert not R.problems(rules)
    found = {(int(r.rule_name), int(r.plugin_id)) for r in C.evaluate_rules(plugins, hosts, rules).filter("matched").collect()}
    for k, p in enumerate(PATTERNS):
        want = {n for n, texts in enumerate(outputs) if re.search(p, "\n".join(x for x in texts if x), re.I | re.M) and any(texts)}
        assert {n for r, n in found if r == k} == want, p
    assert R.halves(r"a\n(.*\n)*?.*b a") == (r"a\n", "b a") and R.halves("c|a[\\s\\S]*b") is None and R.halves(r"a\n[\s\S]*\nb") is None
    assert R.recursive(r"(ab)+c") and R.recursive(r"x(a(bc)*)?") and not R.recursive(r"(ab){1,9}[a-z]+\d*?(x|y)?")
    assert not any(R.recursive(p) or not (R.within_a_line(p) or R.halves(p)) for r in R.load() for p in R.output_patterns(r))


def test_long_outputs(spark):
    """Many lines of many hosts, with the shipped rules and with patterns that are too deep for Java."""
    plugins = spark.createDataFrame([("f", "1", "n", "g", 1)], "file_id string, plugin_id string, name string, family string, ord int")
    text = F.when(F.col("id") == 3, "x.js\n").when(F.col("id") == 2990, "Installed version : 1\nq" + "ab" * 100_000 + "z").otherwise(F.repeat(F.lit("a line of no interest\n"), 400))
    hosts = spark.range(3000).select(F.lit("f").alias("file_id"), F.lit("1").alias("plugin_id"), F.col("id").alias("host_ord"), F.col("id").alias("ord"), text.alias("plugin_output"))
    rules = [*R.enabled(R.load()), _rule(plugin_output_patterns=[r"q(ab)+z"]), _rule(plugin_output_patterns=[r"installed version[\s\S]*\.js$"]) | {"rule_name": "not"}]
    assert sorted(r.rule_name for r in C.evaluate_rules(plugins, hosts, rules).filter("matched").collect()) == ["javascript", "r"]
