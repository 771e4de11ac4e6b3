"""Reports of any layout against a parser of whole files, whatever the splits."""

import random
import xml.etree.ElementTree as ET
from xml.sax.saxutils import escape, quoteattr

import pytest
from pyspark.sql import functions as F

from reportmill import api
from reportmill.sources import detect, scan, xml

TRAPS = ["</ReportHost>", '<ReportHost name="x">', "<ReportHost/>", "</ReportHostile>", "-->", "]]", "<!--", "<?x ?>", "<![CDATA[", "a & b < c > d", "ü€\U0001f600", "\n\n", "'\"", "</ReportHost >"]


def host(rng, k):
    """A host in one of many spellings of the same data."""
    gap = rng.choice(["", "\n", "  ", "\t\n"])

    def text(x):
        if rng.random() < 0.4 and "]]>" not in x:
            return f"<![CDATA[{x}]]>"
        return escape(x) if rng.random() < 0.8 or "]]>" in x or not x else escape(x[:1]) + f"<![CDATA[{x[1:]}]]>"

    def aside():
        inside = "".join(rng.choices(TRAPS, k=rng.randint(0, 3))).replace("--", "- -").replace("- ->", "- >")
        return rng.choice(["", "", "", f"<!-- {inside} -->", f"<?note {inside.replace('?>', '')}?>"])

    name = "".join(rng.choices(["a", "é", ">", "/>", "'"], k=3))
    if rng.random() < 0.15:
        return f"<ReportHost{rng.choice(['', ' '])}name={quoteattr(name)}/>".replace("ReportHostname", "ReportHost name")
    items = ""
    for i in range(rng.randint(0, 4)):
        said = "".join(rng.choices(TRAPS, k=rng.randint(0, 4)))
        items += f'{aside()}<ReportItem port="{i}" protocol="tcp" svc_name={quoteattr(name)} severity="1" pluginID="{k}"><plugin_output>{text(said)}</plugin_output>{gap}</ReportItem>{gap}'
    properties = "" if rng.random() < 0.2 else f'<HostProperties><tag name="host-ip">10.0.0.{k % 250}</tag>{aside()}<tag name="os">{text(name)}</tag></HostProperties>'
    end = rng.choice(["</ReportHost>", "</ReportHost>", "</ReportHost >", "</ReportHost\n>"])
    return f"<ReportHost name={quoteattr(name)}>{gap}{aside()}{properties}{gap}{items}{end}{rng.choice(['', '', gap])}{aside()}"


def document(rng, n, encoding="utf-8"):
    hosts = "".join(host(rng, k) for k in range(n))
    return f"<?xml version='1.0' encoding='{encoding}'?><!-- <ReportHost> --><NessusClientData_v2><Policy><policyName>P</policyName></Policy><Report name=\"r\">{hosts}</Report></NessusClientData_v2>"


def expected(data: bytes):
    """(host_ord, ip or None), and (host_ord, place, svc_name, output) of the items of hosts with properties, by a parser of the whole file."""
    hosts, items = [], []
    for k, h in enumerate(ET.fromstring(data).iter("ReportHost"), 1):
        properties = h.find("HostProperties")
        hosts.append((k, None if properties is None else next((t.text for t in properties.iter("tag") if t.get("name") == "host-ip"), "")))
        if properties is not None:
            items += [(k, i, x.get("svc_name") or "", x.findtext("plugin_output") or "") for i, x in enumerate(h.iter("ReportItem"))]
    return sorted(hosts, key=str), items


def found(spark, path, size=None):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    if size:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        r = xml.read_vulnerabilities(spark, path)
        hosts = sorted(((h.host_ord, h.ip if h.has_properties else None) for h in r.hosts.collect()), key=str)
        items = sorted((i.host_ord, i.ord.pos, i.svc_name, i.plugin_output) for i in r.items.collect())
        return (hosts, items), sorted(map(tuple, r.damaged.select("host_ord", "cause").collect()), key=str), r
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("seed, size", [(0, None), (1, 200), (2, 1000), (3, 5000)])
def test_any_layout_and_split(spark, tmp_path, seed, size):
    data = document(random.Random(seed), 40).encode()
    (tmp_path / "r.nessus").write_bytes(data)
    got, damaged, r = found(spark, str(tmp_path / "r.nessus"), size)
    assert got == expected(data) and not damaged
    assert [(c.scan_name, c.policy_name) for c in r.context.collect()] == [("r", "P")]


def test_usual_files_without_white_space(spark, tmp_path):
    """Hosts directly behind each other; no row needs the longer way."""
    hosts = "".join(f'<ReportHost name="h{k}"><HostProperties><tag name="host-ip">10.0.0.{k}</tag></HostProperties><ReportItem port="1" pluginID="{k}"/></ReportHost>' for k in range(90))
    data = f'<?xml version="1.0"?><NessusClientData_v2><Report name="r">{hosts}</Report></NessusClientData_v2>'.encode()
    (tmp_path / "r.nessus").write_bytes(data)
    assert scan.unusual(scan._lines(spark, str(tmp_path / "r.nessus"), "ReportHost")) == []
    got, damaged, _ = found(spark, str(tmp_path / "r.nessus"), 500)
    assert got == expected(data) and not damaged
    (tmp_path / "n.xml").write_text("<?xml version='1.0'?><nmaprun>" + "".join(f'<host><address addr="10.0.0.{k}" addrtype="ipv4"/></host>' for k in range(9)) + "</nmaprun>")
    assert [h.host_ord for h in xml.read_scans(spark, str(tmp_path / "n.xml")).hosts.orderBy("host_ord").collect()] == list(range(1, 10))


@pytest.mark.parametrize("encoding", ["iso-8859-1", "us-ascii", "utf-16"])
def test_encodings(spark, tmp_path, encoding):
    text = document(random.Random(9), 12, encoding)
    data = text.encode(encoding, "xmlcharrefreplace") if encoding == "utf-16" else "".join(c if ord(c) < 128 or (encoding == "iso-8859-1" and ord(c) < 256) else "?" for c in text).encode(encoding)
    (tmp_path / "a b.nessus").write_bytes(data)
    (tmp_path / "plain.nessus").write_bytes(document(random.Random(10), 5).encode())
    _, damaged, r = found(spark, str(tmp_path / "*.nessus"))
    assert not damaged and r.context.count() == 2
    mine = F.col("file_id").contains("%20")
    hosts = sorted(((h.host_ord, h.ip if h.has_properties else None) for h in r.hosts.filter(mine).collect()), key=str)
    items = sorted((i.host_ord, i.ord.pos, i.svc_name, i.plugin_output) for i in r.items.filter(mine).collect())
    assert (hosts, items) == expected(data)
    (tmp_path / "odd.nessus").write_bytes(b"<?xml version='1.0' encoding='EBCDIC-X'?><x/>")
    with pytest.raises(ValueError, match="EBCDIC-X"):
        xml.read_vulnerabilities(spark, str(tmp_path / "odd.nessus"))


def test_damage_is_reported(spark, tmp_path):
    def host(k, inside):
        return f'<ReportHost name="{k}"><HostProperties><tag name="host-ip">10.0.0.{k}</tag></HostProperties><ReportItem port="1" pluginID="{k}">{inside}</ReportItem>'

    def read(body):
        (tmp_path / "d.nessus").write_bytes(b"<?xml version='1.0'?><N><Report>" + body + b"</Report></N>")
        return found(spark, str(tmp_path / "d.nessus"))

    end = b"</ReportHost>"
    whole, broken, unended = host(1, "").encode() + end, host(2, "<description>a & b</description>").encode() + end, host(3, "").encode()
    (_, items), damaged, r = read(whole + broken + unended + whole + host(5, "").encode().replace(b"10.0", b"\xff") + end + end + whole + unended)
    assert [i[0] for i in items] == [1, 4, 6]
    assert damaged == sorted([(2, "not well-formed"), (3, "no end tag of ReportHost"), (5, "not in the encoding it says"), (7, "no end tag of ReportHost"), (None, "an end tag of ReportHost without a start")], key=str)
    assert r.damaged.filter("host_ord = 2").first().start.startswith('<ReportHost name="2">')


def test_states_compose(spark):
    """A text's transition is that of its halves one after the other, wherever it is cut outside of a mark."""
    rng, marks = random.Random(2), ["<!--", "-->", "<![CDATA[", "]]>", "<?", "?>", "x", "<a b='>'>"]
    rows = [("".join(rng.choices(marks, k=rng.randint(0, 5))), "".join(rng.choices(marks, k=rng.randint(0, 5)))) for _ in range(150)]
    frame = spark.createDataFrame([(a, b, a + b) for a, b in rows], "a string, b string, ab string")
    got = frame.select(*[F.array(*[scan.after(F.col(c), k) for k in range(4)]).alias(c) for c in ("a", "b", "ab")], F.col("ab").alias("text")).collect()

    def walk(text, state):
        at = 0
        while at < len(text):
            if state == 0:
                opened = [(text.find(o, at), k) for k, (o, _) in enumerate(scan.STRETCHES, 1) if text.find(o, at) >= 0]
                if not opened:
                    return 0
                place, state = min(opened)
                at = place + len(scan.STRETCHES[state - 1][0])
            else:
                place = text.find(scan.STRETCHES[state - 1][1], at)
                if place < 0:
                    return state
                at, state = place + len(scan.STRETCHES[state - 1][1]), 0
        return state

    for r in got:
        assert r.ab == [walk(r.text, k) for k in range(4)] and r.ab == [r.b[r.a[k]] for k in range(4)]


def test_process_reports_damage(spark, tmp_path):
    body = '<N><Policy/><Report>{}<ReportHost name="b"><HostProperties/><ReportItem port="1" pluginID="1">a & b</ReportItem></ReportHost>{}</Report></N>'
    good = '<ReportHost name="a"><HostProperties><tag name="host-ip">10.0.0.1</tag></HostProperties><ReportItem port="1" protocol="tcp" pluginID="1" pluginName="n"/></ReportHost>'
    (tmp_path / "d.nessus").write_text("<?xml version='1.0'?>" + body.format(good, good))
    with pytest.raises(ValueError, match="host 2: not well-formed"):
        api.process(spark, str(tmp_path / "d.nessus"), kind="vuln")
    done = api.process(spark, str(tmp_path / "d.nessus"), kind="vuln", damage="report", output_dir=str(tmp_path / "out"), output_name="x")
    assert [h.host_ord for h in done["report"].hosts.orderBy("host_ord").collect()] == [1, 3] and done["written"]["Parsed_damaged"]
    assert spark.read.json(str(tmp_path / "out" / "x_Parsed_damaged")).first().cause == "not well-formed"
    api.release(done)
    with pytest.raises(ValueError, match="damage"):
        api.process(spark, str(tmp_path / "d.nessus"), kind="vuln", damage="ignore")


def test_strict_checks_in_a_store(spark, tmp_path):
    hosts = "".join(f'<host><address addr="10.0.0.{k}" addrtype="ipv4"/></host>' for k in range(50))
    for name, text in (("a", f"<nmaprun>{hosts}</nmaprun>"), ("cut", f"<nmaprun>{hosts}"), ("in", f"<nmaprun>{hosts}<host><address></host></nmaprun>"), ("other", f"<other>{hosts}</other>"), ("half", f"<nmaprun>{hosts[:-9]}")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.xml").write_text("<?xml version='1.0'?>" + text)
    detect.check_in_store(spark, f"file://{tmp_path}/a", "net")
    for name, said in (("cut", "outside of hosts"), ("in", "x.xml is not well-formed"), ("other", "no port scan"), ("half", "no end tag")):
        with pytest.raises(ValueError, match=said):
            detect.check_in_store(spark, f"file://{tmp_path}/{name}", "net")
    with pytest.raises(ValueError, match="does not end"):
        detect.check_in_store(spark, f"file://{tmp_path}/a", "vuln")
    with pytest.raises(FileNotFoundError):
        detect.check_in_store(spark, f"file://{tmp_path}/none", "net")
    with pytest.raises(ValueError):
        api.process(spark, f"file://{tmp_path}/cut", kind="net", strict=True)
