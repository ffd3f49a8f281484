import json

import pytest
from pyspark.sql import functions as F

from emberline.config import Prefilter, Settings
from emberline.functions.mapping import FILE, INDEX, finding, normalize
from emberline.operators import prefilter
from emberline.plans import documents, views
from emberline.plans.run import correlate, run_files
from emberline.sources import files

T0 = 1783728000000
MIN = 60_000

def record(uid, clock, title, severity, host, **more):
    return {"@timestamp": f"2026-03-02T{clock}:00Z", "id": uid, "rule": {"name": title}, "severity": severity, "host": host} | more


def threat(name, uid, technique, label):
    return {"tactic": {"name": name, "id": uid}, "technique": {"id": technique, "name": label}}


#: A mail rule, a staged archive and an upload from another machine by one user; a scan, a trifle, and something unrelated.
RECORDS = [
    record("m3", "09:05", "Upload to a new domain", "high", {"name": "srv-mail", "ip": ["10.4.1.9"]}, user={"name": "mkoch"}, source={"ip": "198.51.100.23"}, threat=threat("Exfiltration", "TA0010", "T1567", "Web Service")),
    record("m1", "08:12", "Mail rule created", "high", {"name": "ws-ada", "ip": ["10.4.1.20"]}, user={"name": "mkoch"}, threat=threat("Persistence", "TA0003", "T1137", "Office Startup")),
    record("m2", "08:40", "Archive staged", "medium", {"name": "ws-ada"}, process={"entity_id": "p-5f", "pid": 4410, "name": "packer.exe", "command_line": "packer a x.zip"}, threat=threat("Collection", "TA0009", "T1560", "Archive")),
    record("m4", "08:50", "Inventory scan", "critical", {"name": "inv-scan-2"}),
    record("m5", "09:00", "Clock drift", "low", {"name": "ws-ada"}),
    record("m6", "19:05", "New disk", "medium", {"name": "ws-eli"}),
]
SETTINGS = Settings(prefilter=Prefilter(scanner_hosts=("INV-scan-2",)))


@pytest.fixture(scope="module")
def ndjson(tmp_path_factory):
    p = tmp_path_factory.mktemp("in") / "chain.ndjson"
    p.write_text("".join(json.dumps(r) + "\n" for r in RECORDS) + "\nnot json\n[1]\n")
    return str(p)


@pytest.fixture(scope="module")
def run(spark, ndjson):
    return run_files(spark, ndjson, SETTINGS, T0)


def test_a_file_to_chains(run):
    one, two = run.summaries().orderBy("first_time").collect()
    assert one.cluster_id == "CHAIN-2026-03-02-ws-ada-001"
    assert [a.uid for a in one.alerts] == ["m1", "m2", "m3"]
    assert one.tactic_sequence == ["Persistence", "Collection", "Exfiltration"]
    assert (one.disposition, one.surfaced, one.risk) == ("progressing", True, 16.0)
    assert (two.cluster_id, [a.uid for a in two.alerts], two.disposition, two.surfaced, two.risk) == ("CHAIN-2026-03-02-ws-eli-001", ["m6"], "unknown", False, 4.0)
    c = run.counters().first()
    assert (c.normalized, c.suppressed, c.correlated, c.chains, c.surfaced) == (6, 2, 4, 2, 1)
    assert {r.uid: r.rule for r in run.decisions.where("suppressed").collect()} == {"m4": "approved_scanner_host", "m5": "severity_floor"}
    names = {r.name: r.risk for r in run.risk.join(run.entities, "entity_uid").collect()}
    assert names == {"ws-ada": 12.0, "mkoch": 16.0, "srv-mail": 8.0, "198.51.100.23": 8.0, "ws-eli": 4.0}


def test_views_of_a_run(run):
    lanes = {r.uid: (r.lane, r.lane_index) for r in views.timeline(run.placed, run.alerts).collect()}
    assert lanes["m3"] == ("Exfiltration", 2) and lanes["m6"] == ("Untagged", 0)
    links = {tuple(r) for r in views.entity_links(run.bridge, run.entities).collect()}
    assert links == {("mkoch", "ws-ada", "m1"), ("198.51.100.23", "mkoch", "m3"), ("198.51.100.23", "srv-mail", "m3"), ("mkoch", "srv-mail", "m3")}
    assert {(r.src, r.dst) for r in views.then_links(run.placed).collect()} == {("m1", "m2"), ("m2", "m3")}
    brief = run.briefs()
    assert [r.cluster_id for r in documents.chain_list(brief).collect()] == ["CHAIN-2026-03-02-ws-eli-001", "CHAIN-2026-03-02-ws-ada-001"]
    listed = lambda **kw: [r.cluster_id[17:23] for r in documents.chain_list(brief, run.items(), **kw).collect()]
    assert listed(surfaced_only=True, text="PACKER", entity="srv-mail", min_severity=4) == ["ws-ada"] and listed(limit=-1) == []
    assert listed(mode="active") == ["ws-ada"] and listed(mode="triaged") == [] and listed(verdict="pending", text=" disk ") == ["ws-eli"] and listed(text="T1560") == ["ws-ada"] and listed(text="nowhere") == []
    docs = run.documents(url="https://soc/", written_at_ms=5, size=2)
    parts = {(r.part, r.block): json.loads(r.document) for r in docs.where("cluster_id like '%ada%'").collect()}
    first = parts["chain", 0]
    assert (first["alert_blocks"], first["entity_blocks"], set(parts)) == (2, 2, {("chain", 0), ("alerts", 0), ("alerts", 1), ("entities", 0), ("entities", 1)})
    assert [a["uid"] for b in (0, 1) for a in parts["alerts", b]["alerts"]] == ["m1", "m2", "m3"] and parts["alerts", 0]["alerts"][1]["command"] == "packer a x.zip"
    assert sum(len(parts["entities", b]["entities"]) for b in (0, 1)) == 4 and parts["alerts", 1]["alerts"][0]["techniques"] == [{"uid": "T1567", "name": "Web Service"}]
    assert first["@timestamp"] == "2026-03-02T09:05:00.000Z" and first["triage_status"] == "pending" and first["chain"]["alert_count"] == 3
    assert first["dashboard_url"] == "https://soc/incident/CHAIN-2026-03-02-ws-ada-001"
    report = "\n".join(r.report for r in run.reports(size=2).where("cluster_id like '%ada%'").orderBy("block").collect())
    assert report.startswith("# Upload to a new domain\n") and report.count("\n- ") == 7 and "**Verdict:** pending" in report and "Archive staged** Medium: ws-ada" in report.replace("\\", "")
    assert views.lookup(docs, docs.where("false"), "CHAIN-2026-03-02-ws-ada-001").count() == 5 and views.lookup(docs.where("false"), docs, "CHAIN-2026-03-02-ws-ada-001").count() == 5
    events = documents.event_list(run.items(), "web SERVICE", "203.0.113").count(), documents.event_list(run.items(), "p-5f").count(), documents.event_list(run.items()).count()
    assert events == (0, 1, 4)
    nodes = {r.name: (r.domain, r.alert_count) for r in views.entity_nodes(run.bridge, run.entities, run.risk).collect()}
    assert nodes["mkoch"] == ("user", 2)
    pane = {r.entity_uid: (r.alerts, r.chains) for r in views.entity_pane(run.placed, run.bridge).collect()}
    assert pane["user|username|mkoch"] == (2, 1)


def test_the_graph_around_events(run):
    nodes, links = views.event_graph(run.placed, run.alerts, run.bridge, run.entities)
    kinds = {r.id: (r.kind, r.label) for r in nodes.where("chain = 'm1'").collect()}
    assert kinds["event:m2"] == ("event", "Archive staged") and kinds["user:mkoch"] == ("user", "mkoch") and kinds["technique:T1560"] == ("technique", "Archive")
    assert kinds["process:packer.exe"][0] == "process" and kinds["command:packer a x.zip"][0] == "command" and kinds["network:198.51.100.23"][0] == "network"
    got = {(r.src, r.dst, r.relation) for r in links.collect()}
    assert {("event:m1", "event:m2", "then"), ("host:ws-ada", "event:m2", "observed"), ("event:m2", "technique:T1560", "uses"), ("event:m2", "command:packer a x.zip", "executes"), ("event:m2", "process:packer.exe", "contains")} <= got


def test_titles(spark):
    none = "struct<tactic:struct<name:string,uid:string>,technique:struct<name:string,uid:string>>"
    tag = lambda tactic, name=None: ((tactic, None), (name, None))
    rows = [
        (1, "a", 1, 3, "x", [tag("Persistence", "PowerShell")]), (1, "b", 2, 5, "y", [tag("Credential Access")]), (2, "c", 1, 3, "x", [tag("persistence", "powershell")]),
        (3, "d", 1, 3, "powershell ran", [tag("Persistence", "Shell")]), (4, "f", 5, 3, "later", []), (4, "e", 5, 3, "same time", []), (5, "g", 1, 3, "", []),
    ]
    df = spark.createDataFrame(rows, f"chain long, uid string, time long, severity_id int, title string, attacks array<{none}>")
    got = {r.chain: r.incident_title for r in views.incident_titles(df.select("chain", "uid"), df.drop("chain")).collect()}
    assert got == {1: "PowerShell Credential Theft", 2: "PowerShell Persistence", 3: "powershell ran", 4: "same time", 5: "Security Investigation"}


def alerts(spark, rows):
    """Alerts from short dicts: minutes after T0 and any of the columns."""
    cols = ["uid", "severity_id", "hostname", "username", "email", "device_ip", "src_ip", "mac", "agent_uid", "process_guid", "tactic"]
    data = [(*(r.get(c) for c in cols), T0 + r["t"] * MIN) for r in rows]
    schema = ", ".join(f"{c} {'int' if c == 'severity_id' else 'string'}" for c in cols) + ", time long"
    df = spark.createDataFrame(data, schema)
    tactic = F.struct(F.struct(F.lit(None).cast("string").alias("name"), F.col("tactic").alias("uid")).alias("tactic"), F.struct(F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("uid")).alias("technique"))
    none = {c: F.lit(None).cast("string") for c in ("desc", "message", "process_name", "cmd_line", "dst_ip")}
    return df.withColumn("attacks", F.when(F.col("tactic").isNotNull(), F.array(tactic)).otherwise(F.array().cast("array<struct<tactic:struct<name:string,uid:string>,technique:struct<name:string,uid:string>>>"))).withColumn("severity_id", F.coalesce("severity_id", F.lit(3))).withColumn("title", F.col("uid")).withColumns(none)


CASES = [
    ([{"t": 59, "hostname": "A"}, {"t": 61, "hostname": "A"}], [(2, "unknown", 8.0)]),
    ([{"t": 0, "hostname": "A"}, {"t": 90, "hostname": "A"}], [(1, "unknown", 8.0), (1, "unknown", 8.0)]),
    ([{"t": 0, "hostname": "A"}, {"t": 60, "hostname": "A"}], [(2, "unknown", 8.0)]),
    ([{"t": 0, "hostname": "A", "username": "j", "tactic": "TA0006"}, {"t": 10, "hostname": "B", "username": "J", "tactic": "TA0008"}], [(2, "progressing", 8.0)]),
    ([{"t": 0, "hostname": "A", "tactic": "TA0010"}, {"t": 1, "hostname": "A", "tactic": "TA0001"}], [(2, "reversed", 4.0)]),
    ([{"t": k, "hostname": "A", "tactic": "TA0006"} for k in range(3)], [(3, "flat", 12.0)]),
    ([{"t": 0, "hostname": "A"}, {"t": 30, "hostname": "B"}, {"t": 40, "hostname": "A", "username": "j"}, {"t": 45, "hostname": "B", "username": "j"}], [(4, "unknown", 8.0)]),
    ([{"t": 0}, {"t": 1}], [(1, "unknown", 4.0), (1, "unknown", 4.0)]),
    ([{"t": 1430, "hostname": "A"}, {"t": 1450, "hostname": "A"}, {"t": 1500, "hostname": "A"}], [(3, "unknown", 12.0)]),
    ([{"t": 0, "hostname": "A", "username": "j", "severity_id": 4}, {"t": 300, "hostname": "B", "username": "j", "severity_id": 4}], [(1, "unknown", 16.0), (1, "unknown", 16.0)]),
]
#: Addresses and identifiers: rows and the name of the entity of each (first touched).
LEASES = [{"t": 0, "hostname": "A", "device_ip": "10.0.0.9"}, {"t": 120, "hostname": "B", "device_ip": "10.0.0.9"}, {"t": 30, "src_ip": "10.0.0.9"}, {"t": 180, "src_ip": "10.0.0.9"}, {"t": -5, "src_ip": "10.0.0.9"}, {"t": 3000, "device_ip": "10.0.0.9"}]
BRIDGES = [{"t": 0, "hostname": "A", "mac": "AA-BB-CC-00-11-22"}, {"t": 500, "agent_uid": "agent-1", "mac": "aa:bb:cc:00:11:22"}, {"t": 900, "hostname": "B", "username": "j"}, {"t": 1400, "hostname": "A", "username": "j"}]


@pytest.fixture(scope="module")
def small(spark):
    """All small cases in one run: names and addresses carry the case's number."""
    rows = []
    for n, case in enumerate([c for c, _ in CASES] + [LEASES, BRIDGES]):
        for k, r in enumerate(case):
            own = {c: f"{r[c]}-{n}" for c in ("hostname", "username") if c in r} | {c: r[c].replace("10.0.0.", f"10.0.{n}.") for c in ("device_ip", "src_ip") if c in r}
            rows.append(r | own | {"uid": f"{n:02}-{k:02}"})
    return correlate(alerts(spark, rows), Settings())


def test_small_chains(small):
    found = {}
    for c in small.chains.orderBy("first_time", "cluster_id").collect():
        found.setdefault(int(c.chain[:2]), []).append((c.alert_count, c.disposition, c.risk))
        assert c.surfaced == (c.risk >= 10)
    assert [found[n] for n in range(len(CASES))] == [e for _, e in CASES]


def test_addresses_follow_their_leases_and_identifiers_bridge(small):
    owner = {r.uid: r.name for r in small.bridge.where("pos <> 3").join(small.entities, "entity_uid").collect()}
    n = len(CASES)
    assert [owner[f"{n:02}-{k:02}"] for k in range(6)] == [f"A-{n}", f"B-{n}", f"A-{n}", f"B-{n}", f"10.0.{n}.9", f"B-{n}"]
    n += 1
    assert [owner[f"{n:02}-{k:02}"] for k in range(4)] == [f"A-{n}", f"A-{n}", f"B-{n}", f"A-{n}"]


def test_forms_of_one_address_meet(spark):
    import ipaddress
    import random

    from emberline.functions.values import address

    rng = random.Random(5)
    whole = [":".join(f"{rng.choice((0, 0, 0, 1, 0xAB, 0xFFFF)):x}" for _ in range(8)) for _ in range(300)] + ["0:0:0:0:0:0:0:0", "1:0:0:0:0:0:0:0", "0:0:0:0:0:0:0:1"]
    forms = [(x, str(ipaddress.ip_address(x))) for x in whole if not x.startswith("0:0:0:0:0:ffff:")] + [(" FE80::0:1 ", "fe80::1"), ("10.0.0.1 ", "10.0.0.1"), ("junk", "junk"), (" ", None), (None, None), ("ABCD:EF01:2345:6789:ABCD:EF01:2345:6789", "abcd:ef01:2345:6789:abcd:ef01:2345:6789")]
    df = spark.createDataFrame(forms, "x string, want string")
    assert [(r.x, r.want, r.got) for r in df.select("x", "want", address(F.col("x")).alias("got")).collect() if r.want != r.got] == []
    rows = [{"uid": "a", "t": 0, "hostname": "H", "device_ip": "fe80:0:0:0::1"}, {"uid": "b", "t": 5, "src_ip": "FE80::0001"}]
    assert [c.alert_count for c in correlate(alerts(spark, rows)).chains.collect()] == [2]


def test_a_uid_counts_once_and_the_order_of_rows_does_not_matter(spark):
    rows = [{"uid": "x", "t": 0, "hostname": "A"}, {"uid": "x", "t": 5, "hostname": "A"}, {"uid": "y", "t": 7, "hostname": "A"}, {"uid": "z", "t": 90, "hostname": "A"}]
    a, b = (correlate(alerts(spark, r)).chains.orderBy("cluster_id").collect() for r in (rows[1:] + rows[:1], rows[::-1]))
    assert a == b and [c.alert_count for c in a] == [2, 1]


def test_prefilter_rules(spark):
    rules = Prefilter("medium", ("10.10.0.0/16", "192.0.2.99", "2001:db8::/32"), ("svc-backup",), ())
    rows = [{"t": 0, "src_ip": "10.10.3.4"}, {"t": 0, "device_ip": "192.0.2.99"}, {"t": 0, "src_ip": "junk"}, {"t": 0, "username": "SVC-Backup"}, {"t": 0, "severity_id": 0}, {"t": 0, "src_ip": "2001:DB8::1"}, {"t": 0, "severity_id": 2, "src_ip": "10.10.3.4"}, {"t": 0, "src_ip": "2001:db9::1"}]
    out = prefilter.decide(alerts(spark, [{"uid": f"{k}"} | r for k, r in enumerate(rows)]), rules)
    assert [(r.rule, r.matched) for r in out.orderBy("uid").collect()] == [("trusted_ip", "10.10.3.4"), ("trusted_ip", "192.0.2.99"), (None, None), ("expected_service_account", "SVC-Backup"), (None, None), ("trusted_ip", "2001:DB8::1"), ("severity_floor", "2"), (None, None)]
    with pytest.raises(ValueError):
        Prefilter(trusted_networks=("10.0.0.0/99",))
    nets = spark.createDataFrame([("10.0.0.0/8",), ("10.10.0.0/16",)], "network string")
    got = prefilter.trusted_join(spark.createDataFrame([("10.10.3.4",), ("10.9.0.1",), ("11.0.0.1",), (None,)], "ip string"), nets)
    assert {r.ip: r.network for r in got.collect()} == {"10.10.3.4": "10.10.0.0/16", "10.9.0.1": "10.0.0.0/8", "11.0.0.1": None, None: None}


def test_networks_of_all_lengths_match_brute_force(spark):
    import ipaddress
    import random

    rng = random.Random(2)
    v4 = lambda: f"10.{rng.randint(0, 3)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}"
    v6 = lambda: str(ipaddress.ip_address((0xFD << 120) | rng.getrandbits(20) << 100 | rng.getrandbits(8)))
    nets = [f"{v4()}/{rng.randint(0, 32)}" for _ in range(40)] + [f"{v6()}/{rng.randint(0, 128)}" for _ in range(40)] + ["10.0.0.1", "fd00::1", "10.0.0.0/33", "x/8", "10.0.0.0/y", None]
    ips = [v4() for _ in range(150)] + [v6() for _ in range(150)] + ["10.0.0.1", "FD00::1", "::ffff:10.0.0.1", "nothing", None, "10.0.0.1"]
    known = []
    for n in nets:
        try:
            known.append((ipaddress.ip_network(n, strict=False), n))
        except (ValueError, AttributeError):
            pass

    def narrowest(ip):
        try:
            a = ipaddress.ip_address(ip)
        except ValueError:
            return None
        return min(((-n.prefixlen, name) for n, name in known if n.version == a.version and a in n), default=(0, None))[1]

    rows = spark.createDataFrame([(k, ip) for k, ip in enumerate(ips)], "k int, ip string")
    got = prefilter.trusted_join(rows, spark.createDataFrame([(n,) for n in nets], "network string"))
    assert got.columns == ["k", "ip", "network"]
    assert {r.k: r.network for r in got.collect()} == {k: narrowest(ip) if ip and "ffff" not in ip else None for k, ip in enumerate(ips)}


def test_triage_redacts_restores_skips_and_fails(spark, run):
    from emberline.plans import triage as T

    kb = spark.createDataFrame([("T1560", "Archive Collected Data", ["collection"], "archive packer data staged", "", []), ("T1137", "Office Startup", ["persistence"], "mail rule office startup", "", [])], "uid string, name string, tactics array<string>, description string, detection string, platforms array<string>")
    asked = []

    def verdict(frame):
        rows = []
        for r in frame.itertuples():
            if "ws-eli" in r.prompt or "New disk" in r.prompt:
                raise RuntimeError("no answer\nat all")
            token = next(w for w in ("[HOST_1]", "[HOST_2]") if w in r.prompt)
            leaked = [w for w in ("ws-ada", "mkoch", "198.51.100.23", "10.4.1.9") if w in r.prompt]
            rows.append((r.cluster_id, "True Positive", 85, ["t1560", "T9999"], ["host.name", "made.up"], f"{token} was used; leaked {len(leaked)}", None))
        import pandas as pd

        return pd.DataFrame(rows, columns=["cluster_id", "verdict", "confidence", "techniques", "cited", "text", "error"])

    result = T.triage(run, kb, verdict, SETTINGS, everything=True)
    got = {r.cluster_id[17:23]: r for r in result.collect()}
    ada, eli = got["ws-ada"], got["ws-eli"]
    assert (ada.triage_status, ada.verdict, ada.confidence, ada.accepted, ada.rejected, ada.unverified, ada.cited) == ("triaged", "True Positive", 40, ["T1560"], ["T9999"], ["made.up"], ["host.name"])
    assert ada.text in ("ws-ada was used; leaked 0", "srv-mail was used; leaked 0") and ada.named == ["T1560 Archive Collected Data"]
    assert (eli.triage_status, eli.verdict, eli.triage_error) == ("ai_unavailable", None, "no answer")
    brief = run.briefs(result)
    assert [r.cluster_id[17:23] for r in documents.chain_list(brief, mode="triaged", verdict="True Positive").collect()] == ["ws-ada"]
    assert documents.nav_counts(brief).first().asDict() == {"total": 2, "surfaced": 1, "triaged": 1}
    doc = json.loads(run.documents(result).where("part = 'chain' and cluster_id like '%ada%'").first().document)
    assert doc["triage"]["mitre_attack_techniques"] == ["T1560"] and doc["triage"]["confidence_score"] == 40 and doc["triage_status"] == "triaged"
    report = "\n".join(r.report for r in run.reports(result).where("cluster_id like '%ada%'").orderBy("block").collect())
    assert "**Verdict:** True Positive, confidence 40/100" in report and "- T1560 Archive Collected Data" in report and "> Cited, but not in the records: made.up" in report and "T9999" in report
    failed = "\n".join(r.report for r in run.reports(result).where("cluster_id like '%eli%'").orderBy("block").collect())
    assert "**Verdict:** none: no answer" in failed and "## Analysis" not in failed

    def again(frame):
        asked.extend(frame["cluster_id"])
        return frame[["cluster_id"]].assign(verdict="False Positive", confidence=5, text="x")

    second = {r.cluster_id[17:23]: r.verdict for r in T.triage(run, kb, again, SETTINGS, previous=result, everything=True).collect()}
    assert second == {"ws-ada": "True Positive", "ws-eli": "False Positive"}  # what was triaged isn't asked again


def test_candidates_and_messages(spark):
    kb = spark.createDataFrame([("T1", "A & B", ["x", "y"], " one\ntwo ", "", []), ("T2", None, None, "d" * 700, "", [])], "uid string, name string, tactics array<string>, description string, detection string, platforms array<string>")
    cases = spark.createDataFrame([("C1", ["T2", "T1", "T0"], "<chain/>"), ("C2", [], "p")], "cluster_id string, candidates array<string>, prompt string")
    one, two = documents.messages(documents.candidate_text(cases, kb), "You review.", "Decide.").orderBy("cluster_id").collect()
    assert one.candidate_xml == '<candidates>\n<technique id="T2" name="" tactics="">' + "d" * 600 + '…</technique>\n<technique id="T1" name="A &amp; B" tactics="x, y">one two</technique>\n</candidates>'
    assert [m.role for m in one.messages] == ["system", "user"] and one.messages[1].content == "<chain/>\n\n" + one.candidate_xml + "\n\nDecide." and "none were found" in two.candidate_xml


def test_order_over_buckets_equals_a_window(spark):
    import random

    from pyspark.sql import Window as W

    from emberline.operators.temporal import ordered

    rng = random.Random(3)
    rows = [(rng.choice(("a", "b", None)), rng.choice((None, *range(0, 90, 3))), f"u{k:03}", rng.choice((None, k))) for k in range(200)]
    df = spark.createDataFrame(rows, "key string, time long, uid string, v int")
    w = W.partitionBy("key").orderBy("time", "uid")
    plain = df.select("key", "time", "uid", F.row_number().over(w).alias("seq"), F.lag("v").over(w).alias("previous_v"), F.lead("uid").over(w).alias("following_uid"))
    for width in (1, 10, 10**6):
        got = ordered(df, "key", "time", "uid", ("v",), ("uid",), bucket_ms=width).select(*plain.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))


def normal(spark, records, mapping=FILE):
    rows = spark.createDataFrame([(json.dumps(r), k) for k, r in enumerate(records)], "raw string, k int")
    raw = files._raw(rows, F.parse_json("raw"), "file", T0) if mapping is FILE else files.hits(rows.withColumnRenamed("raw", "hit"), T0)
    return normalize(raw, mapping)


def test_normalizer_edges(spark):
    bad, naive, flat, both, syslog, empty = normal(
        spark,
        [
            {"id": "1", "timestamp": 1783728000, "pid": "x1", "severity": True, "host": {"ip": "10.0.0.1"}},
            {"id": "2", "timestamp": "2026-07-11T02:30:00+02:00", "process.pid": "404", "severity": "5", "mac": ["AA", "BB"]},
            {"id": "3", "timestamp": 1783728000000, "host.name": "flat", "process": {"pid": 4.0, "command_line": "x"}, "severity_id": 9},
            {"id": "4", "time": "nonsense", "threat": {"tactic": {"name": ["A", "B"]}, "technique": {"id": ["T1", "T2"], "name": "both"}}},
            {"id": "5", "time": "Oct  3 10:15:32", "threat": [{"technique": {"id": "T1"}}, {"technique": {"id": "T2"}}]},
            {"timestamp": "", "host": "", "severity": []},
        ],
    ).orderBy(F.length("uid"), "uid").collect()
    assert bad.time == T0 and bad.labels == ["parse_error"] and set(bad.unmapped.fields) == {"actor.process.pid", "severity", "device.hostname"} and bad.pid is None
    assert naive.time == 1783729800000 and naive.pid == 404 and naive.severity_id == 5 and naive.mac == "AA" and naive.labels == []
    assert flat.time == T0 and flat.hostname == "flat" and flat.pid == 4 and flat.severity_id == 0 and flat.labels == ["parse_error"]
    assert both.time == T0 and [(a.tactic.name, a.technique.uid, a.technique.name) for a in both.attacks] == [("A", "T1", "both"), ("B", "T2", "both")]
    assert [a.technique.uid for a in syslog.attacks] == ["T1", "T2"] and syslog.time_dt.endswith("-10-03T10:15:32.000Z")
    assert len(empty.uid) == 16 and empty.hostname == "" and empty.title == "Unknown finding" and empty.vendor_name == "file" and empty.labels == ["parse_error"]


def test_search_hits(spark):
    hit = {"_id": "h1", "_source": {"@timestamp": T0, "kibana.alert.severity": "critical", "kibana.alert.rule": {"name": "R", "threat": [{"tactic": {"name": "Execution", "id": "TA0002"}, "technique": [{"id": "T1059", "name": "Shell"}]}]}, "host": {"name": "h"}}}
    (row,) = normal(spark, [hit], INDEX).collect()
    assert (row.uid, row.title, row.severity_id, row.hostname, row.vendor_name, row.time) == ("h1", "R", 5, "h", "Elastic", T0)
    assert json.loads(finding(normal(spark, [hit], INDEX)).select(F.to_json(F.struct("*")).alias("j")).first().j)["class_uid"] == 2004


def test_csv_rows_over_lines_and_splits(spark, tmp_path):
    import csv
    import random

    rng = random.Random(1)
    cell = lambda: rng.choice(("x", "", 'say "hi"', "two\nlines", "a,b", '"', "\n\n", "host", "é"))
    rows = [["host", "rule", "id"]] + [[cell(), cell(), f"i{k}"] for k in range(300)] + [["host", "rule", "id"]]
    with open(tmp_path / "a.csv", "w", newline="") as f:
        csv.writer(f, lineterminator="\n").writerows(rows)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        assert spark.read.text(str(tmp_path / "a.csv")).rdd.getNumPartitions() > 5
        got = files.read_csv(spark, str(tmp_path / "a.csv"), T0).select("raw", F.to_json("payload").alias("j")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    cells = lambda d: (d["host"], d["rule"], d["id"])
    assert sorted(cells(json.loads(r.j)) for r in got) == sorted(map(tuple, rows[1:]))
    assert all(next(csv.reader([*r.raw.splitlines(keepends=True)]))[2] == json.loads(r.j)["id"] for r in got)


def test_a_catalogue_counts_without_data(spark, tmp_path):
    spark.range(30).repartition(3).write.parquet(str(tmp_path / "top" / "b"))
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "top" / ".hidden.parquet"))
    got = files.catalogue(spark, str(tmp_path / "top")).collect()
    assert [(r.name, r.files, r.rows) for r in got if r.name == "b"] == [("b", 3, 30)] and all(r.bytes > 0 for r in got)


def test_json_arrays_and_csv(spark, tmp_path):
    (tmp_path / "a.json").write_text(' [{"id": "1", "host": "h"}, 3, {"id": "2"}]')
    assert sorted(r.uid for r in normalize(files.read_records(spark, str(tmp_path / "a.json"), T0), FILE).collect()) == ["1", "2"]
    (tmp_path / "a.csv").write_text("timestamp,host,rule\n2026-07-11T00:00:00Z,h1,R1\n,,R2\n")
    rows = normalize(files.read_records(spark, str(tmp_path / "a.csv"), T0), FILE).orderBy("title").collect()
    assert [(r.hostname, r.title, r.unmapped.raw) for r in rows] == [("h1", "R1", "2026-07-11T00:00:00Z,h1,R1"), ("", "R2", ",,R2")]
    with pytest.raises(Exception):
        files.read_records(spark, str(tmp_path / "none.ndjson")).collect()
    names = spark.createDataFrame([("logs-a",), ("x",), (".siem-signals-b",), ("my-alerts",), ("logs-a",)], "name string")
    assert {r.name: r.rank for r in files.suggest(names).collect()} == {"logs-a": 4, ".siem-signals-b": 2}


def test_chains_link_sessions_and_not_alerts(spark, monkeypatch):
    import random

    from emberline.operators import chains

    rng = random.Random(4)
    rows = [(f"u{k:03}", k * MIN, f"host{k % 2}") for k in range(300)] + [("u007", 7 * MIN, "user7"), ("u207", 207 * MIN, "user7")]
    rows += [(f"v{k:02}", rng.randrange(9000) * MIN, f"name{rng.randrange(12)}") for k in range(90)]
    rows += [(u, t, f"more{rng.randrange(6)}") for u, t, e in rows if e.startswith("name")]
    linked, found = [], chains.connected_components
    monkeypatch.setattr(chains, "connected_components", lambda edges: linked.append(edges.count()) or found(edges))
    got = {r.uid: r.chain for r in chains.members(spark.createDataFrame(rows, "uid string, time long, entity_uid string"), 60 * MIN).collect()}
    top = {u: u for u, _, _ in rows}

    def head(u):
        while top[u] != u:
            u = top[u]
        return u

    for entity in {e for _, _, e in rows}:
        of = sorted((t, u) for u, t, e in rows if e == entity)
        for (t, u), (later, v) in zip(of, of[1:]):
            if later - t <= 60 * MIN:
                low, high = sorted((head(u), head(v)))
                top[high] = low
    assert got == {u: head(u) for u in top} and len(set(got.values())) > 20
    assert linked[0] < 50


def test_sightings_are_reduced_to_spellings(spark):
    from emberline.operators import entities

    rows = [{"uid": f"s{k:02}", "t": k, "hostname": ("A", "a")[k % 2], "username": "j", "device_ip": "10.0.0.9"} for k in range(40)] + [{"uid": "x", "t": -1, "src_ip": "10.0.0.8"}, {"uid": "y", "t": 99, "src_ip": "10.0.0.8"}]
    bridge, sighted = entities.resolve(alerts(spark, rows))
    got = sorted((r.entity_uid, r.kind, r.value, r.display, (r.time - T0) // MIN) for r in sighted.collect())
    assert got == [("host|hostname|a", "hostname", "a", "A", 0), ("host|hostname|a", "hostname", "a", "a", 1), ("host|hostname|a", "ip", "10.0.0.9", "10.0.0.9", 0), ("ip|ip|10.0.0.8", "ip", "10.0.0.8", "10.0.0.8", -1), ("user|username|j", "username", "j", "j", 0)]
    assert {r.name for r in entities.entity_table(bridge, sighted).collect()} == {"A", "j", "10.0.0.8"}
