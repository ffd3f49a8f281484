"""Registry of the alert-analytics queries over the driver's tables, and their DuckDB SQL.

The tables hold no alerts, so both engines see the same alert view over ``events``: hosts and users from the event's
fields, device addresses on even events (shared by several hosts over time), source addresses on odd ones, and every
seventh event without a host.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from emberline.config import Prefilter, Settings
from emberline.operators import entities as E, evidence, prefilter, search
from emberline.operators.inverted import Index
from emberline.operators.components import connected_components
from emberline.operators.temporal import as_of, expired, first_arrival, intervals, ordered, sessions
from emberline.functions.mapping import FILE, normalize
from emberline.plans import documents, views
from emberline.plans.run import Run, correlate
from emberline.plans.triage import triage
from emberline.sources import files
from emberline.storage import shared_dir
from emberline.streaming.tables import latest_by_key

SETTINGS = Settings(prefilter=Prefilter(severity_floor="none"))
RULES = Prefilter("medium", ("10.0.0.0/28", "10.0.0.77"), ("USER3", "user5"), ("host12-1",))
W_MS = SETTINGS.window_ms
SEVERITIES = {"error": 5, "purchase": 4, "signup": 3, "view": 2, "click": 1}
TACTIC_OF = {"signup": ("TA0003", "Persistence"), "click": ("TA0002", "Execution"), "view": ("TA0007", "Discovery"), "purchase": ("TA0009", "Collection"), "error": ("TA0040", "Impact")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def alert_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    bare = F.col("event_id") % 7 == 0
    host = F.when(~bare, F.concat(F.lit("host"), k, F.lit("-"), (F.col("user_id") % 10).cast("string")))
    ip = F.concat(F.lit("10.0.0."), k)
    even = F.col("event_id") % 2 == 0
    pick = lambda j: F.coalesce(*(F.when(F.col("event_type") == t, F.lit(v[j])) for t, v in TACTIC_OF.items()))
    none = F.lit(None).cast("string")
    tactic = F.struct(pick(1).alias("name"), pick(0).alias("uid"))
    only = lambda x: F.when(F.col("event_type") == "click", x)
    technique = F.struct(only(F.lit("PowerShell")).alias("name"), only(F.lit("T1059.001")).alias("uid"))
    view = F.col("event_type") == "view"
    process = F.struct(
        only(F.lit("PowerShell.exe")).when(view, "viewer.exe").alias("executable"),
        only(F.concat(F.lit("powershell -EncodedCommand $"), k)).when(view, F.concat(F.lit("viewer --page "), k)).alias("command_line"),
    )
    raw = F.to_json(F.struct(process.alias("process"), F.struct(F.when(~even | bare, ip).alias("ip")).alias("source")))
    return e.select(
        F.concat(F.lit("evt-"), "event_id").alias("uid"), F.unix_millis(F.col("ts").cast("timestamp")).alias("time"),
        F.coalesce(*(F.when(F.col("event_type") == t, F.lit(v)) for t, v in SEVERITIES.items())).alias("severity_id"),
        F.concat(F.lit("Alert "), "event_type").alias("title"), host.alias("hostname"), F.concat(F.lit("user"), "user_id").alias("username"),
        F.when(even & ~bare, ip).alias("device_ip"), F.when(~even | bare, ip).alias("src_ip"),
        *(none.alias(c) for c in ("desc", "message", "mac", "agent_uid", "email", "process_guid", "process_name", "cmd_line", "dst_ip")),
        F.array(F.struct(tactic.alias("tactic"), technique.alias("technique"))).alias("attacks"), raw.alias("raw"),
    )


_RUNS: dict[tuple[str, str], Run] = {}


def run_of(spark: SparkSession, sf_dir: str) -> Run:
    """The run over a folder's alerts, made once for a session: its tables lie in the shared folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _RUNS:
        _RUNS[key] = correlate(alert_view(spark, sf_dir), SETTINGS)
    return _RUNS[key]


_SEV = "CASE event_type " + " ".join(f"WHEN '{t}' THEN {v}" for t, v in SEVERITIES.items()) + " END"
_RANK = "CASE event_type WHEN 'signup' THEN 4 WHEN 'click' THEN 3 WHEN 'view' THEN 8 WHEN 'purchase' THEN 10 WHEN 'error' THEN 13 END"
_TNAME = "CASE event_type " + " ".join(f"WHEN '{t}' THEN '{v[1]}'" for t, v in TACTIC_OF.items()) + " END"
A = f"""a AS (SELECT 'evt-' || event_id AS uid, event_id, epoch_us(ts) // 1000 AS time, {_SEV} AS severity_id, 'Alert ' || event_type AS title,
  CASE WHEN event_id % 7 <> 0 THEN 'host' || (props->>'$.k') || '-' || (user_id % 10) END AS hostname, 'user' || user_id AS username,
  CASE WHEN event_id % 2 = 0 AND event_id % 7 <> 0 THEN '10.0.0.' || (props->>'$.k') END AS device_ip,
  CASE WHEN event_id % 2 <> 0 OR event_id % 7 = 0 THEN '10.0.0.' || (props->>'$.k') END AS src_ip, {_RANK} AS rank, {_TNAME} AS tactic FROM events)"""
LEASE = """l AS (SELECT device_ip AS ip, time, max('host|hostname|' || hostname) AS owner FROM a WHERE device_ip IS NOT NULL AND hostname IS NOT NULL GROUP BY ALL)"""
BRIDGE = """b AS (SELECT uid, time, 'host|hostname|' || hostname AS entity_uid, 1 AS pos FROM a WHERE hostname IS NOT NULL
  UNION ALL SELECT uid, time, 'user|username|' || username, 3 FROM a
  UNION ALL SELECT uid, a.time, coalesce(owner, 'ip|ip|' || src_ip), 4 FROM a ASOF LEFT JOIN l ON a.src_ip = l.ip AND a.time >= l.time WHERE src_ip IS NOT NULL),
bridge AS (SELECT uid, time, entity_uid, min(pos) AS pos FROM b GROUP BY ALL)"""
SESSIONS = f"""g AS (SELECT *, CASE WHEN time - lag(time) OVER w <= {W_MS} THEN 0 ELSE 1 END AS s FROM bridge WINDOW w AS (PARTITION BY entity_uid ORDER BY time, uid)),
h AS (SELECT *, sum(s) OVER (PARTITION BY entity_uid ORDER BY time, uid ROWS UNBOUNDED PRECEDING) AS n FROM g),
sess AS (SELECT *, min(time) OVER (PARTITION BY entity_uid, n) AS session, min(uid) OVER (PARTITION BY entity_uid, n) AS hub FROM h)"""
CHAIN = """edge AS (SELECT DISTINCT uid AS u, hub AS v FROM sess WHERE uid <> hub),
twoway AS (SELECT u, v FROM edge UNION SELECT v, u FROM edge),
reach AS (SELECT u, v FROM twoway UNION SELECT r.u, e.v FROM reach r JOIN twoway e ON r.v = e.u),
placed AS (SELECT uid, time, least(uid, coalesce((SELECT min(v) FROM reach WHERE reach.u = x.uid), uid)) AS chain FROM (SELECT DISTINCT uid, time FROM bridge) x)"""
BASE = f"WITH RECURSIVE {A}, {LEASE}, {BRIDGE}, {SESSIONS}, {CHAIN}"
NAMED = """seen AS (SELECT entity_uid, min(time) AS first_seen, max(time) AS last_seen FROM bridge GROUP BY entity_uid),
prim AS (SELECT uid, arg_min(entity_uid, row(CASE WHEN entity_uid IN (SELECT owner FROM l) OR entity_uid LIKE 'ip|%' THEN 3 WHEN entity_uid LIKE 'host%' THEN 5 ELSE 6 END, pos, entity_uid)) AS entity_uid FROM bridge GROUP BY uid),
freq AS (SELECT chain, entity_uid, count(*) AS n FROM placed JOIN prim USING (uid) GROUP BY ALL),
top AS (SELECT chain, arg_min(entity_uid, row(-n, first_seen, entity_uid)) AS primary_entity FROM freq JOIN seen USING (entity_uid) GROUP BY chain),
risk AS (SELECT entity_uid, CAST(sum([0, 1, 2, 4, 8, 16, 32][severity_id + 1]) AS DOUBLE) AS risk FROM bridge JOIN a USING (uid) GROUP BY entity_uid),
steps AS (SELECT chain, rank, lag(rank) OVER (PARTITION BY chain ORDER BY p.time, uid) AS p FROM placed p JOIN a USING (uid)),
disp AS (SELECT chain, CASE WHEN count(*) < 2 THEN 'unknown' WHEN count(*) FILTER (WHERE rank < p) > count(*) FILTER (WHERE rank > p) THEN 'reversed' WHEN count(*) FILTER (WHERE rank > p) > 0 THEN 'progressing' ELSE 'flat' END AS disposition FROM steps GROUP BY chain),
crisk AS (SELECT chain, max(risk) AS raw, count(DISTINCT entity_uid) AS entity_count FROM bridge JOIN placed USING (uid) JOIN risk USING (entity_uid) GROUP BY chain),
base AS (SELECT chain, count(*) AS alert_count, min(p.time) AS first_time, max(p.time) AS last_time, arg_min(uid, row(p.time, uid)) AS first_uid, max(severity_id) AS max_severity FROM placed p JOIN a USING (uid) GROUP BY chain),
full_ AS (SELECT base.*, entity_count, disposition, primary_entity, split_part(primary_entity, '|', 3) AS primary_name, raw * CASE WHEN disposition = 'reversed' THEN 0.5 ELSE 1.0 END::DOUBLE AS risk FROM base JOIN crisk USING (chain) JOIN disp USING (chain) JOIN top USING (chain)),
ids AS (SELECT *, strftime(make_timestamp(first_time * 1000), '%Y-%m-%d') AS date, regexp_replace(regexp_replace(primary_name, '[^A-Za-z0-9_-]+', '-', 'g'), '^-+|-+$', '', 'g') AS label FROM full_),
chains AS (SELECT *, 'CHAIN-' || date || '-' || label || '-' || printf('%03d', row_number() OVER (PARTITION BY date, label ORDER BY first_time, first_uid)) AS cluster_id, risk >= 10 AS surfaced FROM ids)"""
ALL = f"{BASE}, {NAMED}"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def records(spark: SparkSession, d: str) -> DataFrame:
    """JSON records over ``events`` in several spellings: three fields and units of time, nested and flat hosts, severities by
    name, and a process id that is no number on every eleventh."""
    e, i = table(spark, d, "events"), F.col("event_id")
    ms, of = F.unix_millis(F.col("ts").cast("timestamp")), lambda n, c: F.when(i % 3 == n, c)
    name = F.concat(F.lit("host"), (F.col("user_id") % 50).cast("string"))
    names = {"error": "critical", "purchase": "HIGH", "signup": "Med", "view": "low", "click": "info"}
    level = F.coalesce(*(F.when(F.col("event_type") == t, F.lit(v)) for t, v in names.items()))
    pick = lambda j: F.coalesce(*(F.when(F.col("event_type") == t, F.lit(v[j])) for t, v in TACTIC_OF.items()))
    one = F.struct(
        F.concat(F.lit("evt-"), i).alias("id"), of(0, F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).alias("@timestamp"), of(1, ms).alias("timestamp"), of(2, F.floor(ms / 1000)).alias("time"),
        level.alias("severity"), F.struct(F.concat(F.lit("Alert "), "event_type").alias("name")).alias("rule"), F.when(i % 2 == 0, F.struct(name.alias("name"), F.array(F.concat(F.lit("10.1.0."), i % 9), F.lit("fe80::1")).alias("ip"))).alias("host"), F.when(i % 2 == 1, name).alias("hostname"),
        F.struct(F.concat(F.lit("user"), "user_id").alias("name")).alias("user"), F.struct(F.when(i % 11 == 0, F.lit("none")).otherwise((i % 500).cast("string")).alias("pid")).alias("process"),
        F.struct(F.struct(pick(1).alias("name"), F.array(pick(0)).alias("id")).alias("tactic"), F.struct(F.array(F.lit("T1"), F.lit("T2")).alias("id")).alias("technique")).alias("threat"),
    )
    return files._raw(e.select(F.to_json(one).alias("raw")), F.parse_json("raw"), "file", 0)


@query("alerts_normalized", f"""WITH r AS (SELECT *, CASE WHEN event_id % 3 = 2 THEN epoch_us(ts) // 1000000 * 1000 ELSE epoch_us(ts) // 1000 END AS t FROM events)
SELECT 'evt-' || event_id AS uid, t AS time, strftime(make_timestamp(t * 1000), '%Y-%m-%dT%H:%M:%S.') || printf('%03d', t % 1000) || 'Z' AS time_dt, {_SEV} AS severity_id, 'Alert ' || event_type AS title, 'host' || (user_id % 50) AS hostname,
  CASE WHEN event_id % 2 = 0 THEN '10.1.0.' || (event_id % 9) END AS device_ip, 'user' || user_id AS username, CASE WHEN event_id % 11 <> 0 THEN event_id % 500 END AS pid, event_id % 11 = 0 AS flagged,
  CASE WHEN event_id % 11 = 0 THEN '"none"' END AS kept_pid, {_TNAME} || '/T1,' || {_TNAME} || '/T2' AS attacks, 'file' AS vendor_name FROM r""")
def _(spark, d):
    shown = F.array_join(F.transform("attacks", lambda a: F.concat_ws("/", a["tactic"]["name"], a["technique"]["uid"])), ",")
    return normalize(records(spark, d), FILE).select(
        "uid", "time", "time_dt", "severity_id", "title", "hostname", "device_ip", "username", "pid", F.array_contains("labels", "parse_error").alias("flagged"),
        F.try_element_at("unmapped.fields", F.lit("actor.process.pid")).alias("kept_pid"), shown.alias("attacks"), "vendor_name",
    )


_TR = lambda c: f"({c} IS NOT NULL AND (CAST(split_part({c}, '.', 4) AS INT) <= 15 OR {c} = '10.0.0.77'))"
_DEC = f"""d AS (SELECT *, CASE WHEN severity_id > 0 AND severity_id < 3 THEN 'severity_floor' WHEN {_TR("src_ip")} OR {_TR("device_ip")} THEN 'trusted_ip'
  WHEN username IN ('user3', 'user5') THEN 'expected_service_account' WHEN hostname = 'host12-1' THEN 'approved_scanner_host' END AS rule FROM a)"""


@query("prefilter_decisions", f"WITH {A}, {_DEC} SELECT uid, rule, CASE rule WHEN 'severity_floor' THEN CAST(severity_id AS VARCHAR) WHEN 'trusted_ip' THEN CASE WHEN {_TR('src_ip')} THEN src_ip ELSE device_ip END WHEN 'expected_service_account' THEN username WHEN 'approved_scanner_host' THEN hostname END AS matched, rule IS NOT NULL AS suppressed FROM d")
def _(spark, d):
    return prefilter.decide(alert_view(spark, d), RULES).select("uid", "rule", "matched", "suppressed")


@query("prefilter_counts", f"WITH {A}, {_DEC} SELECT coalesce(rule, 'kept') AS rule, count(*) AS alerts FROM d GROUP BY 1")
def _(spark, d):
    return prefilter.decide(alert_view(spark, d), RULES).groupBy(F.coalesce("rule", F.lit("kept")).alias("rule")).agg(F.count("*").alias("alerts"))


_NETS = ("10.0.0.0/28", "10.0.0.0/26", "10.0.0.80/29", "fd00::40/122", "fd00::/16", "fd00::55", "0.0.0.0/33", "nothing")


@query("trusted_cidr_join", f"""WITH {A}, i AS (SELECT uid, CAST(split_part(coalesce(src_ip, device_ip), '.', 4) AS INT) AS n, event_id % 3 = 0 AS six FROM a)
SELECT uid, CASE WHEN six THEN printf('fd00::%x', n) ELSE '10.0.0.' || n END AS ip, CASE WHEN NOT six AND n <= 15 THEN '10.0.0.0/28' WHEN NOT six AND n <= 63 THEN '10.0.0.0/26' WHEN NOT six AND n BETWEEN 80 AND 87 THEN '10.0.0.80/29'
  WHEN six AND n = 85 THEN 'fd00::55' WHEN six AND n BETWEEN 64 AND 127 THEN 'fd00::40/122' WHEN six THEN 'fd00::/16' END AS network FROM i""")
def _(spark, d):
    nets = spark.createDataFrame([(n,) for n in _NETS], "network string")
    n = F.substring_index(F.coalesce("src_ip", "device_ip"), ".", -1).cast("long")
    six = F.substring("uid", 5, 20).cast("long") % 3 == 0
    ip = F.when(six & n.isNotNull(), F.concat(F.lit("fd00::"), F.lower(F.hex(n)))).otherwise(F.concat(F.lit("10.0.0."), n))
    return prefilter.trusted_join(alert_view(spark, d).select("uid", ip.alias("ip")), nets)


@query("dedup_first_arrival", "SELECT event_id, arrival FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY arrival) AS n FROM (SELECT event_id, epoch_us(ts) // 1000 + 1 AS arrival FROM events UNION ALL SELECT event_id, epoch_us(ts) // 1000 - event_id AS arrival FROM events WHERE event_id % 3 = 0)) WHERE n = 1")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("t"))
    rows = e.select("event_id", (F.col("t") + 1).alias("arrival")).unionByName(e.where("event_id % 3 = 0").select("event_id", (F.col("t") - F.col("event_id")).alias("arrival")))
    return first_arrival(rows, "event_id", "arrival")


@query("entity_timeline_gaps", f"WITH {A} SELECT uid, username, time, time - lag(time) OVER (PARTITION BY username ORDER BY time, uid) AS gap FROM a")
def _(spark, d):
    rows = ordered(alert_view(spark, d).select("uid", "username", "time"), "username", "time", "uid", ("time",))
    return rows.select("uid", "username", "time", (F.col("time") - F.col("previous_time")).alias("gap"))


@query("entity_sessions", f"WITH {A}, {LEASE}, {BRIDGE}, {SESSIONS} SELECT uid, entity_uid, session FROM sess")
def _(spark, d):
    return sessions(run_of(spark, d).bridge.select("uid", "entity_uid", "time"), "entity_uid", "time", W_MS).select("uid", "entity_uid", "session")


@query("alert_entities", f"WITH {A}, {LEASE}, {BRIDGE} SELECT uid, time, entity_uid, CAST(pos AS INT) AS pos FROM bridge")
def _(spark, d):
    return run_of(spark, d).bridge.select("uid", "time", "entity_uid", "pos")


@query("chain_members", f"{BASE} SELECT uid, time, chain FROM placed")
def _(spark, d):
    return run_of(spark, d).placed.select("uid", "time", "chain")


@query("chains", f"{ALL} SELECT cluster_id, alert_count, first_time, last_time, max_severity, entity_count, disposition, primary_entity, risk, surfaced FROM chains")
def _(spark, d):
    return run_of(spark, d).chains.select("cluster_id", "alert_count", "first_time", "last_time", "max_severity", "entity_count", "disposition", "primary_entity", "risk", "surfaced")


@query("primary_entity", f"{ALL} SELECT uid, entity_uid AS primary_entity FROM prim")
def _(spark, d):
    return run_of(spark, d).primary.select("uid", "primary_entity")


@query("entity_table", f"{ALL} SELECT entity_uid, split_part(entity_uid, '|', 3) AS name, split_part(entity_uid, '|', 1) AS domain, first_seen, last_seen FROM seen")
def _(spark, d):
    return run_of(spark, d).entities.select("entity_uid", "name", "domain", "first_seen", "last_seen")


@query("ip_asof_owner", f"WITH {A}, {LEASE} SELECT uid, src_ip, owner FROM a ASOF LEFT JOIN l ON a.src_ip = l.ip AND a.time >= l.time WHERE src_ip IS NOT NULL")
def _(spark, d):
    a = alert_view(spark, d)
    leases = a.where("device_ip is not null and hostname is not null").select(F.col("device_ip").alias("src_ip"), "time", F.concat(F.lit("host|hostname|"), "hostname").alias("owner"))
    return as_of(a.where("src_ip is not null").select("uid", "src_ip", "time"), leases, "src_ip", "time", "owner").select("uid", "src_ip", "owner")


@query("ip_leases", f"WITH {A}, c AS (SELECT device_ip AS ip, time, hostname, lag(hostname) OVER (PARTITION BY device_ip ORDER BY time, hostname) AS p FROM a WHERE device_ip IS NOT NULL AND hostname IS NOT NULL), k AS (SELECT * FROM c WHERE p IS NULL OR p <> hostname) SELECT ip, time AS start, lead(time) OVER (PARTITION BY ip ORDER BY time, hostname) AS \"end\", hostname FROM k")
def _(spark, d):
    return intervals(alert_view(spark, d).where("device_ip is not null").select(F.col("device_ip").alias("ip"), "time", "hostname"), "ip", "time", "hostname")


@query("identifier_components", "WITH RECURSIVE e AS (SELECT DISTINCT 'h' || (event_id // 3) AS u, 'm' || (event_id // 5) % 997 AS v FROM events), b AS (SELECT u, v FROM e UNION SELECT v, u FROM e), r AS (SELECT u, v FROM b UNION SELECT r.u, b.v FROM r JOIN b ON r.v = b.u) SELECT u AS node, least(u, min(v)) AS component FROM r GROUP BY u")
def _(spark, d):
    return connected_components(table(spark, d, "events").selectExpr("concat('h', event_id div 3) AS u", "concat('m', event_id div 5 % 997) AS v"))


@query("tactic_disposition", f"{ALL} SELECT chain, disposition FROM disp")
def _(spark, d):
    return run_of(spark, d).chains.select("chain", "disposition")


@query("entity_risk", f"{ALL} SELECT entity_uid, risk FROM risk")
def _(spark, d):
    return run_of(spark, d).risk


@query("surfaced_chains", f"{ALL} SELECT chain, risk FROM chains WHERE surfaced")
def _(spark, d):
    return run_of(spark, d).chains.where("surfaced").select("chain", "risk")


@query("incident_title", f"{ALL} SELECT chain, CASE WHEN bool_or(rank = 3) AND bool_or(rank = 4) THEN 'PowerShell Persistence' ELSE arg_min(title, row(-severity_id, -p.time, uid)) END AS incident_title FROM placed p JOIN a USING (uid) GROUP BY chain")
def _(spark, d):
    r = run_of(spark, d)
    return views.incident_titles(r.placed, r.alerts)


@query("lane_index", f"{ALL}, q AS (SELECT chain, uid, p.time, rank, tactic FROM placed p JOIN a USING (uid)) SELECT chain, uid, row_number() OVER (PARTITION BY chain ORDER BY time, uid) AS seq, tactic AS lane, dense_rank() OVER (PARTITION BY chain ORDER BY rank) - 1 AS lane_index FROM q")
def _(spark, d):
    r = run_of(spark, d)
    return views.timeline(r.placed, r.alerts).select("chain", "uid", F.col("seq").cast("long").alias("seq"), "lane", "lane_index")


@query("graph_links", f"{ALL}, n AS (SELECT uid, split_part(entity_uid, '|', 3) AS name FROM bridge) SELECT x.name AS a, y.name AS b, x.uid FROM n x JOIN n y ON x.uid = y.uid AND x.name < y.name")
def _(spark, d):
    r = run_of(spark, d)
    return views.entity_links(r.bridge, r.entities)


@query("graph_nodes", f"{ALL} SELECT entity_uid, split_part(entity_uid, '|', 3) AS name, split_part(entity_uid, '|', 1) AS domain, risk, (SELECT count(DISTINCT uid) FROM bridge b2 WHERE b2.entity_uid = risk.entity_uid) AS alert_count FROM risk")
def _(spark, d):
    r = run_of(spark, d)
    return views.entity_nodes(r.bridge, r.entities, r.risk)


@query("then_links", f"{ALL}, t AS (SELECT chain, lag(uid) OVER (PARTITION BY chain ORDER BY time, uid) AS src, uid AS dst FROM placed) SELECT * FROM t WHERE src IS NOT NULL")
def _(spark, d):
    return views.then_links(run_of(spark, d).placed)


@query("entity_pane", f"{ALL} SELECT entity_uid, count(DISTINCT uid) AS alerts, count(DISTINCT chain) AS chains, min(bridge.time) AS first_seen, max(bridge.time) AS last_seen FROM bridge JOIN placed USING (uid) GROUP BY entity_uid")
def _(spark, d):
    r = run_of(spark, d)
    return views.entity_pane(r.placed, r.bridge)


@query("chain_list_topn", f"{ALL} SELECT cluster_id, alert_count, last_time FROM chains WHERE max_severity >= 4 ORDER BY last_time DESC, cluster_id DESC LIMIT 200")
def _(spark, d):
    return documents.chain_list(run_of(spark, d).briefs(), min_severity=4).select("cluster_id", "alert_count", "last_time")


_ISO = lambda c: f"(strftime(make_timestamp({c} * 1000), '%Y-%m-%dT%H:%M:%S.') || printf('%03d', {c} % 1000) || 'Z')"
_LABEL = "CASE {} WHEN 5 THEN 'Critical' WHEN 4 THEN 'High' WHEN 3 THEN 'Medium' WHEN 2 THEN 'Low' ELSE 'Informational' END"
_TITLE = "titles AS (SELECT chain, CASE WHEN bool_or(rank = 3) AND bool_or(rank = 4) THEN 'PowerShell Persistence' ELSE arg_min(title, row(-severity_id, -p.time, uid)) END AS incident_title FROM placed p JOIN a USING (uid) GROUP BY chain)"
_ITEMS = f"""named AS (SELECT uid, list_sort(list(DISTINCT split_part(entity_uid, '|', 3))) AS entities, arg_min(split_part(entity_uid, '|', 3), row(pos, entity_uid)) FILTER (WHERE entity_uid LIKE 'host|%') AS host,
  arg_min(split_part(entity_uid, '|', 3), row(pos, entity_uid)) FILTER (WHERE entity_uid LIKE 'ip|%') AS ip FROM bridge GROUP BY uid),
items AS (SELECT chain, row_number() OVER (PARTITION BY chain ORDER BY p.time, uid) AS seq, uid, severity_id, {{'uid': uid, 'time': p.time, 'time_dt': {_ISO("p.time")}, 'title': title, 'description': '', 'rule': title, 'severity': {_LABEL.format("severity_id")},
  'host': coalesce(hostname, host, ''), 'user': username, 'process': '', 'command': '', 'source_ip': coalesce(src_ip, ip, ''), 'destination_ip': '', 'entities': entities, 'tactics': [tactic],
  'techniques': CASE WHEN rank = 3 THEN [{{'uid': 'T1059.001', 'name': 'PowerShell'}}] ELSE [] END}} AS item FROM placed p JOIN a USING (uid) JOIN named USING (uid)),
idents AS (SELECT DISTINCT * FROM (SELECT 'host|hostname|' || hostname AS entity_uid, 'hostname' AS kind, hostname AS value FROM a WHERE hostname IS NOT NULL UNION ALL SELECT 'host|hostname|' || hostname, 'ip', device_ip FROM a WHERE hostname IS NOT NULL AND device_ip IS NOT NULL
  UNION ALL SELECT entity_uid, split_part(entity_uid, '|', 2), split_part(entity_uid, '|', 3) FROM bridge WHERE entity_uid NOT LIKE 'host|%')),
who AS (SELECT chain, row_number() OVER (PARTITION BY chain ORDER BY entity_uid) AS seq, {{'name': split_part(entity_uid, '|', 3), 'domain': split_part(entity_uid, '|', 1), 'risk_score': risk, 'identifiers': ids}} AS entity
  FROM (SELECT DISTINCT chain, entity_uid FROM bridge JOIN placed USING (uid)) JOIN risk USING (entity_uid) JOIN (SELECT entity_uid, list({{'kind': kind, 'value': value}} ORDER BY kind, value) AS ids FROM idents GROUP BY entity_uid) USING (entity_uid))"""
_PARTS = f"{ALL}, {_TITLE}, {_ITEMS}"


@query("chain_briefs", f"""{_PARTS}, s AS (SELECT chain, array_to_string(list_sort(list(DISTINCT item.tactics[1])), ',') AS tactics, CASE WHEN bool_or(len(item.techniques) > 0) THEN 'T1059.001' ELSE '' END AS techniques FROM items GROUP BY chain)
SELECT cluster_id, incident_title, primary_name AS primary_entity, {_LABEL.format("max_severity")} AS severity, alert_count, first_time, last_time, risk, surfaced, disposition, tactics, techniques, 'pending' AS triage_status FROM chains JOIN titles USING (chain) JOIN s USING (chain)""")
def _(spark, d):
    listed = lambda c: F.array_join(c, ",").alias(c)
    return run_of(spark, d).briefs().select(
        "cluster_id", "incident_title", "primary_entity", "severity", "alert_count", "first_time", "last_time", "risk", "surfaced", "disposition", listed("tactics"), listed("techniques"), "triage_status",
    )


@query("chain_reports", f"""{_PARTS}, t AS (SELECT chain, seq, '- ' || item.time_dt || ' **' || item.title || '** ' || item.severity || ': ' || array_to_string(item.entities, ', ') || ' (' || item.tactics[1] || ')' AS line FROM items),
w AS (SELECT chain, seq, CASE WHEN seq = 1 THEN '## Entities' || chr(10) ELSE '' END || '- ' || entity.name || ' (' || entity.domain || '), risk ' || format('{{:,.1f}}', entity.risk_score) AS line FROM who),
x AS (SELECT chain, 0 AS part, 0 AS b, '# ' || incident_title || chr(10) || 'Chain ' || cluster_id || chr(10) || '**Verdict:** pending' || chr(10) || '**Disposition:** ' || disposition || chr(10) || '**Risk:** ' || format('{{:,.1f}}', risk)
    || CASE WHEN surfaced THEN ' (surfaced)' ELSE ' (below the threshold)' END || chr(10) || '**Time:** ' || {_ISO("first_time")} || ' to ' || {_ISO("last_time")} || ', '
    || CASE WHEN n < 60 THEN n || 's' WHEN n < 3600 THEN CAST(round(n / 60) AS BIGINT) || 'm' ELSE round(n / 3600, 1) || 'h' END || chr(10) || '**Main entity:** ' || primary_name || chr(10) || '[Open](https://soc.example/incident/' || cluster_id || ')' || chr(10) || '## Timeline' AS report
    FROM (SELECT *, (last_time - first_time) // 1000 AS n FROM chains) JOIN titles USING (chain)
  UNION ALL SELECT chain, 1, (seq - 1) // 4, string_agg(line, chr(10) ORDER BY seq) FROM t GROUP BY ALL UNION ALL SELECT chain, 2, (seq - 1) // 4, string_agg(line, chr(10) ORDER BY seq) FROM w GROUP BY ALL)
SELECT cluster_id, row_number() OVER (PARTITION BY chain ORDER BY part, b) - 1 AS block, report FROM x JOIN chains USING (chain)""")
def _(spark, d):
    return run_of(spark, d).reports(url="https://soc.example", size=4)


@query("result_documents", f"""{_PARTS}, n AS (SELECT chain, ceil(count(*) / 4)::BIGINT AS n FROM items GROUP BY chain), m AS (SELECT chain, ceil(count(*) / 4)::BIGINT AS m FROM who GROUP BY chain),
x AS (SELECT cluster_id, 'chain' AS part, 0 AS block, to_json({{'@timestamp': {_ISO("last_time")}, 'cluster_id': cluster_id, 'dashboard_url': 'https://soc.example/incident/' || cluster_id, 'source': 'emberline', 'written_at': 0,
    'chain': {{'alert_count': alert_count, 'primary_entity': primary_name, 'first_time': {_ISO("first_time")}, 'last_time': {_ISO("last_time")}, 'disposition': disposition, 'risk_score': risk, 'surfaced': surfaced}},
    'alert_blocks': n, 'entity_blocks': m, 'triage_status': 'pending'}}) AS document FROM chains JOIN n USING (chain) JOIN m USING (chain)
  UNION ALL SELECT cluster_id, 'alerts', (seq - 1) // 4, to_json({{'cluster_id': cluster_id, 'alerts': list(item ORDER BY seq)}}) FROM items JOIN chains USING (chain) GROUP BY cluster_id, (seq - 1) // 4
  UNION ALL SELECT cluster_id, 'entities', (seq - 1) // 4, to_json({{'cluster_id': cluster_id, 'entities': list(entity ORDER BY seq)}}) FROM who JOIN chains USING (chain) GROUP BY cluster_id, (seq - 1) // 4)
SELECT cluster_id, part, block, CAST(document AS VARCHAR) AS document FROM x""")
def _(spark, d):
    return run_of(spark, d).documents(url="https://soc.example", size=4)


@query("event_list", f"{_PARTS} SELECT chain, seq, uid, item.host AS host, item.user AS user, item.source_ip AS source_ip FROM items WHERE severity_id = 5 AND contains(array_to_string(item.entities, ' ') || ' ' || uid || ' ' || item.source_ip, 'host1')")
def _(spark, d):
    found = documents.event_list(run_of(spark, d).items(), "Alert ERROR", "host1")
    return found.select("chain", "seq", "uid", "item.host", "item.user", "item.source_ip")


@query("nav_counts", f"{ALL} SELECT count(*) AS total, count(*) FILTER (WHERE surfaced) AS surfaced, count(*) FILTER (WHERE surfaced) AS triaged FROM chains")
def _(spark, d):
    r = run_of(spark, d)
    return documents.nav_counts(r.briefs(triage(r, _kb(spark), _stub, SETTINGS)))


_AROUND = """k AS (SELECT uid, props->>'$.k' AS k, event_type, src_ip AS ip FROM a JOIN events USING (event_id)),
i AS (SELECT uid, 1 AS pos, 'technique' AS kind, 'T1059.001' AS value, 'PowerShell' AS label, 'uses' AS relation FROM k WHERE event_type = 'click'
  UNION ALL SELECT uid, 2, CASE event_type WHEN 'click' THEN 'encoded_command' ELSE 'command' END, v, v, 'executes' FROM (SELECT *, CASE event_type WHEN 'click' THEN 'powershell -EncodedCommand $' || k WHEN 'view' THEN 'viewer --page ' || k END AS v FROM k) WHERE v IS NOT NULL
  UNION ALL SELECT uid, 3, CASE event_type WHEN 'click' THEN 'powershell' ELSE 'process' END, v, v, 'contains' FROM (SELECT *, CASE event_type WHEN 'click' THEN 'PowerShell.exe' WHEN 'view' THEN 'viewer.exe' END AS v FROM k) WHERE v IS NOT NULL
  UNION ALL SELECT uid, 4, 'network', ip, ip, 'contains' FROM k WHERE ip IS NOT NULL
  UNION ALL SELECT DISTINCT uid, 0, split_part(entity_uid, '|', 1), split_part(entity_uid, '|', 3), split_part(entity_uid, '|', 3), 'observed' FROM bridge
  UNION ALL SELECT uid, 5, 'event', uid, title, '' FROM a)"""


@query("event_graph_nodes", f"{ALL}, {_AROUND} SELECT DISTINCT chain, kind || ':' || value AS id, kind, label FROM i JOIN placed USING (uid)")
def _(spark, d):
    r = run_of(spark, d)
    return views.event_graph(r.placed, r.alerts, r.bridge, r.entities)[0]


@query("event_graph_links", f"""{ALL}, {_AROUND}, t AS (SELECT chain, lag(uid) OVER (PARTITION BY chain ORDER BY time, uid) AS p, uid FROM placed)
SELECT chain, 'event:' || p AS src, 'event:' || uid AS dst, 'then' AS relation, uid FROM t WHERE p IS NOT NULL
UNION ALL SELECT chain, CASE pos WHEN 0 THEN kind || ':' || value ELSE 'event:' || uid END, CASE pos WHEN 0 THEN 'event:' || uid ELSE kind || ':' || value END, relation, uid FROM i JOIN placed USING (uid) WHERE pos < 5""")
def _(spark, d):
    r = run_of(spark, d)
    return views.event_graph(r.placed, r.alerts, r.bridge, r.entities)[1]


def _stub(frame: pd.DataFrame) -> pd.DataFrame:
    """A verdict function without a model: every candidate, one technique that is none, and a field that isn't there."""
    more = {"verdict": "suspicious", "confidence": 90, "techniques": [[*sorted(c), "T0000"] for c in frame["candidates"]], "cited": [[*e, "nowhere"] for e in frame["evidence"]], "text": "", "error": None}
    return frame[["cluster_id"]].assign(**more)


def _kb(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [("T1059.001", "PowerShell", [], "scripts", "", []), ("T1136", "Create Account", ["persistence"], "new accounts", "", []), ("T1566", "Phishing", [], "mail", "", [])],
        "uid string, name string, tactics array<string>, description string, detection string, platforms array<string>",
    )


@query("chain_triage", f"""{ALL}, held AS (SELECT chain, bool_or(event_type = 'click') AS c, bool_or(event_type = 'signup') AS s, bool_or(event_type IN ('click', 'view')) AS p, bool_or(src_ip IS NOT NULL) AS i FROM placed JOIN a USING (uid) JOIN events USING (event_id) GROUP BY chain)
SELECT cluster_id, CASE WHEN surfaced THEN 'triaged' ELSE 'pending' END AS triage_status, CASE WHEN surfaced THEN concat_ws(',', CASE WHEN c THEN 'T1059.001' END, CASE WHEN s THEN 'T1136' END) END AS accepted,
  CASE WHEN surfaced THEN 'T0000' END AS rejected, CASE WHEN surfaced THEN 'nowhere' END AS unverified, CASE WHEN surfaced THEN 40 END AS confidence,
  CASE WHEN surfaced THEN concat_ws(',', CASE WHEN p THEN 'process.command_line,process.executable' END, CASE WHEN i THEN 'source.ip' END) END AS evidence FROM chains JOIN held USING (chain)""")
def _(spark, d):
    out = triage(run_of(spark, d), _kb(spark), _stub, SETTINGS)
    listed = lambda c: F.array_join(c, ",")
    return out.select("cluster_id", "triage_status", *(listed(c).alias(c) for c in ("accepted", "rejected", "unverified", "evidence")), "confidence")


@query("run_counters", f"{ALL} SELECT (SELECT count(*) FROM a) AS normalized, 0::BIGINT AS parse_flagged, 0::BIGINT AS suppressed, (SELECT count(*) FROM a) AS correlated, count(*) AS chains, count(*) FILTER (WHERE surfaced) AS surfaced, (SELECT count(*) FROM seen) AS entities FROM chains")
def _(spark, d):
    return run_of(spark, d).counters()


@query("stale_entities", f"{ALL} SELECT entity_uid FROM seen WHERE last_seen < (SELECT max(time) FROM a) - {SETTINGS.retention_minutes * 60_000}")
def _(spark, d):
    r = run_of(spark, d)
    now = r.alerts.agg(F.max("time")).first()[0] or 0
    return E.stale(r.entities, now, SETTINGS.retention_minutes * 60_000).select("entity_uid")


@query("expired_alerts", f"WITH {A} SELECT uid FROM a WHERE time < (SELECT max(time) FROM a) - {SETTINGS.retention_minutes * 60_000}")
def _(spark, d):
    a = alert_view(spark, d)
    return expired(a, "time", a.agg(F.max("time")).first()[0] or 0, SETTINGS.retention_minutes * 60_000).select("uid")


_TOK = "regexp_extract_all(lower({}), '[a-z0-9][a-z0-9._-]*')"


@query("bm25_topk", f"""WITH w AS (SELECT doc_id AS uid, unnest({_TOK.format("source || ' ' || lang")}) AS t, 3 AS w FROM documents UNION ALL SELECT doc_id, unnest({_TOK.format("text")}), 1 FROM documents),
tf AS (SELECT uid, t, sum(w) AS tf FROM w GROUP BY ALL), q AS (SELECT item_id AS query, t, least(count(*), 3) AS n FROM (SELECT item_id, unnest({_TOK.format("text")}) AS t FROM benchmark) GROUP BY ALL),
len AS (SELECT uid, sum(tf) AS length FROM tf GROUP BY uid), m AS (SELECT avg(length) AS mean FROM len), c AS (SELECT count(*) AS docs FROM documents),
idf AS (SELECT t, ln(1 + (docs - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, c GROUP BY t, docs),
s AS (SELECT query, uid, sum(n * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean))) AS score FROM q JOIN tf USING (t) JOIN idf USING (t) JOIN len USING (uid), m GROUP BY ALL)
SELECT query, r AS rank, uid, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, uid) AS r FROM s WHERE score > 0) WHERE r <= 8""")
def _(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("uid"), F.concat_ws(" ", "source", "lang").alias("title"), F.col("text").alias("body"))
    out = search.bm25(table(spark, d, "benchmark").select(F.col("item_id").alias("query"), "text"), docs, SETTINGS.top_k)
    return out.withColumn("rank", F.col("rank").cast("long"))


@query("bm25_index", ORACLES["bm25_topk"])
def _(spark, d):
    """The index is written from three quarters of the documents, a third of them with other texts, which the rest and their
    true texts replace."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("uid"), F.concat_ws(" ", "source", "lang").alias("title"), F.col("text").alias("body"))
    index = Index(spark, f"{shared_dir(spark)}/inverted-{uuid.uuid4().hex}")
    index.add(docs.where("uid % 4 > 0").withColumn("body", F.when(F.col("uid") % 4 == 1, F.reverse("body")).otherwise(F.col("body")))).add(docs.where("uid % 4 < 2"))
    return index.top(table(spark, d, "benchmark").select(F.col("item_id").alias("query"), "text"), SETTINGS.top_k).withColumn("rank", F.col("rank").cast("long"))


@query("cosine_topk", "SELECT query, r AS rank, uid, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, uid) AS r FROM (SELECT q.vec_id AS query, d.vec_id AS uid, list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]) AS score FROM embeddings q, embeddings d WHERE q.vec_id % 50 = 0)) WHERE r <= 8")
def _(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("uid"), F.col("embedding").alias("vector"))
    out = search.cosine(v.where("uid % 50 = 0").withColumnRenamed("uid", "query"), v, SETTINGS.top_k)
    return out.withColumn("rank", F.col("rank").cast("long"))


_FOUND = "array_to_string(list_sort(list_distinct({})), ',')"


@query("redact_documents", f"""SELECT doc_id, {_FOUND.format(f"regexp_extract_all(coalesce(text, ''), '{evidence.MAIL}')")} AS mails,
{_FOUND.format(f"list_filter([trim(x, '.') FOR x IN regexp_split_to_array(coalesce(text, ''), '[^0-9.]+|[.][.]+')], lambda x: regexp_full_match(x, '{evidence._OCTET}([.]{evidence._OCTET}){{3}}'))")} AS addresses FROM documents""")
def _(spark, d):
    out = evidence.redact(table(spark, d, "documents").select("doc_id", "text"), "text")
    of = lambda kind: F.array_join(F.array_sort(F.map_values(F.map_filter("tokens", lambda k, v: F.startswith(k, F.lit(f"[{kind}_"))))), ",")
    return out.select("doc_id", F.coalesce(of("EMAIL"), F.lit("")).alias("mails"), F.coalesce(of("IP"), F.lit("")).alias("addresses"))


@query("restored_documents", "SELECT doc_id, text FROM documents")
def _(spark, d):
    out = evidence.redact(table(spark, d, "documents").select("doc_id", "text"), "text")
    return out.select("doc_id", evidence.restore(F.col("redacted"), F.col("tokens")).alias("text"))


@query("flatten_props", "SELECT event_id, 'k' AS key, props->>'$.k' AS value FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.explode(evidence.flatten_payload("props")).alias("p")).select("event_id", "p.key", "p.value")


@query("grounding_validation", "WITH v AS (SELECT event_id, 'T10' || printf('%02d', event_id % 30) AS t FROM events) SELECT event_id, CASE WHEN event_id % 30 < 20 THEN [t] ELSE [] END::VARCHAR AS accepted, CASE WHEN event_id % 30 < 20 THEN ['bad'] ELSE [lower(t), 'bad'] END::VARCHAR AS rejected, CASE WHEN event_id % 4 = 0 THEN 40 ELSE 90 END AS confidence FROM v")
def _(spark, d):
    t = F.format_string("T10%02d", F.col("event_id") % 30)
    rows = table(spark, d, "events").select(
        "event_id", F.array(F.lower(t), F.lit("bad")).alias("techniques"), F.array(*(F.lit(f"T10{k:02}") for k in range(20))).alias("candidates"),
        F.array(F.when(F.col("event_id") % 4 == 0, "nowhere").otherwise("host.name")).alias("cited"), F.array(F.lit("host.name")).alias("evidence"), F.lit(90).alias("confidence"),
    )
    shown = lambda c: F.concat(F.lit("["), F.array_join(c, ", "), F.lit("]"))
    return search.validate(rows).select("event_id", shown("accepted").alias("accepted"), shown("rejected").alias("rejected"), "confidence")


@query("upsert_latest", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def _(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return latest_by_key(o, "o_custkey", F.struct("o_orderdate", "o_orderkey")).select("o_custkey", "o_orderkey", "o_totalprice")


_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query("table_catalogue", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS rows FROM {t}" for t in _TABLES))
def _(spark, d):
    return files.catalogue(spark, d).where(F.col("name").isin(*_TABLES)).select("name", "rows")


@query("conversation_threads", "SELECT conv_id, count(*) AS turns, string_agg(role, '>' ORDER BY turn) AS roles, count(*) FILTER (WHERE role = p) AS same_speaker FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations) GROUP BY conv_id")
def _(spark, d):
    w = W.partitionBy("conv_id").orderBy("turn")
    c = table(spark, d, "conversations").withColumn("p", F.lag("role").over(w))
    roles = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ">")
    return c.groupBy("conv_id").agg(F.count("*").alias("turns"), roles.alias("roles"), F.count_if(F.col("role") == F.col("p")).alias("same_speaker"))
