"""Declarative mappings: a source's field lists compiled into one ``select`` over its JSON records.

A mapping lists, for each target, the source paths in order of preference, a named transform and a default. A value that
can't be cast flags the row, goes to ``unmapped`` under its target's name, and leaves the target unset (the default
stands only for missing values).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from emberline.functions import values as V


@dataclass(frozen=True)
class Rule:
    target: str
    sources: tuple[str, ...]
    transform: str | None = None
    default: str | None = None


@dataclass(frozen=True)
class Mapping:
    time: tuple[str, ...]
    severity: tuple[str, ...]
    rules: tuple[Rule, ...]
    #: Paths of tactic names, tactic uids, technique uids and technique names.
    attacks: tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...], tuple[str, ...]]
    offset_minutes: int = 0
    assume_year: int | None = None

    def __post_init__(self) -> None:
        known = set(TEXT_TARGETS) | set(INT_TARGETS)
        for r in self.rules:
            if r.target not in known:
                raise ValueError(f"no such target: {r.target}")
            if r.transform and r.transform not in V.TRANSFORMS:
                raise ValueError(f"no such transform: {r.transform}")


#: Columns of a normalized alert, by the names of the finding's nested fields with dots for levels.
TEXT_TARGETS = (
    "finding_info.title", "finding_info.uid", "finding_info.desc", "finding_info.analytic.name", "finding_info.analytic.uid", "message",
    "device.hostname", "device.ip", "device.mac", "device.uid", "device.domain", "device.os.name",
    "actor.user.name", "actor.user.uid", "actor.user.domain", "actor.user.email_addr",
    "actor.process.uid", "actor.process.name", "actor.process.cmd_line",
    "src_endpoint.ip", "src_endpoint.hostname", "dst_endpoint.ip",
    "metadata.product.vendor_name", "metadata.product.name", "metadata.event_code", "metadata.log_name",
)
INT_TARGETS = ("actor.process.pid", "src_endpoint.port", "dst_endpoint.port")

# The field lists of the two kinds of source.
FILE = Mapping(
    time=("@timestamp", "timestamp", "time", "event_time", "date"),
    severity=("severity", "severity_id", "event.severity"),
    rules=(
        Rule("finding_info.title", ("rule.name", "rule_name", "rule", "title", "alert_name"), None, "Unknown finding"),
        Rule("finding_info.uid", ("id", "alert_id", "event.id", "uuid")),
        Rule("finding_info.desc", ("description", "rule.description")),
        Rule("message", ("message", "reason")),
        Rule("device.hostname", ("host.name", "hostname", "host")),
        Rule("device.ip", ("host.ip", "host_ip"), "first"),
        Rule("device.mac", ("host.mac", "mac"), "first"),
        Rule("device.uid", ("agent.id", "agent_id", "host.id")),
        Rule("actor.user.name", ("user.name", "username", "user")),
        Rule("actor.user.email_addr", ("user.email", "email", "upn")),
        Rule("actor.user.domain", ("user.domain",)),
        Rule("actor.process.uid", ("process.entity_id", "process_guid")),
        Rule("actor.process.pid", ("process.pid", "pid"), "int"),
        Rule("actor.process.name", ("process.name",)),
        Rule("actor.process.cmd_line", ("process.command_line", "command_line")),
        Rule("src_endpoint.ip", ("source.ip", "src_ip", "source_ip")),
        Rule("src_endpoint.port", ("source.port", "src_port"), "int"),
        Rule("dst_endpoint.ip", ("destination.ip", "dst_ip", "dest_ip")),
        Rule("dst_endpoint.port", ("destination.port", "dst_port"), "int"),
        Rule("metadata.product.vendor_name", ("vendor", "event.provider"), None, "file"),
        Rule("metadata.event_code", ("event.code", "event_code")),
    ),
    attacks=(
        ("threat.tactic.name", "tactic_name", "tactic"), ("threat.tactic.id", "tactic_id"),
        ("threat.technique.id", "technique_id", "technique"), ("threat.technique.name", "technique_name"),
    ),
)
INDEX = Mapping(
    time=("kibana.alert.original_time", "@timestamp", "event.created"),
    severity=("kibana.alert.severity", "signal.rule.severity", "event.severity"),
    rules=(
        Rule("finding_info.title", ("kibana.alert.rule.name", "signal.rule.name", "rule.name"), None, "Unknown finding"),
        Rule("finding_info.uid", ("kibana.alert.uuid", "signal.rule.rule_id", "event.id")),
        Rule("finding_info.desc", ("kibana.alert.rule.description", "signal.rule.description")),
        Rule("finding_info.analytic.name", ("kibana.alert.rule.name", "signal.rule.name")),
        Rule("finding_info.analytic.uid", ("kibana.alert.rule.uuid", "signal.rule.id")),
        Rule("message", ("kibana.alert.reason", "message")),
        Rule("device.hostname", ("host.name", "host.hostname")),
        Rule("device.ip", ("host.ip",), "first"),
        Rule("device.mac", ("host.mac",), "first"),
        Rule("device.uid", ("agent.id", "host.id")),
        Rule("device.domain", ("host.domain",)),
        Rule("device.os.name", ("host.os.name",)),
        Rule("actor.user.name", ("user.name",)),
        Rule("actor.user.uid", ("user.id",)),
        Rule("actor.user.domain", ("user.domain",)),
        Rule("actor.user.email_addr", ("user.email",)),
        Rule("actor.process.uid", ("process.entity_id",)),
        Rule("actor.process.pid", ("process.pid",), "int"),
        Rule("actor.process.name", ("process.name",)),
        Rule("actor.process.cmd_line", ("process.command_line",)),
        Rule("src_endpoint.ip", ("source.ip",)),
        Rule("src_endpoint.port", ("source.port",), "int"),
        Rule("src_endpoint.hostname", ("source.domain",)),
        Rule("dst_endpoint.ip", ("destination.ip",)),
        Rule("dst_endpoint.port", ("destination.port",), "int"),
        Rule("metadata.product.vendor_name", ("event.provider", "agent.type"), None, "Elastic"),
        Rule("metadata.product.name", ("event.module",)),
        Rule("metadata.event_code", ("event.code",)),
        Rule("metadata.log_name", ("event.dataset",)),
    ),
    attacks=(
        ("kibana.alert.rule.threat.tactic.name", "threat.tactic.name"), ("kibana.alert.rule.threat.tactic.id", "threat.tactic.id"),
        ("kibana.alert.rule.threat.technique.id", "threat.technique.id"), ("kibana.alert.rule.threat.technique.name", "threat.technique.name"),
    ),
)


ATTACK = "struct<tactic:struct<name:string,uid:string>,technique:struct<name:string,uid:string>>"


def _lists(rows: DataFrame, paths: tuple[tuple[str, ...], ...]) -> DataFrame:
    """Columns ``_a0`` to ``_a3`` (lists of strings, each from its first present path) and ``_wrong`` (something in one of
    them is no scalar)."""
    wrong = []
    for j, options in enumerate(paths):
        for k, p in enumerate(options):
            values, nested = V.each_sql("payload", p)
            rows = rows.withColumns({f"_o{j}{k}": F.expr(V.lookup_sql("payload", p)), f"_e{j}{k}": F.expr(values), f"_n{j}{k}": F.expr(nested)})
        found, bad = F.lit(None).cast("array<string>"), F.lit(False)
        for k in range(len(options) - 1, -1, -1):
            v, each = F.col(f"_o{j}{k}"), F.col(f"_e{j}{k}")
            there = V.present(v).isNotNull()
            mine = F.when(V.kind(v) == "ARRAY", F.try_variant_get(v, "$", "array<string>")).otherwise(F.array(V.to_text(v)))
            odd = F.exists(each, lambda x: ~V.kind(x).isin("STRING", "BIGINT", "DECIMAL", "DOUBLE"))
            found = F.when(there, mine).when(F.size(each) > 0, F.transform(each, V.to_text)).otherwise(found)
            bad = F.when(there, F.schema_of_variant(v).rlike(r"^ARRAY<(OBJECT|ARRAY)|^OBJECT|^BOOLEAN")).when(F.size(each) > 0, odd).when(F.col(f"_n{j}{k}"), True).otherwise(bad)
        rows = rows.withColumns({f"_a{j}": found, f"_w{j}": F.coalesce(bad, F.lit(False))})
        wrong.append(F.col(f"_w{j}"))
    return rows.withColumn("_wrong", wrong[0] | wrong[1] | wrong[2] | wrong[3])


def _side_by_side(rows: DataFrame) -> DataFrame:
    """``attacks`` from the four lists; a list of one stands for all. A wrong list drops the whole."""
    rows = rows.withColumn("_n", F.greatest(*(F.coalesce(F.size(f"_a{j}"), F.lit(0)) for j in range(4))))
    n = F.col("_n")

    def one(i: Column) -> Column:
        name, uid, technique, label = (F.when((F.size(f"_a{j}") == 1) & (n > 1), F.get(f"_a{j}", F.lit(0))).otherwise(F.get(f"_a{j}", i)) for j in range(4))
        tactic = F.when(name.isNotNull() | uid.isNotNull(), F.struct(name.alias("name"), uid.alias("uid")))
        return F.struct(tactic.alias("tactic"), F.when(technique.isNotNull() | label.isNotNull(), F.struct(label.alias("name"), technique.alias("uid"))).alias("technique"))

    some = F.filter(F.transform(F.sequence(F.lit(0), n - 1), one), lambda a: a["tactic"].isNotNull() | a["technique"].isNotNull())
    return rows.withColumn("attacks", F.when(F.col("_wrong") | (n == 0), F.array().cast(f"array<{ATTACK}>")).otherwise(some.cast(f"array<{ATTACK}>")))


def normalize(raw: DataFrame, mapping: Mapping) -> DataFrame:
    """``raw(raw string, payload variant, fallback_uid string, received_ms long, source string)`` -> normalized alerts: the
    finding's fields as columns, with ``uid``, ``time`` and ``labels`` (``parse_error`` where something couldn't be cast).

    A row is never dropped: without a usable time it takes the time it was received, without an id the fallback. The
    lookups, the choice among them and the casts are steps of their own, so that no expression is repeated.
    """
    sources = {"time": mapping.time, "severity": mapping.severity} | {r.target: r.sources for r in mapping.rules}
    paths = list(dict.fromkeys(p for s in sources.values() for p in s))
    place = {p: f"_p{k}" for k, p in enumerate(paths)}
    rows = raw.select("*", *(F.expr(V.lookup_sql("payload", p)).alias(place[p]) for p in paths))
    value = {t: f"_v{k}" for k, t in enumerate(sources)}
    rows = rows.withColumns({value[t]: F.coalesce(*(V.present(F.col(place[p])) for p in s)) for t, s in sources.items()})
    rows = rows.withColumns({value["severity"]: V.first(F.col(value["severity"]))} | {value[r.target]: V.TRANSFORMS[r.transform](F.col(value[r.target])) for r in mapping.rules if r.transform == "first"})
    casts = {"_time": V.to_ms(F.col(value["time"]), mapping.offset_minutes, mapping.assume_year), "original_time": V.to_text(F.col(value["time"])), "_level": V.severity(F.col(value["severity"])), "severity": V.to_text(F.col(value["severity"]))}
    for r in mapping.rules:
        v = F.col(value[r.target])
        cast = V.to_int(v).cast("bigint") if r.target in INT_TARGETS else V.TRANSFORMS[r.transform](v) if r.transform not in (None, "first", "int") else V.to_text(v)
        casts["_c" + r.target.replace(".", "__")] = cast
    rows = rows.withColumns(casts)
    steps, errors, fields = {}, [F.when(F.col("_time").isNull(), F.lit("time: missing or not understood"))], []
    for target, cast in (("severity", "_level"), *((r.target, "_c" + r.target.replace(".", "__")) for r in mapping.rules)):
        wrong = F.col(value[target]).isNotNull() & F.col(cast).isNull()
        errors.append(F.when(wrong, V.failed(F.col(value[target]), target)))
        fields.append(F.struct(F.lit(target).alias("k"), F.when(wrong, F.to_json(value[target])).alias("v")))
    for r in mapping.rules:
        got = F.col("_c" + r.target.replace(".", "__"))
        steps[r.target.replace(".", "__")] = got if r.default is None else F.when(F.col(value[r.target]).isNull(), F.lit(r.default)).otherwise(got)
    steps |= {"time": F.coalesce("_time", "received_ms"), "severity_id": F.coalesce("_level", F.lit(0))}
    rows = _side_by_side(_lists(rows.withColumns(steps), mapping.attacks))
    errors.append(F.when(F.col("_wrong"), F.lit("attacks: not a list of names and ids")))
    wide = rows.withColumns({"parse_errors": F.array_compact(F.array(*errors)), "unmapped_fields": F.map_from_entries(F.filter(F.array(*fields), lambda f: f["v"].isNotNull()))})
    have = set(wide.columns)
    col = lambda k: F.col(k.replace(".", "__")) if k.replace(".", "__") in have else F.lit(None).cast("bigint" if k in INT_TARGETS else "string")
    uid = F.coalesce(F.when(col("finding_info.uid") != "", col("finding_info.uid")), F.col("fallback_uid"))
    return wide.select(
        uid.alias("uid"), F.col("time"), V.iso_ms(F.col("time")).alias("time_dt"), "severity_id", "severity", "source",
        F.coalesce(col("finding_info.title"), F.lit("Unknown finding")).alias("title"), col("finding_info.desc").alias("desc"), col("message").alias("message"),
        col("finding_info.analytic.name").alias("analytic_name"), col("finding_info.analytic.uid").alias("analytic_uid"), "attacks",
        col("device.hostname").alias("hostname"), col("device.ip").alias("device_ip"), col("device.mac").alias("mac"), col("device.uid").alias("agent_uid"),
        col("device.domain").alias("device_domain"), col("device.os.name").alias("os_name"),
        col("actor.user.name").alias("username"), col("actor.user.uid").alias("user_uid"), col("actor.user.domain").alias("user_domain"), col("actor.user.email_addr").alias("email"),
        col("actor.process.uid").alias("process_guid"), col("actor.process.pid").alias("pid"), col("actor.process.name").alias("process_name"), col("actor.process.cmd_line").alias("cmd_line"),
        col("src_endpoint.ip").alias("src_ip"), col("src_endpoint.port").alias("src_port"), col("src_endpoint.hostname").alias("src_hostname"),
        col("dst_endpoint.ip").alias("dst_ip"), col("dst_endpoint.port").alias("dst_port"),
        F.coalesce(col("metadata.product.vendor_name"), F.lit("unknown")).alias("vendor_name"), col("metadata.product.name").alias("product_name"),
        col("metadata.event_code").alias("event_code"), col("metadata.log_name").alias("log_name"), "original_time",
        V.iso_ms(F.col("received_ms")).alias("processed_time"),
        F.when(F.size("parse_errors") > 0, F.array(F.lit("parse_error"))).otherwise(F.array().cast("array<string>")).alias("labels"),
        F.struct(F.col("raw").alias("raw"), F.col("parse_errors").alias("parse_errors"), F.col("unmapped_fields").alias("fields")).alias("unmapped"),
    )


def finding(alerts: DataFrame) -> DataFrame:
    """The nested finding of each normalized alert, in the declared order of its fields (encode with ``to_json``)."""
    s = lambda **k: F.struct(*(c.alias(n) for n, c in k.items()))
    some = lambda x, *cols: F.when(F.coalesce(*cols).isNotNull(), x)
    c = F.col
    return alerts.select(
        c("time"), c("time_dt"), c("severity_id"), c("severity"),
        s(product=s(vendor_name=c("vendor_name"), name=c("product_name")), version=F.lit("1.1.0"), uid=c("uid"), original_time=c("original_time"), processed_time=c("processed_time"), log_name=c("log_name"), event_code=c("event_code"), labels=c("labels")).alias("metadata"),
        s(title=c("title"), uid=c("uid"), desc=c("desc"), analytic=some(s(name=c("analytic_name"), uid=c("analytic_uid")), c("analytic_name"), c("analytic_uid")), attacks=c("attacks")).alias("finding_info"),
        c("message"),
        some(s(hostname=c("hostname"), ip=c("device_ip"), mac=c("mac"), uid=c("agent_uid"), domain=c("device_domain")), c("hostname"), c("device_ip"), c("mac"), c("agent_uid")).alias("device"),
        s(user=s(name=c("username"), uid=c("user_uid"), domain=c("user_domain"), email_addr=c("email")), process=s(uid=c("process_guid"), pid=c("pid"), name=c("process_name"), cmd_line=c("cmd_line"))).alias("actor"),
        some(s(ip=c("src_ip"), hostname=c("src_hostname"), port=c("src_port")), c("src_ip"), c("src_hostname")).alias("src_endpoint"),
        some(s(ip=c("dst_ip"), port=c("dst_port")), c("dst_ip")).alias("dst_endpoint"),
        F.lit(2004).alias("class_uid"), F.lit("Detection Finding").alias("class_name"), F.lit(2).alias("category_uid"), F.lit("Findings").alias("category_name"), F.lit(1).alias("activity_id"), F.lit(200401).alias("type_uid"),
        c("unmapped"),
    )
