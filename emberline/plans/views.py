"""Read-side plans: summaries, timelines, graphs and counters of chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from emberline.config import SEVERITY_LABELS, TACTICS, mapped
from emberline.functions.values import iso_ms
from emberline.operators.chains import alert_rank, tactic_names, tactic_rank
from emberline.operators.evidence import ENCODED, first_by_suffix, flatten_view, tag_label
from emberline.operators.temporal import ordered

UNTAGGED = "Untagged"


def severity_label(level: Column) -> Column:
    return mapped(level.cast("int"), SEVERITY_LABELS, "Unknown")


def lane(attacks: Column) -> Column:
    """Name of an alert's last tactic; the first of equal ones."""
    ranked = F.transform(F.filter(attacks, lambda a: tactic_rank(a["tactic"]).isNotNull()), lambda a, i: F.struct(tactic_rank(a["tactic"]).alias("r"), (-i).alias("i"), F.coalesce(a["tactic"]["name"], a["tactic"]["uid"]).alias("n")))
    return F.coalesce(F.array_max(ranked)["n"], F.lit(UNTAGGED))


def timeline(placed: DataFrame, alerts: DataFrame) -> DataFrame:
    """``(chain, seq, uid, time, lane, lane_index)``: lanes are numbered by the attack's order, those without a tactic last."""
    rows = placed.join(alerts.select("uid", "title", "severity_id", lane(F.col("attacks")).alias("lane"), F.coalesce(alert_rank(F.col("attacks")), F.lit(len(TACTICS))).alias("rank")), "uid")
    # the chain's ranks come to 15 at most, so their set is a bounded array
    sets = rows.groupBy("chain").agg(F.array_sort(F.collect_set("rank")).alias("ranks"))
    return ordered(rows, "chain", "time", "uid").join(sets, "chain").withColumn("lane_index", F.array_position("ranks", F.col("rank")) - 1).select("chain", "seq", "uid", "time", "title", "severity_id", "lane", F.col("lane_index").cast("long").alias("lane_index"))


def then_links(placed: DataFrame) -> DataFrame:
    """Consecutive alerts of a chain."""
    rows = ordered(placed.select("chain", "time", "uid"), "chain", "time", "uid", ("uid",))
    return rows.select("chain", F.col("previous_uid").alias("src"), F.col("uid").alias("dst")).where("src is not null")


def entity_links(bridge: DataFrame, entities: DataFrame) -> DataFrame:
    """``(a, b, uid)``: each pair of entities of one alert, smaller name first. An alert touches five entities at most."""
    names = bridge.join(entities.select("entity_uid", "name"), "entity_uid").groupBy("uid").agg(F.array_sort(F.collect_set("name")).alias("n"))
    pairs = F.flatten(F.transform("n", lambda x, i: F.transform(F.slice(F.col("n"), i + 2, F.size("n")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return names.where(F.size("n") > 1).select("uid", F.explode(pairs).alias("p")).select("p.a", "p.b", "uid")


def entity_nodes(bridge: DataFrame, entities: DataFrame, risk: DataFrame) -> DataFrame:
    """``(entity_uid, name, domain, risk, alert_count)``; an entity that isn't known any more is ``unknown`` with no risk."""
    n = bridge.groupBy("entity_uid").agg(F.countDistinct("uid").alias("alert_count"))
    out = n.join(entities.select("entity_uid", "name", "domain"), "entity_uid", "left").join(risk, "entity_uid", "left")
    return out.select("entity_uid", F.coalesce("name", "entity_uid").alias("name"), F.coalesce("domain", F.lit("unknown")).alias("domain"), F.coalesce("risk", F.lit(0.0)).alias("risk"), "alert_count")


def entity_pane(placed: DataFrame, bridge: DataFrame) -> DataFrame:
    """``(entity_uid, alerts, chains, first_seen, last_seen)``."""
    return bridge.join(placed.select("uid", "chain"), "uid").groupBy("entity_uid").agg(F.countDistinct("uid").alias("alerts"), F.countDistinct("chain").alias("chains"), F.min("time").alias("first_seen"), F.max("time").alias("last_seen"))


# The kinds of artifacts, and the ends of the record's paths that hold them, best first.
COMMAND_PATHS = ("process.command_line", "command_line", "cmd_line")
ARTIFACTS = {
    "process": ("process.name", "process.executable", "process.parent.name"),
    "parent_process": ("process.parent.name", "parent.process.name"),
    "powershell": ("powershell",),
    "encoded_command": ("encodedcommand", "encoded_command"),
    "downloaded_file": ("file.name", "file.path", "url.full"),
    "registry": ("registry.path", "registry.key", "registry.value"),
    "scheduled_task": ("task.name", "scheduled_task"),
    "service": ("service.name", "winlog.event_data.servicename"),
    "network": ("destination.ip", "destination.domain", "source.ip"),
}


def record(alerts: DataFrame) -> Column:
    """The JSON record that an alert was read from; of alerts without one its own columns."""
    if "unmapped" in alerts.columns:
        return F.col("unmapped.raw")
    return F.col("raw") if "raw" in alerts.columns else F.to_json(F.struct("*"))


def event_graph(placed: DataFrame, alerts: DataFrame, bridge: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes ``(chain, id, kind, label)`` and links ``(chain, src, dst, relation, uid)`` of the graph around the alerts: each
    alert leads to the next (then), to its techniques (uses), its command line (executes) and the artifacts in its record
    (contains), and its entities lead to it (observed). An id is kind and value; of several labels the first alert's counts."""
    flat = alerts.select("uid", "title", "attacks", flatten_view(record(alerts)).alias("pairs"))
    found = F.array(*(F.struct(F.lit(k).alias("kind"), first_by_suffix(F.col("pairs"), list(v)).alias("value")) for k, v in ARTIFACTS.items()))
    kind = lambda i: F.when((i["kind"] == "process") & F.contains(F.lower(i["value"]), F.lit("powershell")), F.lit("powershell")).otherwise(i["kind"])
    flat = flat.withColumn("items", F.transform(F.filter(found, lambda i: i["value"] != ""), lambda i: F.struct(kind(i).alias("kind"), i["value"].alias("value"))))
    rows = placed.select("chain", "uid", "time").join(flat.withColumn("cmd", first_by_suffix(F.col("pairs"), list(COMMAND_PATHS))).drop("pairs"), "uid")
    seen = placed.select("chain", "uid", "time").join(bridge.select("uid", "entity_uid"), "uid").join(entities.select("entity_uid", "name", "domain"), "entity_uid", "left")
    seen = seen.select("chain", "uid", "time", F.coalesce("domain", F.lit("entity")).alias("kind"), F.coalesce("name", "entity_uid").alias("value"))
    seen = seen.distinct().withColumns({"label": F.col("value"), "relation": F.lit("observed")})
    technique = rows.select("chain", "uid", "time", F.explode("attacks").alias("a")).where("trim(a.technique.uid) <> ''")
    command = F.when(F.col("cmd").rlike(ENCODED), "encoded_command").otherwise("command")
    around = (
        technique.select("chain", "uid", "time", F.lit("technique").alias("kind"), F.trim("a.technique.uid").alias("value"), F.coalesce(F.nullif("a.technique.name", F.lit("")), F.trim("a.technique.uid")).alias("label"), F.lit("uses").alias("relation"))
        .unionByName(rows.where("cmd <> ''").select("chain", "uid", "time", command.alias("kind"), F.col("cmd").alias("value"), F.col("cmd").alias("label"), F.lit("executes").alias("relation")))
        .unionByName(rows.select("chain", "uid", "time", F.explode("items").alias("i")).select("chain", "uid", "time", "i.kind", "i.value", F.col("i.value").alias("label"), F.lit("contains").alias("relation")))
    )
    events = rows.select("chain", "uid", "time", F.lit("event").alias("kind"), F.col("uid").alias("value"), F.coalesce(F.nullif("title", F.lit("")), "uid").alias("label"), F.lit("").alias("relation"))
    node, event = F.concat_ws(":", "kind", "value"), F.concat(F.lit("event:"), "uid")
    nodes = seen.unionByName(around).unionByName(events).groupBy("chain", node.alias("id"), "kind").agg(F.min_by("label", F.struct("time", "uid")).alias("label"))
    links = (
        then_links(placed).select("chain", F.concat(F.lit("event:"), "src").alias("src"), F.concat(F.lit("event:"), "dst").alias("dst"), F.lit("then").alias("relation"), F.col("dst").alias("uid"))
        .unionByName(seen.select("chain", node.alias("src"), event.alias("dst"), "relation", "uid"))
        .unionByName(around.select("chain", event.alias("src"), node.alias("dst"), "relation", "uid"))
    )
    return nodes, links


def incident_titles(placed: DataFrame, alerts: DataFrame) -> DataFrame:
    """``(chain, incident_title)``: the title of the highest severity, then the latest, then the smallest id; a chain with
    the technique PowerShell and credential access or persistence is named for that."""
    tactics = F.transform(tactic_names(F.col("attacks")), F.lower)
    shell = F.exists("attacks", lambda a: F.lower(a["technique"]["name"]) == "powershell")
    rows = placed.select("chain", "uid").join(alerts, "uid").groupBy("chain").agg(
        F.min_by(F.coalesce("title", F.lit("")), F.struct(-F.col("severity_id"), -F.col("time"), "uid")).alias("t"), F.max(shell).alias("shell"),
        F.max(F.array_contains(tactics, "credential access")).alias("credential"), F.max(F.array_contains(tactics, "persistence")).alias("persistence"),
    )
    title = F.when(F.col("shell") & F.col("credential"), "PowerShell Credential Theft").when(F.col("shell") & F.col("persistence"), "PowerShell Persistence")
    return rows.select("chain", title.otherwise(F.coalesce(F.nullif("t", F.lit("")), F.lit("Security Investigation"))).alias("incident_title"))


def summaries(chains: DataFrame, placed: DataFrame, alerts: DataFrame, bridge: DataFrame, entities: DataFrame, risk: DataFrame) -> DataFrame:
    """``chains`` with nested lists: alerts in order, entities, and the tactic sequence. A row holds a whole chain: where
    chains are large, ``documents`` has the same in blocks."""
    touched = bridge.join(entities.select("entity_uid", "name"), "entity_uid", "left").groupBy("uid").agg(F.array_sort(F.collect_set("name")).alias("entities"))
    c = F.col
    one = F.struct(
        c("time"), c("uid"), iso_ms(c("time")).alias("time_dt"), c("title"), c("desc"), c("message"), severity_label(c("severity_id")).alias("severity"), c("hostname").alias("host"), c("username").alias("user"),
        c("process_name"), c("cmd_line"), c("src_ip").alias("source_ip"), c("dst_ip").alias("destination_ip"), c("attacks"), c("entities"),
    )
    listed = placed.select("chain", "uid").join(alerts, "uid").join(touched, "uid", "left").groupBy("chain").agg(F.array_sort(F.collect_list(one)).alias("alerts"))
    who = bridge.join(placed.select("uid", "chain"), "uid").select("chain", "entity_uid").distinct().join(entities, "entity_uid", "left").join(risk, "entity_uid", "left")
    named = who.groupBy("chain").agg(F.array_sort(F.collect_list(F.struct("name", "domain", F.coalesce("risk", F.lit(0.0)).alias("risk_score"), "identifiers"))).alias("entities"))
    sequence = F.flatten(F.transform("alerts", lambda a: tactic_names(a["attacks"])))
    return chains.join(listed, "chain").join(named, "chain", "left").withColumn("tactic_sequence", sequence)


def counters(decisions: DataFrame, chains: DataFrame, entities: DataFrame) -> DataFrame:
    """One row: what a run read, flagged, suppressed, correlated and surfaced."""
    one = lambda df, *aggs: df.agg(*aggs).withColumn("_one", F.lit(1))
    flagged = F.count_if(F.array_contains("labels", "parse_error")) if "labels" in decisions.columns else F.lit(0).cast("long")
    a = one(decisions, F.count("*").alias("normalized"), flagged.alias("parse_flagged"), F.count_if("suppressed").alias("suppressed"), F.count_if(~F.col("suppressed")).alias("correlated"))
    b = one(chains, F.count("*").alias("chains"), F.count_if("surfaced").alias("surfaced"))
    return a.join(b, "_one").join(one(entities, F.count("*").alias("entities")), "_one").drop("_one")


def markdown(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"([\\`*_{}\[\]<>|#])", r"\\$1")


def lookup(local: DataFrame, written: DataFrame, cluster_id: str) -> DataFrame:
    """The rows of a chain's document: the local ones, else the written ones; none if there are neither."""
    of = lambda df: df.where(F.col("cluster_id") == cluster_id)
    return of(local).unionByName(of(written).join(of(local).select("cluster_id").distinct(), "cluster_id", "left_anti"))


def latest(documents: DataFrame, keep: int = 500, by: str = "written_at") -> DataFrame:
    """The documents written last."""
    return documents.orderBy(F.desc(by), F.desc("cluster_id")).limit(keep)
