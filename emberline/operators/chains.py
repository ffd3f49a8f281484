"""Attack chains: alerts joined by the gap sessions of the entities they touch, with their order, names and risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from emberline.config import TACTICS, Settings, mapped
from emberline.operators.components import connected_components
from emberline.operators.temporal import ordered, sessions
from emberline.storage import materialize

UIDS, NAMES = {u.lower(): k for k, (u, _) in enumerate(TACTICS)}, {n: k for k, (_, n) in enumerate(TACTICS)}


def tactic_rank(tactic: Column) -> Column:
    """Place in the order of an attack, by uid and else by name (null: none)."""
    return F.coalesce(mapped(F.lower(F.trim(tactic["uid"])), UIDS), mapped(F.lower(F.trim(tactic["name"])), NAMES))


def alert_rank(attacks: Column) -> Column:
    """An alert stands where its last tactic stands."""
    return F.array_max(F.transform(attacks, lambda a: tactic_rank(a["tactic"])))


def tactic_names(attacks: Column) -> Column:
    return F.filter(F.transform(attacks, lambda a: F.coalesce(a["tactic"]["name"], a["tactic"]["uid"])), lambda x: x.isNotNull())


def members(bridge: DataFrame, window_ms: int) -> DataFrame:
    """``(uid, time, chain)``: chain is the smallest alert uid of the component.

    The graph is one of sessions, never of alerts or pairs: a session of several alerts is named by the smallest of them,
    its hub, and an alert links the hubs of its sessions. The smallest alert of a component is a hub itself.
    """
    with_session = sessions(bridge.select("uid", "time", "entity_uid"), "entity_uid", "time", window_ms)
    hubs = with_session.groupBy("entity_uid", "session").agg(F.min("uid").alias("v"), F.max("uid").alias("w")).where("v <> w").drop("w")
    held = with_session.join(hubs, ["entity_uid", "session"], "left").groupBy("uid").agg(F.min("time").alias("time"), F.array_sort(F.collect_set("v")).alias("hubs"))
    held = materialize(held, "hubs")
    label = connected_components(held.where("size(hubs) > 1").select(F.explode("hubs").alias("u"), F.col("hubs")[0].alias("v")).where("u <> v").distinct())
    # any of its hubs leads an alert to its component; a drawn one deals the alerts of one large session over several keys
    drawn = F.when(F.size("hubs") > 0, F.element_at("hubs", (F.pmod(F.xxhash64("uid"), F.size("hubs")) + 1).cast("int")))
    alerts = held.select("uid", "time", drawn.alias("hub"))
    return alerts.join(label, alerts["hub"] == label["node"], "left").select("uid", "time", F.coalesce("component", "hub", "uid").alias("chain"))


def dispositions(placed: DataFrame) -> DataFrame:
    """``placed(chain, time, uid, rank)`` -> ``(chain, disposition)`` of the chains with ranked alerts: unknown with fewer than
    two, reversed if there are more steps back than forward, progressing with any step forward, else flat."""
    steps = ordered(placed.where("rank is not null").select("chain", "time", "uid", "rank"), "chain", "time", "uid", ("rank",)).withColumnRenamed("previous_rank", "p")
    sums = steps.groupBy("chain").agg(F.count("*").alias("n"), F.count_if(F.col("rank") > F.col("p")).alias("up"), F.count_if(F.col("rank") < F.col("p")).alias("down"))
    kind = F.when(F.col("n") < 2, "unknown").when(F.col("down") > F.col("up"), "reversed").when(F.col("up") > 0, "progressing").otherwise("flat")
    return sums.select("chain", kind.alias("disposition"))


def label_of(name: Column) -> Column:
    trimmed = lambda c: F.regexp_replace(c, "^-+|-+$", "")
    made = trimmed(F.substring(trimmed(F.regexp_replace(F.coalesce(name, F.lit("")), "[^A-Za-z0-9_-]+", "-")), 1, 40))
    return F.when(made == "", "entity").otherwise(made)


def numbered(chains: DataFrame, issued: DataFrame | None = None) -> DataFrame:
    """``chains(chain, first_time, first_uid, primary_name, ...)`` with ``cluster_id``: CHAIN-date-label-number, numbered by
    formation within a date and label, on from the highest of ``issued(date, label, last)``."""
    rows = chains.withColumn("date", F.date_format(F.timestamp_millis("first_time"), "yyyy-MM-dd")).withColumn("label", label_of(F.col("primary_name")))
    n = F.row_number().over(W.partitionBy("date", "label").orderBy("first_time", "first_uid"))
    if issued is not None:
        rows = rows.join(issued, ["date", "label"], "left")
        n = n + F.coalesce("last", F.lit(0))
    rows = rows.withColumn("number", n)
    return rows.withColumn("cluster_id", F.format_string("CHAIN-%s-%s-%03d", "date", "label", "number")).drop(*(["last"] if issued is not None else []))


def entity_risk(alerts: DataFrame, bridge: DataFrame, weights: dict[int, float]) -> DataFrame:
    """``(entity_uid, risk)``: the weights of all alerts that touch it, whatever their chain."""
    w = alerts.select("uid", F.coalesce(mapped(F.col("severity_id").cast("int"), weights), F.lit(0.0)).alias("w"))
    return bridge.join(w, "uid").groupBy("entity_uid").agg(F.sum("w").alias("risk"))


def primary_entities(placed: DataFrame, primary: DataFrame, entities: DataFrame) -> DataFrame:
    """``(chain, primary_entity, primary_name)``: the most frequent main entity; ties go to the first seen, then the smaller uid."""
    counted = placed.join(primary, "uid").groupBy("chain", F.col("primary_entity").alias("entity_uid")).agg(F.count("*").alias("n"))
    best = counted.join(entities.select("entity_uid", "name", "first_seen"), "entity_uid", "left")
    return best.groupBy("chain").agg(F.min_by(F.struct("entity_uid", "name"), F.struct(-F.col("n"), "first_seen", "entity_uid")).alias("e")).select("chain", F.col("e.entity_uid").alias("primary_entity"), F.col("e.name").alias("primary_name"))


def build(alerts: DataFrame, bridge: DataFrame, primary: DataFrame, entities: DataFrame, settings: Settings, placed: DataFrame | None = None, risk: DataFrame | None = None) -> DataFrame:
    """A row for each chain: times, counts, main entity, cluster id, disposition, risk and whether it surfaces. ``risk`` of
    the entities is summed over ``alerts`` where it isn't given."""
    placed = members(bridge, settings.window_ms) if placed is None else placed
    ranked = materialize(placed.join(alerts.select("uid", "severity_id", alert_rank(F.col("attacks")).alias("rank")), "uid"), "ranked")  # read three times
    sums = ranked.groupBy("chain").agg(F.count("*").alias("alert_count"), F.min("time").alias("first_time"), F.max("time").alias("last_time"), F.min_by("uid", F.struct("time", "uid")).alias("first_uid"), F.max("severity_id").alias("max_severity"))
    risk = entity_risk(alerts, bridge, settings.weights) if risk is None else risk
    touched = bridge.join(placed.select("uid", "chain"), "uid").select("chain", "entity_uid").distinct().join(risk, "entity_uid", "left")
    by_chain = touched.groupBy("chain").agg(F.max("risk").alias("raw_risk"), F.count("*").alias("entity_count"))
    out = sums.join(by_chain, "chain", "left").join(dispositions(ranked), "chain", "left").join(primary_entities(placed, primary, entities), "chain", "left")
    out = out.withColumn("disposition", F.coalesce("disposition", F.lit("unknown")))
    score = F.coalesce("raw_risk", F.lit(0.0)) * F.when(F.col("disposition") == "reversed", settings.reversed_factor).otherwise(1.0)
    return numbered(out.withColumn("risk", score).withColumn("surfaced", F.col("risk") >= settings.surface_threshold).drop("raw_risk"))
