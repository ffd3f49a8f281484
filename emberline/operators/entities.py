"""Entity resolution: hosts, users and addresses behind alerts.

Order-free: identifiers that occur together in an alert belong to one entity (hosts and users never merge), and an
address belongs to the host that held it at that time. All leases count, seen before or after the alert was read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from emberline.config import DISPLAY, PRECEDENCE
from emberline.functions.values import address, mac
from emberline.operators.components import connected_components
from emberline.operators.temporal import as_of
from emberline.storage import materialize

HOST_KINDS, USER_KINDS = ("agent_uid", "hostname", "mac", "process_guid"), ("upn", "username")


def _listed(alerts: DataFrame) -> DataFrame:
    """``alerts`` with ``ids``, the identifiers in their joining form. Agent ids keep their case; empty ones don't count."""
    low = lambda c: F.lower(F.trim(c))
    one = lambda domain, kind, value, display: F.struct(F.lit(domain).alias("domain"), F.lit(kind).alias("kind"), value.alias("value"), F.col(display).alias("display"))
    every = F.array(
        one("host", "agent_uid", F.trim("agent_uid"), "agent_uid"), one("host", "hostname", low("hostname"), "hostname"), one("host", "mac", mac(F.col("mac")), "mac"),
        one("host", "process_guid", low("process_guid"), "process_guid"), one("user", "upn", low("email"), "email"), one("user", "username", low("username"), "username"),
    )
    return alerts.withColumn("ids", F.filter(every, lambda x: x["value"].isNotNull() & (x["value"] != "")))


def identifiers(alerts: DataFrame) -> DataFrame:
    """``(uid, time, domain, kind, value, display)``: a row for each identifier of each alert."""
    return _listed(alerts).select("uid", "time", F.explode("ids").alias("i")).select("uid", "time", "i.*")


def resolve(alerts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``alert_entity(uid, time, entity_uid, domain, pos)`` and ``identifier_entity(domain, kind, value, display, time,
    entity_uid)``, the first time of each spelling. ``alerts`` hold a uid once. An alert touches its host, the holder of its
    device address, its user and the holder of its source address, in this order; one without any of them is an entity of
    its own."""
    node = lambda i: F.concat_ws("|", i["domain"], i["kind"], i["value"])
    of = lambda domain: F.transform(F.filter("ids", lambda i: i["domain"] == domain), node)
    nodes = _listed(alerts).select("uid", "time", "device_ip", "src_ip", of("host").alias("_hosts"), of("user").alias("_users"))
    star = lambda c: F.transform(c, lambda n: F.struct(n.alias("u"), F.array_min(c).alias("v")))
    edges = nodes.where("size(_hosts) > 1 or size(_users) > 1").select(F.inline(F.concat(star("_hosts"), star("_users")))).where("u <> v").distinct()
    label = connected_components(edges)
    base = nodes.select("uid", "time", address(F.col("device_ip")).alias("device_ip"), address(F.col("src_ip")).alias("src_ip"), F.array_min("_hosts").alias("_host"), F.array_min("_users").alias("_user"))
    # an alert's nodes of one domain are of one component, so its smallest node stands for all
    for c in ("host", "user"):
        base = base.join(label.select(F.col("node").alias(f"_{c}"), F.col("component").alias("_c")), f"_{c}", "left").withColumn(f"{c}_entity", F.coalesce("_c", f"_{c}")).drop("_c")
    base = materialize(base.drop("_host", "_user"), "addressed")  # read six times
    leases = base.where("device_ip is not null and host_entity is not null").select(F.col("device_ip").alias("ip"), "time", F.col("host_entity").alias("owner"))
    asked = base.where("device_ip is not null and host_entity is null").select("uid", "time", F.col("device_ip").alias("ip"), F.lit(2).alias("pos")).unionByName(
        base.where("src_ip is not null").select("uid", "time", F.col("src_ip").alias("ip"), F.lit(4).alias("pos"))
    )
    owned = as_of(asked, leases, "ip", "time", "owner").withColumn("entity_uid", F.coalesce("owner", F.concat(F.lit("ip|ip|"), "ip")))
    touched = (
        base.where("host_entity is not null").select("uid", "time", F.col("host_entity").alias("entity_uid"), F.lit(1).alias("pos"))
        .unionByName(base.where("user_entity is not null").select("uid", "time", F.col("user_entity").alias("entity_uid"), F.lit(3).alias("pos")))
        .unionByName(owned.select("uid", "time", "entity_uid", "pos"))
        .unionByName(
            base.where("host_entity is null and user_entity is null and device_ip is null and src_ip is null").select("uid", "time", F.concat(F.lit("ip|ip|unidentified-"), "uid").alias("entity_uid"), F.lit(5).alias("pos"))
        )
    )
    bridge = touched.groupBy("uid", "time", "entity_uid").agg(F.min("pos").alias("pos")).withColumn("domain", F.substring_index("entity_uid", "|", 1))
    spelt = ["domain", "kind", "value", "display"]
    # spellings are few, so they are reduced before they meet anything
    seen = identifiers(alerts).groupBy(*spelt).agg(F.min("time").alias("time")).withColumn("node", F.concat_ws("|", "domain", "kind", "value"))
    known = seen.join(label, "node", "left").select(*spelt, "time", F.coalesce("component", "node").alias("entity_uid"))
    alone = F.substring_index("entity_uid", "|", -1)
    addresses = touched.where("pos in (2, 4, 5)").where("entity_uid like 'ip|%'").groupBy("entity_uid").agg(F.min("time").alias("time"))
    addresses = addresses.select(F.lit("ip").alias("domain"), F.lit("ip").alias("kind"), alone.alias("value"), alone.alias("display"), "time", "entity_uid")
    held = leases.groupBy("ip", "owner").agg(F.min("time").alias("time")).select(F.lit("host").alias("domain"), F.lit("ip").alias("kind"), F.col("ip").alias("value"), F.col("ip").alias("display"), "time", F.col("owner").alias("entity_uid"))
    sighted = known.unionByName(addresses).unionByName(held)
    return bridge.select("uid", "time", "entity_uid", "domain", "pos"), sighted


def entity_table(bridge: DataFrame, sighted: DataFrame) -> DataFrame:
    """``(entity_uid, domain, name, identifiers, first_seen, last_seen)``: the name is the first kind there is, spelt as first seen."""
    spelt = sighted.groupBy("entity_uid", "kind", "value").agg(F.min_by("display", "time").alias("display"), F.min("time").alias("seen"))
    rank = F.coalesce(*(F.when(F.col("kind") == k, F.lit(n)) for n, k in enumerate(DISPLAY)), F.lit(99))
    named = spelt.groupBy("entity_uid").agg(F.min_by("display", F.struct(rank, "seen", "value")).alias("name"), F.array_sort(F.collect_set(F.struct("kind", "value"))).alias("identifiers"))
    seen = bridge.groupBy("entity_uid", "domain").agg(F.min("time").alias("first_seen"), F.max("time").alias("last_seen"))
    return seen.join(named, "entity_uid", "left").select("entity_uid", "domain", F.coalesce("name", F.substring_index("entity_uid", "|", -1)).alias("name"), "identifiers", "first_seen", "last_seen")


def primary(alerts: DataFrame, bridge: DataFrame, sighted: DataFrame, precedence: tuple[str, ...] = PRECEDENCE) -> DataFrame:
    """``(uid, primary_entity)``: the touched entity that has the kind of identifier named first, then the first touched."""
    rank = F.coalesce(*(F.when(F.col("kind") == k, F.lit(n)) for n, k in enumerate(precedence)), F.lit(99))
    kinds = sighted.groupBy("entity_uid").agg(F.min(rank).alias("kind_rank"))
    return bridge.join(kinds, "entity_uid", "left").groupBy("uid").agg(F.min_by("entity_uid", F.struct(F.coalesce("kind_rank", F.lit(99)), "pos", "entity_uid")).alias("primary_entity"))


def stale(entities: DataFrame, now_ms: int, retention_ms: int) -> DataFrame:
    """Entities last seen strictly before the retention's edge."""
    return entities.where(F.col("last_seen") < now_ms - retention_ms)
