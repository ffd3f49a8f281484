"""Alerts as a stream: a micro-batch changes the entities and chains it touches, and reads and writes only those.

Rows newer than the watermark (latest time less the grace) wait; rows behind it are never dropped but take their place in
the next cycle. Identifiers keep the label of their component in a table, into which the edges of new alerts merge those
labels they meet. An alert's place in the state is its identifiers, not their labels, so a merge moves labels only. New
leases of an address are held against the alerts of that address, late ones as well. The chains of all entities that
changed are formed anew from their alerts; every other chain stays as it is.

Chains keep their id when they grow; a merged chain keeps the older id, a part that is split off gets a new one, and a
surfaced chain stays so. State is bounded by the retention, and running a batch again gives the same tables. What changed
in a batch is written to the results by chain id, once, whatever is retried.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from emberline.config import Settings
from emberline.functions.values import address
from emberline.operators import chains as C, entities as E, prefilter
from emberline.operators.components import connected_components
from emberline.operators.temporal import as_of, first_arrival
from emberline.plans import documents
from emberline.sources.sink import Results
from emberline.storage import collected, materialize, remove
from emberline.streaming.tables import BUCKETS, Keyed, Versioned

_CHAINS = (
    "chain string, alert_count long, first_time long, last_time long, first_uid string, max_severity int, entity_count long, disposition string, "
    "primary_entity string, primary_name string, risk double, surfaced boolean, cluster_id string, fingerprint string"
)
_ENTITIES = "entity_uid string, domain string, name string, identifiers array<struct<kind:string,value:string>>, first_seen long, last_seen long, risk double"
#: Stands between an owner's label and its identifier.
_CUT = "\x01"


def _schema(text: str) -> T.StructType:
    return T.StructType.fromDDL(text)


class AlertStream:
    """State under the folder ``state``, shared by all executors: ``buckets`` is fixed when the state is made, and should
    grow with the alerts that are retained. ``results``: where the documents of surfaced chains are written as they change."""

    def __init__(self, spark: SparkSession, state: str, settings: Settings | None = None, buckets: int = BUCKETS, results: Results | None = None) -> None:
        self.results = results
        self.spark, self.settings, self.path = spark, settings or Settings(), state.rstrip("/")
        keyed = lambda name, by, key, schema: Keyed(spark, f"{self.path}/{name}", by, key, _schema(schema) if schema else None, buckets)
        self.alerts = keyed("alerts", "uid", ("uid",), None)
        self.labels = keyed("labels", "node", ("node",), "node string, entity string")
        self.nodes = keyed("nodes", "entity", ("entity", "node"), "entity string, node string")
        self.addresses = keyed("addresses", "ip", ("ip", "uid", "pos"), "ip string, uid string, pos int, time long, node string")
        self.bridge = keyed("bridge", "uid", ("uid", "pos"), "uid string, pos int, time long, node string")
        self.touches = keyed("touches", "entity", ("entity", "uid"), "entity string, uid string, time long")
        self.entities = keyed("entities", "entity_uid", ("entity_uid",), _ENTITIES)
        self.placed = keyed("placed", "uid", ("uid",), "uid string, chain string")
        self.members = keyed("members", "chain", ("chain", "uid"), "chain string, uid string, time long")
        self.chains = keyed("chains", "chain", ("chain",), _CHAINS)
        self.issued = keyed("issued", "label", ("date", "label"), "date string, label string, last long")
        self.merged = keyed("merged", "cluster_id", ("cluster_id",), "cluster_id string, merged_into string")
        self.waiting, self.mark, self.dirty, self.changed = (Versioned(spark, f"{self.path}/{t}") for t in ("waiting", "mark", "dirty", "changed"))
        waits = self.waiting.read()
        self.alerts.schema = waits.schema if waits is not None else None

    @property
    def tables(self) -> list[Keyed]:
        return [t for t in vars(self).values() if isinstance(t, Keyed)]

    def start(self, alerts: DataFrame, checkpoint: str, **trigger):
        """``alerts``: a stream of normalized alerts. ``trigger``: as for ``trigger()``, every five minutes if not given."""
        every = trigger or {"processingTime": f"{self.settings.evaluate_every_minutes} minutes"}
        return alerts.writeStream.foreachBatch(lambda rows, n: self.cycle(rows, n) and None).option("checkpointLocation", checkpoint).trigger(**every).start()

    def cycle(self, batch: DataFrame | None, number: int, flush: bool = False) -> DataFrame:
        """One evaluation; ``flush`` lets all rows in. Returns the chains that changed, ``is_new`` where they surface for
        the first time. Batch numbers rise."""
        with collected() as made:
            changed = self._cycle(batch, number, flush)
            changed = self.changed.write(changed, number)
        remove(self.spark, made)
        for t in self.tables:
            t.merge(number)
        return changed

    def _arrived(self, batch: DataFrame | None, n: int, flush: bool) -> tuple[DataFrame, int]:
        """The alerts that take their place now, and the watermark."""
        s, waits = self.settings, self.waiting.read(n)
        if batch is not None:
            kept = prefilter.decide(first_arrival(batch, "uid", "time"), s.prefilter).where("not suppressed").drop("suppressed", "rule", "matched")
            if self.alerts.schema is None:
                self.alerts.schema = kept.schema
            kept = kept.select(*self.alerts.schema.names)
            known = self.alerts.lookup(kept.select("uid"), n).select("uid")
            fresh = kept.join(known if waits is None else known.union(waits.select("uid")), "uid", "left_anti").select(*self.alerts.schema.names)
            waits = fresh if waits is None else waits.unionByName(fresh)
        if waits is None:
            raise ValueError("the first cycle needs rows")
        waits = materialize(waits, "waits")
        last, before = waits.agg(F.max("time")).first()[0], self.mark.read(n)
        latest = max((x for x in (last, before.first()[0] if before is not None else None) if x is not None), default=0)
        self.mark.write(self.spark.createDataFrame([(latest,)], "latest long"), n)
        edge = latest - s.watermark_seconds * 1000
        ready = F.lit(True) if flush else F.col("time").isNotNull() & (F.col("time") <= edge)
        self.waiting.write(waits.where(~ready), n)
        return materialize(waits.where(ready), "arrived"), edge

    def _entity(self, rows: DataFrame, n: int, step: int) -> DataFrame:
        """``rows(node, ...)`` with the entity of the node: an address, or an alert by itself, is one of its own."""
        label = self.labels.lookup(rows.select("node"), n, step)
        return rows.join(label, "node", "left").withColumn("entity", F.coalesce("entity", "node"))

    def _merge_labels(self, ids: DataFrame, n: int) -> DataFrame:
        """Puts the identifiers and edges of new alerts into the labels; returns the labels that were given up, ``(entity)``."""
        star = ids.groupBy("uid", "domain").agg(F.min("node").alias("v"), F.max("node").alias("w")).where("v <> w").select("uid", "domain", "v")
        edges = ids.join(star, ["uid", "domain"]).select(F.col("node").alias("u"), "v").where("u <> v").distinct()
        known = materialize(self._entity(ids.select("node").distinct(), n, 0), "known")
        of = lambda c: known.select(F.col("node").alias(c), F.col("entity").alias(f"{c}e"))
        met = edges.join(of("u"), "u").join(of("v"), "v").select(F.col("ue").alias("u"), F.col("ve").alias("v")).where("u <> v").distinct()
        label = materialize(connected_components(met).where("node <> component"), "label")
        held = self.nodes.lookup(label.select("node"), n)
        moved = held.join(label.select(F.col("node").alias("entity"), "component"), "entity").select("node", F.col("component").alias("entity"), F.col("entity").alias("was"))
        new = known.join(label.select(F.col("node").alias("entity"), "component"), "entity", "left").select("node", F.coalesce("component", "entity").alias("entity"))
        rows = materialize(new.unionByName(moved.select("node", "entity")).distinct(), "relabelled")
        self.labels.write(rows, None, n)
        self.nodes.write(rows, held, n)
        return label.select(F.col("node").alias("entity"))

    def _located(self, arrived: DataFrame, ids: DataFrame, n: int) -> DataFrame:
        """Writes the addresses of new alerts and returns what changes in the bridge, ``(uid, pos, time, node)``: the places
        of new alerts, and those of older ones whose address turns out to have had another holder."""
        node_of = lambda d: ids.where(F.col("domain") == d).groupBy("uid").agg(F.min("node").alias(f"{d}_node"))
        base = arrived.select("uid", "time", address(F.col("device_ip")).alias("device_ip"), address(F.col("src_ip")).alias("src_ip")).join(node_of("host"), "uid", "left").join(node_of("user"), "uid", "left")
        base = materialize(base, "base")
        at = lambda pos, c, node, rows: rows.select(F.col(c).alias("ip"), "uid", F.lit(pos).alias("pos"), "time", node.alias("node"))
        none = F.lit(None).cast("string")
        here = (
            at(0, "device_ip", F.col("host_node"), base.where("device_ip is not null and host_node is not null"))
            .unionByName(at(2, "device_ip", none, base.where("device_ip is not null and host_node is null")))
            .unionByName(at(4, "src_ip", none, base.where("src_ip is not null")))
        )
        here = materialize(here, "here")
        every = materialize(self.addresses.lookup(here.select("ip"), n).unionByName(here), "addresses")
        self.addresses.write(here, None, n)
        leases = self._entity(every.where("pos = 0"), n, 1).select("ip", "time", F.concat_ws(_CUT, "entity", "node").alias("owner"))
        owned = as_of(every.where("pos > 0").select("ip", "uid", "pos", "time"), leases, "ip", "time", "owner")
        owned = owned.select("uid", "pos", "time", F.coalesce(F.substring_index("owner", _CUT, -1), F.concat(F.lit("ip|ip|"), "ip")).alias("node"))
        before = self.bridge.lookup(owned.select("uid"), n).select("uid", "pos", F.col("node").alias("was"))
        owned = owned.join(before, ["uid", "pos"], "left").where("was is null or was <> node").drop("was")
        place = lambda pos, node, rows: rows.select("uid", F.lit(pos).alias("pos"), "time", node.alias("node"))
        alone = base.where("host_node is null and user_node is null and device_ip is null and src_ip is null")
        return materialize(
            place(1, F.col("host_node"), base.where("host_node is not null")).unionByName(place(3, F.col("user_node"), base.where("user_node is not null")))
            .unionByName(place(5, F.concat(F.lit("ip|ip|unidentified-"), "uid"), alone)).unionByName(owned), "located",
        )

    def _cycle(self, batch: DataFrame | None, n: int, flush: bool) -> DataFrame:
        s = self.settings
        arrived, edge = self._arrived(batch, n, flush)
        horizon = edge - s.retention_minutes * 60_000
        self.alerts.write(arrived, None, n)
        ids = materialize(E.identifiers(arrived).withColumn("node", F.concat_ws("|", "domain", "kind", "value")), "ids")
        lost = self._merge_labels(ids, n)
        located = self._located(arrived, ids, n)
        self.bridge.write(located, None, n)

        # which alerts touch other entities than before, and which entities that concerns
        uids = materialize(located.select("uid").union(self.touches.lookup(lost, n).select("uid")).distinct(), "uids")
        touch = lambda step: self._entity(self.bridge.lookup(uids, n, step), n, step).select("entity", "uid", "time").distinct()
        before, after = materialize(touch(0), "touched"), materialize(touch(1), "touching")
        pair = ["entity", "uid"]
        gone, new = before.join(after, pair, "left_anti"), after.join(before, pair, "left_anti")
        self.touches.write(new, gone, n)
        dirty = self.dirty.read(n)
        concerned = gone.select("entity").union(new.select("entity"))
        concerned = materialize((concerned if dirty is None else concerned.union(dirty)).distinct(), "concerned")

        # all alerts of all chains of those entities
        near = self.touches.lookup(concerned, n, 1).select("uid").union(uids).distinct()
        old = materialize(self.placed.lookup(near, n).select("chain").distinct(), "old")
        held = materialize(self.members.lookup(old, n), "held")
        scope = materialize(held.select("uid").union(near).union(arrived.select("uid")).distinct(), "scope")
        rows = materialize(self.alerts.lookup(scope, n, 1), "rows")
        located = materialize(self._entity(self.bridge.lookup(scope, n, 1), n, 1), "lying")
        bridge = materialize(located.groupBy("uid", "time", F.col("entity").alias("entity_uid")).agg(F.min("pos").alias("pos")).withColumn("domain", F.substring_index("entity_uid", "|", 1)), "bridge")
        placed = materialize(C.members(bridge, s.window_ms), "placed")

        entities = self._entities(rows, bridge, located, concerned, n)
        kinds = entities.select("entity_uid", F.explode("identifiers").alias("i")).select("entity_uid", "i.kind")
        risk = entities.select("entity_uid", "risk")
        built = C.build(rows, bridge, E.primary(rows, bridge, kinds, s.precedence), entities, s, placed, risk).drop("cluster_id", "number", "date", "label")
        named = self._named(built, placed, held, old, n)
        mark = F.sha2(F.concat_ws("|", "alert_count", "last_time", "risk", "surfaced", "disposition", "primary_entity"), 256)
        named = materialize(named.withColumn("fingerprint", mark).drop("number", "date", "label"), "named")

        prior = materialize(self.chains.lookup(old, n), "prior")
        self.chains.write(named, prior, n)
        self.members.write(placed.select("chain", "uid", "time"), held, n)
        self.placed.write(placed.select("uid", "chain"), None, n)
        self._expire(horizon, n)
        seen = prior.select("cluster_id", F.col("fingerprint").alias("f"), F.col("surfaced").alias("was")).dropDuplicates(["cluster_id"])
        live = named.where(F.col("last_time") >= horizon).join(seen, "cluster_id", "left").where("f is null or f <> fingerprint")
        if self.results is not None:
            shown = materialize(live.where("surfaced").drop("f", "was"), "shown")
            of = placed.join(shown.select("chain"), "chain", "left_semi")
            items, who = documents.alert_items(of, rows, bridge, entities), documents.chain_entities(of, bridge, entities.drop("risk"), risk)
            ended = prior.select("cluster_id").join(named.select("cluster_id"), "cluster_id", "left_anti")
            self.results.write(documents.documents(shown, items, who, url=s.dashboard_url), n, ended)
        return live.withColumn("is_new", F.col("surfaced") & ~F.coalesce("was", F.lit(False))).drop("f", "was")

    def _entities(self, rows: DataFrame, bridge: DataFrame, located: DataFrame, concerned: DataFrame, n: int) -> DataFrame:
        """The entities that the alerts of ``bridge`` touch; those ``concerned`` are summed up anew and written."""
        ids = E.identifiers(rows).withColumn("node", F.concat_ws("|", "domain", "kind", "value"))
        named = self._entity(ids, n, 1).select("domain", "kind", "value", "display", "time", F.col("entity").alias("entity_uid"))
        own = F.substring_index("entity", "|", -1)
        lone = located.where("entity like 'ip|%'").select(F.lit("ip").alias("domain"), F.lit("ip").alias("kind"), own.alias("value"), own.alias("display"), "time", F.col("entity").alias("entity_uid"))
        hosts = located.where("pos = 1").join(rows.select("uid", address(F.col("device_ip")).alias("ip")).where("ip is not null"), "uid")
        leased = hosts.select(F.lit("host").alias("domain"), F.lit("ip").alias("kind"), F.col("ip").alias("value"), F.col("ip").alias("display"), "time", F.col("entity").alias("entity_uid"))
        only = concerned.select(F.col("entity").alias("entity_uid"))
        of = lambda df: df.join(only, "entity_uid", "left_semi")
        table = E.entity_table(of(bridge), of(named.unionByName(lone).unionByName(leased)))
        table = materialize(table.join(C.entity_risk(rows, of(bridge), self.settings.weights), "entity_uid", "left"), "entities")
        self.entities.write(table, only.join(table, "entity_uid", "left_anti"), n)
        other = bridge.select("entity_uid").distinct().join(only, "entity_uid", "left_anti")
        return table.unionByName(self.entities.lookup(other, n))

    def _named(self, built: DataFrame, placed: DataFrame, held: DataFrame, old: DataFrame, n: int) -> DataFrame:
        """``built`` with its ids. Each former id goes to one chain, the earliest of those that hold its alerts; of several
        ids a chain keeps the oldest, and the others are merged into it."""
        prior = self.chains.lookup(old, n).select(F.col("chain").alias("was_chain"), "cluster_id", F.col("first_time").alias("since"), F.col("surfaced").alias("was"))
        built = materialize(built, "built")  # its plan is long, and read three times
        claims = placed.join(held.select("uid", F.col("chain").alias("was_chain")), "uid").select("chain", "was_chain").distinct()
        claims = claims.join(prior, "was_chain").join(built.select("chain", "first_time"), "chain")
        won = claims.groupBy("cluster_id").agg(F.min(F.struct("first_time", "chain")).alias("w"), F.first("since").alias("since"), F.max("was").alias("was"))
        won = materialize(won.select("cluster_id", F.col("w.chain").alias("chain"), "since", "was"), "won")
        owners = won.groupBy("chain").agg(F.min_by("cluster_id", F.struct("since", "cluster_id")).alias("own"), F.max("was").alias("was"))
        merged = won.join(owners.select("chain", "own"), "chain").where("cluster_id <> own").select("cluster_id", F.col("own").alias("merged_into"))
        self.merged.write(merged, None, n)
        joined = built.join(owners, "chain", "left")
        fresh = joined.where("own is null").withColumn("label", C.label_of(F.col("primary_name")))
        new = materialize(C.numbered(fresh.drop("label"), self.issued.lookup(fresh.select("label"), n)), "numbered")
        self.issued.write(new.groupBy("date", "label").agg(F.max("number").alias("last")), None, n)
        kept = joined.where("own is not null").withColumn("cluster_id", F.col("own"))
        return kept.unionByName(new, allowMissingColumns=True).withColumn("surfaced", F.col("surfaced") | F.coalesce("was", F.lit(False))).drop("own", "was")

    def _expire(self, horizon: int, n: int) -> None:
        """Drops chains that ended before the horizon with all that only they held, and entities not seen since. Which
        they are is read from two columns of rows that were that old in some version."""
        past = [p.where(F.col("last_time") < horizon).select("chain") for p in self.chains._stored(2 * n + 1)]
        some = self.spark.createDataFrame([], "chain string") if not past else reduce(DataFrame.union, past)
        ended = materialize(self.chains.lookup(some, n, 1).where(F.col("last_time") < horizon).select("chain", "cluster_id"), "ended")
        stale = [p.where(F.col("last_seen") < horizon).select("entity_uid") for p in self.entities._stored(2 * n + 1)]
        stale = self.entities.lookup(reduce(DataFrame.union, stale), n, 1).where(F.col("last_seen") < horizon).select(F.col("entity_uid").alias("entity")) if stale else None
        none = self.spark.createDataFrame([], "entity string")
        if ended.isEmpty() and (stale is None or stale.isEmpty()):
            self.dirty.write(none, n)
            return
        gone = materialize(self.members.lookup(ended, n, 1), "gone")
        lying = materialize(self.bridge.lookup(gone.select("uid"), n, 1), "lying")
        left = materialize(self._entity(lying, n, 1).select("entity", "uid").distinct(), "left")
        rows = self.alerts.lookup(gone.select("uid"), n, 1)
        at = rows.select("uid", F.explode(F.array_distinct(F.array_compact(F.array(*(address(F.col(c)) for c in ("device_ip", "src_ip")))))).alias("ip"))
        addresses = self.addresses.lookup(at.select("ip"), n, 1).join(gone.select("uid"), "uid", "left_semi")
        nodes = materialize(self.nodes.lookup(stale, n, 1), "nodes") if stale is not None else None
        for table, keys in ((self.addresses, addresses), (self.chains, ended), (self.members, gone), (self.placed, gone), (self.bridge, lying), (self.touches, left)):
            table.write(None, materialize(keys.select(*table.key), "keys"), n, 1)
        self.alerts.write(None, gone, n, 1)
        if nodes is not None:
            self.labels.write(None, nodes, n, 1)
            self.nodes.write(None, nodes, n, 1)
            self.entities.write(None, stale.select(F.col("entity").alias("entity_uid")), n, 1)
        ids = ended.select("cluster_id")
        lost = self.merged.read(n, 1).join(ids.withColumnRenamed("cluster_id", "merged_into"), "merged_into", "left_semi")
        self.merged.write(None, lost, n, 1)
        dirty = left.select("entity").distinct()
        self.dirty.write(dirty if stale is None else dirty.join(stale, "entity", "left_anti"), n)
