"""A whole batch run: records to scored attack chains."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from emberline.config import Settings
from emberline.functions.mapping import FILE, INDEX, normalize
from emberline.operators import chains as C, entities as E, prefilter
from emberline.operators.temporal import first_arrival
from emberline.plans import documents, views
from emberline.sources import files
from emberline.storage import materialize


@dataclass
class Run:
    """Tables of a run; every one is a DataFrame over files in the shared folder."""

    decisions: DataFrame
    alerts: DataFrame
    bridge: DataFrame
    entities: DataFrame
    primary: DataFrame
    placed: DataFrame
    risk: DataFrame
    chains: DataFrame

    def summaries(self) -> DataFrame:
        return views.summaries(self.chains, self.placed, self.alerts, self.bridge, self.entities, self.risk)

    def items(self) -> DataFrame:
        return documents.alert_items(self.placed, self.alerts, self.bridge, self.entities)

    def members(self) -> DataFrame:
        return documents.chain_entities(self.placed, self.bridge, self.entities, self.risk)

    def titles(self) -> DataFrame:
        return views.incident_titles(self.placed, self.alerts)

    def briefs(self, triage: DataFrame | None = None) -> DataFrame:
        return documents.briefs(self.chains, self.items(), self.titles(), triage)

    def reports(self, triage: DataFrame | None = None, url: str = "", size: int = documents.BLOCK) -> DataFrame:
        return documents.reports(self.chains, self.items(), self.members(), self.titles(), triage, url, size)

    def documents(self, triage: DataFrame | None = None, url: str = "", written_at_ms: int = 0, size: int = documents.BLOCK) -> DataFrame:
        return documents.documents(self.chains, self.items(), self.members(), triage, url, written_at_ms, size)

    def counters(self) -> DataFrame:
        return views.counters(self.decisions, self.chains, self.entities)


def correlate(alerts: DataFrame, settings: Settings | None = None) -> Run:
    """Normalized alerts to chains. Suppressed alerts give no identifiers and no leases; of alerts with one uid the first
    by time counts."""
    settings = settings or Settings()
    decisions = materialize(prefilter.decide(first_arrival(alerts, "uid", "time"), settings.prefilter), "decisions")
    kept = decisions.where("not suppressed").drop("suppressed", "rule", "matched")
    bridge, sighted = E.resolve(kept)
    bridge, sighted = materialize(bridge, "bridge"), materialize(sighted, "sighted")
    table = materialize(E.entity_table(bridge, sighted), "entities")
    primary = materialize(E.primary(kept, bridge, sighted, settings.precedence), "primary")
    placed = materialize(C.members(bridge, settings.window_ms), "placed")
    risk = materialize(C.entity_risk(kept, bridge, settings.weights), "risk")
    chains = materialize(C.build(kept, bridge, primary, table, settings, placed), "chains")
    return Run(decisions, kept, bridge, table, primary, placed, risk, chains)


def run_files(spark: SparkSession, path: str, settings: Settings | None = None, received_ms: int | None = None) -> Run:
    return correlate(normalize(files.read_records(spark, path, received_ms), FILE), settings)


def run_hits(pages: DataFrame, settings: Settings | None = None, received_ms: int | None = None) -> Run:
    return correlate(normalize(files.hits(pages, received_ms), INDEX), settings)
