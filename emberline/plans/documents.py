"""What is shown and written of chains, in rows of bounded size: a row for each alert, brief rows, and documents and reports
in blocks. A chain with a third of all alerts is many blocks; its manifest says how many."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from emberline.functions.values import iso_ms
from emberline.operators.chains import tactic_names
from emberline.operators.evidence import escape, first_by_suffix, flatten_view
from emberline.operators.temporal import ordered
from emberline.plans.views import ARTIFACTS, markdown, record, severity_label

#: Alerts or entities of a block.
BLOCK = 64
#: Characters of a technique's description that a prompt shows.
DESCRIPTION_CHARS = 600
DISCLAIMER = "Written by a model; a person must review it."

_HEAD = ("cluster_id", "primary_name", "alert_count", "first_time", "last_time", "max_severity", "disposition", "risk", "surfaced")
_TRIAGE = ("triage_status", "verdict", "confidence", "text", "accepted", "rejected", "unverified", "named", "cited", "triage_error")


def alert_items(placed: DataFrame, alerts: DataFrame, bridge: DataFrame, entities: DataFrame) -> DataFrame:
    """A row for each alert of a chain, ``(chain, seq, uid, time, severity_id, item, evidence)``. ``item`` is what a document
    tells of it: the description is its own or the message, the rule the analytic's name or the title; the host, user and
    address are its own or else the name of the first touched entity of that domain. ``evidence`` is its record."""
    touched = bridge.join(entities.select("entity_uid", "name"), "entity_uid", "left")
    first = lambda domain: F.min_by("name", F.when(F.col("domain") == domain, F.struct("pos", "name"))).alias(f"_{domain}")
    touched = touched.groupBy("uid").agg(F.array_sort(F.collect_set("name")).alias("_entities"), *map(first, ("host", "user", "ip")))  # five entities at most
    facts = alerts.withColumn("_record", record(alerts)).join(touched, "uid", "left")
    c = lambda name: F.col(name) if name in facts.columns else F.lit(None).cast("string")
    text = lambda *names: F.coalesce(*(F.nullif(c(n), F.lit("")) for n in names), F.lit(""))
    technique = F.filter(F.transform("attacks", lambda a: F.struct(a["technique"]["uid"].alias("uid"), a["technique"]["name"].alias("name"))), lambda t: t["uid"].isNotNull() | t["name"].isNotNull())
    item = F.struct(
        "uid", "time", iso_ms(F.col("time")).alias("time_dt"), text("title").alias("title"), text("desc", "message").alias("description"), text("analytic_name", "title").alias("rule"),
        severity_label(F.col("severity_id")).alias("severity"), text("hostname", "_host").alias("host"), text("username", "_user").alias("user"), text("process_name").alias("process"), text("cmd_line").alias("command"),
        text("src_ip", "_ip").alias("source_ip"), text("dst_ip").alias("destination_ip"), F.coalesce("_entities", F.array().cast("array<string>")).alias("entities"), tactic_names(F.col("attacks")).alias("tactics"), technique.alias("techniques"),
    )
    rows = ordered(placed.select("chain", "uid", "time"), "chain", "time", "uid").drop("time")
    return rows.join(facts.select("uid", "time", "severity_id", item.alias("item"), F.col("_record").alias("evidence")), "uid").select("chain", "seq", "uid", "time", "severity_id", "item", "evidence")


def event_text(item: Column) -> Column:
    """What a search looks through, lower-cased."""
    parts = [item[c] for c in ("uid", "title", "description", "rule", "host", "user", "process", "command", "source_ip", "destination_ip")]
    techniques = F.transform(item["techniques"], lambda t: F.concat_ws(" ", t["uid"], t["name"]))
    return F.lower(F.concat_ws(" ", *parts, item["entities"], item["tactics"], techniques))


def event_list(items: DataFrame, text: str = "", node: str = "") -> DataFrame:
    """The alerts that hold both texts, anywhere in what is told of them or in their record, with the parent process."""
    hay = F.concat_ws(" ", event_text(F.col("item")), F.lower(F.coalesce("evidence", F.lit("{}"))))
    rows = items.where(hay.contains(text.strip().lower()) & hay.contains(node.lower()))
    return rows.withColumn("parent", first_by_suffix(flatten_view(F.col("evidence")), list(ARTIFACTS["parent_process"])))


def _triaged(chains: DataFrame, triage: DataFrame | None) -> DataFrame:
    """``chains`` with what triage found; without it every chain is pending."""
    kinds = {"confidence": "int"} | dict.fromkeys(("accepted", "rejected", "unverified", "named", "cited"), "array<string>")
    have = triage.columns if triage is not None else []
    rows = chains.select("chain", *_HEAD)
    if triage is not None:
        rows = rows.join(triage.select("cluster_id", *(x for x in _TRIAGE if x in have)), "cluster_id", "left")
    rows = rows.withColumns({x: F.lit(None).cast(kinds.get(x, "string")) for x in _TRIAGE if x not in have})
    return rows.withColumn("triage_status", F.coalesce("triage_status", F.lit("pending")))


def briefs(chains: DataFrame, items: DataFrame, titles: DataFrame, triage: DataFrame | None = None) -> DataFrame:
    """A row for each chain: what a list shows. Tactics, and techniques (those accepted in triage, else those of the alerts),
    are distinct and bounded by their catalogues; texts to search in stay with the alerts (``found_in``)."""
    seen = items.groupBy("chain").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("item.tactics")))).alias("tactics"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.transform("item.techniques", lambda t: t["uid"]))))).alias("_techniques"))
    rows = _triaged(chains, triage).join(titles, "chain").join(seen, "chain", "left")
    none = F.array().cast("array<string>")
    return rows.select(
        "chain", "cluster_id", "incident_title", F.col("primary_name").alias("primary_entity"), severity_label(F.col("max_severity")).alias("severity"), "max_severity", "alert_count", "first_time", "last_time",
        "risk", "surfaced", "disposition", F.coalesce("tactics", none).alias("tactics"), F.coalesce("accepted", F.array_compact("_techniques"), none).alias("techniques"), "triage_status", "verdict", "confidence",
    )


def found_in(brief: DataFrame, items: DataFrame, text: str) -> DataFrame:
    """The briefs that hold a text: in the row itself, or in one of the chain's alerts."""
    needle = text.strip().lower()
    own = F.lower(F.concat_ws(" ", "cluster_id", "primary_entity", "incident_title", "tactics", "techniques")).contains(needle)
    inside = items.where(event_text(F.col("item")).contains(needle)).select("chain").distinct().withColumn("_in", F.lit(True))
    return brief.join(inside, "chain", "left").where(own | F.coalesce("_in", F.lit(False))).drop("_in")


def chain_list(
    brief: DataFrame, items: DataFrame | None = None, mode: str = "all", surfaced_only: bool = False, min_severity: int = 0, verdict: str = "", since_ms: int | None = None,
    text: str = "", entity: str = "", limit: int = 200,
) -> DataFrame:
    """Newest chains first, after the filters; a negative limit is none. ``mode``: all, ``active`` (surfaced) or ``triaged``;
    ``verdict``: that verdict, or ``pending`` for chains without one. ``text`` and ``entity`` look into ``items``."""
    rows = brief.where(F.col("max_severity") >= min_severity)
    rows = rows.where("surfaced") if surfaced_only or mode == "active" else rows.where("triage_status = 'triaged'") if mode == "triaged" else rows
    rows = rows.where(F.col("verdict").isNull() if verdict == "pending" else F.col("verdict") == verdict) if verdict else rows
    rows = rows.where(F.col("last_time") >= since_ms) if since_ms is not None else rows
    rows = found_in(rows, items, text) if text.strip() else rows
    rows = rows.join(items.where(F.array_contains("item.entities", entity)).select("chain").distinct(), "chain", "left_semi") if entity else rows
    return rows.orderBy(F.desc("last_time"), F.desc("cluster_id")).limit(max(0, limit))


def nav_counts(brief: DataFrame) -> DataFrame:
    """One row: chains in all, surfaced and triaged."""
    return brief.agg(F.count("*").alias("total"), F.count_if("surfaced").alias("surfaced"), F.count_if(F.col("triage_status") == "triaged").alias("triaged"))


def blocks(items: DataFrame, key: str, seq: str, value: Column, size: int = BLOCK) -> DataFrame:
    """``(key, block, values)``: the values in order, ``size`` in a row; blocks are counted from 0."""
    rows = items.select(key, F.floor((F.col(seq) - 1) / size).alias("block"), F.col(seq).alias("_s"), value.alias("_v"))
    return rows.groupBy(key, "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("_s", "_v"))), lambda x: x["_v"]).alias("values"))


def chain_entities(placed: DataFrame, bridge: DataFrame, entities: DataFrame, risk: DataFrame) -> DataFrame:
    """``(chain, seq, entity)``: the known entities of a chain, by their id."""
    who = bridge.join(placed.select("uid", "chain"), "uid").select("chain", "entity_uid").distinct().join(entities, "entity_uid").join(risk, "entity_uid", "left")
    one = F.struct("name", "domain", F.coalesce("risk", F.lit(0.0)).alias("risk_score"), "identifiers")
    return ordered(who.withColumn("_at", F.lit(0)), "chain", "_at", "entity_uid").select("chain", "seq", one.alias("entity"))


def documents(chains: DataFrame, items: DataFrame, who: DataFrame, triage: DataFrame | None = None, url: str = "", written_at_ms: int = 0, size: int = BLOCK) -> DataFrame:
    """``(cluster_id, part, block, document)``, keyed by the first three: for each chain a manifest (part ``chain``) with its
    facts, triage and the number of blocks, then the alerts and entities in blocks. Null fields are left out."""
    link = F.concat(F.lit(url.rstrip("/") + "/incident/"), "cluster_id") if url else F.lit(None).cast("string")
    per = lambda rows, name: rows.groupBy("chain").agg(F.ceil(F.count("*") / size).alias(name))
    rows = _triaged(chains, triage).join(per(items, "alert_blocks"), "chain", "left").join(per(who, "entity_blocks"), "chain", "left")
    chain = F.struct("alert_count", F.col("primary_name").alias("primary_entity"), iso_ms(F.col("first_time")).alias("first_time"), iso_ms(F.col("last_time")).alias("last_time"), "disposition", F.col("risk").alias("risk_score"), "surfaced")
    found = F.when(F.col("verdict").isNotNull(), F.struct("verdict", F.col("confidence").alias("confidence_score"), F.col("accepted").alias("mitre_attack_techniques"), F.col("rejected").alias("rejected_techniques"), "cited", "unverified", F.col("text").alias("analysis")))
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    manifest = F.struct(
        iso_ms(F.col("last_time")).alias("@timestamp"), "cluster_id", link.alias("dashboard_url"), F.lit("emberline").alias("source"), F.lit(written_at_ms).cast("long").alias("written_at"), chain.alias("chain"),
        none("alert_blocks"), none("entity_blocks"), "triage_status", found.alias("triage"), "triage_error",
    )
    ids = chains.select("chain", "cluster_id")
    part = lambda name, made: made.join(ids, "chain").select("cluster_id", F.lit(name).alias("part"), "block", F.to_json(F.struct("cluster_id", F.col("values").alias(name))).alias("document"))
    head = rows.select("cluster_id", F.lit("chain").alias("part"), F.lit(0).cast("long").alias("block"), F.to_json(manifest).alias("document"))
    return head.unionByName(part("alerts", blocks(items, "chain", "seq", F.col("item"), size))).unionByName(part("entities", blocks(who, "chain", "seq", F.col("entity"), size)))


def _span(first: Column, last: Column) -> Column:
    seconds = F.floor((last - first) / 1000)
    return F.when(seconds < 60, F.concat(seconds, F.lit("s"))).when(seconds < 3600, F.concat(F.round(seconds / 60).cast("long"), F.lit("m"))).otherwise(F.concat(F.round(seconds / 3600, 1), F.lit("h")))


def reports(chains: DataFrame, items: DataFrame, who: DataFrame, titles: DataFrame, triage: DataFrame | None = None, url: str = "", size: int = BLOCK) -> DataFrame:
    """``(cluster_id, block, report)``: a chain's report as Markdown in blocks; joined by line breaks in order they are the
    whole. The head tells the verdict, or that there is none, and the facts; then come the timeline, the entities and, of
    triaged chains, the techniques, the analysis marked as a model's, and the cited fields."""
    rows = _triaged(chains, triage).join(titles, "chain")
    bold = lambda name, value: F.concat(F.lit(f"**{name}:** "), value)
    verdict = F.when(F.col("verdict").isNotNull(), F.concat("verdict", F.lit(", confidence "), F.col("confidence"), F.lit("/100")))
    verdict = verdict.when(F.col("triage_status") == "ai_unavailable", F.concat(F.lit("none: "), markdown(F.col("triage_error")))).otherwise("pending")
    head = F.concat_ws(
        "\n", F.concat(F.lit("# "), markdown(F.col("incident_title"))), F.concat(F.lit("Chain "), "cluster_id"), bold("Verdict", verdict), bold("Disposition", F.col("disposition")),
        bold("Risk", F.concat(F.format_number("risk", 1), F.when(F.col("surfaced"), " (surfaced)").otherwise(" (below the threshold)"))),
        bold("Time", F.concat(iso_ms(F.col("first_time")), F.lit(" to "), iso_ms(F.col("last_time")), F.lit(", "), _span(F.col("first_time"), F.col("last_time")))), bold("Main entity", markdown(F.col("primary_name"))),
        F.concat(F.lit(f"[Open]({url.rstrip('/')}/incident/"), "cluster_id", F.lit(")")) if url else F.lit(None).cast("string"), F.lit("## Timeline"),
    )
    i = F.col("item")
    line = F.concat(F.lit("- "), i["time_dt"], F.lit(" **"), markdown(i["title"]), F.lit("** "), i["severity"], F.lit(": "), markdown(F.concat_ws(", ", i["entities"])), F.when(F.size(i["tactics"]) > 0, F.concat(F.lit(" ("), markdown(F.concat_ws(", ", i["tactics"])), F.lit(")"))).otherwise(""))
    e = F.col("entity")
    entity = F.concat(F.when(F.col("seq") == 1, "## Entities\n").otherwise(""), F.lit("- "), markdown(e["name"]), F.lit(" ("), F.coalesce(e["domain"], F.lit("unknown")), F.lit("), risk "), F.format_number(e["risk_score"], 1))
    bullets = lambda c, none: F.when(F.size(c) > 0, F.concat(F.lit("- "), F.array_join(F.transform(c, markdown), "\n- "))).otherwise(f"- {none}")
    beside = lambda text, c: F.when(F.size(c) > 0, F.concat(F.lit(f"> {text}: "), markdown(F.array_join(c, ", "))))
    tail = F.concat_ws(
        "\n", F.lit("## Techniques"), bullets("named", "none among the candidates"), beside("Not among the candidates", "rejected"), F.lit(f"## Analysis ({DISCLAIMER})"), F.coalesce("text", F.lit("")),
        F.lit("## Cited evidence"), bullets("cited", "none that the records hold"), beside("Cited, but not in the records", "unverified"),
    )
    ids = chains.select("chain", "cluster_id")
    part = lambda n, made: made.join(ids, "chain").select("cluster_id", F.lit(n).alias("_part"), "block", F.array_join("values", "\n").alias("report"))
    whole = lambda n, made, text: made.select("cluster_id", F.lit(n).alias("_part"), F.lit(0).cast("long").alias("block"), text.alias("report"))
    every = whole(0, rows, head).unionByName(part(1, blocks(items, "chain", "seq", line, size))).unionByName(part(2, blocks(who, "chain", "seq", entity, size)))
    every = every.unionByName(whole(3, rows.where("verdict is not null"), tail))
    return ordered(every.withColumn("_at", F.col("_part").cast("long")), "cluster_id", "_at", "block", bucket_ms=1).select("cluster_id", (F.col("seq") - 1).alias("block"), "report")


def candidate_text(cases: DataFrame, kb: DataFrame) -> DataFrame:
    """``cases(cluster_id, candidates)`` with ``candidate_xml``: the candidates' definitions in their order, descriptions in
    one line of ``DESCRIPTION_CHARS`` characters at most."""
    asked = cases.select("cluster_id", F.posexplode("candidates").alias("at", "uid")).join(kb.select("uid", "name", "tactics", "description"), "uid")
    short = F.translate(F.trim(F.coalesce("description", F.lit(""))), "\n", " ")
    short = F.when(F.length(short) > DESCRIPTION_CHARS, F.concat(F.substring(short, 1, DESCRIPTION_CHARS), F.lit("…"))).otherwise(short)
    text = F.concat(F.lit('<technique id="'), escape(F.col("uid")), F.lit('" name="'), escape(F.coalesce("name", F.lit(""))), F.lit('" tactics="'), escape(F.array_join(F.coalesce("tactics", F.array().cast("array<string>")), ", ")), F.lit('">'), escape(short), F.lit("</technique>"))
    made = asked.select("cluster_id", "at", text.alias("t")).groupBy("cluster_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "t"))), lambda x: x["t"]), "\n").alias("t"))
    body = F.coalesce("t", F.lit("<!-- none were found: name no technique -->"))
    return cases.join(made, "cluster_id", "left").withColumn("candidate_xml", F.concat(F.lit("<candidates>\n"), body, F.lit("\n</candidates>"))).drop("t")


def messages(cases: DataFrame, system: str, task: str) -> DataFrame:
    """``cases(cluster_id, prompt, candidate_xml)`` with ``messages``: what a chat model is asked, by role and content."""
    one = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return cases.withColumn("messages", F.array(one("system", F.lit(system)), one("user", F.concat_ws("\n\n", "prompt", "candidate_xml", F.lit(task)))))
