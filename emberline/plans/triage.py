"""Triage as one plan: a chain's evidence and candidate techniques, a verdict from a plugged-in function, and its checks."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from emberline.config import Settings
from emberline.operators import evidence, search
from emberline.operators.temporal import ordered
from emberline.plans.run import Run
from emberline.plans.views import record
from emberline.storage import materialize

#: What a verdict function returns for each chain; ``error`` instead of a verdict if there is none.
ANSWER = "cluster_id string, verdict string, confidence int, techniques array<string>, cited array<string>, text string, error string"
#: Fewest characters that an alert takes in the evidence text, so later alerts of a long chain can't be seen in it.
ALERT_CHARS = 33


def fingerprints(chains: DataFrame, placed: DataFrame, model: str = "") -> DataFrame:
    """``(chain, cluster_id, surfaced, fingerprint)``: the same as long as a chain holds the same alerts and the model stays.
    Alerts are summed up by their hashes, so no chain is gathered in one place."""
    held = placed.groupBy("chain").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("uid")).alias("x"), F.sum(F.xxhash64("uid", F.lit(1)).cast("decimal(20,0)")).alias("s"))
    mark = F.sha2(F.concat_ws("|", "n", "x", "s", "surfaced", F.lit(model)), 256)
    return chains.join(held, "chain").select("chain", "cluster_id", "surfaced", mark.alias("fingerprint"))


def fields(alerts: DataFrame) -> Column:
    """The first fields by name of an alert's record, or of its own columns if the record is no JSON object."""
    own = F.to_json(F.struct(*(c for c in alerts.columns if c not in ("raw", "unmapped"))))
    text = F.when(F.startswith(F.get_json_object(record(alerts), "$"), F.lit("{")), record(alerts)).otherwise(own)
    return F.slice(F.array_sort(evidence.flatten_payload(text)), 1, evidence.FIELDS)


def indicators(rows: DataFrame) -> DataFrame:
    """``(query, text)``: a chain's search text, distinct texts of its alerts in order. Equal ones meet before they are listed."""
    parts = F.concat(F.array("title", "desc", "message"), F.transform("attacks", evidence.tag_label), F.array("process_name", "cmd_line"))
    one = rows.select("cluster_id", "seq", F.posexplode(parts).alias("at", "part")).where("trim(part) <> ''").select("cluster_id", F.trim("part").alias("part"), F.struct("seq", "at").alias("at"))
    first = one.groupBy("cluster_id", F.lower("part").alias("low")).agg(F.min(F.struct("at", "part")).alias("f"))
    return first.groupBy(F.col("cluster_id").alias("query")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("f")), lambda f: f["part"]), "\n").alias("text"))


def cases(scope: DataFrame, placed: DataFrame, alerts: DataFrame, kb: DataFrame, settings: Settings, redacted: bool = True) -> DataFrame:
    """``scope(chain, cluster_id, fingerprint)`` with ``prompt`` (the evidence, names and addresses as tokens), ``tokens``,
    ``truncated``, ``evidence`` (fields that may be cited) and ``candidates`` (technique ids, best first)."""
    numbered = ordered(placed.join(scope.select("chain", "cluster_id"), "chain"), "chain", "time", "uid")
    rows = numbered.select("cluster_id", "uid", "seq").join(alerts.withColumn("pairs", fields(alerts)), "uid")
    rows = materialize(rows.select("cluster_id", "seq", "uid", "title", "desc", "message", "attacks", "process_name", "cmd_line", "pairs"), "evidence")
    visible = rows.where(F.col("seq") <= settings.max_evidence_chars // ALERT_CHARS + 1)
    shown = visible.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("seq", "uid", "title", "pairs"))).alias("alerts"))
    shown = evidence.payload(shown, settings.max_evidence_chars).withColumn("seeds", evidence.seeds(F.flatten(F.transform("alerts", lambda a: a["pairs"]))))
    shown = materialize(shown.select("cluster_id", "xml", "truncated", "seeds"), "prompts")
    text = evidence.redact(shown, "xml", "seeds") if redacted else shown.withColumns({"redacted": F.col("xml"), "tokens": F.lit(None).cast("map<string,string>")})
    keys = rows.select("cluster_id", F.explode(F.transform("pairs", lambda p: p["key"])).alias("k")).groupBy("cluster_id").agg(F.array_sort(F.collect_set("k")).alias("evidence"))
    found = search.bm25(indicators(rows), search.technique_documents(kb), settings.top_k)
    found = found.groupBy(F.col("query").alias("cluster_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "uid"))), lambda x: x["uid"]).alias("candidates"))
    out = scope.select("cluster_id", "fingerprint").join(text.select("cluster_id", F.col("redacted").alias("prompt"), "tokens", "truncated"), "cluster_id")
    none = F.array().cast("array<string>")
    return out.join(keys, "cluster_id", "left").join(found, "cluster_id", "left").withColumns({"evidence": F.coalesce("evidence", none), "candidates": F.coalesce("candidates", none)})


def _answered(verdict_fn: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A failing function is asked again chain by chain, and leaves those that fail without a verdict, with the first line
    of what went wrong."""
    names = [c.split()[0] for c in ANSWER.split(", ")]

    def asked(frame: pd.DataFrame) -> pd.DataFrame:
        try:
            return verdict_fn(frame)
        except Exception as e:
            if len(frame) > 1:
                return pd.concat([asked(frame.iloc[[k]]) for k in range(len(frame))])
            return frame[["cluster_id"]].assign(error=(str(e) or type(e).__name__).split("\n")[0][:500])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out = asked(frame)
        out = out.reindex(columns=names).astype(object)
        return out.where(out.notna(), None)

    return run


def triage(run: Run, kb: DataFrame, verdict_fn: Callable[[pd.DataFrame], pd.DataFrame], settings: Settings, previous: DataFrame | None = None, everything: bool = False, model: str = "", redacted: bool = True) -> DataFrame:
    """``(cluster_id, fingerprint, triage_status, verdict, confidence, text, accepted, rejected, unverified, cited, named, evidence,
    candidates, triage_error)``, a row for each chain.

    ``verdict_fn`` gets frames of ``cluster_id, prompt, candidates, evidence`` and returns ``ANSWER``; it may be asked again
    about a chain whose task is run again, so answers that cost much should be kept by the prompt. Surfaced chains are
    asked about (``everything``: all); others are ``pending``. Rows of ``previous`` (an earlier result) with an equal
    fingerprint that were triaged are taken over and not asked again; failed ones are ``ai_unavailable`` and asked again.
    ``named`` are the accepted techniques with their names.
    """
    marked = materialize(fingerprints(run.chains, run.placed, model), "fingerprints")
    scope = marked if everything else marked.where("surfaced")
    kept = None
    if previous is not None:
        kept = previous.where("triage_status = 'triaged'").join(marked.select("cluster_id", "fingerprint"), ["cluster_id", "fingerprint"], "left_semi")
        scope = scope.join(kept.select("cluster_id"), "cluster_id", "left_anti")
    asked = materialize(cases(scope, run.placed, run.alerts, kb, settings, redacted), "cases")
    answers = materialize(evidence.triage(asked.select("cluster_id", "prompt", "candidates", "evidence"), _answered(verdict_fn), ANSWER), "answers")
    tokens = F.coalesce("tokens", F.create_map().cast("map<string,string>"))
    back = asked.join(answers, "cluster_id", "left").withColumns({"text": evidence.restore(F.col("text"), tokens), "cited": F.transform("cited", lambda c: evidence.restore(c, tokens))})
    checked = search.validate(back)
    names = checked.select("cluster_id", F.posexplode("accepted").alias("i", "uid")).join(kb.select("uid", "name"), "uid", "left")
    names = names.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.concat_ws(" ", "uid", "name").alias("n")))), lambda x: x["n"]).alias("named"))
    failed = F.col("error").isNotNull() | F.col("verdict").isNull()
    result = checked.join(names, "cluster_id", "left").select(
        "cluster_id", "fingerprint", F.when(failed, "ai_unavailable").otherwise("triaged").alias("triage_status"), "verdict", "confidence", "text", "accepted", "rejected", "unverified",
        F.array_except("cited", "unverified").alias("cited"), F.coalesce("named", F.array().cast("array<string>")).alias("named"), "evidence", "candidates", F.when(failed, F.coalesce("error", F.lit("no verdict"))).alias("triage_error"),
    )
    if kept is not None:
        result = result.unionByName(kept.select(result.columns))
    rest = marked.join(result.select("cluster_id"), "cluster_id", "left_anti").select("cluster_id", "fingerprint", F.lit("pending").alias("triage_status"))
    return result.unionByName(rest, allowMissingColumns=True)
