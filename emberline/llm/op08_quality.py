"""Operator 8: quality classifier with hierarchical empirical Bayes.

1. A logistic regression on a text's own measures, fitted to a bounded sample of labelled rows, gives each document's
   evidence: its probability of being good, and the odds without the base rate.
2. Documents are grouped by the host that published them and by host and path prefix, both from their page's address.
   The expected good documents of a host, shrunk towards the corpus mean by a beta prior whose strength is estimated from the spread between hosts, give
   the host's posterior; the path's is shrunk towards its host's in the same way. Sparse groups stay near their parent.
3. A document's final odds are its own evidence times the odds of its path, from which it is left out.

All of it is DataFrame expressions but for the fit of a dozen weights. Groups are pre-aggregated before the shuffle, so a
host with a third of all documents is a row for each task. Addresses are joined to measured rows, not to texts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from emberline.llm import common, linear
from emberline.llm.op01_divergence import COMMON, SYMBOLS, WIDEST
from emberline.llm.op05_mix import SPLIT
from emberline.storage import materialize

#: Labelled rows that the classifier is fitted on, drawn by a hash of the id.
SAMPLE = 20_000
#: Final probability from which a document is kept; bounds of a prior's strength in documents.
KEEP, LEAST_STRENGTH, MOST_STRENGTH = 0.35, 2.0, 10_000.0
RIDGE = 1e-4
#: Labels whose crc32 of the id, modulo this, is 0 are never fitted on, so that the score can be tested on them.
FOLDS = 5
#: Host and path of an address, the path's first part where another follows, and the number that a path ends with.
ADDRESS = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)[^/?#]*([^?#]*)"
PREFIX, NUMBER = r"^(/[^/]+)/[^/]", r"/(\d+)(?:\.\w+)?/?$"
#: Parts that rows without an id are dealt to.
PARTS = 1024
MEASURES = ("log_words", "symbols", "upper", "digits", "punct", "distinct_words", "word_length", "common", "dup_lines", "no_stop")


def measures(text: Column) -> list[Column]:
    """A dozen numbers between about 0 and 1 for each text; names in ``MEASURES``."""
    t = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(t, SPLIT), "")
    n = F.greatest(F.size(words), F.lit(1))
    chars = F.greatest(F.length(F.array_join(words, "")), F.lit(1))
    share = lambda keep: F.length(F.regexp_replace(t, f"[^{keep}]+", "")) / chars
    lines = F.split(t, "\n")
    frequent = F.array(*(F.lit(w) for w in COMMON))
    return [
        F.log1p(F.size(words)) / 10,
        share(SYMBOLS),
        share(r"\p{Lu}"),
        share("0-9"),
        share(r".,;:!?'\"()\-"),
        F.size(F.array_distinct(words)) / n,
        F.least(chars / n, F.lit(20)) / 20,
        F.size(F.filter(words, lambda w: (F.length(w) <= WIDEST) & F.array_contains(frequent, w))) / n,
        1 - F.size(F.array_distinct(lines)) / F.size(lines),
        F.when(t.rlike(r"[.!?]\s"), 0.0).otherwise(1.0),
    ]


def _design(x: np.ndarray) -> np.ndarray:
    """The measures and bumps of each: quality falls off on both sides of the usual value."""
    return np.concatenate([x, x * x, np.sqrt(np.abs(x))], 1)


def fit(rows: list[tuple[list[float], int]]) -> tuple[np.ndarray, float, float]:
    """Weights of the measures, their squares and roots; bias; base rate."""
    k = 3 * len(MEASURES)
    if not rows:
        return np.zeros(k), 0.0, 0.5
    x, y = _design(np.array([r[0] for r in rows], float)), np.array([r[1] for r in rows], float)
    mean, spread = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = (x - mean) / spread
    w, bias = linear.fit(lambda w: z @ w, lambda r: z.T @ r, y, k, RIDGE, 500)
    return w / spread, bias - float((w * mean / spread).sum()), float((y.sum() + 0.5) / (len(y) + 1))


def _odds(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
    return F.log(q / (1 - q))


def _strength(groups: DataFrame, mean: Column) -> float:
    """How many documents the prior weighs, by the method of moments: the spread between the groups' means around their
    parents' that sampling alone doesn't explain."""
    n, good = F.col("n"), F.col("good")
    within = mean * (1 - mean)
    s = groups.where("n > 1").agg(F.sum(n * F.pow(good / n - mean, 2)).alias("seen"), F.sum(within).alias("chance"), F.sum(n * within).alias("whole"), F.sum(within / n).alias("one")).first()
    if not s or not s.whole:
        return MOST_STRENGTH
    between = max(s.seen - s.chance, 0.0) / s.whole  # correlation of two documents of a group
    return float(min(MOST_STRENGTH, max(LEAST_STRENGTH, 1 / between - 1 if between > 0 else MOST_STRENGTH)))


def places(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """``(number, host, path)``: for each number that an address's path ends with, the host (lower case) and path prefix
    of that document, of several addresses the least one. Addresses without a host or number are left out, null ones too."""
    url = F.col(url_col)
    path = F.regexp_extract(url, ADDRESS, 2)
    parts = pages.select(url.alias("url"), F.regexp_extract(path, NUMBER, 1).try_cast("long").alias("number"), F.struct(F.lower(F.regexp_extract(url, ADDRESS, 1)).alias("host"), F.regexp_extract(path, PREFIX, 1).alias("path")).alias("at"))
    least = parts.where("number is not null and at.host <> ''").groupBy("number").agg(F.min_by("at", "url").alias("at"))
    return least.select("number", "at.host", "at.path")


def _placed(rows: DataFrame, pages: DataFrame, url_col: str) -> DataFrame:
    """Rows with a page get its host and path. Rows without an id are spread, as they have no partner."""
    spread = F.when(F.col("_id").isNull(), F.pmod(F.xxhash64("x"), F.lit(PARTS))).otherwise(F.lit(0))
    known = places(pages, url_col).select(F.col("number").alias("_id"), F.lit(0).cast("long").alias("_part"), F.col("host").alias("_host"), F.col("path").alias("_path"))
    both = rows.withColumn("_part", spread).join(known, ["_id", "_part"], "left")
    found = F.col("_host").isNotNull()
    return both.select("_id", F.coalesce("_host", "host").alias("host"), F.when(found, F.col("_path")).otherwise(F.col("path")).alias("path"), "x")


def score(docs: DataFrame, labels: DataFrame, pages: DataFrame | None = None, host_col: str = "source", path_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", url_col: str = "url") -> DataFrame:
    """``(id_col, held_out, doc_score, host_score, path_score, score, kept)``, a row for each input row.

    With ``pages``, a document whose (integer) id is the number that a page's path ends with belongs to the page's host
    and path prefix. ``host_col`` and ``path_col`` stand in for the others, and for all without ``pages``; nulls of them
    are groups of their own. Null or empty text has the measures of an empty one. Of several labels of an id the highest
    counts, of several texts of a labelled id the one with the least measures; null labels aren't used, nor those of the
    ``held_out`` fold; without labels all documents score alike. Repeated rows count each. Other columns aren't read; an
    empty table gives an empty result.
    """
    held = F.coalesce(common.crc_mod("_id", FOLDS) == 0, F.lit(False))
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg((F.max(label_col) > 0).cast("int").alias("_y")).where(~held)
    sample = F.broadcast(known.orderBy(F.xxhash64("_id", F.lit(8)), "_id").limit(SAMPLE))  # at most SAMPLE rows of two numbers
    rows = docs.select(F.col(id_col).alias("_id"), F.col(host_col).alias("host"), F.col(path_col).alias("path"), F.array(*(m.cast("double") for m in measures(F.col(text_col)))).alias("x"))
    rows = materialize(rows if pages is None else _placed(rows, pages, url_col), "measures")
    fitted = rows.join(sample, "_id").groupBy("_id").agg(F.min("x").alias("x"), F.min("_y").alias("_y")).collect()
    weights, bias, base = fit([(r.x, r._y) for r in sorted(fitted, key=lambda r: r._id)])
    k = len(MEASURES)
    terms = [F.get("x", F.lit(j)) * float(weights[j]) + F.pow(F.get("x", F.lit(j)), F.lit(2.0)) * float(weights[k + j]) + F.sqrt(F.abs(F.get("x", F.lit(j)))) * float(weights[2 * k + j]) for j in range(k)]
    z = sum(terms, F.lit(bias))
    own = materialize(rows.select("_id", "host", "path", (1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0))))).alias("p")), "evidence")

    paths = materialize(own.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("good")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    total = hosts.agg(F.sum("n"), F.sum("good")).first()
    mean = total[1] / total[0] if total and total[0] else base
    by_host = _strength(hosts, F.lit(mean))
    hosts = hosts.select(F.col("host").alias("h"), ((F.col("good") + by_host * mean) / (F.col("n") + by_host)).alias("host_score"))
    groups = materialize(paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).drop("h"), "groups")
    by_path = _strength(groups, F.col("host_score"))
    groups = groups.select(F.col("host").alias("h"), F.col("path").alias("s"), "n", "good", "host_score")
    joined = own.join(groups, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("s")))
    others = (F.col("good") - F.col("p") + by_path * F.col("host_score")) / (F.col("n") - 1 + by_path)
    final = _odds(F.col("p")) - float(np.log(base / (1 - base))) + _odds(others)
    out = joined.select("_id", F.col("p").alias("doc_score"), "host_score", others.alias("path_score"), (1 / (1 + F.exp(-final))).alias("score"))
    rounded = [F.round(c, 6).alias(c) for c in ("doc_score", "host_score", "path_score", "score")]
    return out.select(F.col("_id").alias(id_col), held.alias("held_out"), *rounded, (F.col("score") >= KEEP).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts and paths are those of the documents' pages; documents without a page have their source and language."""
    return score(*(common.table(spark, sf_dir, name) for name in ("documents", "labels", "pages")))
