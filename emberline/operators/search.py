"""Technique knowledge base, BM25 and cosine retrieval, and the checks of what a model may cite."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

#: Fixed values of the ranking function.
K1, B, QUERY_CAP, TITLE_WEIGHT = 1.5, 0.75, 3, 3
TOKEN, TECHNIQUE = r"[a-z0-9][a-z0-9._-]*", r"^T\d{4}(\.\d{3})?$"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({TOKEN})"), F.lit(1))


def technique_id(text: Column) -> Column:
    """The id in upper case, or null if it is none."""
    t = F.upper(F.trim(text))
    return F.when(t.rlike(TECHNIQUE), t)


BUNDLE = (
    "objects array<struct<type:string,name:string,description:string,revoked:boolean,x_mitre_deprecated:boolean,x_mitre_platforms:array<string>,"
    "x_mitre_detection:string,x_mitre_is_subtechnique:boolean,x_mitre_version:string,kill_chain_phases:array<struct<kill_chain_name:string,phase_name:string>>,"
    "external_references:array<struct<source_name:string,external_id:string,url:string>>>>"
)


def compile_bundle(bundles: DataFrame) -> DataFrame:
    """``bundles(value string)`` of technique bundles -> ``(uid, name, tactics, description, detection, platforms, url,
    version)``: attack patterns that are neither revoked nor deprecated and have a valid id. Repeated ids count once."""
    o = bundles.select(F.from_json("value", BUNDLE).alias("b")).select(F.explode("b.objects").alias("o")).select("o.*")
    version = o.where("type = 'x-mitre-collection'").agg(F.max("x_mitre_version").alias("version"))
    reference = F.get(F.filter("external_references", lambda r: r["source_name"] == "mitre-attack"), F.lit(0))
    phases = F.transform(F.filter("kill_chain_phases", lambda p: p["kill_chain_name"] == "mitre-attack"), lambda p: F.replace(p["phase_name"], F.lit("-"), F.lit(" ")))
    rows = o.where("type = 'attack-pattern' and not coalesce(revoked, false) and not coalesce(x_mitre_deprecated, false)").select(
        technique_id(reference["external_id"]).alias("uid"), "name", F.coalesce(phases, F.array().cast("array<string>")).alias("tactics"), F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce("x_mitre_detection", F.lit("")).alias("detection"), F.coalesce("x_mitre_platforms", F.array().cast("array<string>")).alias("platforms"), reference["url"].alias("url"), F.coalesce("x_mitre_is_subtechnique", F.lit(False)).alias("is_subtechnique"),
    ).where("uid is not null").dropDuplicates(["uid"])
    return rows.withColumn("version", version.scalar())


def technique_documents(kb: DataFrame) -> DataFrame:
    return kb.select("uid", F.concat_ws(" ", "uid", "name", F.concat_ws(" ", "tactics")).alias("title"), F.concat_ws(" ", "description", "detection", F.concat_ws(" ", "platforms")).alias("body"))


def term_counts(docs: DataFrame) -> DataFrame:
    """``docs(uid, title, body)`` -> ``(uid, t, tf)``; a word of the title counts ``TITLE_WEIGHT`` times."""
    words = docs.select("uid", F.explode(tokens(F.col("title"))).alias("t"), F.lit(TITLE_WEIGHT).alias("w")).unionByName(docs.select("uid", F.explode(tokens(F.col("body"))).alias("t"), F.lit(1).alias("w")))
    return words.groupBy("uid", "t").agg(F.sum("w").alias("tf"))


def asked_words(queries: DataFrame) -> DataFrame:
    """``queries(query, text)`` -> ``(query, t, n)``; a word counts ``QUERY_CAP`` times at most."""
    return queries.select("query", F.explode(tokens(F.col("text"))).alias("t")).groupBy("query", "t").agg(F.least(F.count("*"), F.lit(QUERY_CAP)).alias("n"))


def rarity(docs: Column, df: Column) -> Column:
    return F.log(1 + (docs - df + 0.5) / (df + 0.5))


def bm25(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """``queries(query, text)`` against ``docs(uid, title, body)`` -> ``(query, rank, uid, score)``, the best ``k`` of each
    with a positive score, ties by uid. Title words weigh ``TITLE_WEIGHT``, a query word counts ``QUERY_CAP`` times at most.

    Only words that some query has are weighed; frequent words are counted before they are shuffled.
    """
    tf, asked = term_counts(docs), asked_words(queries)
    lengths = tf.groupBy("uid").agg(F.sum("tf").alias("length"))
    whole = {"docs": docs.agg(F.count("*")).scalar(), "mean": lengths.agg(F.avg("length")).scalar()}
    hit = tf.join(asked.select("t").distinct(), "t", "left_semi")
    df = hit.groupBy("t").agg(F.count("*").alias("df")).withColumns(whole)
    idf = df.select("t", "mean", rarity(F.col("docs"), F.col("df")).alias("idf"))
    norm = F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean"))
    weighed = hit.join(idf, "t").join(lengths, "uid").select("uid", "t", (F.col("idf") * F.col("tf") * (K1 + 1) / norm).alias("s"))
    scored = asked.join(weighed, "t").groupBy("query", "uid").agg(F.sum(F.col("n") * F.col("s")).alias("score")).where("score > 0")
    return top(scored, k)


def top(scored: DataFrame, k: int) -> DataFrame:
    """``(query, rank, uid, score)``: the best ``k`` of each query by score, then uid, scores to four places. Scores equal to
    six places are ties, whatever the order they were summed in."""
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc(F.round("score", 6)), "uid"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= max(k, 0)).select("query", "rank", "uid", F.round("score", 4).alias("score"))


def normalized(vector: Column) -> Column:
    """Scaled to unit length; a zero vector stays."""
    size = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: x.cast("double") / F.when(size == 0, F.lit(1.0)).otherwise(size))


#: Queries and vectors of a tile, and the scores of it that are held at once.
TILE_QUERIES, TILE_VECTORS, HELD = 16_384, 8_192, 1 << 21


def cosine(queries: DataFrame, vectors: DataFrame, k: int, blocks: int | None = None) -> DataFrame:
    """``queries(query, vector)`` against ``vectors(uid, vector)`` -> ``(query, rank, uid, score)``. All pairs are scored, tile
    by tile: each query is copied to every block of vectors, each vector to every block of queries, and a tile is so many
    rows at most, whatever the tables' sizes. A tile gives its best ``k`` of each query. A vector that is null or holds
    nulls scores null, last of all."""
    n, parts = vectors.count(), int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks, tiles = max(blocks or min(parts, n // 256), -(-n // TILE_VECTORS), 1), max(-(-queries.count() // TILE_QUERIES), 1)
    dealt = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    whole = F.when(~F.exists("vector", lambda x: x.isNull()), F.col("vector")).alias("v")
    q = queries.select("query", whole, dealt("query", tiles).alias("tile")).withColumn("block", every(blocks))
    d = vectors.select("uid", whole, dealt("uid", blocks).alias("block")).withColumn("tile", every(tiles))
    kinds = f"query {q.schema['query'].dataType.simpleString()}, uid {d.schema['uid'].dataType.simpleString()}, score double"
    return top(q.groupBy("tile", "block").cogroup(d.groupBy("tile", "block")).applyInArrow(lambda x, y: _tile(x, y, max(k, 0)), kinds), k)


def _by_length(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of the vectors of each length: their places, and themselves as a matrix, ``normalized`` in its order of sums."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy()
    flat, ends = pc.list_flatten(column).to_numpy(), np.cumsum(np.maximum(lengths, 0))
    at = {int(n): np.flatnonzero(lengths == n) for n in np.unique(lengths) if n >= 0}
    out = {}
    with np.errstate(invalid="ignore", over="ignore"):
        for n, i in at.items():
            v = flat[(ends[i] - n)[:, None] + np.arange(n)].astype(float)
            size = np.zeros(len(i))
            for c in range(n):
                size += v[:, c] * v[:, c]
            out[n] = i, v / np.where(size == 0, 1.0, np.sqrt(size))[:, None]
    return out


def _sixth(scores: np.ndarray) -> np.ndarray:
    """Millionths as SQL rounds them: halves of the decimal spelling away from zero."""
    out = np.floor(scores * 1e6 + 0.5)
    for i in np.flatnonzero(np.abs(scores * 1e6 - np.floor(scores * 1e6) - 0.5) < 1e-6):
        out[i] = float(Decimal(repr(float(scores[i]))).scaleb(6).quantize(Decimal(1), ROUND_HALF_UP))
    return out


def _tile(queries: pa.Table, vectors: pa.Table, k: int) -> pa.Table:
    """The best ``k`` vectors of each query of a tile. A matrix product finds those that may be among them; their scores are
    then summed component by component, so that they don't depend on the tile."""
    rows, cols, scores = [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0)]
    n = vectors.num_rows
    if n and k and queries.num_rows:
        left, right = _by_length(queries["v"]), _by_length(vectors["v"])
        ids = np.empty(n, int)
        ids[pc.sort_indices(vectors["uid"], null_placement="at_start").to_numpy()] = np.arange(n)
        step, last = max(HELD // n, 1), max(n - k, 0)
        for start in range(0, queries.num_rows, step):
            whole = np.full((min(step, queries.num_rows - start), n), -np.inf)  # stays where a score is null
            for m in left.keys() & right.keys():
                own = (left[m][0] >= start) & (left[m][0] < start + step)
                with np.errstate(invalid="ignore"):
                    made = left[m][1][own] @ right[m][1].T
                whole[np.ix_(left[m][0][own] - start, right[m][0])] = np.where(np.isnan(made), np.inf, made)
            least = np.partition(whole, last, axis=1)[:, last]
            i, j = np.nonzero(whole >= (least - 2e-6)[:, None])
            exact = np.full(len(i), np.nan)
            for m in left.keys() & right.keys():
                row, col = np.full(len(whole), -1), np.full(n, -1)
                own = np.flatnonzero((left[m][0] >= start) & (left[m][0] < start + step))
                row[left[m][0][own] - start], col[right[m][0]] = own, np.arange(len(right[m][0]))
                of = np.flatnonzero((row[i] >= 0) & (col[j] >= 0))
                x, y, total = left[m][1][row[i[of]]].T, right[m][1][col[j[of]]].T, np.zeros(len(of))
                for c in range(m):
                    total += x[c] * y[c]
                exact[of] = total
            none, odd = whole[i, j] == -np.inf, np.isnan(exact)
            key = _sixth(np.where(odd, 0.0, exact))
            key[odd], key[none] = np.inf, -np.inf
            order = np.lexsort((ids[j], -key, i))
            i, j, exact, none = i[order], j[order], exact[order], none[order]
            keep = np.arange(len(i)) - np.searchsorted(i, i) < k
            rows.append(i[keep] + start), cols.append(j[keep]), scores.append(np.ma.masked_array(exact, none)[keep])
    score = pa.array(np.ma.concatenate(scores).filled(np.nan), mask=np.ma.getmaskarray(np.ma.concatenate(scores)))
    return pa.table({"query": queries["query"].take(np.concatenate(rows)), "uid": vectors["uid"].take(np.concatenate(cols)), "score": score})


def validate(verdicts: DataFrame) -> DataFrame:
    """``verdicts(chain, techniques array, candidates array, cited array, evidence array, confidence)`` with ``accepted``
    (normalized, distinct, among the candidates), ``rejected`` (the others, as given), ``unverified`` (cited fields that are
    no evidence) and ``confidence``, which is 40 at most if anything cited is unverified."""
    listed = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    ids = F.array_compact(F.transform(listed("candidates"), technique_id))
    ok = lambda x: technique_id(x).isNotNull() & F.array_contains(ids, technique_id(x))
    accepted = F.array_distinct(F.transform(F.filter(listed("techniques"), lambda x: F.coalesce(ok(x), F.lit(False))), technique_id))
    rejected = F.filter(listed("techniques"), lambda x: ~F.coalesce(ok(x), F.lit(False)))
    unverified = F.filter(listed("cited"), lambda x: ~F.array_contains(listed("evidence"), x))
    out = verdicts.withColumns({"accepted": accepted, "rejected": rejected, "unverified": unverified})
    return out.withColumn("confidence", F.when(F.size("unverified") > 0, F.least("confidence", F.lit(40))).otherwise(F.col("confidence")))


def save_kb(kb: DataFrame, path: str) -> None:
    """Writes compiled techniques as JSON lines, in place of what was there."""
    kb.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


KB = "uid string, name string, tactics array<string>, description string, detection string, platforms array<string>, url string, is_subtechnique boolean, version string"


def load_kb(spark: SparkSession, path: str) -> DataFrame:
    """Saved techniques; an error where there are none, or where a line is none."""
    rows = spark.read.schema(KB + ", _broken string").option("columnNameOfCorruptRecord", "_broken").json(path)
    if not rows.take(1) or rows.where("uid is null").take(1):
        raise ValueError(f"{path} holds no techniques")
    return rows.drop("_broken")


def read_bundle(spark: SparkSession, path: str) -> DataFrame:
    kb = compile_bundle(spark.read.text(path, wholetext=True))
    if not kb.take(1):
        raise ValueError(f"{path} has no usable technique")
    return kb
