"""Operator 12: nearest neighbours by inner product through cross-polytope hashing.

The direction of a vector is turned by pseudo-random rotations (sign flips and fast Hadamard transforms); its hash is the
signed axis it lies nearest to. A table's bucket is the axis of a whole rotation and, where there are many vectors, that
of the first few coordinates of a second one, so buckets keep their size as the table grows. Vectors of unlike norms lie
in bands of half an octave, with buckets of their own. A query looks into the buckets of all tables and bands that
promise most (multiprobe): the norm of the band times the query's coordinate on the bucket's axes.

How many buckets that must be depends on the data, so it is measured: for a bounded sample of vectors the exact
neighbours are found by one scan of all rows, with the place of their best bucket in the sample vector's order; the
number of probes is the quantile of those places that gives the wanted recall. A query that finds too few neighbours
looks into every bucket of one table, which is all there is.

Equal vectors collapse into a class with as many ids as an answer can hold. A bucket's members are dealt into tiles and
stay there, and the queries go to every tile, so a bucket that holds a third of all vectors is many tasks. A task returns
at most k + 1 neighbours of a query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from emberline.llm import common
from emberline.llm.op09_crosspolytope import _hadamard, _raw, _unit
from emberline.storage import discard, materialize

#: Tables, vectors of a bucket that the second rotation aims at, and buckets of a table at most.
TABLES, BUCKET, WIDEST = 4, 256, 1 << 15
#: Wanted recall, and vectors on which it is measured.
RECALL, SAMPLE = 0.96, 256
#: Members and queries of a tile.
TILE, QUERIES = 512, 8192
#: Found neighbours that a task holds before it reduces them to the best of each query.
HELD = 1 << 19


def second_axes(dim: int, n: int) -> int:
    """Coordinates of the second rotation (0: none) for buckets of about ``BUCKET`` of ``n`` vectors."""
    want, most = n / BUCKET / (2 * dim), min(dim, WIDEST // (4 * dim))
    return 0 if want < 2 or most < 1 else min(1 << int(math.log2(want / 2)), 1 << int(math.log2(most)))


def _turned(units: np.ndarray, n: int, table: int) -> list[np.ndarray]:
    """The coordinates on whose axes a table's buckets are chosen."""
    dim = 1 << max(0, (units.shape[1] - 1).bit_length())
    padded = np.zeros((len(units), dim))
    padded[:, : units.shape[1]] = units
    out = []
    for r, width in enumerate((dim, second_axes(dim, n))):
        if width:
            rng, y = np.random.default_rng((29, dim, table, r)), padded
            for _ in range(3):
                y = _hadamard(y * rng.choice((-1.0, 1.0), dim))
            out.append(y[:, :width])
    return out


def codes(units: np.ndarray, n: int) -> np.ndarray:
    """A bucket of each table, numbered through all tables, for rows of unit length; ``n``: rows of the index."""
    out = []
    for t in range(TABLES):
        code, buckets = np.zeros(len(units), np.int64), 1
        for y in _turned(units, n, t):
            axis = np.abs(y).argmax(1)
            code = code * (2 * y.shape[1]) + 2 * axis + (y[np.arange(len(y)), axis] < 0)
            buckets *= 2 * y.shape[1]
        out.append(code + t * buckets)
    return np.stack(out, 1)


def promise(units: np.ndarray, n: int, tables: int = TABLES) -> np.ndarray:
    """What each bucket of all tables promises to rows of unit length: their coordinates on its axes. A choice among
    fewer axes says less about a vector's direction, and weighs less."""
    out = []
    for t in range(tables):
        score, first = np.zeros((len(units), 1)), None
        for y in _turned(units, n, t):
            first = first or math.log(2 * y.shape[1])
            weight = math.sqrt(math.log(2 * y.shape[1]) / first)
            score = (score[:, :, None] + weight * np.stack((y, -y), 2).reshape(len(y), 1, -1)).reshape(len(y), -1)
        out.append(score)
    return np.concatenate(out, 1)


def _by_size(raw: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    sizes = np.array([len(x) for x in raw])
    for size in np.unique(sizes).tolist():
        yield size, np.flatnonzero(sizes == size)


def _matrix(raw: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(raw), kind).astype(np.float64).reshape(len(raw), -1)


def _bands(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """Adds the vectors' length in bytes and their norm in half octaves, and drops those that take no part."""
    for batch in _raw(batches, kind):
        batch = batch.filter(batch.column(1).is_valid())
        band = np.zeros(batch.num_rows, np.int32)
        raw = batch.column(1).to_pylist()
        for _, at in _by_size(raw):
            x = _matrix([raw[k] for k in at.tolist()], kind)
            top = np.abs(x).max(1)
            band[at] = np.rint(2 * (np.log2(top) + np.log2(np.sqrt(((x / top[:, None]) ** 2).sum(1)))))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(x) for x in raw], pa.int32()), pa.array(band)], ["vec", "raw", "size", "band"])


def _ranked(units: np.ndarray, n: int, bands: list[int], tables: int = TABLES) -> np.ndarray:
    """Promises of the buckets of all bands, band after band."""
    score = promise(units, n, tables)
    return np.concatenate([score * 2.0 ** ((b - max(bands)) / 2) for b in bands], 1)


def _key(size: int, band: np.ndarray, code: np.ndarray) -> np.ndarray:
    """One number for a bucket. Where two buckets meet in one, queries look at more members than they must."""
    return (np.int64(size) * 4096 + band + 2048) * np.int64(1 << 36) + code


def _measure(batches: Iterator[pa.RecordBatch], sample: list[tuple[int, bytes]], groups: dict[int, tuple[int, list[int]]], kind: str, k: int) -> Iterator[pa.RecordBatch]:
    """``(query, score, place)``: the sample's best neighbours in this task, and where their best bucket stands."""
    own: dict[int, tuple] = {}
    for size, at in _by_size([r for _, r in sample]):
        raw = [sample[i][1] for i in at.tolist()]
        score = _ranked(_unit(raw, kind), *groups[size])
        own[size] = (np.array([sample[i][0] for i in at.tolist()]), _matrix(raw, kind), score, np.sort(score, 1))
    best = {q: np.zeros((0, 2)) for q, _ in sample}
    for batch in batches:
        raw, cls, band = batch.column("raw").to_pylist(), batch.column("cls").to_numpy(), batch.column("band").to_numpy()
        for size, at in _by_size(raw):
            if size not in own:
                continue
            part = [raw[i] for i in at.tolist()]
            ids, x, score, ranked = own[size]
            n, bands = groups[size]
            found = codes(_unit(part, kind), n) + (np.searchsorted(bands, band[at]) * (score.shape[1] // len(bands)))[:, None]
            near = x @ _matrix(part, kind).T
            for j, q in enumerate(ids.tolist()):
                near[j, cls[at] == q] = -np.inf
                top = np.argpartition(-near[j], k)[:k] if len(part) > k else np.arange(len(part))
                place = score.shape[1] - np.searchsorted(ranked[j], score[j][found[top]].max(1), "left")
                both = np.concatenate((best[q], np.stack((near[j][top], place), 1)))
                best[q] = both[np.argsort(-both[:, 0], kind="stable")[:k]]
    rows = [(q, s, int(p)) for q, found in best.items() for s, p in found.tolist() if s > -math.inf]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 3, (pa.int64(), pa.float64(), pa.int64()))], ["query", "score", "place"])


def _place(batches: Iterator[pa.RecordBatch], groups: dict[int, tuple[int, list[int]]], kind: str) -> Iterator[pa.RecordBatch]:
    """The buckets of the index's vectors, one in each table."""
    for batch in batches:
        raw, cls, band = batch.column("raw").to_pylist(), batch.column("cls").to_numpy(), batch.column("band").to_numpy()
        for size, at in _by_size(raw):
            key = _key(size, band[at].astype(np.int64)[:, None], codes(_unit([raw[i] for i in at.tolist()], kind), groups[size][0]))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(cls[at], TABLES)), pa.array(key.ravel())], ["cls", "bucket"])


def _probe(batches: Iterator[pa.RecordBatch], groups: dict[int, tuple[int, list[int]]], kind: str, probes: int | None) -> Iterator[pa.RecordBatch]:
    """The buckets that queries look in; without a number of probes, all of the first table."""
    tables = TABLES if probes else 1
    for batch in batches:
        raw, cls = batch.column("raw").to_pylist(), batch.column("cls").to_numpy()
        for size, every in _by_size(raw):
            n, bands = groups[size]
            for at in np.array_split(every, max(1, len(every) // 64)):
                score = _ranked(_unit([raw[i] for i in at.tolist()], kind), n, bands, tables)
                width = score.shape[1] // len(bands)
                if probes and probes < score.shape[1]:
                    code = np.argpartition(-score, probes - 1, axis=1)[:, :probes]
                else:
                    code = np.broadcast_to(np.arange(score.shape[1]), score.shape)
                key = _key(size, np.array(bands, np.int64)[code // width], code % width)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(cls[at], key.shape[1])), pa.array(np.ascontiguousarray(key).ravel())], ["cls", "bucket"])


def _best(found: np.ndarray, k: int) -> np.ndarray:
    """The first ``k`` of each query: greatest score, then smallest id; a class found twice counts once."""
    found = found[np.lexsort((found["cls"], found["low"], -found["score"], found["query"]))]
    same = (found["query"][1:] == found["query"][:-1]) & (found["cls"][1:] == found["cls"][:-1]) & (found["score"][1:] == found["score"][:-1])
    found = found[np.concatenate(([True], ~same))] if len(found) else found
    start = np.flatnonzero(np.concatenate(([True], found["query"][1:] != found["query"][:-1]))) if len(found) else np.zeros(0, np.int64)
    return found[np.arange(len(found)) - np.repeat(start, np.diff(np.append(start, len(found)))) < k]


_FOUND = np.dtype([("query", "<i8"), ("cls", "<i8"), ("low", "<i8"), ("score", "<f8")])


def _compare(batches: Iterator[pa.RecordBatch], kind: str, k: int) -> Iterator[pa.RecordBatch]:
    """The best neighbours that a task's tiles hold, ``(query, cls, low, score)``."""
    held, n = [], 0

    def out(found: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[c])) for c in _FOUND.names], list(_FOUND.names))

    for table, starts in common.whole_groups(batches, ("bucket", "tile", "part")):
        raw, cls, low, asks = table.column("raw").to_pylist(), *(table.column(c).to_numpy() for c in ("cls", "low", "asks"))
        for a, b in zip(starts.tolist(), np.append(starts[1:], len(raw)).tolist()):
            for _, at in _by_size(raw[a:b]):
                at = at + a
                q, c = at[asks[at] == 1], at[asks[at] == 0]
                if not len(q) or not len(c):
                    continue
                x, y = _matrix([raw[i] for i in q.tolist()], kind), _matrix([raw[i] for i in c.tolist()], kind)
                for s in range(0, len(q), 1024):
                    near = x[s : s + 1024] @ y.T
                    if len(c) > k:  # a matrix product may differ in its last bits, so a little more is kept, then compared term by term
                        bound = -np.partition(-near, k - 1, axis=1)[:, k - 1]
                        slack = 1e-12 * np.sqrt((x[s : s + 1024] ** 2).sum(1)) * np.sqrt((y * y).sum(1).max())
                        i, j = np.nonzero(near >= (bound - slack)[:, None])
                    else:
                        i, j = (v.ravel() for v in np.indices(near.shape))
                    for e in range(0, len(i), 1 << 16):
                        u, v = i[e : e + (1 << 16)] + s, j[e : e + (1 << 16)]
                        part = np.empty(len(u), _FOUND)
                        part["query"], part["cls"], part["low"], part["score"] = cls[q[u]], cls[c[v]], low[c[v]], (x[u] * y[v]).sum(1)
                        held.append(part)
                        n += len(u)
                        if n > HELD:
                            held = [_best(np.concatenate(held), k)]
                            n = len(held[0])
                            if n > HELD // 2:
                                yield out(held[0])
                                held, n = [], 0
    if held:
        yield out(_best(np.concatenate(held), k))


def _looked(classes: DataFrame, placed: DataFrame, asking: DataFrame, groups: dict, kind: str, probes: int | None, k: int) -> DataFrame:
    """``(query, found)``: the best ``k`` entries ``(score, vec, cls)`` of the classes that ask."""
    spark = classes.sparkSession
    probed = materialize(asking.select("cls", "raw").mapInArrow(lambda it: _probe(it, groups, kind, probes), "cls long, bucket long"), "probed")
    asked = probed.groupBy("bucket").agg(F.count("*").alias("queries"))
    members = placed.groupBy("bucket").agg(F.count("*").alias("members"))
    large = asked.join(members, "bucket").where((F.col("queries") > QUERIES) | (F.col("members") > TILE))
    large = large.select("bucket", F.ceil(F.col("members") / TILE).alias("tiles"), F.ceil(F.col("queries") / QUERIES).alias("parts"))
    spread = lambda to, own, rest: (  # noqa: E731: a row's own tile or part, and a copy for each of the other kind
        to.join(large, "bucket", "left").fillna(1, ["tiles", "parts"])
        .withColumn(own[0], F.pmod(F.xxhash64("cls", F.lit(own[0])), F.col(own[1])))
        .withColumn(rest[0], F.explode(F.sequence(F.lit(0).cast("long"), F.col(rest[1]) - 1)))
        .select("bucket", "tile", "part", "cls")
    )
    lying = spread(placed.join(asked.select("bucket"), "bucket", "left_semi"), ("tile", "tiles"), ("part", "parts")).withColumn("asks", F.lit(0))
    looking = spread(probed, ("part", "parts"), ("tile", "tiles")).withColumn("asks", F.lit(1))
    full = lying.union(looking).join(classes.select("cls", "raw", F.get("ids", F.lit(0)).alias("low")), "cls")
    keys = ("bucket", "tile", "part")
    tiles = full.repartition(common.partitions(spark), *keys).sortWithinPartitions(*keys)
    near = tiles.mapInArrow(lambda it: _compare(it, kind, k), "query long, cls long, low long, score double")
    order = W.partitionBy("query").orderBy(F.desc("score"), "low", "cls")
    best = near.withColumn("at", F.dense_rank().over(order)).where(F.col("at") <= k).select("query", "cls", "score").distinct()
    ids = best.join(classes.select("cls", "ids"), "cls").select("query", "cls", "score", F.explode("ids").alias("vec"))
    entry = F.struct((-F.col("score")).alias("away"), "vec", "cls")
    first = ids.withColumn("at", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "vec", "cls"))).where(F.col("at") <= k)
    out = materialize(first.groupBy("query").agg(F.sort_array(F.collect_list(entry)).alias("found")), "nearest")  # k entries at most
    discard(probed)
    return out


def search(
    vectors: DataFrame, k: int = 20, every: int = 20, recall: float = RECALL, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """``(query_id, rank, id_col, score)``: for every row whose id is divisible by ``every`` the ``k`` rows found with
    the largest inner product in double precision, other than itself; ties to the smaller id. Fewer only if there are no more.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows without an id;
    vectors meet only those of their own length. Rows equal in id and vector are one; rows that repeat an id with another
    vector are rows of their own, as queries and as neighbours. Other columns aren't read; an empty table gives an empty result.
    The lengths and half octaves of norms that occur, two columns of small numbers, reach the driver, and with them the
    ``SAMPLE`` vectors on which the number of probes is measured.
    """
    spark = vectors.sparkSession
    common.small_batches(spark)
    kind = "<f4" if vectors.schema[vector_col].dataType.elementType == T.FloatType() else "<f8"
    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec"), F.col(vector_col).alias("x"))
    points = rows.mapInArrow(lambda it: _bands(it, kind), "vec long, raw binary, size int, band int")
    points = materialize(points.groupBy("vec", "raw").agg(F.first("size").alias("size"), F.first("band").alias("band")).withColumn("asks", F.col("vec") % every == 0), "points")
    low = W.partitionBy("raw", "asks").orderBy("vec")
    some = points.withColumn("at", F.row_number().over(low)).where(F.col("at") <= k + 1)
    some = some.groupBy("raw").agg(F.first("size").alias("size"), F.first("band").alias("band"), F.slice(F.sort_array(F.collect_list("vec")), 1, k + 1).alias("ids"), F.max("asks").alias("asks"))
    classes = materialize(some.withColumn("cls", F.monotonically_increasing_id()), "classes")
    groups: dict[int, tuple[int, list[int]]] = {}
    for r in classes.groupBy("size", "band").count().orderBy("size", "band").collect():
        n, bands = groups.get(r["size"], (0, []))
        groups[r["size"]] = (n + r["count"], [*bands, r["band"]])
    sample = [(r.cls, bytes(r.raw)) for r in classes.orderBy(F.xxhash64("raw"), "raw").limit(SAMPLE).select("cls", "raw").collect()]
    near = classes.select("cls", "raw", "band").mapInArrow(lambda it: _measure(it, sample, groups, kind, k), "query long, score double, place long")
    top = near.withColumn("at", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "place"))).where(F.col("at") <= k)
    probes = int(top.agg(F.percentile("place", F.lit(recall))).first()[0] or 0) + 1
    placed = materialize(classes.select("cls", "raw", "band").mapInArrow(lambda it: _place(it, groups, kind), "cls long, bucket long"), "placed")
    asking = classes.where("asks")
    found = _looked(classes, placed, asking, groups, kind, probes, k + 1)
    short = asking.join(found.where(F.size("found") > k), F.col("cls") == F.col("query"), "left_anti")
    if not short.isEmpty():
        rest = _looked(classes, placed, short, groups, kind, None, k + 1)
        found = found.where(F.size("found") > k).unionByName(rest)
    queries = points.where("asks").join(classes.select("raw", "cls"), "raw").select(F.col("vec").alias("query_id"), "cls")
    mine = queries.join(found.withColumnRenamed("query", "cls"), "cls")
    others = F.expr(f"slice(filter(found, f -> NOT (f.vec = query_id AND f.cls = cls)), 1, {k})")
    return mine.select("query_id", F.posexplode(others).alias("at", "f")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("f.vec").alias(id_col), (-F.col("f.away")).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.table(spark, sf_dir, "embeddings"))
