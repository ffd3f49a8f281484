"""Operator 9: near-duplicate vectors by cross-polytope hashing.

A vector is scaled to unit length and turned by pseudo-random rotations, each three rounds of sign flips and a fast
Hadamard transform. Its hash by one rotation is the signed axis it lies nearest to; a table's bucket joins the hashes of
several rotations. A vector is stored under its own bucket and looked up under those of its next best axes (multiprobe).
Pairs in a bucket are verified by the cosine in double precision.

Equal vectors collapse into a class first. Within a bucket, pairs are compared tile by tile and never become rows: a
tile gives each vector's links and the local components. A pair that shares several buckets is counted in the first of
them, which either side can tell from the bucket lists that travel with the vectors. A bucket that holds a third of all
vectors is many tiles, dealt over as many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from emberline.llm import common
from emberline.operators.components import connected_components
from emberline.storage import materialize

#: Vectors of a bucket that the number of rotations of a table aims at, and tables for 2, 3, 4 ... rotations.
BUCKET, TABLES = 8, {2: 6, 3: 10, 4: 16}
#: Second-best axes tried for each rotation of a table.
PROBES = 1
#: Vectors of a tile; groups from this size on are compared by a matrix product, and pairs compared at once below it.
TILE, WIDE, AT_ONCE = 512, 48, 100_000


def _hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of rows whose length is a power of two."""
    n, step = x.shape[1], 1
    x = x.copy()
    while step < n:
        v = x.reshape(len(x), n // (2 * step), 2, step)
        x = np.stack((v[:, :, 0] + v[:, :, 1], v[:, :, 0] - v[:, :, 1]), 2).reshape(len(x), n)
        step *= 2
    return x / math.sqrt(n)


def buckets(x: np.ndarray, rotations: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    """Of unit rows: the own bucket in each table, and the buckets to look in as well, (row, table, probe)."""
    dim = 1 << max(0, (x.shape[1] - 1).bit_length())
    padded = np.zeros((len(x), dim))
    padded[:, : x.shape[1]] = x
    own = np.zeros((len(x), tables), np.uint64)
    probes = np.zeros((len(x), tables, rotations * PROBES), np.uint64)
    row = np.arange(len(x))[:, None]
    for t in range(tables):
        codes = []
        for r in range(rotations):
            rng = np.random.default_rng((17, dim, t, r))
            y = padded
            for _ in range(3):
                y = _hadamard(y * rng.choice((-1.0, 1.0), dim))
            best = np.argsort(-np.abs(y), axis=1, kind="stable")[:, : PROBES + 1]
            best = best if best.shape[1] > PROBES else np.repeat(best[:, :1], PROBES + 1, 1)
            codes.append((best * 2 + (y[row, best] < 0)).astype(np.uint64))
        place = lambda chosen: sum((c * np.uint64((2 * dim) ** k % (1 << 63)) for k, c in enumerate(chosen)), np.uint64(0)) * np.uint64(64) + np.uint64(t)  # noqa: E731, B023
        own[:, t] = place([c[:, 0] for c in codes])
        for r in range(rotations):
            for p in range(PROBES):
                probes[:, t, r * PROBES + p] = place([c[:, p + 1] if k == r else c[:, 0] for k, c in enumerate(codes)])
    return own, probes


def _unit(raw: list[bytes], kind: str) -> np.ndarray:
    """Rows of one length, scaled to unit length in double precision."""
    x = np.frombuffer(b"".join(raw), kind).astype(np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(1, keepdims=True)  # the squares of very large or small components stay finite
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _raw(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for values in batch.column(1).to_pylist():
            x = np.array(values, kind) if values and all(v is not None for v in values) else None
            out.append(x.tobytes() if x is not None and np.isfinite(x).all() and x.any() else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["vec", "raw"])


def _place(batches: Iterator[pa.RecordBatch], kind: str, rotations: int, tables: int) -> Iterator[pa.RecordBatch]:
    """``(rep, copies, raw, seen)`` -> the vectors' buckets. ``seen``: its own ones, then those it is looked up in."""
    for batch in batches:
        reps, raw = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        sizes = np.array([len(x) for x in raw])
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            own, probes = buckets(_unit([raw[k] for k in at.tolist()], kind), rotations, tables)
            salt = np.uint64((int(size) * 0x9E3779B97F4A7C15) % (1 << 64))
            every = np.concatenate((own, probes.reshape(len(at), -1)), 1)
            use = np.concatenate((np.ones(own.shape, bool), (probes != own[:, :, None]).reshape(len(at), -1)), 1)
            every = (every ^ salt).astype(np.int64)
            mine = np.broadcast_to(np.arange(every.shape[1]) < tables, every.shape)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(reps[at], use.sum(1)), pa.int64()), pa.array(every[use], pa.int64()), pa.array(mine[use], pa.bool_()), pa.array([x.tobytes() for x in every], pa.binary()).take(pa.array(np.nonzero(use)[0]))],
                ["rep", "bucket", "own", "seen"],
            )


_KEYS = ("bucket", "low", "high")
_FOUND = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("links", pa.int64())])


def _close(units: np.ndarray, starts: np.ndarray, bound: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs within groups with a cosine of at least ``bound``."""
    sizes = np.diff(np.append(starts, len(units)))
    for start, size in zip(starts[sizes >= WIDE].tolist(), sizes[sizes >= WIDE].tolist()):
        own = units[start : start + size]
        i, j = np.nonzero(np.triu(own @ own.T >= bound, 1))
        yield i + start, j + start
    for size in np.unique(sizes[(sizes < WIDE) & (sizes > 1)]).tolist():
        i, j = np.triu_indices(size, 1)
        own = starts[sizes == size]
        step = max(1, AT_ONCE // len(i))
        for k in range(0, len(own), step):
            x, y = (own[k : k + step, None] + i).ravel(), (own[k : k + step, None] + j).ravel()
            near = np.einsum("ij,ij->i", units[x], units[y]) >= bound
            yield x[near], y[near]


def _compare(batches: Iterator[pa.RecordBatch], kind: str, bound: float, tables: int) -> Iterator[pa.RecordBatch]:
    """Links of pairs of tiles: (u, null, links) adds to u's count, (u, v, null) ties u to v."""
    for table, _ in common.whole_groups(batches, _KEYS):
        raw = table.column("raw").to_pylist()
        lengths = np.array([len(x) for x in raw])
        for length in np.unique(lengths):
            at = np.flatnonzero(lengths == length)
            part = table.take(pa.array(at))
            units = _unit([raw[k] for k in at.tolist()], kind)
            bucket, side, reps, copies, own = (part.column(c).to_numpy() for c in ("bucket", "side", "rep", "copies", "own"))
            seen = np.frombuffer(b"".join(part.column("seen").to_pylist()), np.int64).reshape(len(at), -1)
            keys = np.stack([part.column(c).to_numpy() for c in _KEYS], 1)
            starts = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(1))))
            pairs = list(_close(units, starts, bound))
            i, j = (np.concatenate([p[k] for p in pairs] or [np.zeros(0, np.int64)]) for k in (0, 1))
            on = (own[i] | own[j]) & ((side[i] == 2) | (side[i] != side[j]))  # one lies here by its own hash; tiles meet
            i, j = i[on], j[on]
            first = np.full(len(i), np.iinfo(np.int64).max)  # the least bucket in which the pair meets
            for k in range(tables):
                for x, y in ((i, j), (j, i)):
                    met = (seen[y] == seen[x, k][:, None]).any(1)
                    first = np.where(met, np.minimum(first, seen[x, k]), first)
            on = first == bucket[i]
            i, j = i[on], j[on]
            count = np.zeros(len(at), np.int64)
            np.add.at(count, i, copies[j])
            np.add.at(count, j, copies[i])
            some = np.flatnonzero(count)
            root, before = np.arange(len(at)), None
            while before is None or (root != before).any():  # smallest row index that links lead to
                before = root.copy()
                np.minimum.at(root, i, root[j])
                np.minimum.at(root, j, root[i])
                root = root[root]
            tied = some[root[some] != some]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate((reps[some], reps[tied])), pa.int64()),
                    pa.array([None] * len(some) + reps[root[tied]].tolist(), pa.int64()),
                    pa.array(count[some].tolist() + [None] * len(tied), pa.int64()),
                ],
                schema=_FOUND,
            )


def near_vectors(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(id_col, n_links, component_id, kept)``, a row for each input row with an id.

    Null, empty or zero vectors, and those with null or non-finite components, link with nothing; neither do vectors of
    different lengths. Rows that repeat an id are vectors of their own and link like any others; rows with a null id are
    left out, having no name to link by. Other columns aren't read; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    common.small_batches(spark)
    kind = "<f4" if vectors.schema[vector_col].dataType.elementType == T.FloatType() else "<f8"
    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec"), F.col(vector_col).alias("x"))
    units = materialize(rows.mapInArrow(lambda it: _raw(it, kind), "vec long, raw binary"), "vectors")
    classes = materialize(units.where("raw is not null").groupBy("raw").agg(F.min("vec").alias("rep"), F.count("*").alias("copies")), "classes")
    n, width = classes.agg(F.count("*"), F.max(F.length("raw"))).first()
    axes = 2 << max(0, ((width or 4) // int(kind[-1]) - 1).bit_length())
    most = max(2, 56 // axes.bit_length())
    rotations = min(max(2, math.ceil(math.log(max(n, 2) / BUCKET, axes))), most, max(TABLES))
    tables = TABLES[rotations]
    placed = materialize(classes.select("rep", "raw").mapInArrow(lambda it: _place(it, kind, rotations, tables), "rep long, bucket long, own boolean, seen binary"), "placed")
    sizes = placed.groupBy("bucket").agg(F.count("*").alias("members"), F.max("own").alias("some_own")).where("members > 1 and some_own").select("bucket", F.ceil(F.col("members") / TILE).alias("tiles"))
    dealt = placed.join(sizes, "bucket").withColumn("tile", F.pmod(F.xxhash64("rep", F.lit("tile")), F.col("tiles")))
    # a tile meets itself, every lower tile and every higher one
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))).select(
        "bucket", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"),
        F.when(F.col("tile") == F.col("other"), 2).when(F.col("tile") < F.col("other"), 0).otherwise(1).alias("side"),
        "rep", "own", "seen",
    )
    tiles = met.join(classes, "rep").repartition(common.partitions(spark), *_KEYS).sortWithinPartitions(*_KEYS)
    found = materialize(tiles.mapInArrow(lambda it: _compare(it, kind, cosine, tables), "u long, v long, links long"), "found")
    label = materialize(connected_components(found.where("v is not null").select("u", "v").distinct()), "label")
    counts = found.where("links is not null").groupBy(F.col("u").alias("rep")).agg(F.sum("links").alias("links"))
    summed = classes.join(counts, "rep", "left").join(label.withColumnRenamed("node", "rep"), "rep", "left")
    summed = summed.select("raw", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = units.join(summed, "raw", "left")
    component = F.coalesce("component_id", "vec")
    return out.select(F.col("vec").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec") == component).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(common.table(spark, sf_dir, "embeddings"))
