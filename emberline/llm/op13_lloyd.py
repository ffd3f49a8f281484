"""Operator 13: Lloyd's clustering of integer vectors by dual trees.

Vectors are dealt into blocks, and each block gets a cover tree once: the centre of a node is one of its points, its
children's centres are the points farthest from those before (the node's own centre is the first), until what is left
lies within a fraction of the node's radius. Every round builds a second tree over the centroids and walks the two
together: a pair of nodes goes if its lower bound exceeds the upper bound of the vectors' node. What pairs of leaves are
left are compared in exact integers.

A round reads the blocks and returns sums for each cluster and component, added up by task before they are shuffled. Only
the centroids, ``k`` times the dimension, reach the driver and the tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from emberline.llm import common
from emberline.storage import discard, materialize

#: Vectors of a block and of a leaf; children of a node at most; a child's share of its parent's radius.
BLOCK, LEAF, FANOUT, SHRINK = 8192, 48, 32, 0.6
#: Components below this are compared in doubles, where every step is exact; others in Python's integers.
EXACT = 1 << 20
#: Bits of a summand: sums of larger values are split, so that no sum overflows.
LIMB = 40


@dataclass
class Tree:
    """Nodes by level, children next to each other, and leaves that hold ``order[first : first + size]``."""

    centre: np.ndarray
    radius: np.ndarray
    child: np.ndarray  # first child, or -1
    children: np.ndarray
    first: np.ndarray
    size: np.ndarray
    order: np.ndarray

    def pack(self) -> bytes:
        columns = {"centre": self.centre, "radius": self.radius, "child": self.child, "children": self.children, "first": self.first, "size": self.size}
        return common.pack_table(pa.table(columns)) + self.order.astype("<i4").tobytes()

    @staticmethod
    def unpack(data: bytes, n: int) -> Tree:
        t = common.unpack_table(data[: len(data) - 4 * n])
        return Tree(*(t.column(c).to_numpy() for c in t.column_names), np.frombuffer(data[len(data) - 4 * n :], "<i4"))


def cover_tree(x: np.ndarray, leaf: int = LEAF) -> Tree:
    """Of rows of whole numbers below ``EXACT``. Radii are those that are reached, not the levels' nominal ones."""
    nodes: list[list] = []  # centre, radius, first child, children, first, size
    order: list[np.ndarray] = []
    held = 0
    nodes.append([0, 0.0, -1, 0, 0, 0])
    todo = [(0, 0, np.arange(len(x)))]
    for k, centre, own in todo:  # grows meanwhile
        d = np.sqrt(((x[own] - x[centre]) ** 2).sum(1))
        radius = float(d.max())
        nodes[k][:2] = [centre, radius]
        if len(own) > leaf and radius > 0:
            centres, near, which = [centre], d, np.zeros(len(own), np.int64)
            while len(centres) < FANOUT and near.max() > SHRINK * radius:
                far = int(near.argmax())
                e = np.sqrt(((x[own] - x[own[far]]) ** 2).sum(1))
                which = np.where(e < near, len(centres), which)
                near = np.minimum(near, e)
                centres.append(int(own[far]))
            nodes[k][2:4] = [len(nodes), len(centres)]
            for c, at in enumerate(centres):
                todo.append((len(nodes), at, own[which == c]))
                nodes.append([0, 0.0, -1, 0, 0, 0])
        else:
            nodes[k][4:] = [held, len(own)]
            order.append(own)
            held += len(own)
    return Tree(*(np.array(c) for c in zip(*nodes)), np.concatenate(order))


def _ints(x: np.ndarray) -> np.ndarray:
    return x if x.dtype == object else x.astype(np.int64).astype(object)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all others: as doubles where both are small, else as Python's integers."""
    if x.dtype == object or c.dtype == object:
        return ((_ints(x)[:, None, :] - _ints(c)[None, :, :]) ** 2).sum(2)
    return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :]


def _candidates(x: np.ndarray, tree: Tree, c: np.ndarray, other: Tree) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (leaf, centroid) that bounds can't rule out, by leaf. Bounds are widened by more than doubles err."""
    leaf: list[np.ndarray] = []
    centroid: list[np.ndarray] = []
    u, v = np.zeros(1, np.int64), np.zeros(1, np.int64)
    best = np.full(len(tree.centre), np.inf)  # of a node: an upper bound of its vectors' least distance
    while len(u):
        d = np.sqrt(((x[tree.centre[u]] - c[other.centre[v]]) ** 2).sum(1))
        np.minimum.at(best, u, (d + tree.radius[u]) * (1 + 1e-9) + 1e-9)
        on = (d - tree.radius[u] - other.radius[v]) * (1 - 1e-9) - 1e-9 <= best[u]
        u, v = u[on], v[on]
        done = (tree.child[u] < 0) & (other.child[v] < 0)
        size = other.size[v[done]]
        leaf.append(np.repeat(u[done], size))
        centroid.append(other.order[common.spread(other.first[v[done]], size)])
        u, v = u[~done], v[~done]
        for nodes, side in ((tree, 0), (other, 1)):
            now = (u, v)[side]
            count = np.where(nodes.child[now] < 0, 1, nodes.children[now])
            down = common.spread(np.where(nodes.child[now] < 0, now, nodes.child[now]), count)
            rest = np.repeat((v, u)[side], count)
            if side == 0:
                parents = np.repeat(now, count)
                np.minimum.at(best, down, best[parents])
            u, v = (down, rest) if side == 0 else (rest, down)
    leaf, centroid = np.concatenate(leaf), np.concatenate(centroid)
    order = np.lexsort((centroid, leaf))
    return leaf[order], centroid[order]


def assign(x: np.ndarray, tree: Tree | None, centroids: np.ndarray, other: Tree | None) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, the smaller number of equally near ones, and its squared distance."""
    if tree is None or other is None:
        x, cluster, least = _ints(x), np.zeros(len(x), np.int64), np.zeros(len(x), object)
        for k in range(0, len(x), 64):
            d = squared(x[k : k + 64], centroids)
            cluster[k : k + 64] = np.array([min(range(len(r)), key=r.__getitem__) for r in d.tolist()])
            least[k : k + 64] = d[np.arange(len(d)), cluster[k : k + 64]]
        return cluster, least
    cluster, least = np.zeros(len(x), np.int64), np.zeros(len(x))
    leaf, centroid = _candidates(x, tree, centroids, other)
    starts = np.flatnonzero(np.concatenate(([True], leaf[1:] != leaf[:-1])))
    for a, b in zip(starts.tolist(), np.append(starts[1:], len(leaf)).tolist()):
        k = leaf[a]
        own = tree.order[tree.first[k] : tree.first[k] + tree.size[k]]
        d = squared(x[own], centroids[centroid[a:b]])
        near = d.argmin(1)  # the first, so the smaller number
        cluster[own] = centroid[a:b][near]
        least[own] = d[np.arange(len(own)), near]
    return cluster, least


def _whole(rows: list[list[int]]) -> np.ndarray:
    """Rows of integers as doubles where they are small enough to be exact, else as Python's integers."""
    if all(-EXACT < v < EXACT for r in rows for v in r):
        return np.array(rows, np.float64)
    return np.array(rows, object)


def _blocks(batches: Iterator[pa.RecordBatch], scale: int, dim: int, size: int) -> Iterator[pa.RecordBatch]:
    """``(id, vector)`` of kept vectors -> ``(ids, x, tree)``; a block with large components has no tree."""
    held, n = [], 0

    def block(tables: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(tables)
        flat = t.column(1).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        small = bool((np.abs(flat) * scale < EXACT).all())
        if small:
            x = np.floor(flat * scale).reshape(-1, dim)
            raw, tree = common.pack(x.astype("<i4")), cover_tree(x).pack()
        else:
            raw, tree = common.pack("\n".join(str((n * scale) // d) for n, d in map(float.as_integer_ratio, flat.tolist())).encode()), None
        return pa.RecordBatch.from_arrays(
            [pa.array([common.pack_table(t.select([0]))], pa.binary()), pa.array([t.num_rows], pa.int32()), pa.array([raw], pa.binary()), pa.array([tree], pa.binary())],
            ["ids", "n", "x", "tree"],
        )

    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, size - n)
            held.append(part)
            n, at = n + part.num_rows, at + part.num_rows
            if n == size:
                yield block(held)
                held, n = [], 0
    if held:
        yield block(held)


def _open(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[bytes, np.ndarray, Tree | None]]:
    for batch in batches:
        for row in batch.to_pylist():
            if row["tree"] is None:
                x = np.array([int(v) for v in common.unpack(row["x"]).split(b"\n")], object)
                yield row["ids"], x.reshape(-1, dim), None
            else:
                x = common.unpack(row["x"], "<i4").astype(np.float64).reshape(-1, dim)
                yield row["ids"], x, Tree.unpack(row["tree"], len(x))


def _sums(batches: Iterator[pa.RecordBatch], rows: list[list[int]]) -> Iterator[pa.RecordBatch]:
    """``(cluster, component, limb, total)``, a row for each that this task has; component -1 counts vectors."""
    k, dim = len(rows), len(rows[0])
    c = _whole(rows)
    other = cover_tree(c, 1) if c.dtype != object else None
    total, count, large = np.zeros((k, dim), np.int64), np.zeros(k, np.int64), None
    for _, x, tree in _open(batches, dim):
        cluster, _ = assign(x, tree, c, other)
        count += np.bincount(cluster, minlength=k)
        if tree is None:
            large = np.zeros((k, dim), object) if large is None else large
            np.add.at(large, cluster, x)
        else:
            np.add.at(total, cluster, x.astype(np.int64))
    on = np.flatnonzero(count)
    out = [(int(j), -1, 0, int(count[j])) for j in on]
    for j in on.tolist():
        for d in range(dim):
            rest, limb = int(total[j, d]) + (0 if large is None else int(large[j, d])), 0
            while rest or not limb:
                sign, rest = (-1, -rest) if rest < 0 else (1, rest)
                out.append((j, d, limb, sign * (rest & ((1 << LIMB) - 1))))
                rest, limb = sign * (rest >> LIMB), limb + 1
    columns = list(zip(*out)) or [[]] * 4
    yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in columns], ["cluster", "component", "limb", "total"])


def _assigned(batches: Iterator[pa.RecordBatch], rows: list[list[int]]) -> Iterator[pa.RecordBatch]:
    c = _whole(rows)
    other = cover_tree(c, 1) if c.dtype != object else None
    for ids, x, tree in _open(batches, len(rows[0])):
        cluster, least = assign(x, tree, c, other)
        fits = [int(v) if v < 1 << 63 else None for v in least.tolist()]
        t = common.unpack_table(ids).append_column("cluster", pa.array(cluster, pa.int32())).append_column("distance", pa.array(fits, pa.int64()))
        yield from t.to_batches(max_chunksize=4000)


def _usable(vector: str, dim: int) -> Column:
    good = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == dim) & good, F.lit(False))


def lloyd(
    vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, seed: int = 2,
    id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK,
) -> tuple[DataFrame, list[list[int]]]:
    """``(id_col, cluster, distance)`` of every usable vector after ``rounds`` rounds, and the centroids.

    Vectors of ``dim`` components, none null or non-finite, are used, their components being ``floor(scale * x)``; the
    others have no row. The first centroids are the ``k`` vectors with the smallest sha256 of ``<seed>:<id>``, ties by
    their components; null ids come last (``~``). With fewer than ``k`` vectors each is a centroid; with none the result is empty.
    Repeated rows are vectors of their own. Centroids are exact at any size of components; a distance that doesn't fit in
    a long is null. Other columns aren't read.
    """
    common.small_batches(vectors.sparkSession)
    rows = vectors.where(_usable(vector_col, dim)).select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    kind = rows.schema["id"].dataType.simpleString()
    blocks = materialize(rows.mapInArrow(lambda it: _blocks(it, scale, dim, block), "ids binary, n int, x binary, tree binary"), "blocks")
    name = F.coalesce(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256), F.lit("~"))
    first = rows.select(name.alias("h"), F.col("v").cast("array<double>").alias("v")).orderBy("h", "v").limit(k).collect()
    centroids = [[(n * scale) // d for n, d in map(float.as_integer_ratio, r.v)] for r in first]
    if not centroids:
        return vectors.sparkSession.createDataFrame([], f"id {kind}, cluster int, distance long").withColumnRenamed("id", id_col), []
    for _ in range(rounds):
        now = centroids
        summed = blocks.mapInArrow(lambda it: _sums(it, now), "cluster long, component long, limb long, total long")  # noqa: B023
        found: dict[tuple[int, int], int] = {}
        for r in summed.groupBy("cluster", "component", "limb").agg(F.sum("total").alias("total")).collect():
            found[r.cluster, r.component] = found.get((r.cluster, r.component), 0) + (r.total << (LIMB * r.limb))
        centroids = [[found[j, d] // found[j, -1] for d in range(dim)] if (j, -1) in found else row for j, row in enumerate(now)]
    last = centroids
    out = blocks.mapInArrow(lambda it: _assigned(it, last), f"id {kind}, cluster int, distance long")
    out = materialize(out, "assigned")
    discard(blocks)
    return out.withColumnRenamed("id", id_col), centroids


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = lloyd(common.table(spark, sf_dir, "embeddings"))
    wide = F.col("distance").cast("decimal(38,0)")
    parts = {r.cluster: r.d for r in found.groupBy("cluster").agg(F.sum(wide).alias("d")).collect()}  # a row for each centroid
    fits = lambda v: F.lit(int(v) if v < 1 << 63 else None).cast("long")
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    by_cluster = F.array(*(fits(parts.get(j) or 0) for j in range(len(centroids)))) if centroids else F.array().cast("array<bigint>")
    names = F.array(*(F.lit(d) for d in digest)) if centroids else F.array().cast("array<string>")
    return found.select(
        "vec_id", "cluster", "distance", F.get(by_cluster, "cluster").alias("cluster_inertia"),
        fits(sum(v or 0 for v in parts.values())).alias("inertia"), F.get(names, "cluster").alias("centroid_sha256"),
    )


def _oracle(k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, seed: int = 2) -> str:
    steps = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, [CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e
        FROM embeddings WHERE len(embedding) = {dim} AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)""",
        f"""f AS (SELECT e, row_number() OVER (ORDER BY h, e) - 1 AS c FROM (SELECT e, sha256('{seed}:' || vec_id) AS h FROM v ORDER BY h, e LIMIT {k}))""",
        f"x AS MATERIALIZED (SELECT r, unnest(range({dim})) AS d, unnest(e) AS x FROM v)",
        f"c0 AS MATERIALIZED (SELECT c, unnest(range({dim})) AS d, unnest(e) AS y FROM f)",
    ]
    for n in range(rounds + 1):
        steps.append(f"d{n} AS (SELECT r, c, sum((x - y) * (x - y)) AS s FROM x JOIN c{n} USING (d) GROUP BY r, c)")
        steps.append(f"a{n} AS MATERIALIZED (SELECT r, arg_min(c, s * 1000 + c) AS c, min(s) AS s FROM d{n} GROUP BY r)")
        if n < rounds:
            steps.append(f"m{n} AS (SELECT c, d, sum(x) AS s, count(*) AS n FROM a{n} JOIN x USING (r) GROUP BY c, d)")
            steps.append(f"c{n + 1} AS MATERIALIZED (SELECT c, d, CASE WHEN n IS NULL THEN y ELSE (s - ((s % n) + n) % n) // n END AS y FROM c{n} LEFT JOIN m{n} USING (c, d))")
    return f"""WITH {", ".join(steps)},
    h AS (SELECT c, sha256(string_agg(CAST(CAST(y AS BIGINT) AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
    SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(a.s AS BIGINT) AS distance, CAST(sum(a.s) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
           CAST(sum(a.s) OVER () AS BIGINT) AS inertia, centroid_sha256
    FROM a{rounds} a JOIN v USING (r) JOIN h USING (c)"""


ORACLE = _oracle()
