import hashlib
import math
from fractions import Fraction

import duckdb
import numpy as np
from pyspark.sql import functions as F

from emberline.llm import op13_lloyd


def brute(rows, k, rounds, dim, scale=256):
    kept = [(i, [math.floor(scale * Fraction(v)) for v in x]) for i, x in rows if x is not None and len(x) == dim and all(v is not None and math.isfinite(v) for v in x)]
    first = sorted(kept, key=lambda r: ("~" if r[0] is None else hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [x for _, x in first[:k]]

    def assign():
        out = []
        for _, x in kept:
            d = [sum((a - b) ** 2 for a, b in zip(x, c)) for c in centroids]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        found = assign()
        for j in range(len(centroids)):
            own = [x for (_, x), (c, _) in zip(kept, found) if c == j]
            if own:
                centroids[j] = [sum(v) // len(own) for v in zip(*own)]
    return sorted((str(i), c, d if d < 1 << 63 else None) for (i, _), (c, d) in zip(kept, assign())), centroids


def rows_of(rng, dim, n):
    base = rng.normal(size=(6, dim))
    rows = [(k, (base[k % 6] + rng.normal(size=dim) * 0.2).tolist()) for k in range(n)]
    rows += [(n + k, rows[3][1]) for k in range(n // 3)] + [rows[5], (None, rows[6][1])]
    rows += [(9000 + k, v) for k, v in enumerate((None, [], [None] * dim, [math.nan] * dim, [math.inf] + [1.0] * (dim - 1), [0.0] * dim, [1.0] * (dim + 1)))]
    return [(i, x if x is None else [v if v is None else float(np.float32(v)) for v in x]) for i, x in rows]


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("id", "v", "cluster", "n")})
    found, centroids = op13_lloyd.lloyd(df.repartition(3), **options)
    return sorted((str(r.vec_id), r.cluster, r.distance) for r in found.collect()), centroids


def test_clusters_match_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    monkeypatch.setattr(op13_lloyd, "LEAF", 5)
    monkeypatch.setattr(op13_lloyd, "FANOUT", 4)
    rows = rows_of(rng, 8, 240)
    for k, rounds, block in ((12, 4, 64), (1, 1, 1000), (500, 1, 50)):
        assert run(spark, rows, k=k, rounds=rounds, dim=8, block=block) == brute(rows, k, rounds, 8)
    assert run(spark, rows, k=5, dim=77) == ([], [])
    whole = [(k, [float(k // 4), 0.0]) for k in range(40)]  # ties on a grid
    assert run(spark, whole, k=7, rounds=3, dim=2, block=9) == brute(whole, 7, 3, 2)


def test_components_of_any_size(spark):
    rng = np.random.default_rng(2)
    rows = [(k, (rng.normal(size=4) * 10.0 ** rng.integers(-3, 38)).astype(np.float32).astype(float).tolist()) for k in range(60)]
    assert run(spark, rows, k=6, rounds=3, dim=4, block=16) == brute(rows, 6, 3, 4)


def test_bounds_prune_pairs_of_nodes():
    rng = np.random.default_rng(3)
    x = np.floor((rng.normal(size=(40, 6)) * 2000).repeat(50, 0) + rng.normal(size=(2000, 6)) * 20)
    c = x[::50].copy()
    tree, other = op13_lloyd.cover_tree(x), op13_lloyd.cover_tree(c, 1)
    assert sorted(tree.order.tolist()) == list(range(2000))
    leaf, centroid = op13_lloyd._candidates(x, tree, c, other)
    assert len(leaf) < 0.2 * len(np.unique(leaf)) * len(c)
    d = ((x[:, None] - c[None]) ** 2).sum(2)
    cluster, least = op13_lloyd.assign(x, tree, c, other)
    assert (cluster == d.argmin(1)).all() and (least == d.min(1)).all()


def test_query_matches_its_sql(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [r for r in rows_of(rng, 64, 150) if r[0] is not None]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    columns = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    got = sorted(tuple(r[c] for c in columns) for r in op13_lloyd.query(spark, str(tmp_path)).collect())
    assert got == sorted(duckdb.sql(f"SELECT {', '.join(columns)} FROM ({op13_lloyd.ORACLE})").fetchall())
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "none" / "embeddings.parquet"))
    assert op13_lloyd.query(spark, str(tmp_path / "none")).collect() == []
