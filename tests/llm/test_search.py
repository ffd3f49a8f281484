import math

import numpy as np
from pyspark.sql import functions as F

from emberline.llm import op12_search


def brute(rows, k=20, every=20):
    """Every query's neighbours, equal rows once."""
    good = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)})
    out = {}
    for i, v in good:
        if i % every == 0:
            found = sorted((-(np.array(v) * np.array(w)).sum(), j) for j, w in good if (j, w) != (i, v) and len(w) == len(v))
            out.setdefault(i, []).append([(j, -s) for s, j in found[:k]])
    return out


def near(rows, n):
    rng = np.random.default_rng(n)
    base = rng.normal(size=(10, 24))
    add = lambda v: rows.append((len(rows), None if v is None else [None if x is None else float(np.float32(x)) for x in v]))
    for k in range(n):
        add(base[k % 10] + rng.normal(size=24) * 0.3)
    for _ in range(n // 3):
        add(base[3])
    for _ in range(n // 4):
        add(base[4] + rng.normal(size=24) * 0.01)
    for scale in (1e18, 1e-18, 3.0, -2.0, 40.0):
        add(base[3] * scale)
    for v in (None, [], [0.0] * 24, [None] * 24, [math.nan] * 24, [math.inf] + [1.0] * 23):
        add(v)
    return rows


def asked(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("x") for c in ("raw", "cls", "size", "rank", "asks")})
    got = {}
    for r in op12_search.search(df.repartition(3), **options).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: [(v, s) for _, v, s in sorted(found)] for q, found in got.items()}


def check(got, expected, least):
    assert set(got) == {q for q, lists in expected.items() if lists[0]}
    hit = there = 0
    for q, found in got.items():
        want = expected[q][0]
        assert len(found) == len(want) and q not in {v for v, _ in found}
        assert found == sorted(found, key=lambda x: (-x[1], x[0])) and len({v for v, _ in found}) == len(found)
        hit += sum(s >= want[-1][1] - 1e-12 * abs(want[-1][1]) for _, s in found)
        there += len(want)
        if {v for v, _ in found} == {v for v, _ in want}:
            assert [v for v, _ in found] == [v for v, _ in want] and np.allclose([s for _, s in found], [s for _, s in want], rtol=1e-12)
    assert hit >= least * there


def test_neighbours_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(op12_search, "TILE", 16)
    monkeypatch.setattr(op12_search, "QUERIES", 5)
    monkeypatch.setattr(op12_search, "HELD", 200)
    rows = near([], 300)
    rows += [(None, rows[0][1]), rows[20], (5000, [1.0, 2.0]), (5001, [3.0, -1.0])]
    check(asked(spark, rows), brute(rows), 0.9)


def test_second_rotation(spark, monkeypatch):
    monkeypatch.setattr(op12_search, "BUCKET", 2)
    assert op12_search.second_axes(32, 500) == 1 and op12_search.second_axes(32, 5000) == 16 and op12_search.second_axes(32, 10**9) == 32
    rows = near([], 500)
    check(asked(spark, rows), brute(rows), 0.9)


def test_few_rows_and_ties(spark):
    rows = [(k, [1.0, float(k % 2)]) for k in range(8)]
    got = asked(spark, rows, k=3, every=4)
    assert got == {q: lists[0] for q, lists in brute(rows, 3, 4).items()}
    assert asked(spark, rows[:3]) == {0: [(1, 1.0), (2, 1.0)]} and asked(spark, rows[:1]) == {} and asked(spark, []) == {}
    twice = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [1.0, 0.0]), (1, [1.0, 1.0])]
    df = spark.createDataFrame(twice, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in op12_search.search(df).collect())
    assert got == [(0, 1, 1, 1.0), (0, 1, 1, 1.0), (0, 2, 0, 0.0), (0, 2, 0, 0.0)]
