import __spark_entry__


def test_registry():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) >= 35


def test_components_of_nothing_and_of_a_path(spark):
    from emberline.operators.components import connected_components

    edges = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(100, 101), (7, 7), (None, 3)], "u long, v long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {k: 0 for k in range(31)} | {100: 100, 101: 100}
    assert connected_components(edges.where("false")).collect() == []


def test_sessions_and_as_of_over_bucket_edges(spark):
    from emberline.operators.temporal import as_of, sessions

    rows = spark.createDataFrame([("k", t) for t in (0, 9, 10, 19, 35, 36, 100, 105, 115)] + [(None, 1)], "k string, t long")
    got = sorted((r.t, r.session) for r in sessions(rows, "k", "t", 10, bucket_ms=7).collect() if r.k)
    assert got == [(0, 0), (9, 0), (10, 0), (19, 0), (35, 35), (36, 35), (100, 100), (105, 100), (115, 100)]
    marks = spark.createDataFrame([("k", 5, "a"), ("k", 5, "b"), ("k", 90, "c"), ("q", 0, "z")], "k string, t long, v string")
    owner = {r.t: r.v for r in as_of(rows, marks, "k", "t", "v", bucket_ms=7).collect() if r.k}
    assert owner == {0: None, 9: "b", 10: "b", 19: "b", 35: "b", 36: "b", 100: "c", 105: "c", 115: "c"}


def test_identifier_components_over_all_events_and_far_ones(spark, tmp_path):
    import random

    import duckdb

    ids = sorted(random.Random(3).sample(range(20_000), 700)) + [1_000_003, 1_000_011]
    spark.createDataFrame([(i,) for i in ids], "event_id long").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.node: r.component for r in __spark_entry__.queries()["identifier_components"](spark, str(tmp_path)).collect()}
    top = {}

    def find(n):
        while top.setdefault(n, n) != n:
            n = top[n]
        return n

    for i in ids:
        low, high = sorted((find(f"h{i // 3}"), find(f"m{i // 5 % 997}")))
        top[high] = low
    assert got == {n: find(n) for n in top}
    assert got["h333334"] == got[f"m{1_000_003 // 5 % 997}"] and len(set(got.values())) > 1
    duckdb.sql(f"CREATE OR REPLACE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert got == dict(duckdb.sql(__spark_entry__.oracle_sql()["identifier_components"]).fetchall())
