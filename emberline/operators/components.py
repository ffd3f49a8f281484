"""Connected components by alternating large-star and small-star rounds (MapReduce-style contraction)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from emberline.storage import discard, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u")
    return (
        moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
        .union(low.select("u", F.col("m").alias("v")))
        .where("u <> v")
        .distinct()
    )


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(u, v)`` of any orderable type -> ``(node, component)`` for every node that has an edge.

    ``component`` is the smallest node reachable. Null ends and self loops are ignored; no edges give no rows. Every
    group is reduced to its minimum before it is shuffled, so a node with millions of links is no hot key for the
    aggregation; in the joins its links meet in one task. Each round is written to the shared folder, which cuts the
    lineage; only two counters per round come to the driver.
    """
    now = materialize(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u is not null and v is not null and u <> v").distinct(),
        "cc",
    )
    before = None
    for _ in range(max_rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == before or mark[0] == 0:
            break
        before = tuple(mark)
        last, now = now, materialize(_small_star(_large_star(now)), "cc")
        discard(last)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
