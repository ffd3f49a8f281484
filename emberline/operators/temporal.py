"""Event-time operators: as-of lookup, ownership intervals and gap sessions.

All of them sort by (key, time bucket) instead of by key, with a small table that carries the last value from bucket to
bucket, so that a key with a third of all rows is dealt over as many tasks as it has buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

#: Width of a time bucket; a chain or a name can have a third of all rows, so its order is cut finer.
BUCKET_MS, ORDER_MS = 86_400_000, 300_000


def _carried(marks: DataFrame, key: str, value: str) -> DataFrame:
    """``marks(key, _b, value)``: for each bucket the last value of the buckets before it."""
    before = W.partitionBy(key).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    return marks.withColumn("_before", F.last(value, ignorenulls=True).over(before)).select(key, "_b", "_before")


def as_of(rows: DataFrame, marks: DataFrame, key: str, time: str, value: str, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """``rows`` with ``value``: that of the latest of ``marks(key, time, value)`` at or before the row's time, of the same
    key; of marks at one time the largest value counts. Null: none. Null keys and times find nothing."""
    both = rows.withColumn("_is", F.lit(1)).withColumn(value, F.lit(None).cast(marks.schema[value].dataType)).unionByName(
        marks.where(F.col(key).isNotNull() & F.col(time).isNotNull() & F.col(value).isNotNull()).select(key, time, value).withColumn("_is", F.lit(0)), allowMissingColumns=True
    ).withColumn("_b", F.floor(F.col(time) / bucket_ms))
    w = W.partitionBy(key, "_b").orderBy(time, "_is", F.asc_nulls_first(value)).rowsBetween(W.unboundedPreceding, W.currentRow)
    near = both.withColumn("_v", F.last(value, ignorenulls=True).over(w))
    last = both.groupBy(key, "_b").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(time, value))).alias("_last"))
    far = _carried(last, key, "_last").withColumnRenamed(key, "_k")
    joined = near.where("_is = 1").join(far.withColumnRenamed("_b", "_kb"), (F.col(key) == F.col("_k")) & (F.col("_b") == F.col("_kb")), "left")
    return joined.withColumn(value, F.coalesce("_v", "_before")).select(*rows.columns, value)


def ordered(rows: DataFrame, key: str, time: str, tie: str, previous: tuple[str, ...] = (), following: tuple[str, ...] = (), bucket_ms: int = ORDER_MS) -> DataFrame:
    """``rows`` with ``seq``, the row's place among those of its key by time and ``tie`` (from 1, nulls first), and
    ``previous_<c>`` and ``following_<c>``, the columns' values in the row before and after (null: none).

    Rows are numbered within (key, time bucket). The buckets' sizes, first and last rows, reduced before they are shuffled,
    are summed up and carried along the key, so a key with a third of all rows is as many tasks as it has buckets.
    """
    order = F.struct(time, tie)
    b = rows.withColumn("_b", F.coalesce(F.floor(F.col(time) / bucket_ms), F.lit(-(1 << 62))))
    seen = lambda cs: F.struct(F.lit(1).alias("_is"), *cs)
    ends = b.groupBy(key, "_b").agg(F.count("*").alias("_n"), F.max_by(seen(previous), order).alias("_last"), F.min_by(seen(following), order).alias("_first"))
    w = W.partitionBy(key).orderBy("_b")
    ends = ends.select(
        F.col(key).alias("_k"), F.col("_b").alias("_kb"), F.coalesce(F.sum("_n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.lag("_last").over(w).alias("_prior"), F.lead("_first").over(w).alias("_next"),
    )
    near = W.partitionBy(key, "_b").orderBy(time, tie)
    numbered = b.withColumns({"_seq": F.row_number().over(near), "_p": F.lag(seen(previous)).over(near), "_f": F.lead(seen(following)).over(near)})
    joined = numbered.join(ends, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_b") == F.col("_kb")))
    around = [F.coalesce("_p", "_prior").getField(c).alias(f"previous_{c}") for c in previous] + [F.coalesce("_f", "_next").getField(c).alias(f"following_{c}") for c in following]
    return joined.select(*rows.columns, (F.col("_seq") + F.col("_before")).alias("seq"), *around)


def intervals(marks: DataFrame, key: str, time: str, value: str, bucket_ms: int = ORDER_MS) -> DataFrame:
    """``(key, start, end, value)``: a row wherever the owner of a key changes; ``end`` is the next start (null: open)."""
    some = ordered(marks.where(F.col(key).isNotNull() & F.col(value).isNotNull()).select(key, time, value), key, time, value, (value,), bucket_ms=bucket_ms)
    before = F.col(f"previous_{value}")
    changed = some.where(before.isNull() | (before != F.col(value))).select(key, time, value)
    return ordered(changed, key, time, value, following=(time,), bucket_ms=bucket_ms).select(key, F.col(time).alias("start"), F.col(f"following_{time}").alias("end"), value)


def sessions(rows: DataFrame, key: str, time: str, gap_ms: int, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """``rows`` with ``session``: the time of the first row of the key's session. Rows that are at most ``gap_ms`` apart,
    that included, are of one session. Null keys and times have none."""
    b = rows.withColumn("_b", F.floor(F.col(time) / bucket_ms))
    ends = _carried(b.groupBy(key, "_b").agg(F.max(time).alias("_end")), key, "_end")
    near = W.partitionBy(key, "_b").orderBy(time)
    prev = F.coalesce(F.lag(time).over(near), F.col("_before"))
    flagged = b.join(ends, [key, "_b"], "left").withColumn("_s", F.when(prev.isNull() | (F.col(time) - prev > gap_ms), F.col(time))).drop("_before")
    starts = _carried(flagged.groupBy(key, "_b").agg(F.max("_s").alias("_start")), key, "_start")
    own = F.last("_s", ignorenulls=True).over(near.rangeBetween(W.unboundedPreceding, W.currentRow))
    return flagged.withColumn("_own", own).join(starts, [key, "_b"], "left").withColumn("session", F.coalesce("_own", "_before")).select(*rows.columns, "session")


def first_arrival(rows: DataFrame, key: str, arrival: str) -> DataFrame:
    """One row for each key: the one that arrived first. Keys are reduced before the shuffle."""
    packed = rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), arrival).alias("r"))
    return packed.select("r.*")


def expired(rows: DataFrame, time: str, now_ms: int, retention_ms: int) -> DataFrame:
    """Rows whose time lies strictly before the retention's edge."""
    return rows.where(F.col(time) < now_ms - retention_ms)
