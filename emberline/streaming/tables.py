"""Tables of a stream: small ones that are replaced whole, and large ones by key, of which a batch reads and writes only
the rows it touches. Both survive replays: what a batch writes lies in folders of its own number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from emberline.storage import remove

#: Buckets of a keyed table, and changes that are kept before they are merged into a whole.
BUCKETS, MERGE_AFTER = 32, 12


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the whole folders ``<name>=<number>`` below a path."""
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(top):
        return []
    done = [x.getPath() for x in fs.listStatus(top) if fs.exists(jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS"))]
    return sorted(int(x.getName().split("=")[1]) for x in done)


def latest_by_key(rows: DataFrame, key: str, version: Column) -> DataFrame:
    """The row of each key with the highest version; keys are reduced before the shuffle."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), version).alias("r")).select("r.*")


class Versioned:
    """A table kept as one folder for each batch; a pointer of Parquet files names the batch that counts.

    A batch that is run again writes its folder again and gives the same table, so a replay after a failure is harmless.
    Only Spark reads and writes the folders: they may lie in any store. Folders that no replay can ask for are deleted.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _batches(self) -> list[int]:
        return _numbers(self.spark, self.path)

    def read(self, before: int | None = None) -> DataFrame | None:
        """The newest version, or the newest of a batch before ``before``."""
        have = [b for b in self._batches() if before is None or b < before]
        return self.spark.read.parquet(f"{self.path}/v={have[-1]}") if have else None

    def write(self, rows: DataFrame, batch: int) -> DataFrame:
        out = f"{self.path}/v={batch}"
        rows.write.mode("overwrite").parquet(out)
        earlier = [b for b in self._batches() if b < batch]
        remove(self.spark, [f"{self.path}/v={b}" for b in earlier[:-1]])
        return self.spark.read.schema(rows.schema).parquet(out)

    def upsert(self, rows: DataFrame, batch: int, key: str, version: Column) -> DataFrame:
        """The table with ``rows`` put in by key: of two rows with a key the higher version stays."""
        before = self.read(batch)
        every = rows if before is None else before.unionByName(rows, allowMissingColumns=True)
        return self.write(latest_by_key(every, key, version), batch)


class Keyed:
    """A table of rows by key, as changes by batch and, every few batches, a whole.

    Rows lie in buckets by the hash of the column ``by``, which is part of the key. ``lookup`` opens only the buckets that
    hold the values asked for, ``write`` adds the rows that changed and the keys that are gone. A batch may write in two
    steps. The state before a batch is what lower numbers have written, whatever a failed run of the batch has left.
    """

    def __init__(self, spark: SparkSession, path: str, by: str, key: tuple[str, ...], schema: T.StructType | None = None, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.by, self.key, self.schema, self.buckets = spark, path.rstrip("/"), by, key, schema, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.by), F.lit(self.buckets)).cast("int")

    def _stored(self, before: int) -> list[DataFrame]:
        """The files of the newest whole and of the changes since, below a version."""
        wholes = [v for v in _numbers(self.spark, f"{self.path}/whole") if v < before]
        changes = [v for v in _numbers(self.spark, f"{self.path}/change") if v < before and (not wholes or v > wholes[-1])]
        schema = T.StructType([*self.schema, T.StructField("_gone", T.BooleanType()), T.StructField("_v", T.IntegerType()), T.StructField("_b", T.IntegerType())])
        read = lambda kind, vs: self.spark.read.schema(schema).option("basePath", f"{self.path}/{kind}").parquet(*(f"{self.path}/{kind}/_v={v}" for v in vs))
        return [read(kind, vs) for kind, vs in (("whole", wholes[-1:]), ("change", changes)) if vs]

    def _latest(self, parts: list[DataFrame]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        last = rows.groupBy(*self.key).agg(F.max_by(F.struct(*self.schema.names, "_gone"), "_v").alias("r"))
        return last.where("not r._gone").select(*(F.col("r").getField(c).alias(c) for c in self.schema.names))

    def read(self, batch: int | None = None, step: int = 0) -> DataFrame:
        """All rows: as they are now, or as batch ``batch`` finds them at its ``step``."""
        return self._latest(self._stored(1 << 30 if batch is None else 2 * batch + step))

    def lookup(self, keys: DataFrame, batch: int, step: int = 0) -> DataFrame:
        """The rows whose column ``by`` is among the first column of ``keys``. The numbers of buckets, at most ``buckets``,
        reach the driver."""
        stored = self._stored(2 * batch + step)
        if not stored:
            return self._latest([])
        asked = keys.select(F.col(keys.columns[0]).alias(self.by)).where(F.col(self.by).isNotNull()).distinct()
        buckets = [r[0] for r in asked.select(self._bucket()).distinct().collect()]
        return self._latest([p.where(F.col("_b").isin(buckets)).join(asked, self.by, "left_semi") for p in stored] if buckets else [])

    def files(self, keys: DataFrame, batch: int) -> list[str]:
        """The files that a lookup opens."""
        buckets = {r[0] for r in keys.select(F.col(keys.columns[0]).alias(self.by)).select(self._bucket()).distinct().collect()}
        names = [f for p in self._stored(2 * batch) for f in p.inputFiles()]
        return [f for f in names if any(f"/_b={b}/" in f for b in buckets)]

    def write(self, rows: DataFrame | None, gone: DataFrame | None, batch: int, step: int = 0) -> None:
        """``rows`` replace those of equal keys, and rows with a key of ``gone`` are deleted unless ``rows`` has it too."""
        parts = []
        if rows is not None:
            parts.append(rows.select(*(F.col(f.name).cast(f.dataType) for f in self.schema), F.lit(False).alias("_gone")))
        if gone is not None:
            lost = gone.select(*self.key).distinct()
            lost = lost if rows is None else lost.join(rows.select(*self.key), list(self.key), "left_anti")
            parts.append(lost.select(*(F.col(f.name) if f.name in self.key else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema), F.lit(True).alias("_gone")))
        every = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        self._put(every, "change", 2 * batch + step)

    def _put(self, rows: DataFrame, kind: str, version: int) -> None:
        rows.withColumn("_b", self._bucket()).repartition("_b").write.mode("overwrite").partitionBy("_b").parquet(f"{self.path}/{kind}/_v={version}")

    def merge(self, batch: int, after: int = MERGE_AFTER) -> None:
        """Once ``after`` changes have come together, a whole is written of them. What lies before the last whole but one
        is deleted: a batch that is run again finds the state before it."""
        wholes, changes = (_numbers(self.spark, f"{self.path}/{kind}") for kind in ("whole", "change"))
        if len([v for v in changes if not wholes or v > wholes[-1]]) < after:
            return
        self._put(self.read(batch + 1).withColumn("_gone", F.lit(False)), "whole", 2 * batch + 1)
        keep = wholes[-1] if wholes else -1
        old = [f"{self.path}/whole/_v={v}" for v in wholes[:-1]] + [f"{self.path}/change/_v={v}" for v in changes if v <= keep]
        remove(self.spark, old)
