"""Materialised intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_COLLECTORS: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where it is unset a new temporary folder, on one machine only: with
    executors elsewhere that is an error, as they would not see each other's files."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="emberline-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: later stages start from the files, so a
    lost executor costs a re-read and not a recomputation, and every reader sees the same rows."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table = path
    for collector in _COLLECTORS:
        collector.append(path)
    return out


def remove(spark: SparkSession, paths: Iterable[str]) -> None:
    """Deletes tables that nothing reads any more; those that are gone already are no error."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Deletes materialised tables once all that was made of them has been written."""
    for t in tables:
        remove(t.sparkSession, [t._table])


@contextmanager
def collected() -> Iterator[list[str]]:
    """The paths of the tables that are materialised meanwhile."""
    paths: list[str] = []
    _COLLECTORS.append(paths)
    try:
        yield paths
    finally:
        _COLLECTORS.remove(paths)
