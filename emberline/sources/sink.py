"""A Spark data sink for result documents: staged by tasks, published once all have come.

The store is reached through functions named as ``module:function``, so that any client can stand behind it; with the option
``source`` they get that text first. ``stage(token, documents)`` takes a task's documents, where nobody sees them yet;
``publish(tokens)`` makes what was staged under the tokens visible, each document in place of the one with its ``id``, and
must do no harm if it is called again; ``discard(tokens)`` drops it. A task that is killed may leave what it has staged:
nobody sees it, and the store drops it by age. A document is a dictionary of ``id`` and ``document``,
JSON text or null: that id is to be deleted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from emberline.sources.paged import _bound
from emberline.streaming.tables import BUCKETS, Keyed

SCHEMA = "id string, document string"
_KEY = ("cluster_id", "part", "block")


@dataclass
class Staged(WriterCommitMessage):
    token: str


class _Writer(DataSourceWriter):
    def __init__(self, options) -> None:
        self.o = options

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        token = f"{self.o.get('batch', '0')}-{TaskContext.get().taskAttemptId()}"
        try:
            _bound(self.o, "stage")(token, (row.asDict() for row in rows))
        except BaseException:
            _bound(self.o, "discard")([token])
            raise
        return Staged(token)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        _bound(self.o, "publish")([m.token for m in messages if m is not None])

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        _bound(self.o, "discard")([m.token for m in messages if m is not None])


class DocumentSink(DataSource):
    """Options: ``stage``, ``publish``, ``discard`` (required), ``source``, ``batch``."""

    @classmethod
    def name(cls) -> str:
        return "document_sink"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool):
        return _Writer(self.options)


class Results:
    """Writes those documents that changed since they were written last, and deletes those that a chain no longer has. What
    was written is known by the hash of each document without the time of writing, in a keyed table of the stream's state."""

    def __init__(self, spark: SparkSession, state: str, options: dict[str, str], buckets: int = BUCKETS) -> None:
        schema = T.StructType.fromDDL("cluster_id string, part string, block long, fingerprint string")
        self.spark, self.options = spark, options
        self.written = Keyed(spark, f"{state.rstrip('/')}/written", "cluster_id", _KEY, schema, buckets)
        spark.dataSource.register(DocumentSink)

    def write(self, documents: DataFrame, batch: int, ended: DataFrame | None = None) -> None:
        """``documents(cluster_id, part, block, document)`` of the chains that changed; ``ended(cluster_id)``: chains whose
        documents go. A batch that is written again puts the same documents in the same places."""
        marked = documents.withColumn("fingerprint", F.sha2(F.regexp_replace("document", r'"written_at":\d+', ""), 256))
        chains = documents.select("cluster_id") if ended is None else documents.select("cluster_id").union(ended.select("cluster_id"))
        known = self.written.lookup(chains, batch)
        changed = marked.join(known.withColumnRenamed("fingerprint", "was"), list(_KEY), "left").where("was is null or was <> fingerprint").drop("was")
        gone = known.join(marked, list(_KEY), "left_anti").select(*_KEY)
        name = F.concat_ws("#", *_KEY).alias("id")
        rows = changed.select(name, "document").unionByName(gone.select(name, F.lit(None).cast("string").alias("document")))
        rows.write.format("document_sink").mode("append").options(**self.options, batch=str(batch)).save()
        self.written.write(changed.select(*self.written.schema.names), gone, batch)
        self.written.merge(batch)
