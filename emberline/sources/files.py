"""Alert files: newline-delimited JSON, a JSON array, or CSV with a header; and search hits and technique bundles."""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

RAW = ("raw", "payload", "fallback_uid", "received_ms", "source")


def _raw(rows: DataFrame, payload: Column, source: str, received_ms: int | None, fallback: Column | None = None) -> DataFrame:
    """Only objects are records; the rest is left out."""
    now = received_ms if received_ms is not None else int(time.time() * 1000)
    uid = fallback if fallback is not None else F.substring(F.sha2(F.col("raw"), 256), 1, 16)
    made = rows.select("raw", payload.alias("payload"), uid.alias("fallback_uid"), F.lit(now).cast("long").alias("received_ms"), F.lit(source).alias("source"))
    return made.where(F.schema_of_variant("payload").startswith("OBJECT"))


def read_ndjson(spark: SparkSession, path: str, received_ms: int | None = None) -> DataFrame:
    """A record for each line; ``raw`` is the line itself. Blank and broken lines and those without an object are left out."""
    return _raw(spark.read.text(path).where(F.trim("value") != "").withColumnRenamed("value", "raw"), F.try_parse_json("raw"), "file", received_ms)


def read_json_array(spark: SparkSession, path: str, received_ms: int | None = None) -> DataFrame:
    """A record for each object of one JSON array; a broken file fails."""
    whole = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    items = whole.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select(F.col("value").alias("item"))
    return _raw(items.withColumn("raw", F.to_json("item")), F.col("item"), "file", received_ms)


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """``(raw, head)``: the rows of CSV files as they are written, line breaks within quotes kept (as ``\\n``); ``head`` marks
    the first row of each file.

    Lines are read in splits, many of a file. A line begins a row where the file has had an even number of quotes before
    it; quotes are counted within the splits and summed up over them, so no file is read in one task, and a row that runs
    over the end of a split is put together again. A quote that is never closed takes the rest of its file into its row.
    """
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"))
    lines = lines.withColumns({"i": F.monotonically_increasing_id(), "q": F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))})
    order = W.partitionBy("f").orderBy("b")
    totals = lines.groupBy("f", "b").agg(F.sum("q").alias("n")).withColumn("quotes", F.coalesce(F.sum("n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    near = W.partitionBy("f", "b").orderBy("i")
    begun = F.coalesce(F.sum("q").over(near.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + F.col("quotes")
    marked = lines.join(totals, ["f", "b"]).withColumn("at", F.when(begun % 2 == 0, F.struct("b", "i")))
    ends = marked.groupBy("f", "b").agg(F.max("at").alias("last"), F.min("at").alias("first"))
    ends = ends.select("f", "b", F.last("last", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1)).alias("open"), F.min("first").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("head"))
    own = marked.withColumn("at", F.last("at", ignorenulls=True).over(near.rowsBetween(W.unboundedPreceding, W.currentRow))).join(ends, ["f", "b"])
    own = own.withColumn("at", F.coalesce("at", "open"))
    rows = own.groupBy("f", "at").agg(F.array_sort(F.collect_list(F.struct("b", "i", "line"))).alias("ls"), F.first("head").alias("head"))
    return rows.select(F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("raw"), (F.col("at") == F.col("head")).alias("head"))


def read_csv(spark: SparkSession, path: str, received_ms: int | None = None) -> DataFrame:
    """A record for each row after the header, all values strings and blank cells empty strings; ``raw`` is the row as it
    is written. Quotes are doubled within quotes. Cells beyond the header are left out."""
    names = spark.read.option("header", True).option("escape", '"').csv(path).columns
    schema = ", ".join(f"`{n}` string" for n in names)
    rows = csv_rows(spark, path).where(~F.col("head") & (F.trim("raw") != ""))
    rows = rows.withColumn("cells", F.from_csv("raw", F.lit(schema), {"escape": '"', "multiLine": "true"}))
    filled = F.struct(*(F.coalesce(F.col("cells").getField(n), F.lit("")).alias(n) for n in names))
    return _raw(rows.withColumn("json", F.to_json(filled)), F.parse_json("json"), "file", received_ms)


def read_records(spark: SparkSession, path: str, received_ms: int | None = None) -> DataFrame:
    """By kind of file: ``.csv``, else a JSON array if the first character that is no space is ``[``, else lines of JSON.
    A missing file fails."""
    if path.lower().endswith(".csv"):
        return read_csv(spark, path, received_ms)
    head = spark.read.text(path).where(F.trim("value") != "").first()
    if head and head.value.lstrip().startswith("["):
        return read_json_array(spark, path, received_ms)
    return read_ndjson(spark, path, received_ms)


def hits(pages: DataFrame, received_ms: int | None = None) -> DataFrame:
    """Search hits ``(hit string)`` as records: the payload is the hit's ``_source`` (or the hit, if it has none), ``raw``
    its encoding, and ``_id`` the fallback id."""
    rows = pages.select(F.try_parse_json("hit").alias("h")).select(F.coalesce(F.try_variant_get("h", "$._source", "variant"), F.col("h")).alias("s"), F.try_variant_get("h", "$._id", "string").alias("_id"))
    return _raw(rows.withColumn("raw", F.to_json("s")), F.col("s"), "index", received_ms, F.coalesce("_id", F.substring(F.sha2("raw", 256), 1, 16)))


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """``(name, files, rows, bytes)`` of the Parquet tables below a path, by name, hidden ones as well: a table is a file
    ``<name>.parquet`` or a folder. The driver lists names; rows are counted from the files' footers, read in tasks without
    their data. A table whose files can't be read has no rows."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path).select("path", "length")
    below = F.expr(f"substring(path, locate('{_tail(path)}/', path) + {len(_tail(path)) + 1})")
    name = F.regexp_replace(F.substring_index(below, "/", 1), r"\.parquet$", "")
    sizes = listed.groupBy(name.alias("name")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
    counted = [(n, _rows(spark, f"{path.rstrip('/')}/{n}")) for n in (r.name for r in sizes.select("name").collect())]
    counts = spark.createDataFrame(counted, "name string, rows long")
    return sizes.join(counts, "name", "left").select("name", "files", F.coalesce("rows", F.lit(0)).alias("rows"), "bytes").orderBy("name")


def _tail(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1]


def _rows(spark: SparkSession, path: str) -> int:
    """The number of a table's rows, which Parquet answers from its footers; 0 if there is no such table."""
    for p in (f"{path}.parquet", path):
        try:
            return spark.read.parquet(p).select().count()
        except AnalysisException:
            continue
    return 0


# The name patterns that are tried on a catalogue, best first.
PATTERNS = (
    ".alerts-security*", ".internal.alerts-*", ".siem-signals-*", "wazuh-alerts-*", "logs-*", "filebeat-*", "winlogbeat-*",
    "auditbeat-*",
)


def suggest(names: DataFrame, patterns: tuple[str, ...] = PATTERNS) -> DataFrame:
    """``names(name)`` -> ``(name, rank)``: the distinct names that match a pattern, by the first pattern that does."""
    likes = ["^" + "".join(".*" if c == "*" else ("\\" + c if not c.isalnum() else c) for c in p) + "$" for p in patterns]
    rank = F.coalesce(*(F.when(F.col("name").rlike(x), F.lit(k)) for k, x in enumerate(likes)))
    return names.select("name").distinct().withColumn("rank", rank).where("rank is not null")
