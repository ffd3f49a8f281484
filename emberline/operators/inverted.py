"""A saved inverted index: postings in blocks with bounds of their scores, exact ranking over pruned blocks, merging.

An index is a folder of numbered segments, each written once. A segment lays its documents out by length in ranges of
``BLOCK``; a posting row holds the documents of one range that have a word, and ``peak``, the largest share of the word's
weight that any of them reaches. Words' and ranges' bounds come from the peaks without reading the postings: what can't
reach a query's k-th score so far is never opened.

Counts of words and documents are kept as differences: a segment that replaces documents of earlier ones subtracts theirs
and lists them as dead. A segment counts once its last table is committed; what a failed attempt left is overwritten.
One writer at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from emberline.operators import search
from emberline.operators.search import B, K1
from emberline.storage import discard, materialize

#: Documents of a range, and the ranges of a query that are scored before the others are held against its k-th score.
BLOCK_BITS, FIRST = 4, 16
BLOCK = 1 << BLOCK_BITS
#: Scores equal to six places are ties, so a bound this far below the k-th score may still hold one.
SLACK = 2e-6
_PLACE = ["segment", "range"]


def _share(mean: Column) -> Column:
    """The part of a word's full weight that ``tf`` occurrences in a text of ``length`` words have."""
    return F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("length") / mean))


@dataclass(frozen=True)
class Index:
    """The index in the folder ``path``, which all executors must reach. Ids of any type that can be ordered."""

    spark: SparkSession
    path: str

    def segments(self) -> list[str]:
        """The folders of the committed segments, oldest first."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/*/stats/_SUCCESS")
        found = at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).globStatus(at)
        return sorted(f.getPath().getParent().getParent().toString() for f in found or [])

    def table(self, name: str) -> DataFrame:
        """A table of all segments: ``docs``, ``dead``, ``postings``, ``terms`` or ``stats``."""
        segments = self.segments()
        if not segments:
            raise ValueError(f"{self.path} has no index")
        return self.spark.read.parquet(*(f"{s}/{name}" for s in segments))

    def add(self, docs: DataFrame) -> Index:
        """Adds ``docs(uid, title, body)`` as one segment. A document whose uid is there replaces it; rows with one uid are
        one document with the words of all, rows without a uid are left out, documents without words count as documents."""
        docs = docs.where("uid is not null")
        tf = materialize(search.term_counts(docs), "index-words")
        self._write(docs.select("uid").distinct(), tf)
        discard(tf)
        return self

    def compact(self, path: str) -> Index:
        """The same index as one segment of a new folder, without dead documents."""
        hits = self.table("postings").select("t", "segment", F.inline("hits"))
        tf = materialize(self._alive(hits).select("uid", "t", "tf"), "index-words")
        out = Index(self.spark, path)
        out._write(self._alive(self.table("docs")).select("uid"), tf)
        discard(tf)
        return out

    def _alive(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.table("dead"), ["segment", "uid"], "left_anti")

    def _write(self, ids: DataFrame, tf: DataFrame) -> None:
        number = len(self.segments()) + 1
        folder = f"{self.path}/{number:06}"

        def save(name: str, df: DataFrame) -> DataFrame:
            df.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/{name}")
            return self.spark.read.schema(df.schema).parquet(f"{folder}/{name}")

        sized = ids.join(tf.groupBy("uid").agg(F.sum("tf").alias("length")), "uid", "left").select("uid", F.coalesce("length", F.lit(0)).alias("length"))
        laid = sized.repartitionByRange("length", "uid").sortWithinPartitions("length", "uid")
        docs = save("docs", laid.select(F.lit(number).alias("segment"), F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS).alias("range"), "uid", "length"))
        counts = lambda df, sign: df.agg(*(F.coalesce(sign * c, F.lit(0)).cast("long").alias(n) for n, c in (("docs", F.count("*")), ("worded", F.count_if(F.col("length") > 0)), ("words", F.sum("length")))))
        mean = docs.where("length > 0").agg(F.avg("length")).first()[0] or 1.0
        # A range is whole in a task, so that its words are gathered without another shuffle.
        of = tf.join(docs, "uid").repartition(*_PLACE).groupBy("t", *_PLACE).agg(F.collect_list(F.struct("uid", "tf", "length")).alias("hits"), F.max(_share(F.lit(mean))).alias("peak"))
        postings = save("postings", of.withColumn("mean", F.lit(mean)).sortWithinPartitions("t", "range"))
        terms = postings.groupBy("t").agg(F.sum(F.size("hits")).alias("df"))
        stats = counts(docs, 1)
        if number == 1:
            save("dead", docs.select("segment", "uid").limit(0))
        else:
            gone = self._alive(self.table("docs")).join(docs.select("uid"), "uid", "left_semi").select("segment", "range", "uid", "length")
            gone = save("replaced", gone)
            save("dead", gone.select("segment", "uid"))
            opened = self.table("postings").join(gone.select(*_PLACE).distinct(), _PLACE, "left_semi").select("t", "segment", F.inline("hits"))
            less = opened.join(gone.select("segment", "uid"), ["segment", "uid"], "left_semi").groupBy("t").agg((-F.count("*")).alias("df"))
            terms, stats = terms.unionByName(less), stats.unionByName(counts(gone, -1))
        save("terms", terms)
        save("stats", stats)

    def weights(self, queries: DataFrame) -> DataFrame:
        """``(query, t, weight)``: the words of ``queries(query, text)`` that some document has, with their full weight."""
        n = self.table("stats").agg(F.sum("docs")).first()[0]
        asked = search.asked_words(queries)
        df = self.table("terms").join(asked.select("t").distinct(), "t", "left_semi").groupBy("t").agg(F.sum("df").alias("df")).where("df > 0")
        return asked.join(df.select("t", search.rarity(F.lit(n), F.col("df")).alias("idf")), "t").select("query", "t", (F.col("n") * F.col("idf") * (K1 + 1)).alias("weight"))

    def mean(self) -> float:
        worded, words = self.table("stats").agg(F.sum("worded"), F.sum("words")).first()
        return words / worded if worded else 1.0

    def blocks(self, weights: DataFrame) -> DataFrame:
        """``(query, t, weight, segment, range, bound)``: the ranges that have a word of a query, and the most that it adds to
        a score there. A longer mean length than at the segment's time lifts a share by no more than their ratio."""
        lift = F.greatest(F.lit(1.0), F.lit(self.mean()) / F.col("mean"))
        peaks = self.table("postings").select("t", *_PLACE, (F.col("peak") * lift).alias("peak"))
        return weights.join(peaks, "t").select("query", "t", "weight", *_PLACE, (F.col("weight") * F.col("peak")).alias("bound"))

    def scores(self, blocks: DataFrame) -> DataFrame:
        """``(query, segment, range, uid, score)``: what the postings of ``blocks`` add up to for each document."""
        wanted = blocks.select("query", "t", "weight", *_PLACE)
        hits = wanted.join(self.table("postings").select("t", *_PLACE, "hits"), ["t", *_PLACE]).select("query", *_PLACE, "weight", F.inline("hits"))
        return self._alive(hits).groupBy("query", *_PLACE, "uid").agg(F.sum(F.col("weight") * _share(F.lit(self.mean()))).alias("score"))

    def top(self, queries: DataFrame, k: int, first: int = FIRST) -> DataFrame:
        """``(query, rank, uid, score)`` as ``search.bm25`` over the documents of the index gives them."""
        return search.top(self.search(queries, k, first)[0], k)

    def search(self, queries: DataFrame, k: int, first: int = FIRST) -> tuple[DataFrame, DataFrame]:
        """``(query, uid, score)`` of all documents that may be among the best ``k`` of a query, and the blocks whose postings
        were read for them.

        The ``first`` ranges of a query by bound are scored whole; the k-th score there is the least that counts. In every
        other range that may reach it, the words of least bound that together stay below it are light: a document with light
        words alone is out. So documents come from the heavy words, and light ones are read only in ranges where a document
        reaches the least score with all that light words could add.
        """
        key = ["query", *_PLACE]
        blocks = materialize(self.blocks(materialize(self.weights(queries), "index-weights")), "index-blocks")
        every = materialize(blocks.groupBy(*key).agg(F.sum("bound").alias("whole")), "index-ranges")
        order = F.row_number().over(W.partitionBy("query").orderBy(F.desc("whole"), *_PLACE))
        best = materialize(every.withColumn("n", order).where(F.col("n") <= first).select(*key), "index-first")
        opened = blocks.join(best, key, "left_semi")
        seen = materialize(self.scores(opened), "index-scores")
        place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "uid"))
        least = seen.withColumn("place", place).where(F.col("place") == max(k, 1)).select("query", (F.col("score") - SLACK).alias("least"))
        reach = lambda c: F.coalesce(c >= F.col("least"), F.lit(True))
        rest = every.join(best, key, "left_anti").join(least, "query", "left").where(reach(F.col("whole"))).select(*key, "least")
        upto = F.sum("bound").over(W.partitionBy(*key).orderBy("bound", "t").rowsBetween(W.unboundedPreceding, 0))
        words = materialize(blocks.join(rest, key).withColumn("heavy", reach(upto)), "index-words")
        light = words.groupBy(*key).agg(F.first("least").alias("least"), F.sum(F.when(F.col("heavy"), 0.0).otherwise(F.col("bound"))).alias("light"))
        near = self.scores(words.where("heavy")).join(light, key).where(reach(F.col("score") + F.col("light"))).select(*key, "uid", "score")
        near = materialize(near, "index-near")
        late = words.where("not heavy").join(near.select(*key).distinct(), key, "left_semi")
        more = self.scores(late).join(near.select(*key, "uid"), [*key, "uid"], "left_semi")
        found = seen.unionByName(near).unionByName(more).groupBy("query", "uid").agg(F.sum("score").alias("score"))
        return found, opened.select(*key, "t").unionByName(words.where("heavy").select(*key, "t")).unionByName(late.select(*key, "t"))
