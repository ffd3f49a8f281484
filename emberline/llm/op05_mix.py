"""Operator 5: mixing sources to target weights by Sainte-Lague apportionment.

A source's target is a share of the mix in words. The mix is dealt out in equal blocks of words: the blocks go to the
sources by the highest quotients of their targets, and within a source to its shards by the highest quotients of the
shards' sizes, so every shard has an integer quota. A shard lays its documents end to end in a seeded order, so that the
blocks of its stream are in seeded order too, and takes them from the front, once round and then a second time, as far as
its quota goes.

Only (key, size) rows are shuffled: per source and shard for the sums, per shard for the running totals. A source that
holds a third of all rows is cut into as many shards as its size asks for, in two steps if they are many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from emberline.llm import common
from emberline.storage import materialize

#: Words of a block; words of a shard, and the shards of a source that share its quota at first: a source with more has
#: as many groups of shards, each of which shares its quota among its own.
BLOCK, SHARD_WORDS, FAN = 64, 65536, 4096
#: Weights of the sources by their rank, repeating; words of the mix for each word there is; most takes of a word.
WEIGHTS, SHARE, TIMES = (3, 1, 2), 1.5, 2
SEED = "mix-1"
SPLIT = r"[\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    """Number of words (null: 0)."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPLIT), "")).cast("long")


def sainte_lague(parties: DataFrame, group: list[str], key: str, votes: str, seats: str) -> DataFrame:
    """``parties`` with the column ``won``: how many of its group's ``seats`` a party gets by the highest quotients
    votes / (2 n + 1); ties go to the smaller ``key``. All votes zero: none.

    Rounding moves a group's sum by half a seat for each party at most, so a party's seats lie between its rounded
    shares of ``seats`` minus and plus half the parties, and only quotients in that range are ranked.
    """
    g = W.partitionBy(*group) if group else W.partitionBy()
    v, n, half = F.col(votes).cast("double"), F.col(seats).cast("double"), F.count("*").over(g) / 2
    total = F.sum(v).over(g)
    share = lambda s: F.when(total > 0, F.round(v * s / total)).otherwise(0)
    ranged = parties.withColumn("_low", F.greatest(F.lit(0), share(n - half) - 1).cast("long")).withColumn("_high", (share(n + half) + 1).cast("long"))
    ranged = ranged.withColumn("_open", F.col(seats) - F.sum("_low").over(g))
    tried = ranged.where(F.col(votes) > 0).select(*group, key, "_open", F.explode(F.sequence("_low", "_high")).alias("_n"), v.alias("_v"))
    order = (W.partitionBy(*group) if group else W.partitionBy()).orderBy(F.desc(F.col("_v") / (2 * F.col("_n") + 1)), key)
    more = tried.withColumn("_rank", F.row_number().over(order)).where("_rank <= _open").groupBy(*group, key).agg(F.count("*").alias("_more"))
    return ranged.join(more, [*group, key], "left").withColumn("won", F.col("_low") + F.coalesce("_more", F.lit(0))).drop("_low", "_high", "_open", "_more")


def targets(sources: DataFrame) -> DataFrame:
    """``sources(source, source_size)`` with ``rank`` (by code point, null last) and ``target``: shares by weight, none
    above ``TIMES`` times its source's size, what is cut off dealt out again by weight."""
    every = W.partitionBy()
    ranked = sources.withColumn("rank", F.row_number().over(every.orderBy(F.asc_nulls_last("source"))))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("rank") - 1) % len(WEIGHTS) + 1).cast("int")).cast("double")
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(TIMES))
    order = every.orderBy(F.col("cap") / F.col("weight"), "rank")
    full = F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(W.currentRow, W.unboundedFollowing))
    level = (F.sum("source_size").over(every) * SHARE - full) / rest
    ranked = ranked.withColumn("level", level).withColumn("place", F.row_number().over(order))
    found = F.min_by("level", F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("place"))).over(every)
    return ranked.withColumn("target", F.least("cap", F.coalesce(found, F.lit(0.0)) * F.col("weight"))).select("source", "source_size", "rank", "target")


def apportion(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The columns ``carry`` of every row with ``size``, ``source_size``, ``target`` and ``taken``.

    Null text: size 0, nothing taken. Null sources are one source, the last. Rows with a null id have their place by
    their text. Rows that repeat an id are rows of their own and lie next to each other in the seeded order, by size and
    text; of equal rows it makes no difference which comes first. An empty table gives an empty result. ``carry`` must
    not hold columns named like the new ones or starting with an underscore.
    """
    tie = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    mark = F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col(id_col).cast("string"), tie)).cast("binary"))
    sized = docs.select(*carry, F.col(source_col).alias("_source"), size_of(F.col(text_col)).alias("size"), mark.alias("_mark"), tie.alias("_tie"))
    sized = materialize(sized, "sized")
    ranked = materialize(targets(sized.groupBy(F.col("_source").alias("source")).agg(F.sum("size").alias("source_size"))), "sources")
    shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / SHARD_WORDS))
    known = ranked.withColumn("groups", F.least(F.lit(FAN), shards)).withColumn("parts", F.ceil(shards / F.col("groups"))).withColumnRenamed("source", "_own")
    number = lambda k: F.conv(F.substring("_mark", k, 8), 16, 10).cast("long")
    rows = sized.join(known, F.col("_source").eqNullSafe(F.col("_own"))).withColumn("group", number(1) % F.col("groups")).withColumn("shard", number(9) % F.col("parts"))

    blocks = ranked.withColumn("blocks", F.round(F.sum("target").over(W.partitionBy()) / BLOCK).cast("long"))
    seats = sainte_lague(blocks, [], "rank", "target", "blocks").select("rank", "won")
    parts = materialize(rows.groupBy("rank", "group", "shard").agg(F.sum("size").alias("shard_size")), "shards")
    groups = parts.groupBy("rank", "group").agg(F.sum("shard_size").alias("group_size")).join(seats.withColumnRenamed("won", "for_source"), "rank")
    groups = sainte_lague(groups, ["rank"], "group", "group_size", "for_source").select("rank", "group", F.col("won").alias("for_group"))
    quota = sainte_lague(parts.join(groups, ["rank", "group"]), ["rank", "group"], "shard", "shard_size", "for_group")
    words = F.least(F.col("won") * BLOCK, F.col("shard_size") * TIMES)
    quota = quota.where("shard_size > 0").select("rank", "group", "shard", F.floor(words / F.col("shard_size")).alias("times"), (words % F.col("shard_size")).alias("rest"))
    quota = materialize(quota, "quota")

    order = W.partitionBy("rank", "group", "shard").orderBy("_mark", "size", "_tie")
    end = F.sum("size").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    laid = rows.withColumn("_end", end).join(quota, ["rank", "group", "shard"], "left")
    taken = F.col("times") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("_end"), F.col("rest")) - (F.col("_end") - F.col("size")))
    return laid.select(*carry, "size", "source_size", "target", F.coalesce(taken, F.lit(0)).cast("long").alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a document's text once for each whole take, and once more cut after
    its last taken word. ``n_chars``, if there is such a column, is the new text's length. Documents of which no word is
    taken are left out."""
    names = docs.columns
    boxed = docs.select(F.struct(*names).alias("_row"), "doc_id", "text", "source")  # no column can clash with the new ones
    rows = apportion(boxed, ("_row",)).where("taken > 0").withColumn("_text", F.col("_row.text"))
    part = F.col("taken") % F.col("size")
    lead = F.when(F.col("_text").rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0)
    rest = F.element_at(F.split("_text", SPLIT, (part + 1 + lead).cast("int")), -1)
    cut = F.regexp_replace(F.left("_text", F.length("_text") - F.length(rest)), r"[\x20\x09-\x0D]+$", "")
    copies = F.array_repeat("_text", F.floor(F.col("taken") / F.col("size")).cast("int"))
    made = rows.withColumn("_new", F.explode(F.when(part > 0, F.concat(copies, F.array(cut))).otherwise(copies)))
    new = {"text": F.col("_new"), "n_chars": F.length("_new")}
    return made.select(*(new[c].cast(docs.schema[c].dataType).alias(c) if c in new else F.col("_row").getField(c).alias(c) for c in names))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apportion(common.table(spark, sf_dir, "documents")).withColumn("target", F.round("target", 6))


#: As written for sources of up to ``FAN`` shards, where every group has one.
ORACLE = rf"""
WITH sized AS (
  SELECT doc_id, source, md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS mark, md5(coalesce(text, '')) AS tie,
    CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s),
c AS (SELECT *, CAST([3, 1, 2][(rank - 1) % 3 + 1] AS DOUBLE) AS weight, source_size * 2.0::DOUBLE AS cap FROM w),
o AS (SELECT *, row_number() OVER (ORDER BY cap / weight, rank) AS place,
    ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
t AS (SELECT source, source_size, rank, least(cap, weight * coalesce((SELECT min_by(level, place) FROM o WHERE level <= cap / weight), 0)) AS target FROM o),
b AS (SELECT *, CAST(round(sum(target) OVER () / {BLOCK}) AS BIGINT) AS blocks, sum(target) OVER () AS total FROM t),
q AS (SELECT rank, target / (2 * n + 1) AS quotient, blocks FROM b, LATERAL (SELECT unnest(range(0, CAST(round(target * (blocks + (SELECT count(*) FROM t)) / total) AS BIGINT) + 2)) AS n) WHERE target > 0),
g AS (SELECT rank, count(*) AS won FROM (SELECT *, row_number() OVER (ORDER BY quotient DESC, rank) AS r FROM q) WHERE r <= blocks GROUP BY rank),
d AS (SELECT z.*, t.rank, t.source_size, t.target,
    CAST('0x' || substr(mark, 1, 8) AS BIGINT) % least({FAN}, greatest(1, CAST(ceil(source_size / {SHARD_WORDS}.0) AS BIGINT))) AS shard
  FROM sized z JOIN t ON z.source IS NOT DISTINCT FROM t.source),
p AS (SELECT rank, shard, CAST(sum(size) AS BIGINT) AS shard_size FROM d GROUP BY ALL),
e AS (SELECT p.*, coalesce(g.won, 0) AS won, sum(shard_size) OVER (PARTITION BY p.rank) AS total, count(*) OVER (PARTITION BY p.rank) AS parties FROM p LEFT JOIN g USING (rank)),
f AS (SELECT rank, shard, shard_size::DOUBLE / (2 * n + 1) AS quotient, won FROM e, LATERAL (SELECT unnest(range(0, CAST(round(shard_size * (won + parties) / total) AS BIGINT) + 2)) AS n) WHERE shard_size > 0),
h AS (SELECT rank, shard, count(*) AS quota FROM (SELECT *, row_number() OVER (PARTITION BY rank ORDER BY quotient DESC, shard) AS r FROM f) WHERE r <= won GROUP BY ALL),
k AS (SELECT e.rank, e.shard, shard_size, least(coalesce(quota, 0) * {BLOCK}, shard_size * 2) AS words FROM e LEFT JOIN h USING (rank, shard) WHERE shard_size > 0),
l AS (SELECT d.*, k.shard_size, words, sum(size) OVER (PARTITION BY d.rank, d.shard ORDER BY mark, size, tie ROWS UNBOUNDED PRECEDING) AS fin FROM d LEFT JOIN k USING (rank, shard))
SELECT doc_id, size, source_size, round(target, 6) AS target,
  CAST(coalesce((words // shard_size) * size + greatest(0, least(fin, words % shard_size) - (fin - size)), 0) AS BIGINT) AS taken FROM l
"""
