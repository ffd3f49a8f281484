"""Operator 2: chat formatting by multi-party perspective rotation.

A dialogue is rendered once for each of its participants: that speaker's turns become the assistant's, the others stay
users and are named, and a mask marks the characters that the assistant is trained on. System turns keep their role in
every rendering and have no rendering of their own.

A rendering is cut into blocks of ``BLOCK`` turn numbers, and a block with more than ``ROWS`` rows (many of one turn
number) into parts of so many, so that a conversation that holds a third of all rows is many groups of bounded size and
not one; ordinary dialogues are one block of one part. Only DataFrame expressions are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from emberline.llm import common

#: Turn numbers of a block, rows of a part; the role that is no participant.
BLOCK, ROWS, SYSTEM = 64, 1024, "system"
START, END = "<|im_start|>", "<|im_end|>"


def rotate(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(id_col, perspective, block, part, rendered, spans, n_turns, n_trained)``, a row for each dialogue, participant and
    part of a block of turns. ``spans`` are pairs of character offsets [start, end) into ``rendered``: the assistant's contents
    with their end marks. A rendering is its blocks and parts one after another.

    A null role speaks as ``unknown``, a null text is empty; turns without a dialogue or a turn number have no place and
    are left out. Equal rows count once; different rows with one turn number stand in the order of role and text. A
    dialogue of system turns alone has no rendering. Marks within a text or a role are broken up so that they can't be mistaken, and a
    role's line breaks are spaces in a head, so no role can begin a turn.
    Other columns aren't read; an empty table gives an empty result.
    """
    rows = turns.where(F.col(id_col).isNotNull() & F.col(turn_col).isNotNull()).select(
        F.col(id_col).alias("_id"), F.col(turn_col).cast("long").alias("_turn"), F.coalesce(F.col(role_col), F.lit("unknown")).alias("_role"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")
    ).distinct()
    place = F.row_number().over(W.partitionBy("_id", "_block").orderBy("_turn", "_role", "_text"))
    rows = rows.withColumn("_block", F.floor(F.col("_turn") / BLOCK)).withColumn("_part", F.floor((place - 1) / ROWS))
    speakers = rows.where(F.col("_role") != SYSTEM).select("_id", F.col("_role").alias("perspective")).distinct()
    seen = rows.join(speakers, "_id")
    mine = F.col("_role") == F.col("perspective")
    head = F.when(mine, F.lit(f"{START}assistant\n")).when(F.col("_role") == SYSTEM, F.lit(f"{START}system\n")).otherwise(F.concat(F.lit(f"{START}user name="), F.translate(F.replace("_role", F.lit("<|"), F.lit("< |")), "\n\r", "  "), F.lit("\n")))
    body = F.concat(F.replace("_text", F.lit("<|"), F.lit("< |")), F.lit(f"{END}\n"))
    piece = F.struct(F.col("_turn").alias("turn"), F.col("_role").alias("role"), body.alias("body"), head.alias("head"), mine.alias("mine"))
    blocks = seen.groupBy("_id", "perspective", F.col("_block").alias("block"), F.col("_part").alias("part")).agg(F.sort_array(F.collect_list(piece)).alias("pieces"))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(s, x):
        start = s["at"] + F.length(x["head"])
        end = start + F.length(x["body"])
        one = F.struct(start.alias("start"), (end - 1).alias("end"))
        return F.struct(end.alias("at"), F.when(x["mine"], F.concat(s["spans"], F.array(one))).otherwise(s["spans"]).alias("spans"))

    spans = F.aggregate("pieces", empty, step)["spans"]
    return blocks.select(
        F.col("_id").alias(id_col), "perspective", "block", "part",
        F.array_join(F.transform("pieces", lambda x: F.concat(x["head"], x["body"])), "").alias("rendered"),
        spans.alias("spans"), F.size("pieces").cast("long").alias("n_turns"), F.size(spans).cast("long").alias("n_trained"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rotate(common.table(spark, sf_dir, "conversations"))
    shown = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.withColumn("spans", shown)


ORACLE = f"""
WITH r AS (SELECT DISTINCT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
n AS (SELECT *, CAST(floor(turn / {BLOCK}) AS BIGINT) AS block, (row_number() OVER (PARTITION BY conv_id, floor(turn / {BLOCK}) ORDER BY turn, role, text) - 1) // {ROWS} AS part FROM r),
p AS (SELECT DISTINCT conv_id, role AS perspective FROM r WHERE role <> '{SYSTEM}'),
s AS (SELECT conv_id, perspective, turn, role, role = perspective AS mine, block, part,
    CASE WHEN role = perspective THEN '{START}assistant' WHEN role = '{SYSTEM}' THEN '{START}system' ELSE '{START}user name=' || replace(replace(replace(role, '<|', '< |'), chr(10), ' '), chr(13), ' ') END || chr(10) AS head,
    replace(text, '<|', '< |') || '{END}' || chr(10) AS body FROM n JOIN p USING (conv_id)),
o AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective, block, part ORDER BY turn, role, body ROWS UNBOUNDED PRECEDING) AS fin FROM s)
SELECT conv_id, perspective, block, part, string_agg(head || body, '' ORDER BY turn, role, body) AS rendered,
  coalesce(string_agg(CASE WHEN mine THEN CAST(fin - length(body) AS VARCHAR) || ':' || CAST(fin - 1 AS VARCHAR) END, ',' ORDER BY turn, role, body), '') AS spans,
  count(*) AS n_turns, count(*) FILTER (WHERE mine) AS n_trained FROM o GROUP BY conv_id, perspective, block, part
"""
