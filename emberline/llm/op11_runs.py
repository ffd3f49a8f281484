"""Operator 11: periodic runs of words by Karp-Miller-Rosenberg naming.

Every window of 2^k words gets a name, equal names for equal windows of one document: level 0 names words, a level names
the pairs of names of the level below. Windows that occur once need no name, so higher levels sort few positions. The
common extension of two positions follows from the names by descending levels.

A run of period p holds exactly one multiple of p among its first p positions, so the grid of multiples of p, each held
against its successor, finds every run of period p: n ln n candidates for a document of n words. A candidate whose block
of p words repeats the block before it isn't the first of its run; the first ones are extended to both sides.

Documents are independent: there is no shuffle, and a task holds a few megabytes of text, or one longer document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from emberline.llm import common

#: Text bytes of a chunk, and candidates that are tested at once.
CHUNK_BYTES, AT_ONCE = 4 << 20, 1 << 20
#: The shortest run.
SHORTEST = 12
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True


def _words(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every word; no word crosses the end of a document."""
    if not len(flat):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    black = ~_WHITE[flat]
    edge = np.zeros(len(flat) + 1, bool)
    edge[offsets] = True
    begin, end = black.copy(), black.copy()
    begin[1:] &= ~black[:-1] | edge[1:-1]
    end[:-1] &= ~black[1:] | edge[1:-1]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def _named(keys: np.ndarray) -> np.ndarray:
    """Names from 1 for keys that occur again, 0 for the others."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    first = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    size = np.diff(np.append(first, len(keys)))
    out = np.zeros(len(keys), np.int32)
    out[order] = np.repeat(np.where(size > 1, np.cumsum(size > 1), 0), size)
    return out


def names(words: np.ndarray, doc: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Of word numbers laid end to end: for each level k the names of the windows of 2^k words (0: occurs once in its
    document, or leaves it). ``ends``: where each word's document ends. One more 0 stands past the last word."""
    levels: list[np.ndarray] = []
    at, keys = np.arange(len(words)), (doc.astype(np.int64) << 32) | words.astype(np.int64)
    while len(at):
        found = _named(keys)
        if not found.any():
            break
        level = np.zeros(len(words) + 1, np.int32)
        level[at] = found
        width = 1 << len(levels)
        levels.append(level)
        at = at[found > 0]
        at = at[at + 2 * width <= ends[at]]
        at = at[level[at + width] > 0]
        keys = (level[at].astype(np.int64) << 32) | level[at + width]
    return levels


def _forward(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words from i on equal those from j on."""
    step = np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        name = levels[k][i + step]
        step += ((name > 0) & (name == levels[k][j + step])).astype(np.int64) << k
    return step


def _backward(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words before i equal those before j, i below j."""
    step = np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = i - step - (1 << k), j - step - (1 << k)
        name = levels[k][np.maximum(x, 0)]
        step += ((x >= 0) & (name > 0) & (name == levels[k][np.maximum(y, 0)])).astype(np.int64) << k
    return step


def _blocks_meet(levels: list[np.ndarray], i: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Whether the p words before i equal the p words from i on; i is at least p."""
    out = np.zeros(len(i), bool)
    level = np.frexp(p.astype(np.float64))[1] - 1  # floor(log2 p)
    for k in np.unique(level[level < len(levels)]).tolist():
        on = np.flatnonzero(level == k)
        x, q, name = i[on], p[on], levels[k]
        front, back = name[x - q], name[x - (1 << k)]
        out[on] = (front > 0) & (front == name[x]) & (back > 0) & (back == name[x + q - (1 << k)])
    return out


def runs(words: np.ndarray, sizes: np.ndarray, shortest: int = SHORTEST) -> tuple[np.ndarray, ...]:
    """``(doc, start, length, period)`` of all runs of documents of ``sizes`` words laid end to end, by document, start
    and period. A run is a stretch whose smallest period is q, of at least ``max(shortest, 2 * q)`` words, that can't be
    extended to either side."""
    base = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(len(sizes)), sizes)
    levels = names(words, doc, (base + sizes)[doc])
    half = np.where(sizes >= shortest, sizes // 2, 0)
    owner = np.repeat(np.arange(len(sizes)), half)
    period = np.arange(len(owner)) - (np.cumsum(half) - half)[owner] + 1
    count = (sizes[owner] - 1) // period
    found, upto, at = [], np.cumsum(count), 0
    while at < len(owner) and levels:
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + AT_ONCE, "right")))
        row = np.repeat(np.arange(at, end), count[at:end])
        p = period[row]
        i = base[owner[row]] + p * (np.arange(len(row)) - (upto[row] - count[row] - (upto[at] - count[at])))
        at = end
        name = levels[0][i]
        on = (name > 0) & (name == levels[0][i + p])
        row, p, i = row[on], p[on], i[on]
        inner = np.flatnonzero(i - p >= base[owner[row]])
        on = np.ones(len(row), bool)
        on[inner[_blocks_meet(levels, i[inner], p[inner])]] = False
        row, p, i = row[on], p[on], i[on]
        before = _backward(levels, i, i + p)
        length = before + _forward(levels, i, i + p) + p
        on = length >= np.maximum(shortest, 2 * p)
        found.append((owner[row[on]], (i - before - base[owner[row]])[on], length[on], p[on]))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    d, start, length, p = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((p, length, start, d))  # the same stretch by several periods: the smallest counts
    d, start, length, p = (x[order] for x in (d, start, length, p))
    new = np.concatenate(([True], (d[1:] != d[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])))[: len(d)]
    d, start, length, p = (x[new] for x in (d, start, length, p))
    order = np.lexsort((p, start, d))
    return tuple(x[order].astype(np.int64) for x in (d, start, length, p))


def _find(batches: Iterator[pa.RecordBatch], shortest: int, limit: int) -> Iterator[pa.RecordBatch]:
    for table in common.chunked(batches, "text", limit):
        flat, offsets = common.utf8(table.column("text"))
        begin, end = _words(flat, offsets)
        width = end - begin
        packed = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(begin), [None, pa.py_buffer(np.concatenate(([0], np.cumsum(width))).astype(np.int64)), pa.py_buffer(flat[~_WHITE[flat]])]
        )
        numbers = packed.dictionary_encode().indices.to_numpy()
        sizes = np.diff(np.searchsorted(begin, offsets))
        base = np.cumsum(sizes) - sizes
        d, start, length, period = runs(numbers, sizes, shortest)
        change = np.zeros(len(begin) + 1, np.int64)
        np.add.at(change, base[d] + start + period, 1)
        np.add.at(change, base[d] + start + length, -1)
        kept = np.flatnonzero(np.cumsum(change)[:-1] == 0)
        line = np.append(flat, np.uint8(0))[common.spread(begin[kept], width[kept] + 1)]
        close = np.cumsum(width[kept] + 1)
        line[close - 1] = 0x20
        stop = np.concatenate(([0], close))[np.searchsorted(kept, np.append(base, len(begin)))]
        text = line.tobytes()
        texts = [text[a : max(a, b - 1)] for a, b in zip(stop[:-1].tolist(), stop[1:].tolist())]
        cuts = np.searchsorted(d, np.arange(len(sizes) + 1)).astype(np.int32)
        values = pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], ["start", "length", "period"])
        out = [table.column(0).combine_chunks(), pa.array(sizes), pa.ListArray.from_arrays(pa.array(cuts), values), pa.array(texts, pa.binary())]
        yield from pa.Table.from_arrays(out, [table.schema.names[0], "n_words", "runs", "collapsed"]).to_batches(max_chunksize=2000)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``(id_col, n_words, runs, collapsed)`` for every row: all runs by start and period, and the words joined by one
    space without those that only repeat: a run's words after its first period.

    Words are ``[^\\x20\\x09-\\x0D]+``. A null text, or one without words, has no runs and an empty collapsed text; rows
    with a null or repeated id have a result each; an empty table gives an empty one. Other columns aren't read, so their
    names can't clash. Runs of one document may overlap; equal stretches are reported once, by their smallest period. A
    document is held whole, at about 4 bytes a word and level: 100 bytes a word for the longest.
    """
    common.small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(lambda it: _find(it, shortest, chunk_bytes), f"id {kind}, n_words bigint, runs {RUNS}, collapsed binary").withColumnRenamed("id", id_col)


def _planted() -> Column:
    """The text of which a tenth of the documents, by the crc32 of their id, have made the tail periodic."""
    return F.expr(
        r"""CASE WHEN h % 10 = 0 AND size(w) > 0 THEN array_join(transform(sequence(0, size(w) - 1), i -> get(w,
            CAST(IF(i < g % size(w), i, g % size(w) + (i - g % size(w)) % (1 + (size(w) - g % size(w)) DIV (3 + g % 8))) AS INT))), ' ')
            ELSE text END"""
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(common.WORD), F.lit(0)))
    text = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"), words.alias("w")).select("doc_id", _planted().alias("text"))
    found = periodic_runs(text)
    longest = F.expr("array_max(transform(runs, r -> struct(r.length AS l, -r.start AS s, -r.period AS p, r AS r))).r")
    lines = F.expr(r"array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return found.withColumn("r", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "r.start", "r.length", "r.period",
        F.expr("1000 * r.length DIV r.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
