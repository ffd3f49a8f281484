"""Operator 4: language identification by a linear-chain conditional random field over words.

Every word of a text gets a language by forward-backward. A word's features are its byte n-grams with the word's edges
as marks (so the first and last ones are its affixes) and the word itself as a lexicon entry, all hashed into one weight
table for each language; transitions between the languages of neighbouring words are learnt with them. The training
sequences are documents joined in pairs, so that the model sees switches as well as runs. A text's language is the one
with the largest share of its words' marginals, and that share is the score; runs of words of one language are its spans.

The model is fitted on a bounded sample on the driver; scoring reads each text once and shuffles nothing. Long texts are
taken in pieces, and the chain of a piece in segments that look beyond their ends.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from emberline.llm import common
from emberline.llm.op07_minhash import _mix, _powers
from emberline.storage import discard, materialize

#: Documents that the model is fitted on at most: of each language, their text's bytes in all, and characters of one of
#: them (a longer text counts with its first whole words). Drawn by a hash of id and text.
SAMPLE, SAMPLE_BYTES, SAMPLE_CHARS = 600, 16 << 20, 1 << 16
#: n-gram lengths in bytes, edges included; slots of a weight table for each kind of feature, and of all tables of a kind
#: (more languages have smaller tables).
GRAMS, SLOTS, ALL_SLOTS = (2, 3, 4), 1 << 16, 1 << 20
#: Steps for every ``STEP_LANGUAGES`` languages, documents of a step and of the parts it is summed from (an even number),
#: words of a training sequence (longer ones are cut), learning rate and ridge of the fit.
STEPS, STEP_LANGUAGES, STEP_DOCS, STEP_PART, FIT_WORDS, RATE, RIDGE = 40, 8, 160, 16, 500, 0.2, 1e-4
#: Bytes of text taken at once; words of a segment, and words beyond it that its chain looks at.
TILE_BYTES, SEGMENT, BEYOND = 1 << 19, 2048, 32
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
#: What ends a word: any character of ASCII but its letters.
_BREAK = re.compile(r"[\x00-@\[-`{-\x7f]")
_KEEP = np.full(256, 32, np.uint8)
_KEEP[97:123] = np.arange(97, 123)
_KEEP[128:] = np.arange(128, 256)
_ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Words:
    """Features of the words of several texts: slots of n-gram positions, and each word's range of them."""

    first: np.ndarray  # of each text its first word, and the number of words
    slots: list[np.ndarray]
    ranges: list[tuple[np.ndarray, np.ndarray]]
    whole: np.ndarray


def slots_for(languages: int) -> int:
    """A power of two, so that all languages' tables stay within ``ALL_SLOTS`` for each kind of feature."""
    return max(1 << 10, min(SLOTS, 1 << (ALL_SLOTS // max(languages, 1)).bit_length() - 1))


def words_of(texts: list[str | None], table: int = SLOTS) -> Words:
    parts = [(t or "").lower().encode() for t in texts]
    data = _KEEP[np.frombuffer(b"    " + b"\n".join(parts) + b"    ", np.uint8)]
    inside = data != 32
    edge = np.diff(inside.astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    begin = 4 + np.cumsum([0, *(len(p) + 1 for p in parts)])
    first = np.searchsorted(starts, begin[:-1]) if len(parts) else np.zeros(0, np.int64)
    slots, ranges = [], []
    wide = data.astype(np.uint64)
    gram = wide.copy()
    for n in range(2, max(GRAMS) + 1):
        gram = gram[:-1] | (wide[n - 1 :] << np.uint64(8 * (n - 1)))
        if n in GRAMS:
            k = len(slots)
            slots.append(((((gram + np.uint64(n)) * _ODD) >> np.uint64(48)).astype(np.int32) & (table - 1)) + k * table)
            ranges.append((starts - 1, np.maximum(starts - 1, ends - n + 2)))
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(wide * _powers(int(_ODD), len(data)), out=prefix[1:])
    word = _mix((prefix[ends] - prefix[starts]) * _powers(pow(int(_ODD), -1, 1 << 64), len(data) + 1)[starts])
    return Words(np.append(first, len(starts)).astype(np.int64), slots, ranges, ((word >> np.uint64(48)).astype(np.int64) & (table - 1)) + len(GRAMS) * table)


def emissions(words: Words, weights: np.ndarray) -> np.ndarray:
    """Score of each word (rows) for each language."""
    out = np.empty((len(words.whole), len(weights)))
    for j, w in enumerate(weights):
        out[:, j] = w[words.whole]
        for slots, (a, b) in zip(words.slots, words.ranges):
            total = np.zeros(len(slots) + 1)
            np.cumsum(w[slots], out=total[1:])
            out[:, j] += total[b] - total[a]
    return out


def marginals(scores: np.ndarray, first: np.ndarray, transition: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Forward-backward over sequences whose words are rows ``first[k]`` to ``first[k + 1]``: each word's distribution
    and, if asked for, the expected transitions. All sequences take a step together, the shorter ones drop out."""
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    begin, size = first[:-1][order], size[order]
    e = np.exp(scores - scores.max(1, keepdims=True))
    t = np.exp(transition - transition.max())
    forward, backward = np.empty_like(e), np.ones_like(e)
    longest = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(longest), "left")  # sequences longer than each step
    for step in range(longest):
        at = begin[: active[step]] + step
        a = e[at] * (forward[at - 1] @ t) if step else e[at]
        forward[at] = a / a.sum(1, keepdims=True)
    for step in range(longest - 2, -1, -1):
        at = begin[: active[step + 1]] + step
        b = (e[at + 1] * backward[at + 1]) @ t.T
        backward[at] = b / b.sum(1, keepdims=True)
    p = forward * backward
    p /= p.sum(1, keepdims=True)
    if not pairs:
        return p, None
    inner = np.ones(len(e), bool)
    inner[first[:-1][np.diff(first) > 0]] = False
    at = np.flatnonzero(inner)
    joint = forward[at - 1][:, :, None] * t * (e[at] * backward[at])[:, None, :]
    return p, (joint / joint.sum((1, 2), keepdims=True)).sum(0)


def in_segments(scores: np.ndarray, first: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """``marginals`` with sequences of more than ``SEGMENT`` words cut into segments, each chained with ``BEYOND`` words
    on both sides (what lies farther off moves a marginal by less than rounding shows)."""
    size = np.diff(first)
    if len(size) == 0 or size.max() <= SEGMENT + BEYOND:
        return marginals(scores, first, transition)[0]
    n = np.maximum(1, -(-size // SEGMENT))
    k = common.spread(np.zeros(len(n), np.int64), n)
    begin, end = np.repeat(first[:-1], n), np.repeat(first[1:], n)
    low = begin + k * SEGMENT
    high = np.minimum(low + SEGMENT, end)
    a, b = np.maximum(begin, low - BEYOND), np.minimum(end, high + BEYOND)
    p, _ = marginals(scores[common.spread(a, b - a)], np.append(0, np.cumsum(b - a)), transition)
    at = np.cumsum(b - a) - (b - a)
    return p[common.spread(at + low - a, high - low)]


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray
    transition: np.ndarray

    @property
    def slots(self) -> int:
        return self.weights.shape[1] // (len(GRAMS) + 1)


def fit(texts: list[str | None], langs: list[str]) -> Model:
    """AdaGrad on the conditional likelihood of the word labels, from zero and in a fixed order."""
    languages = sorted(set(langs))
    n = len(languages)
    table = slots_for(n)
    weights, transition = np.zeros((n, (len(GRAMS) + 1) * table)), np.zeros((n, n))
    sum_w, sum_t = np.full_like(weights, 1e-2), np.full_like(transition, 1e-2)
    y = np.array([languages.index(x) for x in langs])
    rng = np.random.default_rng(4)
    for _ in range(STEPS * -(-n // STEP_LANGUAGES) if n > 1 else 0):
        pick = rng.permutation(len(texts))[:STEP_DOCS]
        change_w, change_t, total = np.zeros_like(weights), np.zeros_like(transition), 0
        for k in range(0, len(pick), STEP_PART):  # a step's gradient is summed over parts, of whole pairs each
            part = pick[k : k + STEP_PART]
            words = words_of([texts[j] for j in part.tolist()], table)
            gold = np.repeat(y[part], np.diff(words.first))
            if len(gold) == 0:
                continue
            joined = np.append(words.first[:-1:2], words.first[-1])
            pieces = -(-np.diff(joined) // FIT_WORDS)
            joined = np.append(np.repeat(joined[:-1], pieces) + common.spread(np.zeros(len(pieces), np.int64), pieces) * FIT_WORDS, joined[-1])
            p, pair = marginals(emissions(words, weights), joined, transition, True)
            off = -p
            off[np.arange(len(gold)), gold] += 1
            inner = np.ones(len(gold), bool)
            inner[joined[:-1][np.diff(joined) > 0]] = False
            at = np.flatnonzero(inner)
            np.add.at(change_t, (gold[at - 1], gold[at]), 1)
            change_t -= pair
            total += len(gold)
            for j in range(n):
                change_w[j] += np.bincount(words.whole, off[:, j], weights.shape[1])
                for slots, (a, b) in zip(words.slots, words.ranges):
                    change = np.bincount(a, off[:, j], len(slots) + 1) - np.bincount(b, off[:, j], len(slots) + 1)
                    change_w[j] += np.bincount(slots, np.cumsum(change[:-1]), weights.shape[1])
        if total == 0:
            continue
        for now, g, seen in ((weights, change_w, sum_w), (transition, change_t, sum_t)):
            for j in range(n):
                step = g[j] * (100 / total) - RIDGE * now[j]
                seen[j] += step * step
                now[j] += RATE * step / np.sqrt(seen[j])
    return Model(languages, weights, transition)


def _labelled(texts: list[str | None], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text the sums of its words' marginals by language, and where its words begin; of each word its language."""
    words = words_of(texts, model.slots)
    p = in_segments(emissions(words, model.weights), words.first, model.transition)
    total = np.concatenate((np.zeros((1, p.shape[1])), np.cumsum(p, 0)))
    return np.diff(total[words.first], axis=0), words.first, p.argmax(1).astype(np.int16)


def _pieces(text: str) -> Iterator[str]:
    """A long text in parts, cut between words."""
    at = 0
    while at < len(text):
        found = _BREAK.search(text, at + TILE_BYTES // 4)
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end


def _predict(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    names = model.languages
    kind = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int64()), ("last", pa.int64())]))
    for rows in common.chunked(batches, "_text", TILE_BYTES):
        texts = rows.column("_text").to_pylist()
        if not names:
            share, first, best = np.zeros((len(texts), 1)), np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.int16)
        elif len(texts) == 1 and len(texts[0] or "") > TILE_BYTES:
            parts = [_labelled([x], model) for x in _pieces(texts[0])]
            share, best = sum(x[0] for x in parts), np.concatenate([x[2] for x in parts])
            first = np.array([0, len(best)])
        else:
            share, first, best = _labelled(texts, model)
        n = np.diff(first)
        good = np.array([bool(t and _LETTER.search(t)) for t in texts]) & (n > 0)
        share = share / np.maximum(n, 1)[:, None]
        new = np.ones(len(best), bool)
        new[1:] = best[1:] != best[:-1]
        new[first[:-1][n > 0]] = True
        owner = np.repeat(np.arange(len(texts)), n)
        new &= good[owner]
        start = np.flatnonzero(new)
        runs = np.bincount(owner[start], minlength=len(texts))
        last = np.append(start[1:], 0)
        ends = np.append(np.cumsum(runs)[runs > 0] - 1, []).astype(np.int64)
        last[ends] = first[1:][runs > 0]
        spans = pa.StructArray.from_arrays(
            [pa.array(names or [""], pa.string()).take(pa.array(best[start].astype(np.int64))), pa.array(start - first[owner[start]], pa.int64()), pa.array(last - 1 - first[owner[start]], pa.int64())] if len(start) else [pa.array([], t) for t in (pa.string(), pa.int64(), pa.int64())],
            ["lang", "first", "last"],
        )
        made = {
            "lang_pred": pa.array([names[k] if ok else UNKNOWN for k, ok in zip(share.argmax(1).tolist(), good.tolist())], pa.string()),
            "score": pa.array(np.where(good, np.clip(share.max(1), 0, 1), 0.0)),
            "n_switches": pa.array(np.maximum(runs - 1, 0), pa.int64()),
            "spans": pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(runs)), pa.int32()), spans).cast(kind),
        }
        keep = [c for c in rows.schema.names if c != "_text"]
        yield pa.RecordBatch.from_arrays([*(rows.column(c).combine_chunks() for c in keep), *made.values()], [*keep, *made])


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """The model of the rows with a language whose crc32 of the id, mod 4, isn't 2. All their languages are learnt, each
    from the ``SAMPLE`` documents with the smallest hashes of id and text, or the first of them that together hold its part
    of ``SAMPLE_BYTES``, and from one at least. Equal rows count once, so reruns give the same model."""
    able = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    able = able.where((common.crc_mod("i", 4) != 2) & F.col("l").isNotNull() & F.col("t").isNotNull())
    able = able.withColumn("h", F.xxhash64("i", "t", F.lit(41)))
    place = F.row_number().over(W.partitionBy("l").orderBy("h"))
    first = materialize(able.select("l", "h").distinct().withColumn("k", place).where(F.col("k") <= SAMPLE), "sample")
    languages = first.select("l").distinct().count()
    piece = F.when(F.length("t") <= SAMPLE_CHARS, F.col("t")).otherwise(F.coalesce(F.nullif(F.regexp_extract("t", rf"(?s)^.{{1,{SAMPLE_CHARS}}}(?=[\x00-@\[-`{{-\x7f])", 0), F.lit("")), F.substring("t", 1, SAMPLE_CHARS)))
    rows = able.join(first, ["l", "h"]).select("i", piece.alias("t"), "l", "k").distinct()
    before = F.sum(F.octet_length("t")).over(W.partitionBy("l").orderBy("k", "i", "t").rowsBetween(W.unboundedPreceding, -1))
    drawn = rows.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < SAMPLE_BYTES // max(languages, 1)).select("i", "t", "l").collect()
    discard(first)
    if not drawn:
        return Model([], np.zeros((0, 0)), np.zeros((0, 0)))
    drawn.sort(key=lambda r: (str(r.i), r.t, r.l))
    return fit([r.t for r in drawn], [r.l for r in drawn])


def identify(docs: DataFrame, model: Model, carry: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """``carry``, ``lang_pred``, ``score``, ``n_switches`` (changes of language between neighbouring words) and ``spans``
    (array of language, first and last word: the runs of one language, words counted from 0), a row for each input row.

    Null texts and texts without a letter are ``und`` with score 0 and no spans, and so are all if no language was
    learnt. A text in a script that wasn't learnt gets the least unlike language. Repeated rows get equal results; other
    columns aren't read; an empty table gives an empty result. Texts of more than ``TILE_BYTES`` characters are chained in
    parts. ``carry`` columns must not be named like the new ones (a struct of them can't be)."""
    common.small_batches(docs.sparkSession)
    rows = docs.select(*carry, F.col(text_col).alias("_text"))
    fields = T.StructType([*docs.select(*carry).schema.fields, *T.StructType.fromDDL("lang_pred string, score double, n_switches long, spans array<struct<lang: string, first: long, last: long>>").fields])
    return rows.mapInArrow(lambda it: _predict(it, model), fields)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    out = identify(docs, learn(docs))
    return out.select("doc_id", F.coalesce(common.crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "n_switches")
