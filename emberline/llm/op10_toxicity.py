"""Operator 10: toxicity by weak supervision.

1. Mine. Word beginnings are counted by document over all labelled rows; those that go most with toxic rows become
   lexicon voters (whole short words) and pattern voters (beginnings of a word), and they and the most telling others of
   either kind the classifier's features.
2. Vote. Every document's votes are a list of voters; equal lists are counted over all documents.
3. Label model. Each voter fires with a rate of its own on toxic and on clean documents, and abstains otherwise; that all
   abstain is evidence as well. The rates and the base rate are fitted to all documents by expectation maximisation; a
   known label is one more voter, whose rates are estimated like
   the others' and which is silent where the label isn't known. Voters that fire together more than the class explains
   share their weight: a voter's evidence is divided by one plus the sum of its correlations within the classes, of those
   from ``DEPENDENT`` on (a stand-in for a joint model of the voters: two that always agree count as one).
4. Classifier. A logistic regression on the features learns the posterior labels that the voters alone give (known labels
   have no part in them) of a bounded sample of all documents but the held-out ones, labelled or not, in which each voter
   has rows of its own, and scores all. Last, a scale and a shift of its odds are fitted to the sample's known labels.

A document's text is read once for its features, and a labelled one's once more (shuffled, unless the labels are few
enough to be sent to all) for the counts; what is shuffled besides are counts by feature and by votes.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from emberline.llm import common, linear
from emberline.storage import materialize

#: Documents, drawn by a hash, on which the classifier is fitted, and rows of each voter added to them.
SAMPLE, OWN_ROWS = 20_000, 20
#: Voters that needn't be telling, features besides voters, letters of a word's beginning, toxic rows a voter needs.
VOTERS, FEATURES, BEGIN, LEAST = 60, 3000, (4, 5, 6, 8), 3
#: Log ratio that a voter needs; from which log ratio times the root of the toxic rows on it is telling, and votes whatever
#: its rank.
LIFT, TELLING = 1.5, 20.0
#: From how many of a thousand words on a beginning counts as dense; candidates that voters are chosen from (16-bit numbers
#: hold them and the other features).
DENSE, CANDIDATES = 10, 60_000
#: From which correlation within a class on two voters are held dependent: what is less may be chance, and adds up.
DEPENDENT = 0.5
#: Rounds of expectation maximisation; shares of clean and toxic documents with the label toxic that it starts from.
ROUNDS, GOLD = 5, (0.02, 0.9)
#: Ridge for each row of the fit; least known labels of a class in the sample for the last calibration.
RIDGE, CALIBRATE = 1e-5, 50
_GAP = re.compile(r"[\W\d_]+")


def _plain(text: str) -> str:
    return f" {_GAP.sub(' ', text.lower())} "


def _dense(count: int, words: int) -> bool:
    return count * 1000 >= DENSE * words


def _beginnings(text: str) -> set[str]:
    """Beginnings of words, and short words whole (with a space behind); once more with an @ where they are dense."""
    words = _plain(text).split()
    every = Counter(words)
    counts: Counter = Counter()
    for w, c in every.items():
        for n in BEGIN:
            if len(w) >= n:
                counts[w[:n]] += c
        if len(w) <= max(BEGIN) + 4:
            counts[f"{w} "] += c
    return counts.keys() | {f"{k}@" for k, c in counts.items() if _dense(c, len(words))}


def _mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents in which each feature occurs, clean and toxic, of one task's rows; rows with an empty feature count all."""
    counts: dict[int, Counter] = {0: Counter(), 1: Counter()}

    def out() -> pa.RecordBatch:
        keys = list(counts[0].keys() | counts[1].keys())
        made = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([counts[0][k] for k in keys], pa.int64()), pa.array([counts[1][k] for k in keys], pa.int64())], ["feature", "clean", "toxic"])
        counts[0].clear(), counts[1].clear()
        return made

    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts[toxic].update(_beginnings(text or ""))
            counts[toxic][""] += 1
        if len(counts[0]) + len(counts[1]) > 500_000:
            yield out()
    yield out()


def _match(batches: Iterator[pa.RecordBatch], features: list[str], needs: np.ndarray) -> Iterator[pa.RecordBatch]:
    """``(id, text)`` -> id, votes and features as 16-bit numbers, and the share of rows of such votes that are fitted.
    The first features are the voters, ``needs`` their shares."""
    import ahocorasick

    number = {f: k for k, f in enumerate(features)}
    scan = ahocorasick.Automaton()
    for f in {f.rstrip("@") for f in features}:
        scan.add_word(f" {f}", (number.get(f), number.get(f"{f}@")))
    scan.make_automaton()
    for batch in batches:
        votes, found, need = [], [], []
        for text in batch.column(1).to_pylist():
            plain = _plain(text) if text and features else ""
            counts = Counter(x for _, x in scan.iter(plain)) if plain.strip() else {}
            words = len(plain.split()) if counts else 0
            own = np.array(sorted([a for (a, _), c in counts.items() if a is not None] + [b for (_, b), c in counts.items() if b is not None and _dense(c, words)]), "<u2")
            voting = own[: np.searchsorted(own, len(needs))]
            votes.append(voting.tobytes())
            found.append(own.tobytes())
            need.append(float(needs[voting].max()) if len(voting) else 0.0)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(votes, pa.binary()), pa.array(found, pa.binary()), pa.array(need, pa.float64())], ["id", "votes", "features", "need"])


def _chosen(candidates: list[tuple[str, int, float]], most: int = VOTERS) -> list[str]:
    """Voters from the best candidates ``(feature, toxic rows, lift)`` on: all telling ones, and others up to ``most``.
    Those that only spell another one longer or shorter are left out, and longer spellings that say no more than a
    beginning which votes: a document with the one has the other."""
    taken: list[str] = []
    same: dict[str, list[int]] = {}  # toxic rows of the voters by spelling, and of the voters that begin with it
    longer: dict[str, list[int]] = {}
    roots: dict[str, float] = {}
    for f, toxic, lift in candidates:
        a = f.rstrip("@ ")
        begins = [a[:n] for n in range(1, len(a) + 1)]
        near = [n for b in begins for n in same.get(b, ())] + longer.get(a, [])
        if any(0.9 <= toxic / n <= 1.1 for n in near) or any(roots.get(b, -np.inf) >= lift for b in begins):
            continue
        if len(taken) >= most and lift * toxic**0.5 < TELLING:
            continue
        taken.append(f)
        same.setdefault(a, []).append(toxic)
        for b in begins[:-1]:
            longer.setdefault(b, []).append(toxic)
        if f == a:
            roots[a] = lift
    return taken


class LabelModel:
    """Base rate, and each voter's rate of firing by class, with weights that share correlated evidence."""

    def __init__(self, clean: np.ndarray, toxic: np.ndarray, n_clean: float, n_toxic: float) -> None:
        self.rates = np.stack(((clean + 0.1) / (n_clean + 1), (toxic + 0.5) / (n_toxic + 1)))
        self.base = (n_toxic + 0.5) / (n_clean + n_toxic + 1)
        self.weights = np.ones(len(clean))
        self.gold = np.array(GOLD)
        self.none = np.array([0.5, 0.5])

    def posterior(self, votes: np.ndarray, gold: np.ndarray) -> np.ndarray:
        """P(toxic) of rows of 0/1 votes; gold is -1 where the label isn't known."""
        row, col = np.nonzero(votes)
        return self.of_lists(row, col, gold)

    def of_lists(self, row: np.ndarray, col: np.ndarray, gold: np.ndarray) -> np.ndarray:
        """P(toxic) of rows given by their firings, voter ``col`` in row ``row``."""
        r, none = np.clip(self.rates, 1e-6, 1 - 1e-6), np.clip(self.none, 1e-6, 1)
        z = np.log(self.base / (1 - self.base)) + np.bincount(row, (self.weights * np.log(r[1] / r[0]))[col], len(gold))
        z[np.bincount(row, minlength=len(gold)) == 0] += np.log(none[1] / none[0])
        g = np.clip(self.gold, 1e-3, 1 - 1e-3)
        return linear.sigmoid(z + np.select([gold == 1, gold == 0], [np.log(g[1] / g[0]), np.log((1 - g[1]) / (1 - g[0]))], 0.0))

    def update(self, n: np.ndarray, first: np.ndarray, second: np.ndarray) -> None:
        """By class: the posterior count, the voters' firings and the pairs' common firings."""
        a, b = np.divmod(np.arange(second[0].size), second.shape[2])
        self.refit(n, first, np.bincount(a, shared(n, first, a, b, second.reshape(2, -1)), second.shape[1]))

    def refit(self, n: np.ndarray, first: np.ndarray, extra: np.ndarray, gold: np.ndarray | None = None) -> None:
        """By class the posterior count and the voters' firings, and each voter's positive correlations with the others;
        by class the labelled rows, those labelled toxic, and the rows on which no voter fires."""
        self.base = float(np.clip(n[1] / n.sum(), 1e-6, 1 - 1e-6)) if n.sum() else 0.5
        self.rates = (first + np.array([[0.1], [0.5]])) / (n[:, None] + 1)
        self.weights = 1 / (1 + extra)
        if gold is not None:
            self.gold = (gold[1] + np.array(GOLD)) / (gold[0] + 1)
            self.none = (gold[2] + 0.5) / (n + 1)


def shared(n: np.ndarray, first: np.ndarray, a: np.ndarray, b: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Correlation of the voters a and b within the classes, from their common firings by class, where it is ``DEPENDENT``
    at least; the mean over the classes."""
    extra = np.zeros(len(a))
    for y in (0, 1):
        p = first[y] / max(n[y], 1e-9)
        spread = np.sqrt(np.maximum(p[a] * (1 - p[a]) * p[b] * (1 - p[b]), 0)) + 1e-12
        both = np.minimum((second[y] / max(n[y], 1e-9) - p[a] * p[b]) / spread, 1)
        extra += np.where(both >= DEPENDENT, both, 0) / 2
    return np.where(a == b, 0, extra)


def _lists(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Row and number of each entry of packed 16-bit lists."""
    size = np.array([len(x) // 2 for x in packed], np.int64)
    return np.repeat(np.arange(len(packed)), size), np.frombuffer(b"".join(packed), "<u2").astype(np.int64)


def _expect(batches: Iterator[pa.RecordBatch], model: LabelModel) -> Iterator[pa.RecordBatch]:
    """One task's sums for voters ``(a, b)`` by class: common firings of a < b, firings (a = b), the posterior count
    (-1, -1), the labelled rows (-1, 0), those labelled toxic (-1, 1) and those on which no voter fires (-1, 2)."""
    k = len(model.weights) + 3
    keys, sums = np.zeros(0, np.int64), np.zeros((2, 0))

    def out() -> pa.RecordBatch:
        a, b = np.divmod(keys, k + 1)
        return pa.RecordBatch.from_arrays([pa.array(a - 1, pa.int32()), pa.array(b - 1, pa.int32()), pa.array(sums[0]), pa.array(sums[1])], ["a", "b", "s0", "s1"])

    for batch in batches:
        if batch.num_rows == 0:
            continue
        packed, (gold, n) = batch.column(0).to_pylist(), (batch.column(c).to_numpy() for c in (1, 2))
        row, col = _lists(packed)
        p = model.of_lists(row, col, gold)
        size = np.bincount(row, minlength=len(packed))
        begin = np.cumsum(size) - size
        after = (begin + size)[row] - np.arange(len(row))  # a firing meets itself and those behind it
        one, other = np.repeat(np.arange(len(row)), after), common.spread(np.arange(len(row)), after)
        pair, at = np.append((col[one] + 1) * (k + 1) + col[other] + 1, (0, 1, 2, 3)), np.append(row[one], (0, 0, 0, 0))
        distinct, where = np.unique(np.concatenate((keys, pair)), return_inverse=True)
        new = np.zeros((2, len(distinct)))
        for y, weight in ((0, (1 - p) * n), (1, p * n)):
            value = weight[at]
            value[-4:] = weight.sum(), weight[gold >= 0].sum(), weight[gold == 1].sum(), weight[size == 0].sum()
            new[y] = np.bincount(where, np.concatenate((sums[y], value)), len(distinct))
        keys, sums = distinct, new
        if len(keys) > 1_000_000:
            yield out()
            keys, sums = np.zeros(0, np.int64), np.zeros((2, 0))
    yield out()


def _shared(batches: Iterator[pa.RecordBatch], n: np.ndarray, first: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One task's sums of correlations by voter, from summed pairs."""
    extra = np.zeros(first.shape[1])
    for batch in batches:
        a, b, s0, s1 = (batch.column(c).to_numpy() for c in range(4))
        x = shared(n, first, a, b, np.stack((s0, s1)))
        extra += np.bincount(a, x, len(extra)) + np.bincount(b, x, len(extra))
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(extra)), pa.int32()), pa.array(extra)], ["k", "x"])


def _calibrated(weights: np.ndarray, bias: float, z: np.ndarray, gold: np.ndarray) -> tuple[np.ndarray, float]:
    """The classifier with its odds scaled and shifted to the known labels of rows with the odds ``z``; as it was if they
    are too few to tell, or would turn it round."""
    z, y = np.clip(z[gold >= 0], -15, 15), gold[gold >= 0].astype(float)
    if min(y.sum(), len(y) - y.sum()) < CALIBRATE:
        return weights, bias
    w, shift = linear.fit(lambda w: z * w[0] / 5, lambda r: np.array([(z * r).sum() / 5]), y, 1, 0.0, 500)
    return (weights * w[0] / 5, bias * w[0] / 5 + shift) if w[0] > 0 else (weights, bias)


def score(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic",
    n_voters: int = VOTERS, n_features: int = FEATURES, n_candidates: int = CANDIDATES, sample: int = SAMPLE,
) -> DataFrame:
    """``(id_col, held_out, score, predicted)``, a row for each input row. Labels are learnt from ids whose crc32 mod 5
    isn't 0. ``n_voters``: voters that needn't be telling (telling ones all vote, as far as they are among the
    ``n_candidates`` best); ``n_features``: features of the classifier besides; ``sample``: documents that it is fitted on.

    Null or empty text has no features and gets the classifier's base score. Null labels aren't used; of several labels
    of an id the highest counts. Repeated rows get equal scores. Without labels of either class all score the same.
    Other columns aren't read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    learn = labels.where(F.col(toxic_col).isNotNull() & F.col(id_col).isNotNull()).withColumn("m", common.crc_mod(id_col, 5)).where("m <> 0")
    known = learn.groupBy(F.col(id_col).alias("id")).agg((F.max(toxic_col) > 0).cast("int").alias("toxic"))
    known = materialize(known, "known")
    counts = rows.join(known, "id").select("text", "toxic").mapInArrow(_mine, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counts = materialize(counts.where(f"clean + toxic >= {LEAST}"), "counts")
    every = counts.where("feature = ''").first()
    n0, n1 = (every["clean"] or 0, every["toxic"] or 0) if every else (0, 0)
    lift = F.log((F.col("toxic") + 0.5) / (n1 + 1)) - F.log((F.col("clean") + 0.5) / (n0 + 1))
    ranked = counts.where("feature <> ''").withColumn("lift", lift).withColumn("z", F.col("lift") * F.sqrt(F.col("clean") + F.col("toxic")))
    tried = ranked.where(f"toxic >= {LEAST} and z > 3 and lift >= {LIFT}").orderBy(F.desc(F.col("lift") * F.sqrt("toxic")), F.length("feature"), "feature").limit(n_candidates).collect()
    voting = _chosen([(r.feature, r.toxic, r.lift) for r in tried], n_voters)
    rates = {r.feature: (r.clean, r.toxic) for r in tried}
    best = ranked.orderBy(F.desc(F.abs("z")), "feature").limit(n_features + len(voting)).collect()
    voters = set(voting)
    features = voting + [r.feature for r in best if r.feature not in voters][:n_features]
    clean, toxic = (np.array([rates[f][y] for f in voting], float) for y in (0, 1))
    needs = OWN_ROWS / np.maximum(clean + toxic, 1)

    id_type = rows.schema["id"].dataType.simpleString()
    table = materialize(rows.mapInArrow(lambda it: _match(it, features, needs), f"id {id_type}, votes binary, features binary, need double"), "votes")
    model = LabelModel(clean, toxic, n0, n1)
    masks = materialize(table.select("id", "votes").join(known, "id", "left").groupBy("votes", F.coalesce("toxic", F.lit(-1)).alias("gold")).agg(F.count("*").alias("n")), "masks")
    for _ in range(ROUNDS if voting else 0):
        now = model
        sums = masks.select("votes", "gold", "n").mapInArrow(lambda it: _expect(it, now), "a int, b int, s0 double, s1 double").groupBy("a", "b").agg(F.sum("s0").alias("s0"), F.sum("s1").alias("s1"))  # noqa: B023
        sums = materialize(sums, "sums")
        n, first, gold = np.zeros(2), np.zeros((2, len(voting))), np.zeros((3, 2))
        for r in sums.where("a = b or a < 0").collect():
            if r.a >= 0:
                first[:, r.a] = r.s0, r.s1
            elif r.b < 0:
                n[:] = r.s0, r.s1
            else:
                gold[r.b] = r.s0, r.s1
        extra = np.zeros(len(voting))
        for r in sums.where("a >= 0 and a < b").mapInArrow(lambda it: _shared(it, n, first), "k int, x double").groupBy("k").agg(F.sum("x").alias("x")).collect():  # noqa: B023
            extra[r.k] = r.x
        model.refit(n, first, extra, gold)

    total = masks.agg(F.sum("n")).first()[0] or 0
    share = F.greatest(F.lit(sample / max(total, 1)), F.col("need") * ((n0 + n1) / max(total, 1)))
    drawn = F.pmod(F.xxhash64("id", "features", F.lit(17)), F.lit(1 << 30)) < share * (1 << 30)
    trained = table.where(drawn & (F.coalesce(common.crc_mod("id", 5), F.lit(1)) != 0)).select("id", "votes", "features").distinct()
    fitted = trained.join(known, "id", "left").select("id", "votes", "features", F.coalesce("toxic", F.lit(-1)).alias("gold")).orderBy("id", "features").toArrow()
    found, gold = fitted.column("features").to_pylist(), fitted.column("gold").to_numpy()
    row, col = _lists(found)
    target = model.of_lists(*_lists(fitted.column("votes").to_pylist()), np.full(len(found), -1)) if found and n1 else np.zeros(0)
    weights, bias = linear.fit(
        lambda w: np.bincount(row, w[col], len(found)), lambda r: np.bincount(col, r[row], len(features)), target, len(features), RIDGE
    )
    weights, bias = _calibrated(weights, bias, np.bincount(row, weights[col], len(found)) + bias, gold)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = np.array([weights[np.frombuffer(x, "<u2")].sum() for x in batch.column(1).to_pylist()]) + bias
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(linear.sigmoid(z))], ["id", "score"])

    scored = table.select("id", "features").mapInArrow(apply, f"id {id_type}, score double").withColumnRenamed("id", id_col)
    return scored.select(id_col, F.coalesce(common.crc_mod(id_col, 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
