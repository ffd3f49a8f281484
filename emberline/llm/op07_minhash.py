"""Operator 7: near duplicates by HyperMinHash.

Each of 288 hash functions deals a document's distinct shingles anew; a register keeps the leading-zero count of the
smallest value and ten mantissa bits after it. Bands of six registers are the candidate keys. Candidates are first held
against the collision-corrected Jaccard estimate of the registers, then against the full shingle sets. Two documents
of similarity 0.75 share no band once in ten thousand pairs, of 0.8 once in two million.

Equal sets collapse into a class before anything is paired. First every member of a band bucket is tested against two
pivots, its smallest member and one drawn by a hash: a few pairs for each member, by which a large group of copies grows
together. In a bucket that still holds several components only the members outside its largest one are open: they are
held against the bucket within tasks, registers alone, and what comes out is a list of members that may have a link, not
of pairs. Texts go only to those members, whose pairs are confirmed within tasks; only links leave them. No link is
skipped, and no list of pairs is made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from emberline.llm import common
from emberline.operators.components import connected_components
from emberline.storage import discard, materialize

REGISTERS, ROWS, MANTISSA = 288, 6, 10
BANDS = REGISTERS // ROWS
#: Pivots of each bucket before the rest is tested in full; members of a tile in which it is, by registers and by texts.
PIVOTS, TILE, TEXT_TILE = 2, 2048, 512
#: Bytes of text handled in one vector step; longer texts are taken in pieces of that size.
TILE_BYTES = 1 << 18
#: Texts in such a step at most: registers take 2 kB of each temporary for a text, however short it is.
TILE_ROWS = 1024
#: Ids that may be broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Hashes of shingle sets that a task remembers while it confirms pairs (8 bytes each).
REMEMBERED = 4_000_000

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int, known: dict = {}) -> np.ndarray:  # noqa: B006  kept between batches of a task
    have = known.get(base)
    if have is None or len(have) < n:
        grow = np.full(max(n, TILE_BYTES + 1), base, np.uint64)
        grow[0] = 1
        known[base] = have = np.multiply.accumulate(grow)
    return have[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's ``width``-word shingles (A-Z lower-cased; fewer words: the whole
    sequence as one; no word: none). ``data`` holds the texts' UTF-8 bytes end to end."""
    n = len(offsets) - 1
    lower = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    inside = ~((lower == 32) | ((lower >= 9) & (lower <= 13)))
    edge = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    cut = np.unique(cut[inside[cut - 1] & inside[cut]]) if len(cut) else cut
    if len(cut):  # a word can't run on into the next text
        starts, ends = np.sort(np.concatenate((starts, cut))), np.sort(np.concatenate((ends, cut)))
    prefix = np.zeros(len(lower) + 1, np.uint64)
    np.cumsum((lower.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(lower)), out=prefix[1:])
    word = _mix((prefix[ends] - prefix[starts]) * _powers(_INVERSE, len(lower) + 1)[starts] + (ends - starts).astype(np.uint64))
    first = np.searchsorted(starts, offsets[:-1])
    last = np.searchsorted(starts, offsets[1:])
    whole = len(word) - width + 1
    gram = np.zeros(max(whole, 0), np.uint64)
    for j in range(width):
        gram += _mix(word[j : j + len(gram)] + np.uint64(j + 1)) * np.uint64(2 * j + 3)
    gram = _mix(gram)
    out = []
    for a, b in zip(first.tolist(), last.tolist()):
        if b - a >= width:
            out.append(np.unique(gram[a : b - width + 1]))
        elif b > a:
            h = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for x in word[a:b]:
                    h = _mix(np.array([h * np.uint64(_BASE) + x], np.uint64))[0]
            out.append(np.array([h], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def whole_set(data: np.ndarray, width: int) -> np.ndarray:
    """``shingle_sets`` of one text of any length, in pieces that share ``width`` - 1 words."""
    if len(data) <= 4 * TILE_BYTES:
        return shingle_sets(data, np.array([0, len(data)]), width)[0]
    gap = np.flatnonzero((data == 32) | ((data >= 9) & (data <= 13)))
    begins = np.append(0, gap + 1)  # of a word, or of nothing between two separators
    begins = begins[np.append(begins[:-1] != gap, begins[-1] < len(data))]
    if len(begins) < width:
        return shingle_sets(data, np.array([0, len(data)]), width)[0]
    out, at = [], 0
    while True:
        k = max(at + width, int(np.searchsorted(begins, begins[at] + TILE_BYTES)))
        end = int(begins[k]) if k < len(begins) else len(data)
        part = data[begins[at] : end]
        out.append(shingle_sets(part, np.array([0, len(part)]), width)[0])
        if k >= len(begins):
            return np.unique(np.concatenate(out))
        at = k - width + 1


def text_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """``shingle_sets``, or ``whole_set`` where there is one long text."""
    return [whole_set(data, width)] if len(offsets) == 2 else shingle_sets(data, offsets, width)


_MULTIPLY, _XOR = (x.astype(np.uint32) for x in np.random.default_rng(7).integers(1, 1 << 32, (2, REGISTERS), dtype=np.uint64))
_MULTIPLY |= np.uint32(1)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """HyperMinHash registers of each non-empty set of 64-bit hashes: leading zeros and mantissa of the least value."""
    n = np.array([len(x) for x in sets], np.int64)
    start = np.cumsum(n) - n
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    least = np.stack([np.minimum.reduceat((flat ^ x) * m, start) for m, x in zip(_MULTIPLY, _XOR)], 1)
    exact = least.astype(np.float64) + 0.5
    high = np.floor(np.log2(exact)).astype(np.int64)
    mantissa = ((exact * 2.0 ** -high - 1) * (1 << MANTISSA)).astype(np.int64)
    return (((31 - high) << MANTISSA) | mantissa).astype(np.uint16)


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of rows of registers, corrected for registers that agree by chance: unlike minima of like
    magnitude agree once in 2 ** MANTISSA, and magnitudes agree once in three."""
    return estimates_of(a == b)


def estimates_of(same: np.ndarray) -> np.ndarray:
    chance = 1 / (3 * (1 << MANTISSA))
    return np.maximum(0.0, (same.mean(1) - chance) / (1 - chance))


def _sketches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for rows in common.chunked(batches, "text", TILE_BYTES, TILE_ROWS):
        sets = text_sets(*common.utf8(rows.column("text")), width)
        full = [x for x in sets if len(x)]
        found = iter(registers(full) if full else ())
        yield pa.RecordBatch.from_arrays(
            [
                rows.column("doc").combine_chunks(),
                *_set_names(sets),
                pa.array([next(found).tobytes() if len(x) else None for x in sets], pa.binary()),
            ],
            ["doc", "n", "set_a", "set_b", "registers"],
        )


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's band keys: a hash of the band's registers, with the band's number in the last six bits."""
    for batch in batches:
        rows = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, BANDS, ROWS).astype(np.uint64)
        key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2])
        for k in range(ROWS):
            key = _mix(key * np.uint64(_BASE) + rows[:, :, k])
        key = (key & ~np.uint64(63)) | np.arange(BANDS, dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), BANDS), pa.int64()), pa.array(key.ravel().astype(np.int64), pa.int64())], ["rep", "band"])


def _likely(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs that the registers and the sets' sizes don't rule out."""
    bound = _least_estimate(percent)
    for batch in batches:
        u, v, nu, nv, ru, rv = (batch.column(batch.schema.get_field_index(c)) for c in ("u", "v", "nu", "nv", "ru", "rv"))
        a, b = (np.frombuffer(b"".join(x.to_pylist()), np.uint16).reshape(-1, REGISTERS) for x in (ru, rv))
        n = np.stack((nu.to_numpy(), nv.to_numpy()))
        ok = (estimates(a, b) >= bound) & (100 * n.min(0) >= percent * n.max(0))
        yield pa.RecordBatch.from_arrays([u, v], ["u", "v"]).filter(pa.array(ok, pa.bool_()))


def _set_names(sets: list[np.ndarray]) -> tuple[pa.Array, pa.Array, pa.Array]:
    """The size and two 64-bit sums that name each set."""
    return (
        pa.array([len(x) for x in sets], pa.int64()),
        pa.array([int(x.sum().astype(np.int64)) for x in sets], pa.int64()),
        pa.array([int(_mix(x).sum().astype(np.int64)) for x in sets], pa.int64()),
    )


def _packed(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for rows in common.chunked(batches, "text", TILE_BYTES, TILE_ROWS):
        names = _set_names(text_sets(*common.utf8(rows.column("text")), width))
        packed = pa.array([common.pack((x or "").encode()) for x in rows.column("text").to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([rows.column("doc").combine_chunks(), *names, packed], ["doc", "n", "set_a", "set_b", "text"])


class _Sets:
    """Shingle sets of packed texts, remembered up to ``REMEMBERED`` hashes."""

    def __init__(self, width: int) -> None:
        self.width, self.known, self.held = width, {}, 0

    def of(self, packed: bytes) -> np.ndarray:
        got = self.known.get(packed)
        if got is None:
            data = np.frombuffer(common.unpack(packed), np.uint8)
            got = whole_set(data, self.width)
            if self.held + len(got) > REMEMBERED:
                self.known.clear()
                self.held = 0
            self.known[packed] = got
            self.held += len(got)
        return got


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = np.sort(np.concatenate((a, b)))
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def _least_estimate(percent: int) -> float:
    """Four standard errors below the bound: pairs with a lower estimate are ruled out (of those at the bound one in
    30,000, a third of what shares no band)."""
    return percent / 100 - 4 * (percent / 100 * (1 - percent / 100) / REGISTERS) ** 0.5


def _confirm(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs whose full shingle sets are similar enough."""
    sets = _Sets(width)
    for batch in batches:
        rows = zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("tu", "tv")))
        keep = [_similar(sets.of(tu), sets.of(tv), percent) for tu, tv in rows]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[tuple[int, int]], np.ndarray]]:
    """Whole pairs of tiles: their rows, where each begins and ends, and the registers."""
    for table, starts in common.whole_groups(batches, _TILES):
        ends = [*starts[1:].tolist(), table.num_rows]
        yield table, list(zip(starts.tolist(), ends)), np.frombuffer(b"".join(table.column("registers").to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _met(x: int, b: int, root: np.ndarray, side: np.ndarray, n: np.ndarray, band: np.ndarray, regs: np.ndarray, percent: int) -> np.ndarray:
    """Rows from x + 1 to b of other components that x may link to, and whose first band in common with x this is.
    ``root`` and the other arrays are those of the whole table."""
    other = np.flatnonzero((root[x + 1 : b] != root[x]) & ((side[x] == 2) | (side[x + 1 : b] != side[x]))) + x + 1
    other = other[100 * np.minimum(n[other], n[x]) >= percent * np.maximum(n[other], n[x])]
    if len(other) == 0:
        return other
    same = regs[other] == regs[x]
    likely = estimates_of(same) >= _least_estimate(percent)
    other, same = other[likely], same[likely]
    return other[same.reshape(len(other), BANDS, ROWS).all(2).argmax(1) == band[x]] if len(other) else other


def _live(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Members of pairs of tiles that may have a link to another component, by their registers."""
    for table, groups, regs in _groups(batches):
        rep, own, side, n, key, minor = (table.column(c).to_numpy() for c in ("rep", "own", "side", "n", "band", "minor"))
        band, live = (key & 63).astype(np.int64), np.zeros(len(rep), bool)
        for a, b in groups:
            # a pair has a minor member, which comes first: the rows are sorted so
            for x in range(a, a + int(minor[a:b].sum())):
                other = _met(x, b, own, side, n, band, regs, percent)
                live[other] = True
                live[x] |= len(other) > 0
        yield pa.RecordBatch.from_arrays([pa.array(key[live], pa.int64()), pa.array(rep[live], pa.int64())], ["band", "rep"])


def _across(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Links between components within pairs of tiles. A pair of documents is tested in the first band it shares, and no
    longer once its components have been tied there."""
    sets = _Sets(width)
    for table, groups, regs in _groups(batches):
        out = []
        rep, own, side, n, key = (table.column(c).to_numpy() for c in ("rep", "own", "side", "n", "band"))
        band, root = (key & 63).astype(np.int64), own.copy()
        texts = table.column("text")
        for a, b in groups:
            here = root[a:b]
            for x in range(a, b - 1):
                for y in _met(x, b, root, side, n, band, regs, percent).tolist():
                    if root[y] != root[x] and _similar(sets.of(texts[x].as_py()), sets.of(texts[y].as_py()), percent):
                        out.append((rep[x], rep[y]))
                        here[here == root[y]] = root[x]
        yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in out], pa.int64()), pa.array([v for _, v in out], pa.int64())], ["u", "v"])


_TILES = ("band", "low", "high")


def _dealt(placed: DataFrame, tile: int) -> DataFrame:
    """``placed(band, rep, own)`` of the buckets with several components, dealt into pairs of tiles: ``(band, low, high,
    side, rep, own, minor)``. A bucket within ``tile`` is one tile; of a larger one the members outside its largest
    component (``minor``) have tiles of their own, and only pairs of tiles with one of these meet."""
    sizes = placed.groupBy("band", "own").agg(F.count("*").alias("k")).groupBy("band").agg(F.count("*").alias("parts"), F.max_by("own", F.struct("k", "own")).alias("most"), F.max("k").alias("k"), F.sum("k").alias("all"))
    tiles = lambda n: F.greatest(F.lit(1), F.ceil(n / tile)).cast("long")
    sizes = sizes.where("parts > 1").select("band", "most", (F.col("all") <= tile).alias("one"), tiles(F.col("all") - F.col("k")).alias("minors"), tiles(F.col("k")).alias("majors"))
    minor, number = F.col("own") != F.col("most"), F.xxhash64("rep", F.lit("tile"))
    own = F.when(F.col("one"), 0).when(minor, F.pmod(number, F.col("minors"))).otherwise(F.col("minors") + F.pmod(number, F.col("majors")))
    met = F.when(F.col("one"), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.when(minor, F.col("minors") + F.col("majors")).otherwise(F.col("minors")) - 1))
    rows = placed.join(sizes, "band").select("band", "rep", "own", minor.alias("minor"), own.alias("tile"), F.explode(met).alias("other"))
    side = F.when(F.col("tile") == F.col("other"), 2).when(F.col("tile") < F.col("other"), 0).otherwise(1)
    return rows.select("band", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), side.alias("side"), "rep", "own", "minor")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_shingles, component_id, kept)``, a row for each input row with an id. Ids are of any orderable type.

    Links join documents whose shingle sets have 100 * intersection >= percent * union; ``component_id`` is the smallest
    id reachable. Null, empty or word-free texts have no shingles and no links. Rows that repeat an id are documents of
    their own: unlike texts of one id link only by their sets. Rows with a null id are left out, having no name to link
    by. Other columns aren't read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    docs = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).where("doc is not null")
    kind = docs.schema["doc"].dataType.simpleString()
    sketch = materialize(docs.mapInArrow(lambda it: _sketches(it, width), f"doc {kind}, n long, set_a long, set_b long, registers binary"), "sketch")
    one = ["set_a", "set_b", "n"]
    classes = sketch.where("n > 0").groupBy(*one).agg(F.min_by(F.struct("doc", "registers"), "doc").alias("r"))
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("rep"), *one, "r.*"), "classes")
    bands = classes.select("rep", "registers").mapInArrow(_bands, "rep long, band long")
    many = bands.groupBy("band").agg(F.count("*").alias("members")).where("members > 1").select("band")
    shared = materialize(bands.join(many, "band", "left_semi").distinct(), "shared")
    ids = materialize(classes.join(shared.select("rep").distinct(), "rep", "left_semi"), "marks")
    names = ids.select("doc").distinct()
    picked = docs.join(F.broadcast(names) if ids.count() <= BROADCAST_IDS else names, "doc", "left_semi")
    packed = picked.mapInArrow(lambda it: _packed(it, width), f"doc {kind}, n long, set_a long, set_b long, text binary")
    texts = materialize(packed.join(ids.select("rep", "doc", *one), ["doc", *one]).groupBy("rep").agg(F.min("text").alias("text")), "texts")
    marks = ids.select("rep", "n", "registers")

    def linked(pairs: DataFrame) -> DataFrame:
        side = lambda t, x, *names: t.select(F.col("rep").alias(x), *(F.col(a).alias(b) for a, b in names))
        likely = pairs.join(side(marks, "u", ("n", "nu"), ("registers", "ru")), "u").join(side(marks, "v", ("n", "nv"), ("registers", "rv")), "v")
        likely = materialize(likely.select("u", "v", "nu", "nv", "ru", "rv").mapInArrow(lambda it: _likely(it, percent), "u long, v long").distinct(), "likely")
        sets = likely.join(side(texts, "u", ("text", "tu")), "u").join(side(texts, "v", ("text", "tv")), "v")
        links = materialize(sets.select("u", "v", "tu", "tv").mapInArrow(lambda it: _confirm(it, width, percent), "u long, v long").distinct(), "links")
        discard(pairs, likely)
        return links

    drawn = [F.min("rep"), F.min_by("rep", F.xxhash64("rep", F.lit(1)))][:PIVOTS]
    pivots = shared.groupBy("band").agg(F.array_distinct(F.array(*drawn)).alias("p")).select("band", F.explode("p").alias("v"))
    pairs = shared.join(pivots, "band").where("rep <> v").select(F.least("rep", "v").alias("u"), F.greatest("rep", "v").alias("v")).distinct()
    links = linked(materialize(pairs, "pairs"))
    label = materialize(connected_components(links), "label")

    placed = shared.join(label.withColumnRenamed("node", "rep"), "rep", "left").select("band", "rep", F.coalesce("component", "rep").alias("own"))
    placed = materialize(placed, "placed")

    def in_tiles(rows: DataFrame) -> DataFrame:
        return rows.repartition(common.partitions(spark), *_TILES).sortWithinPartitions(*_TILES, F.desc("minor"))

    live = in_tiles(_dealt(placed, TILE).join(marks, "rep")).mapInArrow(lambda it: _live(it, percent), "band long, rep long")
    live = materialize(live.distinct().join(placed, ["band", "rep"]).select("band", "rep", "own"), "live")
    discard(placed, shared)
    tiles = in_tiles(_dealt(live, TEXT_TILE).join(marks, "rep").join(texts, "rep"))
    more = materialize(tiles.mapInArrow(lambda it: _across(it, width, percent), "u long, v long"), "links")
    discard(live, texts, ids, label)
    label = materialize(connected_components(links.union(more)), "label")

    named = label.select(F.col("node").alias("rep"), "component").join(classes.select("rep", "doc"), "rep")
    least = named.groupBy("component").agg(F.min("doc").alias("component_id"))
    linked_classes = named.join(least, "component").select("rep", "component_id")
    of_set = classes.select("rep", *one, F.col("doc").alias("least_doc")).join(linked_classes, "rep", "left").select(*one, F.coalesce("component_id", "least_doc").alias("component_id"))
    member = sketch.select("doc", *one).join(of_set, one, "left").select("doc", "n", F.coalesce("component_id", "doc").alias("component_id"))
    return member.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), "component_id", (F.col("doc") == F.col("component_id")).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))
