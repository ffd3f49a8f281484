"""Operator 3: repeated substrings of at least ``LENGTH`` bytes, by sampled suffix sorting with induction, out of core.

A full suffix array of a corpus needs a tuple for each byte; carried through shuffles that is many times the input. The
work here follows the induced-sorting idea on a sample: only sampled suffixes are ranked outright, and the rest get
their place from the sampled suffix that induces them.

* Sample. In every window of ``LENGTH`` bytes the anchor is the ``GRAM``-byte substring with the least hash (leftmost on
  ties). Equal windows have equal anchors at equal offsets, so a suffix of interest is named by (anchor, offset).
* Induce. Suffixes of one anchor with neighbouring offsets form a node: offsets [q * 2^j, (q + 1) * 2^j). Every suffix
  of a node shares the node's common prefix part I (the bytes all its windows have in common). If I occurs once, none of
  the node's windows can repeat. If the node's whole span U occurs twice, all of them repeat. Otherwise the node is
  split into nodes of the next level and the tuples (position, common part, span) are carried on, down to single windows.
  A repeated span whose common part also occurs in other spans goes on too, once, as their possible partner.
* Out of core. Names are compared in hash buckets by a sorted shuffle in place of a disk-backed priority queue, as the
  tuples of one round are read only in the next; their number follows the bytes of text, and a task reads them one after
  another. A value is sent once per chunk of documents, so a passage that a third of all documents share is one entry
  per chunk. Chunks and tuples are tables in the shared folder.

Matches never cross documents, and a window may match within its own document. Common parts, which only decide what is
carried on, are named by 64 bits; spans, which decide what is removed, by 128 bits of two independent hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from emberline.llm import common
from emberline.llm.op07_minhash import _mix, _powers
from emberline.storage import discard, materialize

LENGTH, GRAM = 200, 32
#: Halving steps: nodes of 128, 16 and 1 window starts.
LEVELS = (7, 4, 0)
#: Text bytes of a chunk, of one vector step within it, and text bytes for each bucket of names.
CHUNK_BYTES, TILE_BYTES, BUCKET_BYTES = 3 << 20, 1 << 18, 32 << 20

_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xA0761D6478BD642F)
_INVERSES = tuple(pow(b, -1, 1 << 64) for b in _BASES)


class _Text:
    """Hashes of byte ranges of one text, by each of the bases."""

    def __init__(self, data: np.ndarray) -> None:
        self.n = len(data)
        self.sums = []
        wide = data.astype(np.uint64) + np.uint64(1)
        for base in _BASES:
            s = np.zeros(self.n + 1, np.uint64)
            np.cumsum(wide * _powers(base, self.n), out=s[1:])
            self.sums.append(s)

    def hash(self, k: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[k][end] - self.sums[k][start]) * _powers(_INVERSES[k], self.n + 1)[start])


def _split(a: np.ndarray, b: np.ndarray, p: np.ndarray, level: int) -> tuple[np.ndarray, ...]:
    """Windows starting in [a, b] with anchor p, cut at multiples of 2^level of the offset p - start."""
    low, high = (p - b) >> level, (p - a) >> level
    n = high - low + 1
    q = common.spread(low, n)
    a, b, p = np.repeat(a, n), np.repeat(b, n), np.repeat(p, n)
    return np.maximum(a, p - ((q << level) + (1 << level) - 1)), np.minimum(b, p - (q << level)), p, q


def _names(text: _Text, a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray, level: int) -> tuple[np.ndarray, ...]:
    """Of each node the name of its common part, and both halves of the name of its whole span."""
    start = p - (q << level)
    common_part = text.hash(0, start, start + LENGTH + 1 - (1 << level)) ^ _mix(q.astype(np.uint64) + np.uint64(level << 20))
    place = _mix(((p - a) * 1024 + (p - b)).astype(np.uint64) + np.uint64((level + 1) << 40))
    return _mix(common_part), *(_mix(text.hash(k, a, b + LENGTH) ^ place) for k in (1, 2))


def _anchors(data: np.ndarray, text: _Text) -> np.ndarray:
    """For every window start its anchor's start, in one tile of text."""
    width = LENGTH - GRAM + 1
    at = np.arange(len(data) - GRAM + 1)
    key = (text.hash(0, at, at + GRAM) & np.uint64(~((1 << 24) - 1) & ((1 << 64) - 1))) | at.astype(np.uint64)
    n = len(key) - width + 1
    padded = np.full(-(-len(key) // width) * width, (1 << 64) - 1, np.uint64)
    padded[: len(key)] = key
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.ascontiguousarray(np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1]).ravel()
    return (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & np.uint64((1 << 24) - 1)).astype(np.int64)


def _tiles(offsets: np.ndarray, tile: int) -> Iterator[tuple[int, int]]:
    """Byte ranges of at most about a tile; a longer text is cut into tiles that overlap by a window."""
    ends = offsets[1:].tolist()
    start, done = int(offsets[0]), int(offsets[0])
    for end in ends:
        if end - start > tile and done > start:
            yield start, done
            start = done
        while end - start > 2 * tile:
            yield start, start + tile + LENGTH - 1
            start += tile
        done = end
    if done > start:
        yield start, done


def _roots(data: np.ndarray, offsets: np.ndarray, tile_bytes: int) -> tuple[np.ndarray, ...]:
    """The nodes of the first level of a chunk, with their names."""
    doc_end = offsets[1:]
    found = []
    for start, end in _tiles(offsets, tile_bytes):
        if end - start < LENGTH:
            continue
        tile = data[start:end]
        text = _Text(tile)
        anchor = _anchors(tile, text)
        s = np.arange(len(anchor))
        owner_end = np.minimum(doc_end[np.searchsorted(doc_end, s + start, "right")], end) - start
        good = s + LENGTH <= owner_end
        s, anchor = s[good], anchor[good]
        if len(s) == 0:
            continue
        head = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (s[1:] != s[:-1] + 1))))
        tail = np.concatenate((head[1:] - 1, [len(s) - 1]))
        a, b, p, q = _split(s[head], s[tail], anchor[head], LEVELS[0])
        found.append((a + start, b + start, p + start, *_names(text, a, b, p, q, LEVELS[0])))
    if not found:
        e = np.zeros(0, np.int64)
        return e, e, e, *[e.astype(np.uint64)] * 3
    joined = [np.concatenate(x) for x in zip(*found)]
    order = np.argsort(joined[0], kind="stable")
    return tuple(x[order] for x in joined)


#: kind 0: a chunk's rows and nodes; 1: names for a bucket; 2: window ranges found repeated.
_ROWS = pa.schema([("kind", pa.int8()), ("bucket", pa.int64()), ("chunk", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
_DDL = "kind byte, bucket long, chunk long, a binary, b binary, c binary"


def _distinct(*parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of names in one or two halves: where each distinct one is first met, the number of each name among them, and how
    often each occurs; in the order of the first half."""
    order = np.lexsort(parts[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.any([x[order][1:] != x[order][:-1] for x in parts], 0)
    inverse = np.empty(len(order), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return order[new], inverse, np.bincount(inverse, minlength=int(new.sum()))


def _message(chunk: int, names: tuple[np.ndarray, ...], buckets: int) -> tuple[list[dict], bytes]:
    """Rows that ask how often each name occurs, a name once per chunk; and what it takes to read the answer.

    With a common part goes a digest of a span that has it, and whether spans differ within the chunk."""
    rows: dict[int, list[bytes]] = {}
    keep = []
    for k, own in ((0, names[:1]), (1, names[1:])):
        first, inverse, count = _distinct(*own)
        if k == 0:
            digest = (names[1] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            differs = np.zeros(len(first), bool)
            differs[inverse[(names[1] != names[1][first[inverse]]) | (names[2] != names[2][first[inverse]])]] = True
        bucket = (own[0][first] >> np.uint64(32)).astype(np.int64) % buckets
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        present, sizes = np.unique(bucket, return_counts=True)
        for group in np.split(order, np.cumsum(sizes)[:-1]) if len(order) else []:
            row = rows.setdefault(int(bucket[group[0]]), [b"", b"", b""])
            row[k] = b"".join(x[first[group]].tobytes() for x in own)
            if k == 0:
                row[2] = digest[first[group]].tobytes() + np.packbits(differs[group]).tobytes()
        bits = np.packbits(np.stack((count[order] > 1, differs[order] if k == 0 else np.zeros(len(order), bool))))
        one = np.zeros(len(inverse), bool)
        one[first] = True
        keep += [common.varint(place[inverse]), bits, common.varint(np.diff(present, prepend=0)), common.varint(sizes), np.packbits(one)]
    ask = [{"kind": 1, "bucket": b, "chunk": chunk, "a": i, "b": u, "c": d} for b, (i, u, d) in sorted(rows.items())]
    return ask, common.pack_table(pa.record_batch([pa.array([x.tobytes() for x in keep], pa.binary())], ["x"]))


def _answers(key: bytes, replies: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Per node: is it open (its common part occurs twice, its span once), and does its span occur twice. Of the nodes
    of one repeated span that shares its common part with another span, one in the corpus counts as open too: it
    stands for them where parts of the other span are looked up."""
    x = [np.frombuffer(y, np.uint8) for y in common.unpack_table(key).column("x").to_pylist()]
    got = []
    for k, names in ((0, ("a", "c")), (1, ("b", "d"))):
        place, bits, present, sizes, one = x[5 * k : 5 * k + 5]
        place, present, sizes = common.unvarint(place), np.cumsum(common.unvarint(present)), common.unvarint(sizes)
        total = int(sizes.sum())
        bits = np.unpackbits(bits, count=2 * total).astype(bool).reshape(2, total)
        start = np.cumsum(sizes) - sizes
        for bucket, *flags in zip(replies.column("bucket").to_pylist(), *(replies.column(n).to_pylist() for n in names)):
            at = int(np.searchsorted(present, bucket))
            if at < len(present) and present[at] == bucket:
                n = int(sizes[at])
                for j in (0, 1):
                    bits[j, start[at] : start[at] + n] |= np.unpackbits(np.frombuffer(flags[j], np.uint8), count=n).astype(bool)
        got.append((bits[0][place], bits[1][place], np.unpackbits(one, count=len(place)).astype(bool)))
    (part, mixed, _), (span, elected, one) = got
    return (part & ~span) | (span & mixed & elected & one), span


def _first(batches: Iterator[pa.RecordBatch], buckets: int, chunk_bytes: int, tile_bytes: int) -> Iterator[pa.RecordBatch]:
    chunk = TaskContext.get().partitionId() << 32
    for rows in common.chunked(batches, "text", chunk_bytes):
        a, b, p, *names = _roots(*common.utf8(rows.column("text")), tile_bytes)
        ask, key = _message(chunk, tuple(names), buckets)
        nodes = common.pack(np.concatenate([common.varint(np.diff(a, prepend=0)), common.varint(b - a), common.varint(p - b)]))
        yield pa.RecordBatch.from_pylist([{"kind": 0, "bucket": None, "chunk": chunk, "a": common.pack_table(rows.combine_chunks()), "b": nodes, "c": key}], _ROWS)
        for k in range(0, len(ask), 512):
            yield pa.RecordBatch.from_pylist(ask[k : k + 512], _ROWS)
        chunk += 1


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket and chunk -> the answers, bucket after bucket."""
    for table, starts in common.whole_groups(batches, ("bucket",)):
        for start, end in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows]):
            yield from _counted(table.slice(start, end - start)).to_batches()


def _counted(table: pa.Table) -> pa.Table:
    """One bucket of names: which occur in two chunks; common parts whose spans differ; the first chunk of a span."""

    def each(sizes: list[int], flags: np.ndarray) -> pa.Array:
        ends = np.cumsum(sizes).tolist()
        return pa.array([np.packbits(flags[e - n : e]).tobytes() for n, e in zip(sizes, ends)], pa.binary())

    parts = [np.frombuffer(x, np.uint64) for x in table.column("a").to_pylist()]
    spans = [np.frombuffer(x, np.uint64).reshape(2, -1) for x in table.column("b").to_pylist()]
    notes = table.column("c").to_pylist()
    digest = np.concatenate([np.frombuffer(x, np.uint32, len(p)) for x, p in zip(notes, parts)])
    differs = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8, offset=4 * len(p)), count=len(p)).astype(bool) for x, p in zip(notes, parts)])
    of_part, of_span = [len(x) for x in parts], [x.shape[1] for x in spans]
    first, part, count = _distinct(np.concatenate(parts))
    bad = differs | (digest != digest[first[part]])
    mixed = np.bincount(part, bad, len(first)) > 0
    lead, span, often = _distinct(*np.concatenate(spans, 1))
    leads = np.zeros(len(span), bool)
    leads[lead] = True
    return pa.table({"bucket": table.column("bucket"), "chunk": table.column("chunk"), "a": each(of_part, (count > 1)[part]), "b": each(of_span, (often > 1)[span]), "c": each(of_part, mixed[part]), "d": each(of_span, leads)})


def _nodes(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    v = common.unvarint(common.unpack(packed, np.uint8))
    n = len(v) // 3
    a = np.cumsum(v[:n])
    b = a + v[n : 2 * n]
    return a, b, b + v[2 * n :]


def _carry(chunk: int, a: np.ndarray, b: np.ndarray, p: np.ndarray, shift: np.ndarray | int, data: np.ndarray, level: int, buckets: int, tile_bytes: int) -> list[dict]:
    """The undecided nodes' next level: their names to ask for, and their bytes to go on with.

    ``data``: the text that the nodes' positions are in, ``shift`` what leads from there to the chunk's. The bytes of
    the nodes' spans are laid end to end, and a carried node's positions are in this new text."""
    length = b - a + LENGTH
    end = np.cumsum(length)
    begin = end - length
    kept, names = [], []
    pieces = np.unique(np.searchsorted(end, np.arange(0, int(end[-1]), tile_bytes)))
    for k, m in zip(pieces.tolist(), [*pieces[1:].tolist(), len(a)]):
        text = _Text(data[common.spread(a[k:m], length[k:m])])
        back = begin[k:m] - begin[k]
        moved = a[k:m] - back
        a2, b2, p2, q2 = _split(back, b[k:m] - moved, p[k:m] - moved, level)
        names.append(_names(text, a2, b2, p2, q2, level))
        owner = np.searchsorted(back, a2, "right") - 1
        to_chunk = (a[k:m] + shift if isinstance(shift, int) else a[k:m] + shift[k:m]) - begin[k:m]
        kept.append((a2 + begin[k], b2 + begin[k], p2 + begin[k], to_chunk[owner]))
    ask, key = _message(chunk, tuple(np.concatenate(x) for x in zip(*names)), buckets)
    spans = data[common.spread(a, length)]
    node = [np.concatenate(x).tobytes() for x in zip(*kept)]
    body = common.pack_table(pa.record_batch([pa.array([*node, spans.tobytes()], pa.binary())], ["x"]))
    return [{"kind": 0, "bucket": None, "chunk": chunk, "a": body, "b": None, "c": key}, *ask]


def _ranges(chunk: int, a: np.ndarray, b: np.ndarray) -> dict:
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    return {"kind": 2, "bucket": None, "chunk": chunk, "a": common.pack(np.concatenate([common.varint(np.diff(a, prepend=0)), common.varint(b - a)])), "b": None, "c": None}


def _second(left: pa.Table, right: pa.Table, level: int, buckets: int, tile_bytes: int) -> pa.Table:
    if left.num_rows == 0:
        return _ROWS.empty_table()
    chunk = left.column("chunk")[0].as_py()
    a, b, p = _nodes(left.column("b")[0].as_py())
    open_, span = _answers(left.column("c")[0].as_py(), right)
    out = [_ranges(chunk, a[span], b[span])]
    if open_.any():
        data, _ = common.utf8(common.unpack_table(left.column("a")[0].as_py()).column("text"))
        out += _carry(chunk, a[open_], b[open_], p[open_], 0, data, level, buckets, tile_bytes)
    return pa.Table.from_pylist(out, _ROWS)


def _further(left: pa.Table, right: pa.Table, level: int | None, buckets: int, tile_bytes: int) -> pa.Table:
    """As ``_second`` from carried nodes; ``level`` None: the nodes were single windows, and all is decided."""
    if left.num_rows == 0:
        return _ROWS.empty_table()
    chunk = left.column("chunk")[0].as_py()
    x = common.unpack_table(left.column("a")[0].as_py()).column("x").to_pylist()
    a, b, p, shift = (np.frombuffer(y, np.int64) for y in x[:4])
    data = np.frombuffer(x[4], np.uint8)
    open_, span = _answers(left.column("c")[0].as_py(), right)
    out = [_ranges(chunk, (a + shift)[span], (b + shift)[span])] if span.any() else []
    if level is not None and open_.any():
        out += _carry(chunk, a[open_], b[open_], p[open_], shift[open_], data, level, buckets, tile_bytes)
    return pa.Table.from_pylist(out, _ROWS)


def _cut(left: pa.Table, right: pa.Table, columns: list[str], schema: pa.Schema) -> pa.Table:
    """One chunk's documents without the bytes that a repeated window covers."""
    if left.num_rows == 0:
        return schema.empty_table()
    rows = common.unpack_table(left.column("a")[0].as_py())
    data, offsets = common.utf8(rows.column("text"))
    cover = np.zeros(len(data) + 1, np.int32)
    for packed in right.column("a").to_pylist():
        v = common.unvarint(common.unpack(packed, np.uint8))
        a = np.cumsum(v[: len(v) // 2])
        b = a + v[len(v) // 2 :]
        np.add.at(cover, a, 1)
        np.add.at(cover, b + LENGTH, -1)
    gone = np.cumsum(cover[:-1]) > 0
    removed = np.concatenate(([0], np.cumsum(gone)))
    texts, spans = [], []
    for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        own = gone[start:end]
        if removed[end] == removed[start]:
            texts.append(data[start:end].tobytes())
            spans.append([])
            continue
        texts.append(data[start:end][~own].tobytes())
        edge = np.flatnonzero(np.diff(np.concatenate(([False], own, [False])).astype(np.int8))).tolist()
        spans.append([{"start": s, "end": e} for s, e in zip(edge[::2], edge[1::2])])
    made = {
        "n_bytes": pa.array(np.diff(offsets), pa.int64()),
        "n_removed": pa.array(removed[offsets[1:]] - removed[offsets[:-1]], pa.int64()),
        "spans": pa.array(spans, schema.field("spans").type),
        "kept": pa.array(texts, pa.binary()),
    }
    return pa.table([rows.column(f"c{columns.index(f.name)}") if f.name in columns else made[f.name] for f in schema], schema=schema)


def remove_repeats(docs: DataFrame, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), chunk_bytes: int = CHUNK_BYTES, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """The columns ``carry`` of every row, with ``n_bytes``, ``n_removed``, ``spans`` (array of start and end, the maximal
    removed runs of UTF-8 bytes) and ``kept`` (binary: the other bytes).

    A byte goes if a ``LENGTH``-byte string covers it that also starts anywhere else in any text. Null text: as empty.
    Texts shorter than that lose nothing. Rows with equal ids are rows of their own. An empty table gives an empty
    result. Chunks and tiles of other sizes give equal results. ``carry`` columns can be of any Arrow-friendly type and must not be named like the new columns.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    common.small_batches(spark)
    parts = common.partitions(spark)
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = max(parts, -(-size // BUCKET_BYTES))
    columns = list(carry)
    rows = docs.select(F.col(text_col).alias("text"), *(F.col(c).alias(f"c{k}") for k, c in enumerate(columns)))
    first = materialize(rows.mapInArrow(lambda it: _first(it, buckets, chunk_bytes, tile_bytes), _DDL), "suffix")

    def replies(t: DataFrame) -> DataFrame:
        asked = t.where("kind = 1").select("bucket", "chunk", "a", "b", "c").repartition(parts, "bucket").sortWithinPartitions("bucket", "chunk")
        return asked.mapInArrow(_count, "bucket long, chunk long, a binary, b binary, c binary, d binary")

    def joined(t: DataFrame, f) -> DataFrame:
        return t.where("kind = 0").select("chunk", "a", "b", "c").groupBy("chunk").cogroup(replies(t).groupBy("chunk")).applyInArrow(f, _DDL)

    def further(level: int | None):
        return lambda x, y: _further(x, y, level, buckets, tile_bytes)

    now = materialize(joined(first, lambda x, y: _second(x, y, LEVELS[1], buckets, tile_bytes)), "suffix")
    found = materialize(now.where("kind = 2").select("chunk", "a"), "ranges")
    for level in (*LEVELS[2:], None):
        last, now = now, materialize(joined(now, further(level)), "suffix")
        discard(last)  # what it has found lies in a small table of its own
        found = found.union(materialize(now.where("kind = 2").select("chunk", "a"), "ranges"))
    discard(now)
    out = T.StructType([*docs.select(*columns).schema.fields, *T.StructType.fromDDL("n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept binary").fields])
    schema = to_arrow_schema(out)
    return first.where("kind = 0").select("chunk", "a").groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(lambda x, y: _cut(x, y, columns, schema), out)


def with_text(out: DataFrame) -> DataFrame:
    """The rows of ``remove_repeats`` with the column ``text``: what is kept, without pieces of characters that a cut
    went through. Keeps the other columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.column(batch.schema.get_field_index("kept")).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string())], [*batch.schema.names, "text"])

    return out.mapInArrow(run, T.StructType([*out.schema.fields, T.StructField("text", T.StringType())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(common.table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
