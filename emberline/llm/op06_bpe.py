"""Operator 6: byte-level BPE encoding and decoding by a global distinct-word shuffle.

A text is cut into pre-tokens by the public pattern. A chunk of documents keeps its pre-tokens as positions in the
chunk's own word list; the words alone are shuffled, dealt out by their hash. The entries of a word from all chunks meet
in one bucket, where each distinct word is encoded once; the ids go back to the chunks and are laid out by position. What
moves is each word once per chunk, never each occurrence: the most frequent word is one entry per chunk, so no word is a
hot key. Buckets are as many as the bytes of text ask for and are read one after another.

Decoding looks the ids up in the table of token bytes, which goes to every task: a join with a table of the
vocabulary's size.

Words, positions and ids travel in packed blocks (one row per chunk and word bucket). The chunk table is written to the
shared folder before the shuffle: a lost executor re-reads it, and positions and words always come from the same run.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from emberline.llm import common
from emberline.storage import materialize

#: Text bytes of a chunk (bounds the word list and the positions that a task holds), and for each bucket of words.
CHUNK_BYTES, BUCKET_BYTES = 12 << 20, 64 << 20
#: Characters from which on a text's words are read one by one.
LONG = 1 << 20


def ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class _Words(dict):
    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _split(batches: Iterator[pa.RecordBatch], pattern: str, buckets: int, chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    import regex

    pattern = regex.compile(pattern)

    def codes_of(text: str) -> np.ndarray:
        if len(text) > LONG:
            return np.fromiter((words[m[0]] for m in pattern.finditer(text)), np.uint32)
        found = pattern.findall(text)
        return np.fromiter(map(words.__getitem__, found), np.uint32, len(found))

    chunk = TaskContext.get().partitionId() << 32
    for rows in common.chunked(batches, "text", chunk_bytes):
        words = _Words()
        codes = [codes_of(text or "") for text in rows.column("text").to_pylist()]
        flat = np.concatenate(codes) if codes else np.zeros(0, np.uint32)
        order = np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")
        rank = np.empty(len(words), np.uint32)
        rank[order] = np.arange(len(words), dtype=np.uint32)
        names = np.array([w.encode() for w in words], object)[order] if words else np.zeros(0, object)
        bucket = np.fromiter((zlib.crc32(w) % buckets for w in names), np.uint32, len(names))
        head = pa.table({"doc": rows.column("doc"), "n": pa.array([len(c) for c in codes], pa.int64())})
        body = common.pack_table(head.combine_chunks())
        positions = common.pack(common.varint(rank[flat]), 9)
        out = [(None, chunk, body, positions, common.pack_narrow(bucket))]
        at = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[at])) + 1
        for group in np.split(at, cuts) if len(at) else []:
            lengths = np.fromiter(map(len, names[group]), np.int64, len(group))
            out.append((int(bucket[group[0]]), chunk, b"".join(names[group]), common.varint(lengths).tobytes(), None))
        for row in range(0, len(out), 256):
            yield pa.RecordBatch.from_pylist(
                [dict(zip(("bucket", "chunk", "a", "b", "c"), (r[0], r[1], common.pack(r[2], 9), common.pack(r[3], 9), None) if r[0] is not None else r)) for r in out[row : row + 256]],
                _CHUNKS,
            )
        chunk += 1


_CHUNKS = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
_IDS = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("n", pa.binary()), ("ids", pa.binary())])


def _encode(batches: Iterator[pa.RecordBatch], table: dict[bytes, int], pattern: str) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket: a bucket's words are reduced to the distinct ones, and each is encoded once."""
    import tiktoken

    one = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})._core_bpe.encode_single_piece
    for rows, starts in common.whole_groups(batches, ("bucket",)):
        for first, last in zip(starts.tolist(), [*starts[1:].tolist(), rows.num_rows]):
            known: dict[bytes, list[int]] = {}
            out = []
            for bucket, chunk, a, b in zip(*(rows.column(i).slice(first, last - first).to_pylist() for i in range(4))):
                data, lengths = common.unpack(a), common.unvarint(common.unpack(b, np.uint8))
                ends = np.cumsum(lengths)
                sizes, ids = [], []
                for start, end in zip((ends - lengths).tolist(), ends.tolist()):
                    word = data[start:end]
                    got = known.get(word)
                    if got is None:
                        known[word] = got = one(word)
                    sizes.append(len(got))
                    ids += got
                out.append({"bucket": bucket, "chunk": chunk, "n": common.pack(common.varint(np.array(sizes, np.int64))), "ids": common.pack_narrow(np.array(ids, np.uint32))})
            yield pa.RecordBatch.from_pylist(out, _IDS)


def _lay_out(left: pa.Table, right: pa.Table) -> pa.Table:
    """The ids of one chunk's documents: positions -> words -> ids."""
    schema = pa.schema([("doc", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
    if left.num_rows == 0:
        return schema.empty_table()
    head = common.unpack_table(left.column("a")[0].as_py())
    positions = common.unvarint(common.unpack(left.column("b")[0].as_py(), np.uint8))
    bucket = common.unpack_narrow(left.column("c")[0].as_py())
    size = np.zeros(len(bucket), np.int64)
    start = np.zeros(len(bucket), np.int64)
    parts, at = [], 0
    for b, n, ids in zip(right.column("bucket").to_pylist(), right.column("n").to_pylist(), right.column("ids").to_pylist()):
        own = np.flatnonzero(bucket == b)
        n, ids = common.unvarint(common.unpack(n, np.uint8)), common.unpack_narrow(ids)
        size[own], start[own] = n, at + np.cumsum(n) - n
        parts.append(ids)
        at += len(ids)
    flat = np.concatenate(parts) if parts else np.zeros(0, "<u4")
    counts, texts, done = [], [], 0
    for n in head.column("n").to_pylist():
        own = positions[done : done + n]
        done += n
        ids = flat[common.spread(start[own], size[own])]
        counts.append(len(ids))
        texts.append(ids.tobytes())
    return pa.table({"doc": head.column("doc"), "n_tokens": pa.array(counts, pa.int64()), "ids": pa.array(texts, pa.binary())}, schema)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``(id_col, n_tokens, ids)`` for every row: ids are little-endian unsigned 32-bit integers, as the tiktoken
    library's ``encode_ordinary`` gives them. Null text: as empty, no ids. Repeated rows and ids: a row each. Null ids
    stay null. Other columns aren't read. An empty table gives an empty result. ``path``, the ranks, is read by the
    driver. Chunks of other sizes give equal results.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    parts = common.partitions(spark)
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = max(parts, -(-size // BUCKET_BYTES))
    table = spark.sparkContext.broadcast(ranks(path))  # of the vocabulary's size
    chunks = materialize(
        docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).mapInArrow(lambda it: _split(it, pattern, buckets, chunk_bytes), "bucket long, chunk long, a binary, b binary, c binary"),
        "bpe",
    )
    ids = (
        chunks.where("bucket is not null").select("bucket", "chunk", "a", "b").repartition(parts, "bucket").sortWithinPartitions("bucket")
        .mapInArrow(lambda it: _encode(it, table.value, pattern), "bucket long, chunk long, n binary, ids binary")
    )
    return (
        chunks.where("bucket is null").select("chunk", "a", "b", "c").groupBy("chunk")
        .cogroup(ids.groupBy("chunk"))
        .applyInArrow(_lay_out, "doc long, n_tokens long, ids binary")
        .withColumnRenamed("doc", id_col)
    )


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with the column ``decoded`` (binary): the bytes of each row's tokens, looked up by rank in the table
    of token bytes, whose size is the vocabulary's. Null ids: null."""
    by_rank = sorted(ranks(path).items(), key=lambda x: x[1])
    lengths = np.zeros(by_rank[-1][1] + 1, np.int64)
    for token, rank in by_rank:
        lengths[rank] = len(token)
    table = encoded.sparkSession.sparkContext.broadcast((lengths, b"".join(token for token, _ in by_rank)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, flat = table.value[0], np.frombuffer(table.value[1], np.uint8)
        start = np.cumsum(size) - size
        for batch in batches:
            out = []
            for ids in batch.column(batch.schema.get_field_index(ids_col)).to_pylist():
                own = np.frombuffer(ids, "<u4") if ids is not None else None
                out.append(None if own is None else flat[common.spread(start[own], size[own])].tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, f"{fields}, decoded binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = decode(encode(common.table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN), path)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
