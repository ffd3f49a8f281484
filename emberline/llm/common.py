"""Reading, batching and byte packing that the operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Bytes that separate words: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the decimal text of an id, modulo ``n`` (null id: null)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of bounded bytes, so that a run of very long texts can't fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pack(a: bytes | np.ndarray, level: int = 3) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes())


def unpack(b: bytes, dtype=None) -> bytes | np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(b)
    return raw if dtype is None else np.frombuffer(raw, dtype)


def narrow(values: np.ndarray) -> np.ndarray:
    """Unsigned values in the fewest bytes that hold them all."""
    top = int(values.max()) if len(values) else 0
    return values.astype("u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4")


def pack_narrow(values: np.ndarray, level: int = 9) -> bytes:
    """``narrow`` values, with their width in the first byte."""
    v = narrow(values)
    return bytes([v.itemsize]) + pack(v, level)


def unpack_narrow(data: bytes) -> np.ndarray:
    return unpack(data[1:], f"<u{data[0]}").astype(np.uint32)


def pack_table(t: pa.Table | pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write(t)
    return sink.getvalue().to_pybytes()


def unpack_table(b: bytes) -> pa.Table:
    return pa.ipc.open_stream(b).read_all()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column end to end, and n + 1 offsets into them (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = pc.fill_null(pc.cast(column, pa.large_binary()), b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunked(batches: Iterator[pa.RecordBatch], column: str, limit: int, most: int = 1 << 62) -> Iterator[pa.Table]:
    """Rows in groups of about ``limit`` bytes of text and ``most`` rows; a longer text is a group of its own."""
    held: list[pa.RecordBatch] = []
    size = rows = 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(pc.cast(batch.column(batch.schema.get_field_index(column)), pa.large_binary())), 0).to_numpy(zero_copy_only=False)
        at = 0
        while at < len(lengths):
            ends = np.cumsum(lengths[at:]) + size
            n = min(int(np.searchsorted(ends, limit, "right")), most - rows)
            if n == 0 and rows == 0:
                n = 1
            if n:
                held.append(batch.slice(at, n))
                size = int(ends[n - 1])
                rows += n
                at += n
            if at < len(lengths) or size >= limit or rows >= most:
                yield pa.Table.from_batches(held)
                held, size, rows = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)
    pa.default_memory_pool().release_unused()  # the worker lives on, beside those of later stages


def whole_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by integer keys, in tables that don't cut a group, with the groups' starts."""

    def starts(table: pa.Table) -> np.ndarray:
        k = np.stack([table.column(c).to_numpy() for c in keys], 1)
        return np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]).any(1))))

    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        at = starts(held)
        if len(at) > 1:
            yield held.slice(0, at[-1]), at[:-1]
            held = held.slice(at[-1])
    if held is not None and held.num_rows:
        yield held, starts(held)
    pa.default_memory_pool().release_unused()


def varint(values: np.ndarray) -> np.ndarray:
    """Unsigned values as little-endian groups of seven bits."""
    v = values.astype(np.uint64)
    size = 1 + sum((v >= np.uint64(1 << (7 * k))).astype(np.int64) for k in range(1, 5))
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(5):
        on = size > k
        out[at[on] + k] = ((v[on] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | ((size[on] > k + 1).astype(np.uint8) << 7)
    return out


def unvarint(data: np.ndarray) -> np.ndarray:
    last = (data & 128) == 0
    ends = np.flatnonzero(last)
    starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    out = np.zeros(len(ends), np.int64)
    size = ends - starts + 1
    for k in range(5):
        on = size > k
        out[on] |= (data[starts[on] + k].astype(np.int64) & 127) << (7 * k)
    return out


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices of the runs ``[start, start + length)``, one after another."""
    total = int(lengths.sum())
    begin = np.cumsum(lengths) - lengths
    return np.repeat(starts - begin, lengths) + np.arange(total)
