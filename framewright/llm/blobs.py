"""Arrays in binary columns, and Arrow batches in and out.

Operators that move millions of tiny records pack those that go to the same
bucket into one compressed row. Spark still partitions and shuffles them; the
number of buckets follows the session's shuffle partitions, so that a bucket
stays small when the cluster's settings fit its input.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

BUCKETS_PER_PARTITION = 2


def buckets(spark: SparkSession) -> int:
    return BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))


def pack(*arrays: np.ndarray) -> bytes:
    parts = [struct.pack("<B", len(arrays))]
    for a in arrays:
        a = np.ascontiguousarray(a)
        parts.append(struct.pack("<3sQ", a.dtype.str[1:].encode(), a.nbytes))
        parts.append(a.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(body: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(body)
    (count,), at, out = struct.unpack_from("<B", raw), 1, []
    for _ in range(count):
        kind, size = struct.unpack_from("<3sQ", raw, at)
        at += struct.calcsize("<3sQ")
        kind = np.dtype("<" + kind.rstrip(b"\0").decode())
        out.append(np.frombuffer(raw, kind, size // kind.itemsize, at))
        at += size
    return out


def unpack_all(bodies) -> list[np.ndarray]:
    """The arrays of all bodies, those of the same place put together."""
    return [np.concatenate(a) for a in zip(*map(unpack, bodies))]


def split_by(key: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple]:
    """Each key with its part of every array, in the order they had."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    edges = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else []
    arrays = [a[order] for a in arrays]
    for lo, hi in zip(edges, np.r_[edges[1:], len(key)]):
        yield int(key[lo]), *(a[lo:hi] for a in arrays)


def delta(a: np.ndarray) -> np.ndarray:
    """Differences of neighbours: small numbers, which compress well."""
    return np.diff(a, prepend=a.dtype.type(0))


def encoded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column end to end, and where each row ends; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets[1:] - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], text: str, size: int) -> Iterator[pa.RecordBatch]:
    """The rows again, cut so that a piece has about ``size`` bytes of text; one row is never cut."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        ends = encoded(column)[1]
        lo = 0
        while lo < len(ends):
            start = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, start + size, side="right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


