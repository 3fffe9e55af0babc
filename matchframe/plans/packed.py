"""Numeric rows in chunks, for work that scans the same rows many times.

A written row holds a few thousand rows of the table as one compressed block, column after column.
A scan hands blocks to Python as they are, so it costs neither rows in the JVM nor Arrow columns.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from .session import scratch_dir

CHUNK = 4096
LEVEL = 3  # of zstd
# small row groups: a reader holds one at a time, and few chunks make enough tasks
OPTIONS = {"parquet.block.size": 4 << 20, "parquet.enable.dictionary": "false", "compression": "none"}


def write_chunks(df: DataFrame) -> DataFrame:
    """Write once to the shared scratch folder and read back, as materialize() does."""
    path = scratch_dir(df.sparkSession)
    df.write.options(**OPTIONS).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def packed(df: DataFrame, columns: Sequence[Column]) -> DataFrame:
    """n, v: blocks of up to CHUNK rows, nulls as NaN."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, CHUNK):
                part = batch.slice(first, CHUNK)
                block = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in part.columns])
                yield pa.RecordBatch.from_arrays([pa.array([part.num_rows], pa.int32()), pa.array([squeeze_block(block)], pa.binary())], names=["n", "v"])
    rows = df.select(*[c.cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    return write_chunks(rows.mapInArrow(run, "n int, v binary"))


def blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    """The (columns, rows) arrays of a task's chunks."""
    for batch in batches:
        for n, v in zip(batch.column(0).to_pylist(), batch.column(1)):
            yield expand_block(v.as_buffer(), width, n)


def squeeze(data: np.ndarray) -> bytes:
    return pa.Codec("zstd", compression_level=LEVEL).compress(np.ascontiguousarray(data).tobytes(), asbytes=True)


def expand(data, kind: str, *shape: int) -> np.ndarray:
    size = int(np.prod(shape)) * np.dtype(kind).itemsize
    return np.frombuffer(pa.Codec("zstd").decompress(data, size), kind).reshape(shape) if size else np.zeros(shape, kind)


def squeeze_block(block: np.ndarray) -> bytes:
    """Compressed (columns, rows) numbers: a column of few different values as these and a code of one or two
    bytes per row, another one as it is. Bits are kept, also of NaN and of minus zero."""
    sizes, parts = [], []
    for column in np.ascontiguousarray(block, np.float64).view(np.int64):
        coded = pa.array(column).dictionary_encode()
        k = len(coded.dictionary)
        width = 1 if k <= 256 else 2
        if k <= 65536 and 8 * k + width * len(column) < 8 * len(column):
            sizes.append(k)
            parts += [coded.dictionary.to_numpy().tobytes(), coded.indices.to_numpy().astype(f"u{width}").tobytes()]
        else:
            sizes.append(-1)
            parts.append(column.tobytes())
    body = b"".join(parts)
    return np.array([len(body), *sizes], np.int32).tobytes() + squeeze(np.frombuffer(body, np.uint8))


def expand_block(data, columns: int, n: int) -> np.ndarray:
    length, *sizes = np.frombuffer(data, np.int32, columns + 1).tolist()
    body, at, out = expand(memoryview(data)[4 * (columns + 1):], "u1", length), 0, np.empty((columns, n))
    for row, k in zip(out, sizes):
        if k < 0:
            row[:] = body[at:at + 8 * n].view(np.float64)
            at += 8 * n
            continue
        values, width = body[at:at + 8 * k].view(np.float64), 1 if k <= 256 else 2
        at += 8 * k
        np.take(values, body[at:at + width * n].view(f"u{width}"), out=row)
        at += width * n
    return out


def squeeze_ids(*columns: np.ndarray) -> bytes:
    """Whole numbers, all first bytes, all second bytes and so on: the high ones are mostly the same."""
    ids = np.stack([np.ascontiguousarray(c, np.int64) for c in columns])
    return squeeze(ids.view(np.uint8).reshape(*ids.shape, 8).transpose(0, 2, 1))


def expand_ids(data: bytes, columns: int, n: int) -> np.ndarray:
    planes = expand(data, "u1", columns, 8, n)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(np.int64).reshape(columns, n)


def slot_of(ids: np.ndarray, slots: int) -> np.ndarray:
    """A task number per id, the same wherever it is asked for."""
    return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(slots)).astype(np.int64)


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches joined to tables of at least so many rows, the last one of what is left."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def runs(key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each key with the places that hold it, in order."""
    order = np.argsort(key, kind="stable")
    cuts = np.flatnonzero(np.diff(key[order])) + 1
    for part in np.split(order, cuts) if len(order) else ():
        yield int(key[part[0]]), part
