"""Sums of fixed-size count arrays over a whole corpus."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame

CHUNK = 1 << 15
SCHEMA = "chunk int, counts binary"


def chunks(counts: np.ndarray):
    """(chunk, compressed 32-bit counts) of the chunks of one task's array that are not all zero."""
    for k in range(0, len(counts), CHUNK):
        part = counts[k : k + CHUNK]
        if part.any():
            yield k // CHUNK, zlib.compress(part.astype("<u4").tobytes(), 1)


def gather(rows: DataFrame, length: int, code=None, kind=np.int64) -> np.ndarray:
    """The sum of all tasks' arrays. rows: chunk and counts; chunks are summed apart, and `length` numbers reach the driver,
    of type `kind` and encoded by `code` where it is given."""

    def add(batches):
        import pyarrow as pa

        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(raw), "<u4")
                if k in sums:
                    sums[k] += part
                else:
                    sums[k] = part.astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([(code(x) if code else x).tobytes() for x in sums.values()], pa.binary())], names=["chunk", "counts"])

    out = np.zeros(-(-length // CHUNK) * CHUNK, kind)
    n = -(-length // CHUNK)
    for row in rows.repartition(min(n, 64), "chunk").mapInArrow(add, SCHEMA).collect():
        part = np.frombuffer(bytes(row["counts"]), kind)
        out[row["chunk"] * CHUNK : row["chunk"] * CHUNK + len(part)] = part
    return out[:length]
