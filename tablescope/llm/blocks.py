"""Columns of numbers as compressed blocks: one row for each bucket and batch, instead of one for each number.

A block holds its first column as differences and all columns byte by byte (all lowest bytes, then all second ones, ...),
so that sorted keys and small numbers take as many bytes as they need.
"""

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tablescope.llm import hashing

SCHEMA = "bucket int, kind int, n int, data binary"


def buckets_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return (hashing.mix(key) >> np.uint64(32)).astype(np.int64) % buckets


def pack(numbers: np.ndarray, kind: int, *columns: np.ndarray) -> pa.RecordBatch:
    """The rows of the columns, in order, as a block for each bucket number."""
    order = np.argsort(numbers.astype(np.uint16 if len(numbers) and numbers.max() < 1 << 16 else np.int64), kind="stable")
    there = numbers[order]
    first = np.flatnonzero(np.append(True, there[1:] != there[:-1])) if len(there) else np.zeros(0, np.int64)
    ends, codec = np.append(first[1:], len(there)), pa.Codec("zstd", compression_level=1)
    columns = [c[order] for c in columns]
    steps = columns[0].copy()
    steps[1:] -= columns[0][:-1]
    steps[first] = columns[0][first]
    columns[0] = steps
    data = [codec.compress(b"".join(c[x:y].view(np.uint8).reshape(-1, c.itemsize).T.tobytes() for c in columns), asbytes=True)
            for x, y in zip(first, ends)]
    return pa.RecordBatch.from_arrays([pa.array(there[first], pa.int32()), pa.array(np.full(len(first), kind), pa.int32()),
                                       pa.array(ends - first, pa.int32()), pa.array(data, pa.binary())],
                                      names=["bucket", "kind", "n", "data"])


def unpack(n: int, data: bytes, *types) -> list[np.ndarray]:
    types = [np.dtype(t) for t in types]
    raw = np.frombuffer(pa.Codec("zstd").decompress(data, n * sum(t.itemsize for t in types)), np.uint8)
    out, at = [], 0
    for t in types:
        part = raw[at:at + n * t.itemsize].reshape(t.itemsize, n)
        out.append(np.ascontiguousarray(part.T).view(t).reshape(n))
        at += n * t.itemsize
    out[0] = np.cumsum(out[0], dtype=out[0].dtype)
    return out


def unpacked(batches: Iterable[pa.RecordBatch], kinds: dict[int, tuple]) -> dict[int, list[np.ndarray]]:
    """The columns of all blocks of each kind; `kinds` has the types of their columns."""
    held = {k: [[np.zeros(0, t) for t in types]] for k, types in kinds.items()}
    for batch in batches:
        for kind, n, data in zip(*(batch.column(c).to_pylist() for c in ("kind", "n", "data"))):
            held[kind].append(unpack(n, data, *kinds[kind]))
    return {k: [np.concatenate(c) for c in zip(*parts)] for k, parts in held.items()}


def dealt(blocks: DataFrame, buckets: int) -> DataFrame:
    """A partition for each bucket."""
    return blocks.repartitionById(buckets, "bucket")
