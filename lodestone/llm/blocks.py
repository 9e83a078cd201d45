"""Exchanging large arrays: rows of a bucket number and a packed block of arrays.

A shuffle of some hundred values a row costs the JVM and Arrow as little as one value would. Each task packs its values by
bucket; a bucket's blocks come to one task in sequence, which takes one bucket at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "bucket int, block binary"


def pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *(x for a in arrays for x in (a.dtype.itemsize * 100 + ord(a.dtype.kind) % 100, len(a)))], np.int64)
    return b"".join([head.tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)])


_KINDS = {ord(k) % 100: k for k in "iufbS"}


def unpack(block: bytes | pa.Buffer) -> list[np.ndarray]:
    n = int(np.frombuffer(block, np.int64, 1)[0])
    head = np.frombuffer(block, np.int64, 2 * n, 8)
    at, out = 8 + 16 * n, []
    for code, size in zip(head[::2].tolist(), head[1::2].tolist()):
        kind = np.dtype(f"{_KINDS[code % 100]}{code // 100}")
        out.append(np.frombuffer(block, kind, size, at))
        at += size * kind.itemsize
    return out


def batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "block"])


def spread(bucket: np.ndarray, n: int, *arrays: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Each bucket that has values, with its part of the arrays, in their order."""
    order = np.argsort(bucket, kind="stable")
    edge = np.searchsorted(bucket[order], np.arange(n + 1))
    for b in np.flatnonzero(np.diff(edge)):
        at = order[edge[b] : edge[b + 1]]
        yield int(b), [a[at] for a in arrays]


def by_bucket(df: DataFrame, n: int, run: Callable[[int, list[list[np.ndarray]]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """run(bucket, its unpacked blocks) for each of n buckets of df, a table of SCHEMA."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        now = None
        for got in batches:
            for b, block in zip(got.column(0).to_pylist(), got.column(1)):
                if b != now and held:
                    yield from run(now, held)
                    held = []
                now = b
                held.append(unpack(block.as_buffer()))
        if held:
            yield from run(now, held)

    return df.repartitionById(n, "bucket").sortWithinPartitions("bucket").mapInArrow(each, schema)


def joined(blocks: list[list[np.ndarray]]) -> list[np.ndarray]:
    """The blocks' arrays, one after the other."""
    return [np.concatenate(x) for x in zip(*blocks, strict=True)]
