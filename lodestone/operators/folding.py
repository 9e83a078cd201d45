"""Digests of ordered groups as a streaming fold: the state of the hash is carried from batch to batch."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import PREFIX


def folded_digest(rows: DataFrame, by: list[str], order: list[str], piece: Column, opening: str = "", between: str = "", closing: str = "", prefix: str = PREFIX) -> DataFrame:
    """(by, digest): SHA-256 of each group's pieces in order, with what stands before, between and behind them.

    A group is sorted by Spark, which spills, and streams through one task: memory is that of a batch, whatever the group's
    size. Null pieces are left out; with no columns in by, all rows are one group, and none if there are no rows.
    """
    keys = by or ["__all"]
    parts = rows.select(*((F.col(c) for c in by) if by else [F.lit(0).alias("__all")]), *(F.col(c).alias(f"__o{i}") for i, c in enumerate(order)), piece.alias("__piece"))
    fields = [parts.schema[k] for k in keys] + [T.StructField("digest", T.StringType())]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields])
    at = len(keys) + len(order)

    def fold(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, between_, first = hashlib.sha256(opening.encode()), between.encode(), True
        for batch in batches:
            own = batch.column(at).drop_null()
            for text in own:
                if not first:
                    state.update(between_)
                state.update(text.as_buffer())
                first = False
        state.update(closing.encode())
        yield pa.RecordBatch.from_arrays([*(pa.array([k.as_py()], k.type) for k in key), pa.array([prefix + state.hexdigest()])], names=[*keys, "digest"])

    # the grouping needs rows dealt out and sorted by its keys, which they are: the order within a group stays
    dealt = parts.repartition(*keys).sortWithinPartitions(*keys, *(f"__o{i}" for i in range(len(order))))
    found = dealt.groupBy(*keys).applyInArrow(fold, schema)
    return found if by else found.drop("__all")
