"""Vectors as rows: which of them count, classes of equal ones, and streams of grouped rows inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.operators.keyed import cut_lineage


def numbered(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """``uid, vec_id, vec, valid``; a vector counts if it is neither null nor zero and of finite numbers only."""
    value = F.col("vec")
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(value, lambda x: x != 0)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("vec")).withColumn("valid", F.coalesce(finite, F.lit(False)))
    return cut_lineage(rows.withColumn("uid", F.monotonically_increasing_id()))


def by_length(rows: DataFrame) -> list[DataFrame]:
    """The vectors that count, one frame for each length, shortest first; vectors of different lengths are not comparable.

    An operator runs once for each length: a table is meant to have few.
    """
    lengths = [r.n for r in rows.filter("valid").select(F.size("vec").alias("n")).distinct().orderBy("n").collect()]
    return [rows.filter(F.col("valid") & (F.size("vec") == n)) for n in lengths]


def matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls as rows of numbers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def unit_rows(rows: np.ndarray) -> np.ndarray:
    """Rows in double precision, each of length one; scaled first, so that large numbers do not overflow."""
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of sorted batches, one table for each run of equal keys."""
    kept: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in keys], axis=1)
        cuts = np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(values)]])
        for start, end in zip(starts, ends, strict=True):
            key = tuple(values[start])
            if kept and key != last:
                yield pa.Table.from_batches(kept)
                kept = []
            kept.append(batch.slice(start, end - start))
            last = key
    if kept:
        yield pa.Table.from_batches(kept)
