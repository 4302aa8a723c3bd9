"""Helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.operators.keyed import cut_lineage

#: Letters A to Z and their small forms; other letters keep their case.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def mix64(x: np.ndarray | int) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the splitmix finaliser), by array."""
    with np.errstate(over="ignore"):
        x = np.asarray(x).astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def unit(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the values alone."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 53)).cast("double") / float(1 << 53)


def with_row_id(rows: DataFrame, name: str = "_uid") -> DataFrame:
    """Rows with a number of their own, fixed by writing them to the shared folder once."""
    return cut_lineage(rows.withColumn(name, F.monotonically_increasing_id()))


def extended(rows: DataFrame, **columns: T.DataType) -> T.StructType:
    """The schema of ``rows`` with further columns at its end."""
    return T.StructType([*rows.schema.fields, *(T.StructField(name, kind) for name, kind in columns.items())])


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Arrow batches in pieces of a few rows, so that a worker holds the results of few long texts at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def running_total(rows: DataFrame, order: list[str], amount: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``amount`` over all rows before each one, in the order given.

    The rows are dealt by range and summed inside each range; what crosses ranges is one number per range.
    Rows should be narrow, as they are written to the shared folder.
    """
    def local(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before = 0
        for frame in frames:
            sums = frame[amount].cumsum()
            yield frame.assign(**{name: sums - frame[amount] + before})
            before += int(sums.iloc[-1]) if len(sums) else 0

    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    stretches = cut_lineage(ranged.mapInPandas(local, extended(rows, **{name: T.LongType()})).withColumn("_range", F.spark_partition_id()))
    sizes = stretches.groupBy("_range").agg(F.sum(amount).alias("_size"))
    # one row per range: as many as there are shuffle partitions, whatever the data
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_size").over(ahead), F.lit(0)).alias("_start"))
    return stretches.join(F.broadcast(starts), "_range").withColumn(name, F.col(name) + F.col("_start")).drop("_range", "_start")
