"""Mixing sources to target weights by pivotal dependent rounding.

Every document has an expected number of copies, the target of its source over the source's size. The whole
part is taken for sure. The fractions are rounded in pairs: mass, counted in words, moves at random from one
document to the other until one fraction is 0 or 1, so the words of a source stay the same and each document
keeps its expectation. Pairing runs in buckets of a source; the one undecided document that a bucket leaves
goes up a tree of further buckets until a source has one, which goes to the nearer whole number.

Defined results: a null or blank text has size 0 and takes 0 words; a null source is a source of its own, last
in order; a source of size 0 has target 0; repeated rows are rounded each for itself; all random choices are
hashes of id, size and source, so that reruns agree however rows are dealt.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import mix64, running_total, table, unit, with_row_id
from attestry.operators.keyed import cut_lineage, salted_join

WORD = r"[^\x20\x09-\x0D]+"
BUCKET, FAN_IN = 1024, 256


def n_words(text: str | Column) -> Column:
    """Number of words of a text: runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``source, source_size, target``: sources in order take the weights in turn and share ``share`` of all sizes.

    A target stops at ``most`` times its source's size; the excess goes to the others by weight until none is
    above. One row of sums reaches the driver for each round; a round settles at least one source.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("_one", F.lit(1).cast("long"))
    ranked = running_total(sources.withColumn("_null", F.col("source").isNull().cast("int")), ["_null", "source"], "_one", "_rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights)).cast("int") + 1)
    rows = cut_lineage(ranked.select("source", "source_size", weight.alias("_w"), (F.col("source_size") * float(most)).alias("_cap")))
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    level = None  # words per unit of weight; a source is settled once level * weight reaches its cap
    while True:
        settled = F.lit(False) if level is None else F.col("_w") * level >= F.col("_cap")
        used, open_weight, n = rows.agg(
            F.sum(F.when(settled, F.col("_cap")).otherwise(0.0)), F.sum(F.when(settled, 0.0).otherwise(F.col("_w"))), F.count(F.when(settled, 1))
        ).first()
        if not open_weight or level is not None and n == before:
            break
        level, before = (share * total - used) / open_weight, n
    target = F.col("_cap") if level is None else F.least(F.col("_w") * level, F.col("_cap"))
    return rows.select("source", "source_size", target.alias("target"))


def pair_up(frame: pd.DataFrame, seed: int) -> pd.DataFrame:
    """Round the fractions of one bucket; at most one row keeps a fraction between 0 and 1.

    Large documents come first, so that what is left undecided tends to be small.
    """
    frame = frame.sort_values(["size", "mark", "doc_id"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
    x, size = frame["part"].to_numpy(np.float64).copy(), frame["size"].to_numpy(np.float64)
    draws = mix64(frame["mark"].to_numpy().view(np.uint64) ^ mix64(np.uint64(seed))).astype(np.float64) / 2.0**64
    free = -1
    for j in range(len(x)):
        if not 0.0 < x[j] < 1.0:
            continue
        if free < 0:
            free = j
            continue
        i = free
        up = min((1.0 - x[i]) * size[i], x[j] * size[j])  # most words that i can take from j
        down = min(x[i] * size[i], (1.0 - x[j]) * size[j])
        if draws[j] * (up + down) < down:
            full_i, full_j = up == (1.0 - x[i]) * size[i], up == x[j] * size[j]
            x[i], x[j] = (1.0 if full_i else x[i] + up / size[i]), (0.0 if full_j else x[j] - up / size[j])
        else:
            full_i, full_j = down == x[i] * size[i], down == (1.0 - x[j]) * size[j]
            x[i], x[j] = (0.0 if full_i else x[i] - down / size[i]), (1.0 if full_j else x[j] + down / size[j])
        free = next((k for k in (i, j) if 0.0 < x[k] < 1.0), -1)
    return frame.assign(part=x)


def pairing(seed: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    return lambda frame: pair_up(frame, seed)


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0,
        doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` for each row: how many whole copies the mix takes."""
    sized = with_row_id(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(text).alias("size")))
    targets = source_targets(sized, weights, share, most)
    counts = sized.groupBy("source").agg(F.count("*").alias("_rows"))
    goals = cut_lineage(targets.join(counts, targets.source.eqNullSafe(counts.source)).select(targets["*"], "_rows"))
    keyed = goals.withColumns({"_k": F.coalesce("source", F.lit("")), "_null": F.col("source").isNull()}).drop("source")
    rows = salted_join(sized.withColumns({"_k": F.coalesce("source", F.lit("")), "_null": F.col("source").isNull()}), keyed, ["_k", "_null"])
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    mark = F.xxhash64("doc_id", "size", "source")
    rows = rows.withColumns({
        "whole": F.floor(expected), "part": F.when(F.col("size") > 0, expected - F.floor(expected)).otherwise(0.0), "mark": mark,
        "bucket": F.floor(unit(mark, F.lit(1)) * F.ceil(F.col("_rows") / BUCKET)).cast("long"),
    }).select("_uid", "doc_id", "source", "size", "mark", "bucket", "whole", "part", "source_size", "target")
    rows = cut_lineage(rows)
    undecided = rows.filter((F.col("part") > 0) & (F.col("part") < 1)).select("_uid", "doc_id", "source", "size", "mark", "bucket", "part")
    rounded, step = None, 0
    while True:
        result = cut_lineage(undecided.groupBy("source", "bucket").applyInPandas(pairing(step), undecided.schema))
        open_ = result.filter((F.col("part") > 0) & (F.col("part") < 1))
        last = result.agg(F.max("bucket")).first()[0]
        done = result.filter((F.col("part") <= 0) | (F.col("part") >= 1))
        if not last:  # one bucket a source: what is left goes to the nearer whole number
            done = result.withColumn("part", F.when(F.col("part") >= 0.5, 1.0).otherwise(0.0))
        done = done.select("_uid", F.col("part").cast("long").alias("extra"))
        rounded = done if rounded is None else rounded.unionByName(done)
        if not last:
            break
        undecided, step = open_.withColumn("bucket", F.floor(F.col("bucket") / FAN_IN)), step + 1
    copies = F.col("whole") + F.coalesce("extra", F.lit(0))
    return rows.join(rounded, "_uid", "left").select(
        "doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken")
    )


def op1_mixing(spark, folder: str) -> DataFrame:
    return mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")
