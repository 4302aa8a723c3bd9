"""Near-duplicate vectors by a pivot-permutation index.

Reference points (pivots) are picked from a bounded sample so that none is close to another. A vector is
described by its nearest pivots; the inverted lists are those of every choice of ``SHARED`` of them, so two
vectors meet in a list if and only if they have at least that many pivots in common. Every meeting pair is
verified by cosine in double precision, in the one list that belongs to the lowest pivots it shares.

Lists are cut into parts of bounded size and each pair of parts is one piece of work: a matrix product inside
a task, from which come the number of links of each vector and one link to its component there, never the
pairs. Equal vectors are one class that counts as often as it occurs.

Defined results: vectors that are null, zero, of another than the usual length or with null or non-finite
components have no links and are their own component; equal and null ids take part as rows of their own, and
``component_id`` is the smallest id that is not null; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import table, unit
from attestry.llm.components import components, roots
from attestry.llm.vectors import by_length, matrix, numbered, runs, unit_rows
from attestry.operators.keyed import cut_lineage

#: Nearest pivots that describe a vector, how many of them two vectors must share, and most sampled vectors.
NEAREST, SHARED, SAMPLE = 8, 4, 4_000
#: Pivots are at most this close to each other, in cosine; vectors near each other then lie near the same ones.
APART = 0.6
PART = 1024


def pick_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Up to ``count`` rows of unit length, in order, leaving out those close to one before."""
    kept: list[int] = []
    far = np.ones(len(sample), bool)
    for i in range(len(sample)):
        if far[i]:
            kept.append(i)
            if len(kept) == count:
                break
            far &= sample @ sample[i] < APART
    return sample[kept]


def pivots_of(heads: DataFrame, n: int) -> np.ndarray:
    """Pivots from a hashed sample; their number grows as the fourth root of the vectors, as lists of four pivots need."""
    count = int(min(4096, np.ceil(144 * max(n / 1000, 0.05) ** 0.25)))
    share = max(SAMPLE, 4 * count) / max(n, 1)
    mark = F.xxhash64("vec")
    chosen = heads.select("vec", mark.alias("mark")).filter(unit(mark, F.lit(1)) < share).toPandas().sort_values("mark")
    return pick_pivots(unit_rows(np.array(chosen["vec"].tolist())), count) if len(chosen) else np.zeros((0, 1))


def low_bits(mask: np.ndarray, below: int) -> np.ndarray:
    """The bits of each row's mask for pivots before ``below``."""
    words = np.arange(mask.shape[1])
    keep = np.where(words < below // 64, np.uint64(2**64 - 1), np.uint64(0))
    if below % 64 and below // 64 < len(keep):
        keep[below // 64] = np.uint64((1 << (below % 64)) - 1)
    return mask & keep


def linked_in(left: tuple, right: tuple | None, lowest: int, shared: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of linked rows whose lowest shared pivots end with ``lowest``; ``right`` None: pairs within ``left``."""
    other = left if right is None else right
    masks, group = np.unique(low_bits(left[0], lowest), axis=0, return_inverse=True)
    masks_2, group_2 = np.unique(low_bits(other[0], lowest), axis=0, return_inverse=True)
    common = np.zeros((len(masks), len(masks_2)), np.int32)
    for word in range(masks.shape[1]):
        common += np.bitwise_count(masks[:, None, word] & masks_2[None, :, word])
    ours = common == shared - 1
    if not ours.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows, columns = np.flatnonzero(ours.any(axis=1)[group.ravel()]), np.flatnonzero(ours.any(axis=0)[group_2.ravel()])
    near = left[1][rows] @ other[1][columns].T >= cosine
    near &= ours[np.ix_(group.ravel()[rows], group_2.ravel()[columns])]
    i, j = np.nonzero(near)
    i, j = rows[i], columns[j]
    return (i[i < j], j[i < j]) if right is None else (i, j)


def linked_vectors(rows: DataFrame, cosine: float, nearest: int, shared: int) -> DataFrame:
    """``uid, n_links, component`` of rows ``uid, vec`` that all count and have one length."""
    same = [F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(7), "vec").alias("h2")]
    marked = rows.select("uid", "vec", *same)
    sizes = marked.groupBy("h1", "h2").agg(F.min("uid").alias("head"), F.count("*").alias("weight"))
    members = cut_lineage(marked.select("uid", "h1", "h2").join(sizes, ["h1", "h2"]).select("uid", "head", "weight"))
    heads = cut_lineage(marked.select("uid", "vec").join(members.filter("uid = head"), "uid").select("uid", "vec", "weight"))
    n = heads.count()
    pivots = pivots_of(heads, n)
    nearest = min(nearest, len(pivots))
    shared = min(shared, nearest)
    choices = list(combinations(range(nearest), shared))
    words = -(-max(len(pivots), 1) // 64)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            points = unit_rows(matrix(batch.column("vec")))
            chosen = np.sort(np.argsort(-(points @ pivots.T), axis=1, kind="stable")[:, :nearest], axis=1)
            mask = np.zeros((len(points), words), np.uint64)
            for column in chosen.T:
                mask[np.arange(len(points)), column // 64] |= np.uint64(1) << (column % 64).astype(np.uint64)
            keys = np.zeros((len(points), len(choices)), np.int64)
            for at, choice in enumerate(choices):
                for place in choice:
                    keys[:, at] = keys[:, at] * len(pivots) + chosen[:, place]
            masks = pa.array([row.tobytes() for row in mask], pa.binary())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(points) + 1) * len(choices), pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, masks, lists], ["uid", "vec", "weight", "mask", "keys"])

    vec_type = heads.schema["vec"].dataType.simpleString()
    described = cut_lineage(heads.mapInArrow(describe, f"uid long, vec {vec_type}, weight long, mask binary, keys array<long>"))
    listed = described.select("uid", F.explode("keys").alias("key"))
    lists = listed.groupBy("key").agg(F.count("*").alias("_n")).filter("_n > 1")
    parts = F.ceil(F.col("_n") / PART).cast("int")
    dealt = listed.join(lists, "key").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    work = dealt.select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "uid").join(described.select("uid", "vec", "weight", "mask"), "uid")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            for run in runs(batches, ["key", "i", "j"]):
                if run.num_rows < 2:
                    continue
                i, j, lowest = run["i"][0].as_py(), run["j"][0].as_py(), run["key"][0].as_py() % max(len(pivots), 1)
                uid, weight, part = run["uid"].to_numpy(), run["weight"].to_numpy(), run["part"].to_numpy()
                mask = np.frombuffer(b"".join(run["mask"].to_pylist()), np.uint64).reshape(run.num_rows, words)
                points = unit_rows(matrix(run["vec"]))
                if i == j:
                    a, b = linked_in((mask, points), None, lowest, shared, cosine)
                else:
                    left, right = np.flatnonzero(part == i), np.flatnonzero(part == j)
                    a, b = linked_in((mask[left], points[left]), (mask[right], points[right]), lowest, shared, cosine)
                    a, b = left[a], right[b]
                if len(a):
                    degree = np.bincount(a, weight[b], len(uid)) + np.bincount(b, weight[a], len(uid))
                    root, some = roots(len(uid), a, b), np.flatnonzero(degree)
                    yield uid[some], uid[root[some]], degree[some].astype(np.int64)

        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for piece in found():
            held.append(piece)
            if len(piece[0]) > 1000 or len(held) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], ["uid", "root", "degree"])
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], ["uid", "root", "degree"])

    pieces = work.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(compare, "uid long, root long, degree long")
    pieces = cut_lineage(pieces)
    degrees = pieces.groupBy("uid").agg(F.sum("degree").alias("degree")).withColumnRenamed("uid", "head")
    labels = components(pieces.select(F.col("uid").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "head")
    return members.join(degrees, "head", "left").join(labels, "head", "left").select(
        "uid", (F.coalesce("degree", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("label", "head").alias("component")
    )


def near_vectors(vectors: DataFrame, cosine: float = 0.95, nearest: int = NEAREST, shared: int = SHARED, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id, uid, n_links, component_id, first`` for each row; runs jobs while the plan is built.

    Vectors are compared with those of their own length. Columns other than the two named are not looked at.
    """
    rows = numbered(vectors, vec_id, embedding)
    parts = [linked_vectors(part, cosine, nearest, shared) for part in by_length(rows)]
    linked = reduce(DataFrame.unionByName, parts) if parts else rows.select("uid", F.lit(0).cast("long").alias("n_links"), F.col("uid").alias("component")).limit(0)
    out = rows.select("uid", "vec_id").join(linked, "uid", "left").withColumn("component", F.coalesce("component", -1 - F.col("uid")))
    first = F.min(F.struct(F.col("vec_id").isNull().alias("_null"), "vec_id", "uid")).alias("_first")
    tops = out.groupBy("component").agg(first).select("component", F.col("_first.vec_id").alias("component_id"), F.col("_first.uid").alias("_top"))
    return out.join(tops, "component").select("vec_id", "uid", F.coalesce("n_links", F.lit(0)).alias("n_links"), "component_id", (F.col("uid") == F.col("_top")).alias("first"))


def op4_embedding_near_dedup(spark, folder: str) -> DataFrame:
    found = near_vectors(table(spark, folder, "embeddings"))
    return found.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
