"""Whitening of vectors, with cross-products from bit planes.

Each component becomes a whole number. Less its dimension's smallest value it is a non-negative number of few bits;
bit ``p`` of dimension ``i``, packed over the rows of a block into 64-bit words, is a plane. The cross-product of two
dimensions is the sum over their planes of ``2 ** (p + q)`` times the bits set in both, so it is exact. Blocks add up in
limbs of 32 bits. Covariances are centred as whole numbers and divided once; ``eigh`` takes them from there.

Defined results: rows whose vector is null or holds null or non-finite components are dropped, repeated rows count
each; vectors of different lengths are fitted and whitened apart, each length over its own rows; vectors without
components give no rows; a component without variance, as in a single row, whitens to null, and where no component has
any, ``explained`` and ``identity_error`` are null; equal eigenvalues come in the order of ``eigh``; a whole number beyond 64 bits is
the nearest one within, and a ``deviation`` beyond them is null; columns besides the two asked for are not looked at,
whatever their names; no rows give no rows. Read while the plan is built: ranges, sums and cross-products, as many
numbers as a vector has dimensions, squared; rows with their components are written.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import slices, table
from attestry.llm.vectors import matrix
from attestry.operators.keyed import cut_lineage

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
TOP = 9.22337203685e18  # from here on a number of 64 bits cannot take SHIFT
BLOCK = 8192  # rows of a plane
LIMB = 32


@dataclass(frozen=True)
class Range:
    """Of the vectors of one length: how many, and of each dimension the least and largest number and the sum."""

    n: int
    low: list[int]
    high: list[int]
    total: list[int]


@dataclass(frozen=True)
class Fit:
    """A range with the ``size x k`` directions, their eigenvalues and shares; those without variance are left out."""

    range: Range
    directions: np.ndarray
    values: np.ndarray
    shares: np.ndarray
    components: int


def whole(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """``vec_id, x`` of the rows that count, ``x`` the components as whole numbers."""
    value = F.col("vec")
    counts = value.isNotNull() & F.forall(value, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    scaled = lambda c: c * SCALE
    number = lambda c: (
        F.when(scaled(c) > TOP, F.lit((1 << 63) - 1)).when(scaled(c) < -TOP, F.lit(-(1 << 63))).otherwise(F.floor(scaled(c)) + SHIFT)
    )
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("vec")).filter(counts & (F.size("vec") > 0))
    return rows.select("vec_id", F.transform("vec", number).alias("x"))


def ranges(rows: DataFrame) -> dict[int, Range]:
    """Ranges by length; the driver gets one row a dimension."""
    entries = rows.select(F.size("x").alias("size"), F.posexplode("x").alias("i", "v"))
    found = entries.groupBy("size", "i").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.sum(F.col("v").cast("decimal(20,0)")).alias("total"))
    by_size: dict[int, list] = {}
    for r in found.orderBy("size", "i").collect():
        by_size.setdefault(r["size"], []).append(r)
    return {s: Range(r[0]["n"], [x["low"] for x in r], [x["high"] for x in r], [int(x["total"]) for x in r]) for s, r in by_size.items()}


def planes(x: np.ndarray, low: list[int], bits: int) -> np.ndarray:
    """Bit planes of whole numbers less their dimension's least one: ``dimensions x bits x words``."""
    with np.errstate(over="ignore"):
        u = x.astype(np.uint64) - np.array([v % (1 << 64) for v in low], np.uint64)
    rows = -len(u) % 64
    u = np.pad(u, ((0, rows), (0, 0))).T
    set_ = (u[:, None, :] >> np.arange(bits, dtype=np.uint64)[None, :, None]) & np.uint64(1)
    return np.ascontiguousarray(np.packbits(set_.astype(np.uint8), axis=2)).view(np.uint64)


def cross_products(x: np.ndarray, low: list[int], bits: int) -> dict[int, np.ndarray]:
    """By weight ``p + q``: for each pair of dimensions, the rows that have bit ``p`` of one and ``q`` of the other."""
    words = planes(x, low, bits)
    size = len(words)
    out = {w: np.zeros((size, size), np.int64) for w in range(2 * bits - 1)}
    for i in range(size):
        for p in range(bits):
            both = np.bitwise_count(words[i, p] & words[i:]).sum(axis=2, dtype=np.int64)  # dimensions from i on, by bits
            for q in range(bits):
                out[p + q][i, i:] += both[:, q]
    return out


def limbs(by_weight: dict[int, np.ndarray], count: int) -> np.ndarray:
    """The weighted sum in limbs of 32 bits, ``count x dimensions x dimensions``."""
    out = np.zeros((count, *by_weight[0].shape), np.int64)
    for w, n in by_weight.items():
        at, shift = divmod(w, LIMB)
        out[at] += (n & ((1 << (LIMB - shift)) - 1)) << shift
        out[at + 1] += n >> (LIMB - shift)
    return out


def scatter(rows: DataFrame, by_size: dict[int, Range]) -> dict[int, np.ndarray]:
    """Exact sums of products of shifted numbers, by length, as arrays of Python's whole numbers."""
    bits = {s: max(1, max(h - w for h, w in zip(r.high, r.low, strict=True)).bit_length()) for s, r in by_size.items()}
    lows = {s: r.low for s, r in by_size.items()}
    count = 2 * max(bits.values(), default=1) // LIMB + 2
    names = [f"l{k}" for k in range(count)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for size, x in blocks(batches):
            found = limbs(cross_products(x, lows[size], bits[size]), count)
            sums[size] = sums[size] + found if size in sums else found
            sums[size][1:] += sums[size][:-1] >> LIMB  # carry, so that no limb grows with the blocks
            sums[size][:-1] &= (1 << LIMB) - 1
        for size, s in sums.items():
            i, j = np.triu_indices(size)
            columns = [pa.array(np.full(len(i), size, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), *(pa.array(limb[i, j]) for limb in s)]
            yield pa.RecordBatch.from_arrays(columns, ["size", "i", "j", *names])

    parts = rows.select("x").mapInArrow(work, "size int, i int, j int, " + ", ".join(f"{n} long" for n in names))
    out = {s: np.zeros((s, s), object) for s in by_size}
    for r in parts.groupBy("size", "i", "j").agg(*[F.sum(n).alias(n) for n in names]).collect():
        out[r["size"]][r["i"], r["j"]] = out[r["size"]][r["j"], r["i"]] = sum(r[n] << (LIMB * k) for k, n in enumerate(names))
    return out


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """Components of up to ``BLOCK`` rows of one length each."""
    for batch in slices(batches, BLOCK):
        lists = batch.column("x")
        sizes = np.diff(lists.offsets.to_numpy())
        for size in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == size)
            yield size, matrix(lists if len(at) == len(lists) else lists.take(pa.array(at)))


def fit(rows: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """Means, directions and eigenvalues of the vectors of each length."""
    by_size = ranges(rows)
    products = scatter(rows, by_size) if by_size else {}
    out = {}
    for size, r in by_size.items():
        shifted = [t - r.n * low for t, low in zip(r.total, r.low, strict=True)]
        centred = [[r.n * products[size][i, j] - shifted[i] * shifted[j] for j in range(size)] for i in range(size)]
        covariance = np.array([[v / (r.n * r.n) for v in row] for row in centred], np.float64)
        values, directions = np.linalg.eigh(covariance)
        order = np.arange(size)[::-1][:components]
        trace = sum(centred[i][i] for i in range(size)) / (r.n * r.n)
        # what eigh leaves of nothing is within a rounding error of the whole
        real = [k for k in order if values[k] > trace * size * np.finfo(np.float64).eps]
        shares = np.maximum(values[order], 0) / trace if trace else np.zeros(0)
        out[size] = Fit(r, directions[:, real], values[real], shares, len(order))
    return out


def whiten(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: a row for each vector and component."""
    rows = cut_lineage(whole(vectors, vec_id, embedding))
    fits = fit(rows, components)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, BLOCK):
            lists = batch.column("x")
            sizes = np.diff(lists.offsets.to_numpy())
            for size in np.unique(sizes).tolist():
                at = pa.array(np.flatnonzero(sizes == size))
                deviation, whitened = centre(matrix(lists.take(at)), fits[size])
                white = pa.ListArray.from_arrays(np.arange(len(at) + 1, dtype=np.int32) * whitened.shape[1], whitened.ravel())
                columns = [batch.column("vec_id").take(at), pa.array(np.full(len(at), size, np.int32)), pa.array(deviation, pa.int64()), white]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "size", "deviation", "white"])

    projected = cut_lineage(rows.mapInArrow(project, "vec_id long, size int, deviation long, white array<double>"))
    errors = identity_errors(projected, fits)
    facts = [(size, f.range.n, f.components, f.shares.tolist(), errors[size]) for size, f in fits.items()]
    # one narrow row a length, made on the driver; all vectors of a length have one key, so a shuffle would not spread them
    known = projected.join(F.broadcast(rows.sparkSession.createDataFrame(facts, "size int, n long, k int, shares array<double>, identity_error double")), "size")
    each = known.withColumn("component", F.explode(F.sequence(F.lit(1), F.col("k"))))
    return each.select(
        "vec_id",
        "component",
        "n",
        "deviation",
        F.get("white", F.col("component") - 1).alias("whitened"),
        F.get("shares", F.col("component") - 1).alias("explained"),
        "identity_error",
    )


def centre(x: np.ndarray, f: Fit) -> tuple[list[int | None], np.ndarray]:
    """The sum over dimensions of ``(n * x - S) ** 2`` of each row, and its whitened components."""
    r = f.range
    far = max(max(abs(r.n * h - t), abs(r.n * w - t)) for h, w, t in zip(r.high, r.low, r.total, strict=True))
    most = max(r.n * max(abs(v) for v in (*r.high, *r.low)), max(map(abs, r.total)))
    # 64-bit arithmetic where no step of it can overflow, else whole numbers of Python
    fits = far * far * len(r.low) < 1 << 63 and most < 1 << 62
    off = r.n * x.astype(np.int64 if fits else object) - np.array(r.total, np.int64 if fits else object)
    deviation = [v if v < 1 << 63 else None for v in (off * off).sum(axis=1).tolist()]
    centred = off / r.n if fits else (off / r.n).astype(np.float64)
    return deviation, centred @ f.directions / np.sqrt(f.values)


def identity_errors(projected: DataFrame, fits: dict[int, Fit]) -> dict[int, float | None]:
    """Of each length the largest entry of the covariance of what was whitened, less the identity."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            sizes = batch.column("size").to_numpy(zero_copy_only=False)
            for size in np.unique(sizes).tolist():
                k = len(fits[size].values)
                at = pa.array(np.flatnonzero(sizes == size))
                white = np.column_stack([np.ones(len(at)), batch.column("white").take(at).flatten().to_numpy(zero_copy_only=False).reshape(len(at), k)])
                sums[size] = sums.get(size, 0) + white.T @ white
        for size, s in sums.items():
            i, j = np.indices(s.shape)
            columns = [pa.array(np.full(s.size, size, np.int32)), pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(s.ravel())]
            yield pa.RecordBatch.from_arrays(columns, ["size", "i", "j", "v"])

    sums = {s: np.zeros((len(f.values) + 1,) * 2) for s, f in fits.items()}
    for r in projected.select("size", "white").mapInArrow(work, "size int, i int, j int, v double").groupBy("size", "i", "j").agg(F.sum("v").alias("v")).collect():
        sums[r["size"]][r["i"], r["j"]] = r["v"]
    out: dict[int, float | None] = {}
    for size, s in sums.items():
        n, mean = fits[size].range.n, s[0, 1:] / fits[size].range.n
        left = s[1:, 1:] / n - np.outer(mean, mean) - np.eye(len(mean))
        out[size] = float(np.abs(left).max()) if left.size else None
    return out


def op11_whitening(spark, folder: str) -> DataFrame:
    return whiten(table(spark, folder, "embeddings"))
