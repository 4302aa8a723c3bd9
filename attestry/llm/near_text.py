"""Near-duplicate texts by fast similarity sketching, banding and exact verification.

The set of a document is its distinct word shingles. Elements are placed into ``t`` bins in rounds: in the first
``t`` rounds each element goes to one hashed bin, in the next ``t`` rounds all go to the bin of the round; a bin
keeps its earliest, smallest value and rounds end once every bin is filled, so every coordinate is filled even
for tiny sets. Bands of coordinates make candidates, and the full sets decide.

Equal sets are one class from the start. Candidates of a bucket are compared with one hub, not with each other;
buckets whose members are then still in different components are compared with another hub, and what is still
apart after that is compared in blocks inside tasks. So no link between components is lost, and copies and near
copies, however many, cost a few comparisons each. Sets are compared by 40 bits of each shingle's hash.

Defined results: a document without words (null, empty or blank) has an empty set and is alone; fewer words than
a shingle needs are one shingle; repeated rows and equal ids share a component; a row with a null id takes part,
and ``component_id`` is the smallest id that is not null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import mix64, slices, table
from attestry.llm.components import components, roots
from attestry.llm.vectors import matrix, runs
from attestry.operators.keyed import cut_lineage

BANDS, ROWS = 40, 6
VALUE_BITS, STEP_BITS = 46, 9
#: Rounds with one hub a bucket before what is still apart is compared in blocks of at most so many documents.
HUB_ROUNDS, PART = 2, 512
#: Bytes kept of each element's hash.
WIDTH = 5


#: Words whose hash a task remembers, about 30 MB; any other is hashed when it comes.
REMEMBERED = 200_000


class Words(dict):
    """Word to 64-bit hash; the first ones met are remembered."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < REMEMBERED:
            self[word] = value
        return value


def shingle_set(text: str | None, width: int, known: Words) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    ids = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    width = min(width, len(ids))
    if not width:
        return ids
    with np.errstate(over="ignore"):
        hashed = ids[: len(ids) - width + 1].copy()
        for i in range(1, width):
            hashed = mix64(hashed) + ids[i : len(ids) - width + 1 + i]
    return np.unique(mix64(hashed))


def sketch(elements: np.ndarray, t: int) -> np.ndarray:
    """Fast similarity sketch: the first round and smallest value that fell into each of ``t`` bins.

    Several rounds are hashed and sorted at once, as many as are likely to fill all bins.
    """
    out = np.zeros(t, np.uint64)
    empty = np.ones(t, bool)
    at_once = int(min(max(6 * t // len(elements), 1), 64))
    low = np.uint64((1 << (VALUE_BITS + STEP_BITS)) - 1)
    for start in range(0, 2 * t, at_once):
        steps = np.arange(start, min(start + at_once, 2 * t), dtype=np.uint64)
        value = mix64(elements[None, :] ^ mix64(steps + np.uint64(1))[:, None])
        bins = (value >> np.uint64(VALUE_BITS)) % np.uint64(t)
        bins[steps >= t] = (steps[steps >= t] - np.uint64(t))[:, None]
        keyed = (bins << np.uint64(VALUE_BITS + STEP_BITS)) | (steps << np.uint64(VALUE_BITS))[:, None] | (value & np.uint64((1 << VALUE_BITS) - 1))
        keyed = np.sort(keyed.ravel())
        bins = (keyed >> np.uint64(VALUE_BITS + STEP_BITS)).astype(np.int64)
        first = np.flatnonzero(np.diff(bins, prepend=-1))
        first = first[empty[bins[first]]]
        out[bins[first]] = mix64(keyed[first] & low)
        empty[bins[first]] = False
        if not empty.any():
            break
    return out


def packed(elements: np.ndarray) -> bytes:
    """The upper ``WIDTH`` bytes of each hash."""
    return elements.view(np.uint8).reshape(-1, 8)[:, 8 - WIDTH :].tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    full = np.zeros((len(raw) // WIDTH, 8), np.uint8)
    full[:, :WIDTH] = np.frombuffer(raw, np.uint8).reshape(-1, WIDTH)
    return full.view(np.int64).ravel()


def band_keys(coordinates: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One number for each band of coordinates; bands differ in it."""
    parts = coordinates.reshape(bands, rows)
    key = mix64(np.arange(bands, dtype=np.uint64) + np.uint64(101))
    with np.errstate(over="ignore"):
        for i in range(rows):
            key = mix64(key + parts[:, i])
    return key


def described(docs: DataFrame, width: int, bands: int, rows: int, doc_id: str, text: str) -> DataFrame:
    """``doc_id, row, n, digest, bands, elements``: set size, hash of the set, band keys and the packed set."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in slices(batches):
            sizes, digests, keys, sets = [], [], [], []
            for value in batch.column(1).to_pylist():
                elements = shingle_set(value, width, known)
                raw = elements.tobytes()
                sizes.append(len(elements))
                digests.append(xxhash.xxh3_128_digest(raw))
                keys.append(band_keys(sketch(elements, bands * rows), bands, rows).view(np.int64) if len(elements) else [])
                sets.append(packed(elements))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sets, pa.binary())],
                ["doc_id", "row", "n", "digest", "bands", "elements"],
            )

    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    return narrow.mapInArrow(work, "doc_id long, row long, n long, digest binary, bands array<long>, elements binary")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets have ``100 * intersection >= percent * union``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, last, left = [], None, None
            for a, x, y in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if a != last:
                    last, left = a, unpacked(x.as_py())
                right = unpacked(y.as_py())
                both = len(left) + len(right) - len(np.union1d(left, right))
                good.append(100 * both >= percent * (len(left) + len(right) - both))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    with_b = pairs.join(sets.select(F.col("node").alias("b"), F.col("elements").alias("set_b")), "b")
    both = with_b.join(sets.select(F.col("node").alias("a"), F.col("elements").alias("set_a")), "a").select("a", "b", "set_a", "set_b")
    return both.mapInArrow(work, "a long, b long")


def linked_blocks(here: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links ``a, b`` that join up all documents linked in a bucket and not yet in one component.

    ``here`` has ``key, node, n, label``. A bucket is cut into parts; each pair of parts is one piece of work, in
    which every pair of documents is compared that has different components, can reach the threshold by size and
    shares no earlier band. Sets are counted against each other through a table of the elements of the piece.
    """

    def piece(run: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        node, n, label, part = (run[c].to_numpy() for c in ("node", "n", "label", "part"))
        i, j, key = run["i"][0].as_py(), run["j"][0].as_py(), run["key"][0].as_py()
        bands = matrix(run["bands"])
        sets_ = [unpacked(v) for v in run["elements"].to_pylist()]
        ends = np.cumsum([0, *map(len, sets_)])
        kinds, at = np.unique(np.concatenate(sets_), return_inverse=True)
        band = int(np.flatnonzero(bands[0] == key)[0])
        inside, a, b = np.zeros(len(kinds), bool), [], []
        for row in np.flatnonzero(part == i):
            ours = (label != label[row]) & (part == j) & (100 * np.minimum(n, n[row]) >= percent * np.maximum(n, n[row]))
            if i == j:
                ours[: row + 1] = False
            ours &= ~(bands[:, :band] == bands[row, :band]).any(axis=1)
            if not ours.any():
                continue
            inside[at[ends[row] : ends[row + 1]]] = True
            both = np.add.reduceat(inside[at].astype(np.int64), ends[:-1])
            inside[at[ends[row] : ends[row + 1]]] = False
            found = np.flatnonzero(ours & (100 * both >= percent * (n + n[row] - both)))
            a.append(np.full(len(found), row)), b.append(found)
        if not a:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        root = roots(len(node), np.concatenate(a), np.concatenate(b))
        some = np.flatnonzero(root != np.arange(len(node)))
        return node[root[some]], node[some]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches, ["key", "i", "j"]):
            if run.num_rows > 1:
                a, b = piece(run)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    sizes = here.groupBy("key").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    dealt = here.join(sizes, "key").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "node", "n", "label")
    return dealt.join(sets, "node").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(work, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS,
                    doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, row, n_shingles, component_id, first`` for each row; ``first`` marks one row of each component, with its smallest id.

    Runs jobs while the plan is built: descriptions, hub rounds and components are written to the shared folder.
    """
    if bands * rows > 1 << (STEP_BITS - 1):
        raise ValueError(f"at most {1 << (STEP_BITS - 1)} coordinates")
    all_ = cut_lineage(described(docs, width, bands, rows, doc_id, text))
    filled = all_.filter("n > 0")
    # a class: all rows with one set, named by one of its rows
    classes = filled.groupBy("digest").agg(F.min("row").alias("node"))
    members = cut_lineage(filled.select("row", "digest", "n").join(classes, "digest").select("row", "node", "n"))
    heads = members.filter("row = node").select("node")
    keyed = filled.select(F.col("row").alias("node"), "n", "bands").join(heads, "node", "left_semi").select("node", "n", F.explode("bands").alias("key"))
    first, last = F.min(F.struct("node", "n")).alias("_h"), F.max("node").alias("_last")
    shared = keyed.groupBy("key").agg(first, last).filter("_h.node < _last").select("key", F.col("_h.node").alias("hub"), F.col("_h.n").alias("hub_n"))
    buckets = cut_lineage(keyed.join(shared, "key"))
    labels = cut_lineage(buckets.select("node").distinct()).withColumn("label", F.col("node"))
    # sets of the documents that share a bucket with another; the others have no candidate
    sets = cut_lineage(filled.select(F.col("row").alias("node"), "bands", "elements").join(labels.select("node"), "node", "left_semi"))
    can_link = F.expr(f"100 * least(n, hub_n) >= {percent} * greatest(n, hub_n)")

    def joined(links: DataFrame) -> DataFrame:
        return cut_lineage(labels.select("node").join(components(links), "node", "left").select("node", F.coalesce("label", "node").alias("label")))

    def apart(labels: DataFrame) -> DataFrame:
        """Buckets whose members are in different components."""
        here = buckets.select("key", "node", "n").join(labels, "node")
        spread = here.groupBy("key").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi")).filter("_lo < _hi").select("key")
        return cut_lineage(here.join(spread, "key"))

    pairs = buckets.filter("node <> hub").filter(can_link).select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    links = cut_lineage(verified(pairs, sets, percent))
    labels = joined(links)
    for step in range(1, HUB_ROUNDS):
        here = apart(labels)
        drawn = F.min(F.struct(F.xxhash64("node", "key", F.lit(step)).alias("draw"), F.col("node").alias("hub"), F.col("n").alias("hub_n"), F.col("label").alias("hub_label"))).alias("_h")
        hubs = here.groupBy("key").agg(drawn).select("key", "_h.hub", "_h.hub_n", "_h.hub_label")
        pairs = here.join(hubs, "key").filter("hub_label <> label").filter(can_link).select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
        links = links.unionByName(cut_lineage(verified(pairs, sets, percent)))
        labels = joined(links)
    links = links.unionByName(cut_lineage(linked_blocks(apart(labels), sets, percent)))
    labels = joined(links)

    named = members.join(labels.withColumnRenamed("label", "_l"), "node", "left").select("row", F.coalesce("_l", "node").alias("component"))
    rows_ = all_.select("doc_id", "row", "n").join(named, "row", "left").withColumn("component", F.coalesce("component", -1 - F.col("row")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", "row")).alias("_first")
    tops = rows_.groupBy("component").agg(first).select("component", F.col("_first.doc_id").alias("component_id"), F.col("_first.row").alias("_top"))
    return rows_.join(tops, "component").select("doc_id", "row", F.col("n").alias("n_shingles"), "component_id", (F.col("row") == F.col("_top")).alias("first"))


def op9_minhash_near_dedup(spark, folder: str) -> DataFrame:
    found = near_duplicates(table(spark, folder, "documents"), width=2)
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))
