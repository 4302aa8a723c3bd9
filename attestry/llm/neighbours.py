"""Approximate nearest neighbours: NN-descent builds a neighbour graph, greedy search over it answers queries.

Nearness is the largest inner product. The graph starts from blocks: vectors are sorted along random projections,
cut into blocks of bounded size, and each takes its best neighbours within its block. In each round of NN-descent
a vector with a new link, its own or into it, is the middle between its neighbours and those that have it as a
neighbour; these are joined to it, compared with each other, and what is better than a vector's worst neighbour is
sent to it. A vector rests while no link at it is new, and rounds end when all rest. Rounds compare vectors rounded
to one byte a component, with a scale each; searches and results use the original numbers.

Equal vectors are one class: the graph and the searches are over classes, and results take the members of the
classes found in the order of their ids, so a group of copies fills no list and hides no smaller id.

A search starts at the query's own place in the graph (or at hashed entry points, for queries from outside),
expands the best ``beam`` candidates not yet expanded, all queries at once, and ends for a query when a step brings
nothing new into the better half of its beam.
Candidates are scored where their vectors lie: vectors are dealt into blocks of bounded size, and a query goes
once to each block that holds some of its candidates. Every vector is in the graph and can be found.

Defined results: vectors that are null, zero, of another than the usual length or with null or non-finite
components take no part; equal scores rank by smaller id, null ids last; ids that occur twice are rows of their
own; with fewer vectors than asked for, each query gets all others; no queries give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import mix64, table
from attestry.llm.vectors import by_length, matrix, numbered, runs
from attestry.operators.keyed import cut_lineage, salted_join, top_n

#: Neighbours a vector keeps, and how many of those that have it as a neighbour take part in a round.
DEGREE, MEMBERS = 32, 32
#: Sortings at the start, and vectors a block there.
SORTINGS, BLOCK = 2, 512
#: Candidates a search keeps in view, and vectors a block of the search.
BEAM, HOLD = 200, 4096


def codes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows as one byte a component and a scale each."""
    scale = np.abs(rows).max(axis=1) / 127.0
    return np.rint(rows / scale[:, None]).astype(np.int8), scale


def best(uid: np.ndarray, ids: np.ndarray, scores: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``keep`` best distinct ids but ``uid``; equal scores by smaller id."""
    order = np.lexsort((ids, -scores))
    ids, scores = ids[order], scores[order]
    _, first = np.unique(ids, return_index=True)
    first.sort()
    first = first[ids[first] != uid][:keep]
    return ids[first], scores[first]


def lists_of(rows: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(rows) if rows else np.zeros(0), kind))


GRAPH = "uid long, ids array<long>, scores array<double>"
#: With those of the ids that were not in the list before.
FRESH = f"{GRAPH}, news array<long>"


def graph_batch(uids: list, ids: list, scores: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), lists_of(ids, pa.int64()), lists_of(scores, pa.float64())], ["uid", "ids", "scores"])


def sorted_blocks(points: DataFrame, seed: int, size: int, degree: int) -> DataFrame:
    """Neighbours within blocks of vectors that lie together along one set of projections."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = matrix(batch.column("vec")).astype(np.float64)
            rows = rows / np.abs(rows).max(axis=1, keepdims=True)
            draws = mix64(np.arange(rows.shape[1] * 9, dtype=np.uint64) + np.uint64((seed + 1) << 32)).astype(np.float64) / 2.0**63 - 1.0
            flat = rows @ draws.reshape(-1, 9)
            side = (flat[:, :8] > 0) @ (1 << np.arange(8))
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("vec"), pa.array(side, pa.int64()), pa.array(flat[:, 8])], ["uid", "vec", "side", "at"])

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(held: pa.Table) -> pa.RecordBatch:
            uid, rows = held["uid"].to_numpy(), matrix(held["vec"]).astype(np.float64)
            scores = rows @ rows.T
            np.fill_diagonal(scores, -np.inf)
            take = min(degree, len(uid) - 1)
            chosen = np.argpartition(-scores, max(take - 1, 0), axis=1)[:, :take]
            return graph_batch(uid, [uid[c] for c in chosen], [s[c] for s, c in zip(scores, chosen, strict=True)])

        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, size - n)
                held.append(part)
                n, batch = n + part.num_rows, batch.slice(part.num_rows)
                if n == size:
                    yield block(pa.Table.from_batches(held))
                    held, n = [], 0
        if n:
            yield block(pa.Table.from_batches(held))

    kind = points.schema["vec"].dataType.simpleString()
    keyed = cut_lineage(points.mapInArrow(project, f"uid long, vec {kind}, side long, at double"))
    return keyed.repartitionByRange("side", "at", "uid").sortWithinPartitions("side", "at", "uid").mapInArrow(within, GRAPH)


def merged(before: DataFrame | None, found: DataFrame, degree: int) -> DataFrame:
    """One row for each vector with the best of all its rows, and those of them that ``before`` did not have."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uids, ids, scores, news = [], [], [], []

        def batch() -> pa.RecordBatch:
            rows = graph_batch(uids, ids, scores)
            return pa.RecordBatch.from_arrays([*rows.columns, lists_of(news, pa.int64())], [*rows.schema.names, "news"])

        for run in runs(batches, ["uid"]):
            uid = run["uid"][0].as_py()
            i, s = best(uid, run["ids"].combine_chunks().flatten().to_numpy(), run["scores"].combine_chunks().flatten().to_numpy(), degree)
            old = run.filter(run["old"])["ids"].combine_chunks().flatten().to_numpy()
            uids.append(uid), ids.append(i), scores.append(s), news.append(i[~np.isin(i, old)])
            if len(uids) == 2000:
                yield batch()
                uids, ids, scores, news = [], [], [], []
        if uids:
            yield batch()

    rows = found.withColumn("old", F.lit(False))
    if before is not None:
        rows = before.withColumn("old", F.lit(True)).union(rows)
    return rows.repartition("uid").sortWithinPartitions("uid").mapInArrow(work, FRESH)


def descend(fresh: DataFrame, coded: DataFrame, step: int, degree: int, members: int) -> DataFrame:
    """One round: better neighbours that vectors learn from those they share a neighbour with, at middles with a new link."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uids, ids, scores = [], [], []
        for run in runs(batches, ["middle"]):
            uid, worst, met = run["uid"].to_numpy(), run["worst"].to_numpy(), run["met"].to_numpy().astype(bool)
            code = np.frombuffer(b"".join(run["code"].to_pylist()), np.int8).reshape(len(uid), -1).astype(np.float32)
            scale = run["scale"].to_numpy()
            near = (code @ code.T).astype(np.float64) * scale[:, None] * scale[None, :]
            near[np.ix_(met, met)] = -np.inf  # compared here in the round in which the later of them was new
            np.fill_diagonal(near, -np.inf)
            if len(uid) > degree:  # a vector keeps no more than these
                cut = np.partition(near, len(uid) - degree, axis=1)[:, len(uid) - degree]
                worst = np.maximum(worst, np.nextafter(cut, -np.inf))
            good = near > worst[:, None]
            for row in np.flatnonzero(good.any(axis=1)):
                uids.append(uid[row]), ids.append(uid[good[row]]), scores.append(near[row, good[row]])
            if len(uids) >= 5000:
                yield graph_batch(uids, ids, scores)
                uids, ids, scores = [], [], []
        if uids:
            yield graph_batch(uids, ids, scores)

    edges = fresh.select("uid", F.explode("ids").alias("other"), "news").select("uid", "other", F.array_contains("news", F.col("other")).alias("new"))
    touched = edges.filter("new")
    awake = cut_lineage(touched.select("uid").union(touched.select("other")).distinct().withColumnRenamed("uid", "middle"))
    ahead = edges.select(F.col("uid").alias("middle"), F.col("other").alias("uid"), (~F.col("new")).alias("met")).join(awake, "middle", "left_semi")
    # of the links into a vector at most ``members``, new ones first and then others in each round
    into = edges.join(awake.withColumnRenamed("middle", "other"), "other", "left_semi")
    drawn = top_n(into.withColumn("draw", F.xxhash64("uid", "other", F.lit(step))), ["other"], [F.desc("new"), F.col("draw"), F.col("uid")], members)
    back = drawn.select(F.col("other").alias("middle"), "uid", F.lit(False).alias("met"))
    own = awake.select("middle", F.col("middle").alias("uid"), F.lit(True).alias("met"))
    pairs = ahead.union(back).union(own).groupBy("middle", "uid").agg(F.bool_or("met").alias("met"))
    worst = fresh.select("uid", F.when(F.size("ids") >= degree, F.array_min("scores")).otherwise(F.lit(float("-inf"))).alias("worst"))
    full = pairs.join(coded.join(worst, "uid"), "uid")
    return full.repartition("middle").sortWithinPartitions("middle", "uid").mapInArrow(work, GRAPH)


def neighbour_graph(points: DataFrame, degree: int = DEGREE, members: int = MEMBERS, rounds: int | None = None) -> DataFrame:
    """``uid, ids, scores``: the neighbours found for each of ``points`` (``uid, vec``); each round is written.

    Rounds go on until no vector has a new neighbour, or for as many as ``rounds``.
    """

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows, scale = codes(matrix(batch.column("vec")).astype(np.float64))
                yield pa.RecordBatch.from_arrays([batch.column("uid"), pa.array([r.tobytes() for r in rows], pa.binary()), pa.array(scale)], ["uid", "code", "scale"])

    coded = cut_lineage(points.mapInArrow(code, "uid long, code binary, scale double"))
    start = sorted_blocks(points, 0, BLOCK, degree)
    for seed in range(1, SORTINGS):
        start = start.union(sorted_blocks(points, seed, BLOCK, degree))
    fresh = cut_lineage(merged(None, start, degree))
    step = 0
    # what a list takes in is better than what it drops, so this ends
    while (rounds is None or step < rounds) and not fresh.filter(F.size("news") > 0).isEmpty():
        fresh = cut_lineage(merged(fresh.select("uid", "ids", "scores"), descend(fresh, coded, step, degree, members), degree))
        step += 1
    return fresh.select("uid", "ids", "scores")


BEAM_ROWS = "query long, ids array<long>, scores array<double>, open array<boolean>"
#: With whether one of the best is new in this step.
STATE_ROWS = f"{BEAM_ROWS}, moved boolean"


def search(queries: DataFrame, points: DataFrame, graph: DataFrame, k: int, beam: int = BEAM, best_of: int | None = None) -> DataFrame:
    """``query, ids, scores``: the ``k`` best found for each of ``queries`` (``uid, vec``), which may be rows of ``points``.

    A query is done once a step brings nothing new among its ``best_of`` (``k`` unless given) best.
    """
    best_of = k if best_of is None else best_of
    n = points.count()
    blocks = max(1, -(-n // HOLD))
    block_of = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    held = cut_lineage(points.select(block_of("uid").alias("block"), "uid", "vec"))
    asked = cut_lineage(queries.select(F.col("uid").alias("query"), "vec"))
    # a vector to start from for queries that are not in the graph: the first of each of a few hashed slices
    slices = min(64, max(1, n // 64))
    entries = points.groupBy(F.pmod(F.xxhash64("uid", F.lit(9)), F.lit(slices)).alias("slice")).agg(F.min("uid").alias("uid")).agg(F.collect_list("uid").alias("entries"))
    inside = asked.join(graph.select(F.col("uid").alias("query"), "ids"), "query")
    outside = asked.join(graph.select(F.col("uid").alias("query")), "query", "left_anti").crossJoin(F.broadcast(entries))  # one row
    wanted = inside.select("query", F.col("ids").alias("wanted")).union(outside.select("query", F.col("entries").alias("wanted")))
    state = None

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, uids, rows = -1, None, None
        out: list[tuple] = []
        for run in runs(batches, ["block", "kind"]):
            if run["kind"][0].as_py() == 0:
                block, uids, rows = run["block"][0].as_py(), run["uid"].to_numpy(), matrix(run["vec"]).astype(np.float64)
                order = np.argsort(uids)
                uids, rows = uids[order], rows[order]
                continue
            if run["block"][0].as_py() != block:
                continue
            for query, vec, worst, ids in zip(run["uid"].to_pylist(), run["vec"], run["worst"].to_pylist(), run["ids"], strict=True):
                ids = np.unique(ids.values.to_numpy())
                at = np.searchsorted(uids, ids)
                got = rows[at] @ vec.values.to_numpy().astype(np.float64)
                some = (got >= worst) & (ids != query)
                if some.any():
                    out.append((query, ids[some], got[some], np.ones(some.sum(), bool)))
                if len(out) >= 2000:
                    yield beam_batch(out)
                    out = []
        if out:
            yield beam_batch(out)

    def beam_batch(rows: list[tuple]) -> pa.RecordBatch:
        query, ids, scores, open_ = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), lists_of(list(ids), pa.int64()), lists_of(list(scores), pa.float64()), lists_of(list(open_), pa.bool_())], ["query", "ids", "scores", "open"])

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for run in runs(batches, ["query"]):
            query = run["query"][0].as_py()
            ids, scores, open_ = (run[c].combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("ids", "scores", "open"))
            order = np.lexsort((open_, ids, -scores))  # of one candidate, the row that says it was expanded
            ids, scores, open_ = ids[order], scores[order], open_[order].astype(bool)
            _, first = np.unique(ids, return_index=True)
            first.sort()
            first = first[:beam]
            # one scored anew may differ in its last bit; it stays expanded, so every search ends
            open_ = open_[first] & ~np.isin(ids[first], ids[~open_])
            out.append((query, ids[first], scores[first], open_))
            if len(out) >= 1000:
                yield state_batch(out)
                out = []
        if out:
            yield state_batch(out)

    def state_batch(rows: list[tuple]) -> pa.RecordBatch:
        batch = beam_batch(rows)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array([bool(o[:best_of].any()) for *_, o in rows], pa.bool_())], [*batch.schema.names, "moved"])

    vec_type = points.schema["vec"].dataType.simpleString()
    while True:
        # ids that a query wants scored, in one row for each block that holds some
        each = wanted.select("query", F.explode("wanted").alias("id")).select("query", "id", block_of("id").alias("block"))
        grouped = each.groupBy("query", "block").agg(F.collect_set("id").alias("ids"))
        known = asked if state is None else asked.join(state.select("query", F.when(F.size("scores") >= beam, F.array_min("scores")).alias("worst")), "query", "left")
        worst = F.lit(float("-inf")) if state is None else F.coalesce("worst", F.lit(float("-inf")))
        requests = grouped.join(known.withColumn("_w", worst), "query").select("block", F.lit(1).alias("kind"), F.col("query").alias("uid"), F.col("vec").cast(vec_type).alias("vec"), F.col("_w").alias("worst"), "ids")
        lying = held.select("block", F.lit(0).alias("kind"), "uid", "vec", F.lit(0.0).alias("worst"), F.array().cast("array<long>").alias("ids"))
        scored = lying.union(requests).repartition("block").sortWithinPartitions("block", "kind", "uid").mapInArrow(score, BEAM_ROWS)
        if state is not None:
            done = state.select("query", "ids", "scores", F.transform("open", lambda o: F.lit(False)).alias("open"))
            scored = scored.union(done)
        state = cut_lineage(scored.repartition("query").sortWithinPartitions("query").mapInArrow(narrow, STATE_ROWS))
        frontier = state.filter("moved").select("query", F.explode(F.arrays_zip("ids", "open")).alias("c")).filter("c.open").select("query", F.col("c.ids").alias("uid"))
        if frontier.isEmpty():
            break
        wanted = frontier.join(graph.select("uid", F.col("ids").alias("wanted")), "uid").select("query", "wanted")
    return state.select("query", F.slice("ids", 1, k).alias("ids"), F.slice("scores", 1, k).alias("scores"))


def nearest_of_length(rows: DataFrame, is_query, k: int, beam: int) -> DataFrame:
    """``nearest`` for rows ``uid, vec_id, vec`` that all count and have one length."""
    same = [F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(7), "vec").alias("h2")]
    marked = rows.select("uid", "vec_id", "vec", *same)
    classes = marked.groupBy("h1", "h2").agg(F.min("uid").alias("head"))
    members = cut_lineage(marked.select("uid", "vec_id", "h1", "h2").join(classes, ["h1", "h2"]).select("uid", "vec_id", "head"))
    points = cut_lineage(marked.select("uid", "vec").join(members.filter("uid = head").select("uid"), "uid"))
    graph = neighbour_graph(points)
    asking = members.filter(is_query)
    asked = cut_lineage(points.join(asking.select(F.col("head").alias("uid")), "uid", "left_semi"))
    found = search(asked, points, graph, beam, beam, best_of=beam // 2)
    others = found.select("query", F.explode(F.arrays_zip("ids", "scores")).alias("c")).select("query", F.col("c.ids").alias("head"), F.col("c.scores").alias("score"))
    square = F.aggregate("vec", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    itself = asked.select(F.col("uid").alias("query"), F.col("uid").alias("head"), square.alias("score"))
    # a query needs k others, so k + 1 members of a class and k + 1 rows of a class of queries are enough
    first = top_n(members, ["head"], [F.col("vec_id").isNull(), F.col("vec_id"), F.col("uid")], k + 1, "_rank").select("head", "uid", "vec_id")
    order = F.struct((-F.col("score")).alias("s"), F.col("vec_id").isNull().alias("n"), "vec_id", "uid", "score")
    # at most ``beam`` + 1 classes of k + 1 members a class of queries
    tops = others.union(itself).join(first, "head").groupBy(F.col("query").alias("head")).agg(F.slice(F.array_sort(F.collect_list(order)), 1, k + 1).alias("top"))
    mine = asking.select(F.col("uid").alias("query"), F.col("vec_id").alias("query_id"), "head")
    ranked = salted_join(mine, tops, ["head"]).withColumn("top", F.slice(F.filter("top", lambda c: c.uid != F.col("query")), 1, k))
    return ranked.select("query_id", F.posexplode("top").alias("rank", "c")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("c.vec_id").alias("vec_id"), F.col("c.score").alias("score"))


def nearest(vectors: DataFrame, is_query, k: int = 20, beam: int = BEAM, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for the rows that ``is_query`` (a condition on ``vec_id``) picks, their ``k`` nearest others.

    Vectors are searched among those of their own length. Runs jobs while the plan is built: the graph and the state of
    the searches are written to the shared folder. Columns other than the two named are not looked at.
    """
    parts = [nearest_of_length(rows, is_query, k, beam) for rows in by_length(numbered(vectors, vec_id, embedding))]
    empty = "query_id long, rank int, vec_id long, score double"
    return reduce(DataFrame.unionByName, parts) if parts else vectors.sparkSession.createDataFrame([], empty)


def op8_nearest_neighbours(spark, folder: str) -> DataFrame:
    return nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)
