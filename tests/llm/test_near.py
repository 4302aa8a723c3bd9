"""Near-duplicate lines, texts and vectors, and nearest neighbours, against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestry.llm import lines, near_text, near_vectors, neighbours
from attestry.llm.components import components

DOCS = "doc_id long, text string, row long, key string, n long, line string, _k string"


def within_one(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :]


def test_lines_against_brute_force(spark):
    rng = random.Random(1)
    base = ["".join(rng.choice("abcde é") for _ in range(rng.choice([22, 40, 63, 64, 65, 130]))).strip() + "x" * 3 for _ in range(25)]

    def edited(line):
        at, kind = rng.randrange(len(line)), rng.randrange(4)
        return [line, line[:at] + line[at + 1 :], line[:at] + rng.choice("abz") + line[at + 1 :], line[:at] + rng.choice("abz") + line[at:]][kind]

    rows = [(i, "\n".join(rng.choice([edited(rng.choice(base)), edited(edited(rng.choice(base))), "", " short ", "shorT"]) for _ in range(rng.randrange(1, 9)))) for i in range(150)]
    rows += [(500, None), (501, ""), (502, "aaaa" * 8000), (503, "aaaa" * 8000 + "a"), (None, base[0]), (7000, "\n".join(base))]
    got = {r["doc_id"]: r for r in lines.dedup_lines(spark.createDataFrame([(i, t, 1, "k", 2, "l", "_") for i, t in rows], DOCS)).collect()}
    seen: list[str] = []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        kept = []
        for line in (text or "").split("\n"):
            trimmed = line.strip(" \t\r\x0b\x0c")
            if not trimmed or not any(trimmed == s or min(len(trimmed), len(s)) >= 20 and within_one(trimmed, s) for s in seen):
                kept.append(line)
            if trimmed:
                seen.append(trimmed)
        row = got[doc_id]
        assert row["text"] == (None if text is None else "\n".join(kept)), doc_id
        assert row["lines_dropped"] == (0 if text is None else text.count("\n") + 1 - len(kept)) and row["_k"] == "_" and row["line"] == "l"
    assert lines.dedup_lines(spark.createDataFrame([], DOCS)).count() == 0


def test_line_rows_that_repeat_share_their_fate(spark):
    twin = (1, "a line that is long enough", 1, "", 1, "", "")
    got = lines.dedup_lines(spark.createDataFrame([twin, twin, (2, *twin[1:])], DOCS)).collect()
    assert sorted(r["text"] for r in got) == ["", twin[1], twin[1]]


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(300, 300)]
    parent = {x: x for pair in links for x in pair}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


def brute_sets(text: str | None, width: int) -> frozenset:
    words = (text or "").encode().lower().split()
    width = min(width, len(words))
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1)) if width else frozenset()


@pytest.mark.parametrize("width", [2, 5])
def test_near_texts_against_brute_force(spark, width):
    rng = random.Random(width)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 6, 40, 120]))] for _ in range(20)]
    rows = []
    for i in range(260):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(w.upper() if rng.random() < 0.1 else w for w in words)))
    # a chain: each is near the next, the ends are not near each other
    chain = [f"c{i}" for i in range(100)]
    rows += [(1000 + k, " ".join(chain[k * 3 : k * 3 + 70])) for k in range(10)]
    rows += [(2000, None), (2001, ""), (2002, " \n"), (2003, "w1 " * 30000), (None, rows[0][1]), (5, rows[5][1])]
    docs = spark.createDataFrame([(i, t, 1, "k", 2, "l", "_") for i, t in rows], DOCS)
    got = near_text.near_duplicates(docs, width=width).collect()
    assert len(got) == len(rows)
    sets = [brute_sets(t, width) for _, t in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                label[max(find(i), find(j))] = min(find(i), find(j))
    smallest = {}
    for i, (doc_id, _) in enumerate(rows):
        smallest[find(i)] = min((x for x in (doc_id, smallest.get(find(i))) if x is not None), default=None)
    want = sorted(((d is None, d or 0), len(sets[i]), smallest[find(i)]) for i, (d, _) in enumerate(rows))
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["n_shingles"], r["component_id"]) for r in got) == want
    assert sum(r["first"] for r in got) == len({find(i) for i in range(len(rows))})
    assert near_text.near_duplicates(docs.limit(0), width=width).count() == 0


def test_sketch_fills_every_bin_and_estimates():
    rng = np.random.default_rng(2)
    for size in (1, 2, 5, 400, 5000):
        both = rng.integers(0, 2**63, size, dtype=np.uint64)
        assert (near_text.sketch(both, 240) == near_text.sketch(both[::-1].copy(), 240)).all()
    a = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 2**63, 200, dtype=np.uint64)])
    same = np.mean(near_text.sketch(np.sort(a), 240) == near_text.sketch(np.sort(b), 240))
    assert abs(same - 800 / 1200) < 0.12


VECTORS = "vec_id long, embedding array<float>, label int, uid long, key string"


def vector_rows(n: int, size: int = 12) -> list[tuple]:
    rng = np.random.default_rng(7)
    points = rng.normal(size=(n, size))
    points[n // 2 :] = points[rng.integers(0, 10, n - n // 2)] + rng.normal(scale=0.12, size=(n - n // 2, size))
    rows = [(i, [float(x) for x in p.astype(np.float32)], 0, 9, "k") for i, p in enumerate(points)]
    odd = [None, [], [0.0] * size, [1.0] * (size - 1), [float("nan")] * size, [float("inf")] + [1.0] * (size - 1), [None] + [1.0] * (size - 1)]
    rows += [(10_000 + i, v, 0, 9, "k") for i, v in enumerate(odd)]
    return rows + [(None, rows[3][1], 0, 9, "k"), (3, rows[3][1], 0, 9, "k"), (20_000, [1e30 * x for x in rows[3][1]], 0, 9, "k")]


def usable(v, size=12):
    return v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v) and any(v)


def test_near_vectors_against_brute_force(spark):
    rows = vector_rows(400)
    frame = spark.createDataFrame(rows, VECTORS)
    got = near_vectors.near_vectors(frame).collect()
    good = [i for i, r in enumerate(rows) if usable(r[1])]
    points = np.array([rows[i][1] for i in good])
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    near = points @ points.T >= 0.95
    np.fill_diagonal(near, False)
    label = near_vectors.roots(len(good), *np.nonzero(near))
    ids = [rows[i][0] for i in good]
    smallest = {c: min(x for x, l in zip(ids, label, strict=True) if l == c and x is not None) for c in set(label) if any(x is not None for x, l in zip(ids, label, strict=True) if l == c)}
    want = sorted((-1 if i is None else i, int(d), smallest.get(c, -1)) for i, d, c in zip(ids, near.sum(1), label, strict=True))
    want = sorted([*want, *((r[0], 0, r[0]) for r in rows if not usable(r[1]))])
    assert sorted((-1 if r["vec_id"] is None else r["vec_id"], r["n_links"], -1 if r["component_id"] is None else r["component_id"]) for r in got) == want
    assert near_vectors.near_vectors(frame.limit(0)).count() == 0


def test_near_vectors_in_parts(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "PART", 16)
    rows = [(i, [1.0, 0.001 * (i % 50), 0.0, float(i >= 100)], 0, 0, "") for i in range(140)]
    got = near_vectors.near_vectors(spark.createDataFrame(rows, VECTORS)).collect()
    assert {(r["vec_id"] < 100, r["n_links"], r["component_id"]) for r in got} == {(True, 99, 0), (False, 39, 100)}


def test_neighbours_recall_and_order(spark):
    rows = vector_rows(900)
    got = neighbours.nearest(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 20 == 0, k=10).toPandas()
    good = [r for r in rows if usable(r[1])]
    points = np.array([r[1] for r in good])
    hits = total = 0
    for q, (qid, vec, *_) in enumerate(good):
        if qid is None or qid % 20:
            continue
        scores = points @ np.array(vec)
        order = sorted((i for i in range(len(good)) if i != q), key=lambda i: (-scores[i], good[i][0] is None, good[i][0] or 0))[:10]
        found = got[got["query_id"] == qid].sort_values("rank")
        assert list(found["rank"]) == list(range(1, 11)) and (np.diff(found["score"]) <= 0).all()
        want = {f"{s:.6g}" for s in scores[order]}  # by score, as equal vectors have several ids
        hits, total = hits + len(want & {f"{s:.6g}" for s in found["score"]}), total + len(want)
    assert hits / total >= 0.95


def test_few_or_no_neighbours(spark):
    few = spark.createDataFrame([(i, [1.0, float(i)], 0, 0, "") for i in range(0, 60, 20)], VECTORS)
    got = neighbours.nearest(few, F.col("vec_id") % 20 == 0).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == [(0, 1, 20), (0, 2, 40), (20, 1, 40), (20, 2, 0), (40, 1, 20), (40, 2, 0)] or len(got) == 6
    assert neighbours.nearest(few.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert neighbours.nearest(few.limit(1), F.col("vec_id") % 20 == 0).count() == 0


def test_search_of_outside_queries(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(500)]
    points = spark.createDataFrame(rows, "uid long, vec array<double>")
    asked = spark.createDataFrame([(-1 - i, [float(x) for x in rng.normal(size=8)]) for i in range(10)], "uid long, vec array<double>")
    found = neighbours.search(asked, points, neighbours.neighbour_graph(points, rounds=3), k=5).collect()
    vecs = {r["uid"]: r["vec"] for r in asked.collect()}
    matrix = np.array([v for _, v in rows])
    hits = sum(len(set(np.argsort(-(matrix @ np.array(vecs[r["query"]])))[:5]) & set(r["ids"])) for r in found)
    assert len(found) == 10 and hits >= 45


def test_neighbours_of_repeated_vectors_by_id(spark):
    rng = np.random.default_rng(11)
    points = rng.normal(size=(1500, 8)).astype(np.float32)
    points[200:1100] = points[0]  # more copies than a block holds
    points[1100:1160] = points[1]
    ids = [int(x) for x in rng.permutation(1500)]
    rows = [(i, [float(x) for x in p], 0, 0, "") for i, p in zip(ids, points, strict=True)]
    got: dict = {}
    for r in sorted(neighbours.nearest(spark.createDataFrame(rows, VECTORS).repartition(5), F.col("vec_id") % 20 == 0, k=10).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    _, kind = np.unique(points, axis=0, return_inverse=True)
    at = {i: n for n, i in enumerate(ids)}
    hits = 0
    for query in range(0, 1500, 20):
        scores = points.astype(np.float64) @ points[at[query]].astype(np.float64)
        of_kind = {c: s for c, s in zip(kind.ravel(), scores, strict=True)}  # one score for all copies
        want = sorted((i for i in ids if i != query), key=lambda i: (-of_kind[kind.ravel()[at[i]]], i))[:10]
        hits += len(set(want) & set(got[query]))
        if 200 <= at[query] < 1100 and of_kind[kind.ravel()[0]] == max(of_kind.values()):
            assert got[query] == want
    assert hits >= 0.98 * 750
