"""Vectors of several lengths in one table; ids with many rows in training."""

import numpy as np
from pyspark.sql import functions as F

from attestry.llm import near_vectors, neighbours, quality


def _vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(30)] + [(100 + i, rng.normal(size=5).tolist()) for i in range(12)]
    rows += [(200, rows[3][1]), (201, rows[33][1]), (202, rows[33][1]), (300, [1.0]), (301, [0.0]), (302, None), (303, [float("nan")] * 5)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def _good(v):
    return v is not None and any(v) and all(np.isfinite(v))


def test_links_within_every_length(spark):
    rows, frame = _vectors(spark)
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors.near_vectors(frame).collect()}
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if _good(v)}
    links = {i: {j for j in unit if j != i and len(unit[j]) == len(unit[i]) and unit[i] @ unit[j] >= 0.95 - 1e-12} for i in unit}
    assert {i: n for i, (n, _) in got.items()} == {i: len(links.get(i, ())) for i, _ in rows}
    assert got[200] == (1, 3) and got[201] == got[202] == (2, 103) and got[303] == (0, 303) and got[302] == (0, 302)


def test_search_within_every_length(spark):
    rows, frame = _vectors(spark)
    found = neighbours.nearest(frame, F.col("vec_id") % 20 == 0, k=4).orderBy("query_id", "rank").collect()
    got = {}
    for r in found:
        got.setdefault(r.query_id, []).append(r.vec_id)
    for i, v in rows:
        if i % 20 == 0 and _good(v):
            near = sorted((-float(np.dot(v, w)), j) for j, w in rows if j != i and _good(w) and len(w) == len(v))[:4]
            assert got.get(i, []) == [j for _, j in near], i
    empty = neighbours.nearest(frame.filter("vec_id > 300 AND vec_id < 303"), F.col("vec_id") % 20 == 0)
    assert empty.count() == 0 and empty.columns == ["query_id", "rank", "vec_id", "score"]


def test_an_id_with_many_rows_does_not_widen_the_training_rows(spark):
    rows = spark.range(4000).select((F.col("id") % 2).alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 1000).alias("text"), F.lit(1).alias("label"))
    one = quality.sample_rows(rows, 2000)
    assert one.count() == one.distinct().count() == 1000
    few = quality.sample_rows(rows, 100)
    assert 50 < few.count() < 160 and sorted(map(tuple, few.collect())) == sorted(map(tuple, quality.sample_rows(rows.orderBy("text"), 100).collect()))
