"""Whitening against plain covariances in exact arithmetic, and rows that do not count."""

import math
from fractions import Fraction

import numpy as np
import pytest

from attestry.llm import whitening
from attestry.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<double>, n string, x int"


def brute(vectors: dict[int, list[float]]) -> tuple[np.ndarray, dict[int, int], dict[int, list[int]], list[int]]:
    """Covariance, deviations, whole numbers and sums, by Python's own numbers."""
    xs = {k: [math.floor(1024 * c) + 100_000 for c in v] for k, v in vectors.items()}
    n, size = len(xs), len(next(iter(xs.values())))
    total = [sum(x[i] for x in xs.values()) for i in range(size)]
    off = {k: [n * x[i] - total[i] for i in range(size)] for k, x in xs.items()}
    covariance = [[float(Fraction(sum(o[i] * o[j] for o in off.values()), n**3)) for j in range(size)] for i in range(size)]
    return np.array(covariance), {k: sum(v * v for v in o) for k, o in off.items()}, xs, total


def check(rows, vectors):
    """Whether whitened rows are those of the vectors, up to a sign for each component."""
    covariance, deviation, xs, total = brute(vectors)
    values, directions = np.linalg.eigh(covariance)
    n, size = len(xs), len(total)
    assert len(rows) == n * min(8, size)
    found = {(r.vec_id, r.component): r for r in rows}
    for c in range(1, min(8, size) + 1):
        e, d = values[-c], directions[:, -c]
        expected = np.array([(np.array(xs[k], float) - np.array(total) / n) @ d / math.sqrt(e) for k in xs])
        got = np.array([found[k, c].whitened for k in xs])
        sign = 1 if got @ expected > 0 else -1
        np.testing.assert_allclose(got * sign, expected, atol=1e-7)
        assert all(abs(found[k, c].explained - e / covariance.trace()) < 1e-9 for k in xs)
    assert all(r.deviation == deviation[r.vec_id] and r.n == n for r in rows)
    assert {r.identity_error < 1e-4 for r in rows} == {True}


def test_registered_query_equals_plain_covariance(spark):
    folder = "/root/testdata/sf0.001"
    vectors = {r.vec_id: list(map(float, r.embedding)) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()}
    check(QUERIES["op11_whitening"](spark, folder).collect(), vectors)


def test_blocks_add_up(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", 64)  # sent to the tasks with the functions that use it only if they are closures
    rng = np.random.default_rng(5)
    x = (rng.normal(0, 300, (333, 5)) * [1, 10, 100, 1000, 1]).astype(np.int64) + 100_000
    low, high = x.min(0).tolist(), x.max(0).tolist()
    bits = max(h - w for h, w in zip(high, low, strict=True)).bit_length()
    found = sum(whitening.limbs(whitening.cross_products(x[k : k + 64], low, bits), 3) for k in range(0, 333, 64))
    u = x - x.min(0)
    sums = [[sum(int(found[k, i, j]) << (32 * k) for k in range(3)) for j in range(i, 5)] for i in range(5)]
    assert sums == [[int(u[:, i] @ u[:, j]) for j in range(i, 5)] for i in range(5)]


def test_large_and_distant_components(spark):
    rng = np.random.default_rng(7)
    vectors = {k: [float(v) for v in rng.normal(0, 1, 3) * [1e9, 3e8, 2e9] + [1e12, 0, -1e12]] for k in range(40)}
    rows = whitening.whiten(spark.createDataFrame([(k, v, "n", 1) for k, v in vectors.items()], SCHEMA)).collect()
    covariance, deviation, _, _ = brute(vectors)
    assert {r.vec_id: r.deviation for r in rows} == {k: v if v < 1 << 63 else None for k, v in deviation.items()}
    values = np.linalg.eigvalsh(covariance)[::-1]
    for r in rows:
        assert r.explained == pytest.approx(values[r.component - 1] / covariance.trace(), rel=1e-6)
        assert r.identity_error < 1e-4


def test_rows_that_do_not_count_and_lengths(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(3)
    usual = {k: rng.normal(0, 0.3, 4).tolist() for k in range(30)}
    usual[30] = usual[0]  # a repeated vector counts again
    short = {k: rng.normal(0, 0.3, 2).tolist() for k in range(40, 50)}
    bad = [(100, None), (101, [1.0, None, 1.0, 1.0]), (102, [nan, 1.0, 1.0, 1.0]), (103, [inf, 1.0, 1.0, 1.0]), (104, []), (None, None)]
    rows = whitening.whiten(spark.createDataFrame([(k, v, "n", 1) for k, v in [*usual.items(), *short.items(), *bad]], SCHEMA)).collect()
    check([r for r in rows if r.vec_id < 40], usual)
    check([r for r in rows if r.vec_id >= 40], short)


def test_no_variance_one_row_no_rows(spark):
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, 0.25], "n", 1)], SCHEMA)).collect()
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in sorted(one)] == [
        (1, 1, 1, 0, None, None, None),
        (1, 2, 1, 0, None, None, None),
    ]
    flat = whitening.whiten(spark.createDataFrame([(k, [k / 8, 3.0], None, None) for k in range(9)], SCHEMA)).collect()
    assert {(r.component, r.whitened is None, r.explained) for r in flat} == {(1, False, 1.0), (2, True, 0.0)}
    huge = whitening.whiten(spark.createDataFrame([(k, [1e300 * (-1) ** k, float(k)], None, None) for k in range(4)], SCHEMA)).collect()
    assert {r.deviation for r in huge} == {None}
    none = whitening.whiten(spark.createDataFrame([], SCHEMA))
    assert none.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert none.collect() == []
