"""Mixing and packing: sums, bounds, reruns, exact round trips, edge cases."""

from __future__ import annotations

import itertools
import random
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from attestry.llm import mixing, packing

DOCS = "doc_id long, text string, source string, size string, _uid long"


def water(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Targets by settling the sources above their cap one round after the other."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, open_ = {}, share * sum(sizes.values()), set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] >= most * sizes[s]]
        for s in over or open_:
            target[s] = most * sizes[s] if over else level * weight[s]
        left -= sum(most * sizes[s] for s in over)
        open_ = open_ - set(over) if over else set()
    return target


@pytest.fixture(scope="module")
def mixed(spark):
    rng = random.Random(3)
    rows = [(i, " ".join("w" for _ in range(rng.choice([1, 3, 40, 200]))), rng.choice(["a"] * 6 + ["b", "Z", None, "é"]), "x", 5) for i in range(3000)]
    rows += [(7, "same row\ttwice", "b", "", 0)] * 2 + [(None, None, "a", "", 0), (None, " \n ", None, "", 0), (3001, "w " * 30000, "b", "", 0)]
    return rows, mixing.mix(spark.createDataFrame(rows, DOCS)).toPandas()


def test_mix_sizes_and_targets(mixed):
    rows, got = mixed
    sizes = {}
    for _, text, source, *_ in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").encode().split())
    target = water(sizes)
    assert len(got) == len(rows) and got["size"].sum() == sum(sizes.values())
    for source, part in got.groupby(got["source"].where(got["source"].notna(), None), dropna=False):
        source = None if pd.isna(source) else source
        assert set(part["source_size"]) == {sizes[source]}
        assert np.allclose(part["target"], target[source])
        assert abs(part["taken"].sum() - target[source]) <= part["size"].max() / 2 + 1e-6
    assert (got["taken"] <= 2 * got["size"]).all() and (got["taken"] == got["copies"] * got["size"]).all()


def test_mix_does_not_depend_on_partitions(spark, mixed):
    rows, got = mixed
    again = mixing.mix(spark.createDataFrame(rows, DOCS).repartition(7)).toPandas()
    key = lambda f: sorted(map(tuple, f[["doc_id", "size", "taken"]].fillna(-1).astype(int).to_numpy()))
    assert key(again) == key(got)


def test_mix_of_nothing(spark):
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
    one = mixing.mix(spark.createDataFrame([(1, None, None, "", 0)], DOCS)).first()
    assert (one["size"], one["target"], one["taken"]) == (0, 0.0, 0)


def test_pairing_keeps_sum_and_expectation():
    frame = pd.DataFrame({"doc_id": range(60), "size": [1 + i % 7 for i in range(60)], "part": [0.3] * 60, "mark": np.arange(60, dtype=np.int64) * 7919})
    taken = np.zeros(60)
    for seed in range(400):
        out = mixing.pair_up(frame.sample(frac=1, random_state=seed), seed).sort_values("doc_id")
        assert np.isclose((out["part"] * out["size"]).sum(), (frame["part"] * frame["size"]).sum())
        assert ((out["part"] > 0) & (out["part"] < 1)).sum() <= 1
        taken += out["part"].to_numpy()
    assert abs(taken.mean() / 400 - 0.3) < 0.02


def test_hilbert_curve_is_a_walk():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        points = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        keys = packing.hilbert_key(points, bits)
        assert sorted(keys) == list(range(len(points)))
        walk = points[np.argsort(keys)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_pack_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["the", "zebra", "été", "<|endoftext|>", "12", "\n", "日本"]) for _ in range(rng.choice([0, 1, 50, 900]))), "s", "", 0) for i in range(120)]
    rows += [(None, None, "s", "", 0), (5, "twin", "s", "", 0), (5, "twin", "s", "", 0), (999, "long " * 40000, "s", "", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    pieces = packing.pack(docs, *packing.vocabulary()).toPandas()
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    exact.encode_special_tokens = True
    want = sorted([*exact.encode(t or "", add_special_tokens=False).ids, 0] for _, t, *_ in rows)
    pieces["ids"] = [np.frombuffer(v, "<u2").tolist() for v in pieces["ids"]]
    assert (pieces["ids"].map(len) == pieces["length"]).all()
    # sequences are full and gapless, but for the last
    totals = pieces.groupby("sequence_id")["length"].sum()
    assert list(totals.index) == list(range(len(totals))) and (totals.iloc[:-1] == 1024).all() and totals.iloc[-1] <= 1024
    for _, part in pieces.sort_values("offset").groupby("sequence_id"):
        assert (part["offset"] == part["length"].cumsum() - part["length"]).all()
    # pieces of a document follow each other along the sequences
    stream = pieces.sort_values(["sequence_id", "offset"])
    docs_out, now = [], []
    for ids, start, length, total in stream[["ids", "start", "length", "doc_tokens"]].itertuples(index=False):
        assert start == len(now)
        now = now + ids
        if start + length == total:
            docs_out.append(now)
            now = []
    assert not now and sorted(docs_out) == want
    sums = packing.digest(packing.pack(docs, *packing.vocabulary())).toPandas()
    crc = {(r.sequence_id, r.offset): r.ids_crc32 for r in sums.itertuples()}
    assert all(crc[r.sequence_id, r.offset] == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in pieces.itertuples())
    assert packing.pack(docs.limit(0), *packing.vocabulary()).count() == 0


def test_queries_give_added_tokens_their_id(spark, tmp_path):
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x<|endoftext|>  y\n", "<|endoftext|", "plain text", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.withColumn("lang", F.lit("")).withColumn("source", F.lit("")).withColumn("n_chars", F.lit(0)).write.parquet(f"{tmp_path}/documents.parquet")
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*exact.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    assert ids[0] == [64, 220, 50256, 275, 0]
    want = {i: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids.items()}
    stage = dict(corpus_pipeline.STAGES)["packing"]
    for got in (packing.op10_packing(spark, str(tmp_path)), stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), "")):
        assert {r["doc_id"]: (r["doc_tokens"], r["ids_crc32"]) for r in got.collect()} == want


def test_checksums_are_made_where_pieces_are_cut(spark, tmp_path):
    docs = spark.createDataFrame([(i, "word " * (i % 7 * 400)) for i in range(60)], "doc_id long, text string")
    two = packing.digest(packing.pack(docs, *packing.vocabulary()))
    one = packing.pack(docs, *packing.vocabulary(), digests=True)
    assert one.schema == two.schema and sorted(one.collect()) == sorted(two.collect())
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    # a second Python worker for each task took the executors beyond their memory
    plan = packing.op10_packing(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
