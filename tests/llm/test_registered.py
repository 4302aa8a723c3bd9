"""The registered queries over a whole table, and the pipeline stage by stage."""

from __future__ import annotations

import zlib
from pathlib import Path

import numpy as np
import pytest

from __spark_entry__ import queries

pipeline = pytest.importorskip("corpus_pipeline")
FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, extra string"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").toPandas()


def test_language_query(spark, documents):
    got = queries()["op2_language_id"](spark, FOLDER).toPandas().merge(documents, on="doc_id")
    assert len(got) == len(documents)
    assert all(h == (zlib.crc32(str(d).encode()) % 4 == 2) for h, d in zip(got["held_out"], got["doc_id"], strict=True))
    assert (got["lang_pred"] == got["lang"])[got["held_out"]].mean() > 0.95


def test_quality_query(spark, documents):
    got = queries()["op6_quality"](spark, FOLDER).toPandas()
    assert len(got) == len(documents) and got["score"].between(0, 1).all() and ((got["score"] >= 0.3) == (got["predicted"] == 1)).all()
    assert all(h == (zlib.crc32(str(d).encode()) % 5 == 0) for h, d in zip(got["held_out"], got["doc_id"], strict=True))
    held = got[got["held_out"]].merge(spark.read.parquet(f"{FOLDER}/labels.parquet").toPandas(), on="doc_id")
    good, bad = held.loc[held["quality"] == 1, "score"], held.loc[held["quality"] == 0, "score"]
    assert not len(bad) or np.mean([[g > b for g in good] for b in bad]) > 0.9


def test_page_queries(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").toPandas()
    texts = queries()["op5_html_extraction"](spark, FOLDER).toPandas()
    assert sorted(texts["page_id"]) == sorted(pages["page_id"]) and (texts["text"].str.len() == texts["n_chars"]).all()
    verdicts = queries()["op7_url_filter"](spark, FOLDER).toPandas()
    assert sorted(verdicts["page_id"]) == sorted(pages["page_id"]) and set(verdicts["verdict"]) <= {"allow", "block"}


def test_neighbour_query_recall(spark):
    table = spark.read.parquet(f"{FOLDER}/embeddings.parquet").toPandas()
    got = queries()["op8_nearest_neighbours"](spark, FOLDER).toPandas()
    points, ids = np.array(table["embedding"].tolist(), dtype=np.float64), table["vec_id"].to_numpy()
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        scores = points @ points[q]
        scores[q] = -np.inf
        best = ids[np.lexsort((ids, -scores))[: min(20, len(ids) - 1)]]
        mine = got[got["query_id"] == ids[q]].sort_values("rank")
        hits, total = hits + len(set(best) & set(mine["vec_id"])), total + len(best)
        exact = dict(zip(ids, scores, strict=True))
        assert np.allclose(mine["score"], [exact[v] for v in mine["vec_id"]], rtol=0, atol=1e-12)
    assert hits / total >= 0.9


def test_pipeline_stages(spark, documents):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    before = documents
    for name, stage in pipeline.STAGES[:-1]:
        frame = stage(spark, docs, FOLDER)
        assert frame.columns == list(documents.columns), name
        after = frame.toPandas()
        assert set(after["doc_id"]) <= set(before["doc_id"]) and (after["n_chars"] == after["text"].str.len()).all()
        if name == "language_id":
            assert (after.merge(before, on="doc_id")["lang_x"] == after.merge(before, on="doc_id")["lang_y"]).mean() > 0.95
        if name == "line_dedup":
            lines = [line.strip() for text in after.sort_values("doc_id")["text"] for line in text.split("\n") if line.strip()]
            assert len(lines) == len(set(lines))
        if name == "minhash_near_dedup":
            assert after["text"].is_unique or after["text"].duplicated().sum() == after["text"].isin(["", " "]).sum() - 1
        docs, before = frame, after
    pieces = pipeline.STAGES[-1][1](spark, docs, FOLDER).toPandas()
    assert pieces["doc_tokens"].where(pieces["start"] == 0).notna().sum() == len(before)
    assert pieces["length"].sum() == pieces.loc[pieces["start"] == 0, "doc_tokens"].sum()


def test_pipeline_of_odd_rows(spark, tmp_path):
    odd = [(1, None, None, None, 0, "x"), (2, "", "en", "s", 0, "x"), (None, "the words of a text without an id", "en", "s", 0, "x"), (3, "12 34", "en", None, 0, "x")]
    text = "the quick brown fox jumps over the lazy dog and runs away again\nle renard brun saute par dessus le chien"
    rows = [*odd, *[(10 + i, text + f"\nline {i} of this text is its own line", "en", "s", 0, "x") for i in range(3)], (10, text, "en", "s", 0, "x")]
    for name, data in (("odd", rows), ("none", [])):
        spark.createDataFrame(data, COLUMNS).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = pipeline.run(spark, f"{tmp_path}/{name}").toPandas()
        assert set(got["doc_id"].dropna()) <= {10, 11, 12} and (len(got) > 0) == (name == "odd")


def test_pipeline_leaves_only_what_its_result_reads(spark, tmp_path):
    from attestry.operators.keyed import shared_folder

    root = Path(shared_folder(spark).removeprefix("file:"))
    before = {p for top in ("attestry-state", "corpus-pipeline") for p in root.glob(f"{top}/*")}
    rows = [(k, f"the old house by the river number {k} " * 9 + "\n" + "und der alte Mann am Fluss " * 3, "en", "s", 10, "x") for k in range(60)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/in/documents.parquet")
    pieces = pipeline.run(spark, f"{tmp_path}/in")
    left = {p for top in ("attestry-state", "corpus-pipeline") for p in root.glob(f"{top}/*")} - before
    states, outputs = [p for p in left if p.parent.name == "attestry-state"], [p for p in left if p.parent.name == "corpus-pipeline"]
    assert len(states) == 2 and [sorted(d.name for d in o.iterdir()) for o in outputs] == [["mixing"]]
    assert pieces.count() > 0
