"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

A text is words and runs of signs; its features are the hashed single ones, pairs, and one feature for a word
that follows itself. Their values are counts under a square root, scaled to length one, so that a score is one
sparse dot product. Training makes a few passes of FTRL-proximal updates over a bounded sample of labelled rows
in one task; scoring reads every text whole.

Defined results: null and empty texts have no features and score what the intercept says; conflicting labels of
one id count as the lower one; labels that are null or of unknown ids are not learned from; without labels every
score is 0.5; with one kind of label the scores lean to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.llm.common import extended, mix64, slices, table, unit
from attestry.operators.keyed import cut_lineage

BITS = 18
#: Most labelled rows to learn from, give or take what hashing to a fraction does.
TRAIN_ROWS = 12_000
PASSES = 5
ALPHA, BETA, L1, L2 = 3.0, 1.0, 0.002, 0.02
TOKEN = regex.compile(r"\w+|[^\w\s]+")


class Tokens(dict):
    """Word to 64-bit hash; emptied when it grows large."""

    def __missing__(self, token: str) -> int:
        if len(self) > 2_000_000:
            self.clear()
        value = self[token] = xxhash.xxh3_64_intdigest(token.encode("utf-8", "surrogatepass"))
        return value


def features(text: str | None, known: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a text's features; the values have length one."""
    tokens = TOKEN.findall(text or "")
    if not tokens:
        return np.zeros(0, np.int64), np.zeros(0)
    ids = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
    with np.errstate(over="ignore"):
        pairs = mix64(ids[:-1]) + ids[1:]
    pairs[ids[:-1] == ids[1:]] = np.uint64(0x5A3E)  # a word after itself, whichever it is
    index = (mix64(np.concatenate([ids, pairs])) >> np.uint64(64 - BITS)).astype(np.int64)
    index, counts = np.unique(index, return_counts=True)
    values = np.sqrt(counts)
    return index, values / np.sqrt((values**2).sum())


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], passes: int = PASSES) -> tuple[np.ndarray, float]:
    """Weights and intercept after FTRL-proximal updates in the order given."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights(i: np.ndarray) -> np.ndarray:
        pull = np.sign(z[i]) * np.maximum(np.abs(z[i]) - np.where(i < size - 1, L1, 0.0), 0.0)
        return -pull / ((BETA + np.sqrt(n[i])) / ALPHA + L2)

    for _ in range(passes):
        for index, values, label in rows:
            i, x = np.append(index, size - 1), np.append(values, 1.0)  # the last is the intercept
            w = weights(i)
            slope = (1.0 / (1.0 + np.exp(-np.clip(x @ w, -35.0, 35.0))) - label) * x
            sigma = (np.sqrt(n[i] + slope**2) - np.sqrt(n[i])) / ALPHA
            z[i] += slope - sigma * w
            n[i] += slope**2
    all_ = weights(np.arange(size))
    return all_[:-1], float(all_[-1])


class QualityModel:
    def __init__(self, weights: np.ndarray, intercept: float):
        self.weights, self.intercept = weights, intercept

    @classmethod
    def fit(cls, labelled: DataFrame, train_rows: int = TRAIN_ROWS) -> QualityModel:
        """``labelled`` has ``doc_id, text, label``; at most about ``train_rows`` of its rows should be there."""

        def learn(frame: pd.DataFrame) -> pd.DataFrame:
            known = Tokens()
            frame = frame.sort_values(["mark", "doc_id", "text"], kind="stable")
            rows = [(*features(t, known), int(y)) for t, y in zip(frame["text"], frame["label"], strict=True)]
            weights, intercept = train(rows)
            full = np.flatnonzero(weights)
            return pd.DataFrame({"i": np.append(full, -1), "w": np.append(weights[full], intercept)})

        marked = labelled.select("doc_id", "text", "label", F.xxhash64("doc_id", F.lit(3)).alias("mark"), F.lit(0).alias("task"))
        found = marked.groupBy("task").applyInPandas(learn, "i long, w double").toPandas()
        weights, last = np.zeros(1 << BITS), found.loc[found["i"] < 0, "w"]
        rest = found[found["i"] >= 0]
        weights[rest["i"].to_numpy(np.int64)] = rest["w"]
        return cls(weights, float(last.iloc[0]) if len(last) else 0.0)

    def score(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """Adds ``score``, the probability of label 1, in place of a column of this name; only the text is looked at."""
        index = np.flatnonzero(self.weights)
        sent = self.weights[index]  # most weights are 0

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, weights = Tokens(), np.zeros(1 << BITS)
            weights[index] = sent
            for batch in slices(batches):
                scores = []
                for value in batch.column(batch.schema.names.index(text)):
                    i, x = features(value.as_py(), known)
                    scores.append(1.0 / (1.0 + np.exp(-np.clip(weights[i] @ x + self.intercept, -35.0, 35.0))))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "score"])

        docs = docs.drop("score")
        return docs.mapInArrow(work, extended(docs, score=T.DoubleType()))


def sample_labels(labels: DataFrame, label: str, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``doc_id, label``, one row an id, about ``train_rows`` of them at most, chosen by a hash of the id."""
    one = cut_lineage(labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.min(label).cast("int").alias("label")))
    n = one.count()
    return one.filter(unit(F.col("doc_id"), F.lit(5)) < train_rows / n) if n > train_rows else one


def sample_rows(labelled: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``doc_id, text, label`` without repeated rows, about ``train_rows`` of them at most, chosen by a hash of id and text.

    An id may stand in many rows: each of its texts has the label of the id, equal ones count once.
    """
    marked = labelled.select("doc_id", "text", "label", F.coalesce(F.sha2("text", 256), F.lit("")).alias("_digest"))
    n = marked.agg(F.count_distinct("doc_id", "_digest")).first()[0]
    if n > train_rows:
        marked = marked.filter(unit(F.col("doc_id"), F.col("_digest"), F.lit(6)) < train_rows / n)
    return marked.groupBy("doc_id", "_digest").agg(F.min("label").alias("label"), F.min("text").alias("text")).select("doc_id", "text", "label")


def op6_quality(spark, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    labels = sample_labels(table(spark, folder, "labels").filter(~held_out), "quality")
    # the sample is bounded by TRAIN_ROWS, whatever the corpus
    model = QualityModel.fit(sample_rows(docs.join(F.broadcast(labels), "doc_id")))
    return model.score(docs).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )
