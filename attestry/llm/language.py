"""Language identification by error-correcting output codes.

Every language has a codeword. For each bit a binary classifier over hashed letter n-grams predicts whether the
language is on the one or the other side; decoding picks the codeword with the smallest loss, each bit weighing
as much as its classifier was right in training, and flags a text whose two best codewords are close.

Classifiers are naive Bayes over n-gram counts of all training texts. Counts are summed where the texts are read
(``2**BUCKET_BITS`` buckets a language) and added up by Spark; the driver holds languages times buckets numbers,
whatever the size of the corpus.

Defined results: a null text and one without letters are ``und`` with score 0 and flagged; a null language is not
learned from; without any training language all texts are ``und``; with one, it is predicted with score 1; ties
go to the language that comes first in code point order.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.llm.common import extended, mix64, slices, table

BUCKET_BITS = 14
WIDTHS = (2, 3, 4)
#: Below this gap between the two best losses, per unit of weight, a text is ambiguous.
MARGIN = 0.02
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
#: ASCII letters and bytes of longer characters stay; the rest becomes one space.
KEEP = np.array([b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256)], np.uint8)


def grams(text: str, bits: int = BUCKET_BITS) -> np.ndarray:
    """Counts of the hashed n-grams of a text: small letters in UTF-8, other characters as one space."""
    raw = KEEP[np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8)]
    blank = raw == 32
    blank[0] = False
    blank[1:] &= raw[:-1] == 32
    raw = raw[~blank].astype(np.uint32)
    total = np.zeros(1 << bits, np.int64)
    for width in WIDTHS:
        if len(raw) < width:
            continue
        code = np.zeros(len(raw) - width + 1, np.uint32)
        for i in range(width):
            code = code * np.uint32(257) + raw[i : len(raw) - width + 1 + i]
        code = (code + np.uint32(width)) * np.uint32(2654435761)
        total += np.bincount((code ^ (code >> np.uint32(15))) >> np.uint32(32 - bits), minlength=1 << bits)
    return total


def has_letter(text: str | None) -> bool:
    return text is not None and LETTER.search(text) is not None


def codewords(n: int) -> np.ndarray:
    """One row of bits (+1, -1) for each of ``n`` languages, far apart from each other.

    Up to six languages have every split there is; more have hashed codes, the best of 64 by smallest distance.
    """
    if n <= 1:
        return np.ones((n, 0))
    if n <= 6:
        columns = [c for c in product((1, -1), repeat=n) if c[0] == 1 and min(c) < 0]
        return np.array(columns, np.float64).T
    length = int(np.ceil(10 * np.log2(n)))
    best, far = None, -1
    for trial in range(64):
        cells = mix64(np.arange(n * length, dtype=np.uint64) + np.uint64(trial << 32))
        code = np.where((cells & np.uint64(1)).astype(bool), 1.0, -1.0).reshape(n, length)
        distance = ((length - code @ code.T) / 2 + np.eye(n) * length).min()
        if distance > far and (np.abs(code.sum(0)) < n).all():
            best, far = code, distance
    return best


def counted(docs: DataFrame, bits: int = BUCKET_BITS) -> DataFrame:
    """``lang, bucket, n``: n-gram counts of ``docs`` (``lang, text``), summed where the texts are read."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not has_letter(text := text.as_py()):
                    continue
                found = grams(text, bits)
                if lang in sums:
                    sums[lang] += found
                else:
                    sums[lang] = found
        for lang, total in sums.items():
            full = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(full), pa.string()), pa.array(full, pa.int32()), pa.array(total[full], pa.int64())], ["lang", "bucket", "n"])

    return docs.mapInArrow(work, "lang string, bucket int, n long")


class LanguageModel:
    """Codewords and one row of n-gram weights for each bit."""

    def __init__(self, langs: list[str], counts: np.ndarray, margin: float = MARGIN):
        self.langs, self.margin = langs, margin
        self.code = codewords(len(langs))
        rates = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * counts.shape[1]) if len(langs) else counts
        bits = self.code.shape[1]
        self.weights = np.zeros((counts.shape[1], bits))
        self.trust = np.ones(bits)
        for b in range(bits):
            plus, minus = rates[self.code[:, b] > 0].mean(axis=0), rates[self.code[:, b] < 0].mean(axis=0)
            self.weights[:, b] = np.log(plus) - np.log(minus)
            # a bit's trust: its mean margin on the languages' own profiles, and nothing for one that is wrong there
            self.trust[b] = max((rates @ self.weights[:, b] * self.code[:, b]).min(), 1e-3)
        if bits:
            self.trust /= self.trust.sum()

    @classmethod
    def fit(cls, docs: DataFrame, lang: str = "lang", text: str = "text", margin: float = MARGIN) -> LanguageModel:
        """Learn from all rows with a language."""
        rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).filter("lang is not null")
        found = counted(rows).groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
        langs = sorted(found["lang"].unique())
        counts = np.zeros((len(langs), 1 << BUCKET_BITS))
        counts[found["lang"].map({v: i for i, v in enumerate(langs)}).to_numpy(np.int64), found["bucket"].to_numpy(np.int64)] = found["n"]
        return cls(langs, counts, margin)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score from 0 to 1 and whether the text is ambiguous."""
        if not self.langs or not has_letter(text):
            return UNKNOWN, 0.0, True
        if len(self.langs) == 1:
            return self.langs[0], 1.0, False
        found = grams(text)
        margins = found @ self.weights / max(found.sum(), 1)
        # exponential loss of each bit against each codeword, weighed by trust
        loss = (np.exp(-4.0 * self.code * margins) * self.trust).sum(axis=1)
        order = np.argsort(loss, kind="stable")
        gap = loss[order[1]] - loss[order[0]]
        odds = np.exp(-(loss - loss.min()) / 0.1)
        return self.langs[order[0]], float(odds[order[0]] / odds.sum()), bool(gap < self.margin)

    def label(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """Adds ``lang_pred, score, ambiguous`` in place of columns of these names; only the text is looked at."""

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                names = batch.schema.names
                got = [self.predict(t.as_py()) for t in batch.column(names.index(text))]
                extra = [pa.array([g[i] for g in got], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*names, "lang_pred", "score", "ambiguous"])

        docs = docs.drop("lang_pred", "score", "ambiguous")
        return docs.mapInArrow(work, extended(docs, lang_pred=T.StringType(), score=T.DoubleType(), ambiguous=T.BooleanType()))


def op2_language_id(spark, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = LanguageModel.fit(docs.filter(~held_out))
    narrow = model.label(docs.select("doc_id", "text"))
    return narrow.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")
