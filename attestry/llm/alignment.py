"""Alignment of two tokenizers over a corpus, worked out once for each distinct text.

Documents are shuffled by their full text and counted; each distinct text is encoded by both tokenizers once.
Places where a token of either ends cut the text into groups, and the two tokens that end at such a place are linked.
How often a pair of ids is linked in the corpus is the sum over distinct texts, weighted by how many documents have
the text. Measures of a text then go back to all its documents by the text's sha256.

Defined results: null and empty texts, and texts whose tokens do not give the text back byte for byte, have no tokens,
zeros and an empty digest; very long texts are encoded whole; repeated rows each count and each have a row; ties for
the highest count all count as highest; columns besides the two asked for are not looked at, whatever their names;
no rows give no rows. Written while the plan is built: one table of distinct texts and one of pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestry.llm.common import slices, table
from attestry.llm.packing import coder, vocabulary
from attestry.llm.pieces import SPACE, model
from attestry.operators.keyed import cut_lineage, weighted_join

_SIDES: dict = {}


class Side:
    """One tokenizer: how it encodes, and of each id the bytes and the text forms that a list of groups needs."""

    def __init__(self, encode, tokens: list[bytes], last: str):
        if not all(tokens):
            raise ValueError("a token without bytes has no end of its own")
        self.encode, self.tokens = encode, tokens
        self.sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.inner = np.array([f"{i}," for i in range(len(tokens))], object)
        self.final = np.array([f"{i}{last}" for i in range(len(tokens))], object)


def sides(ranks: str, pattern: str, pieces: str) -> tuple[Side, Side]:
    """The byte-level vocabulary of a rank file and the piece vocabulary of a model file; one pair per Python worker."""
    key = ranks, pattern, pieces
    if key not in _SIDES:
        from sentencepiece import SentencePieceProcessor

        a = coder(ranks, pattern)
        b = SentencePieceProcessor(model_file=pieces)
        spelled = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(map(b.id_to_piece, range(b.get_piece_size())))]
        _SIDES[key] = (
            Side(lambda texts: [a.encode_ordinary(" " + t) for t in texts], [a.decode_single_token_bytes(i) for i in range(a.n_vocab)], "|"),
            Side(lambda texts: b.encode(texts, num_threads=1), spelled, ";"),
        )
    return _SIDES[key]


def groups_of(a: np.ndarray, b: np.ndarray, left: Side, right: Side) -> tuple[np.ndarray, np.ndarray, str]:
    """Ids of the two tokens that end each group together, and all groups as text."""
    ends_a, ends_b = left.sizes[a].cumsum(), right.sizes[b].cumsum()
    here = np.zeros((2, ends_a[-1] + 1), bool)
    here[0, ends_a], here[1, ends_b] = True, True
    cut_a, cut_b = here[1, ends_a], here[0, ends_b]
    # a token's place in the text form: behind the tokens of its own side and those of the other side in groups before
    done_a, done_b = np.flatnonzero(cut_a) + 1, np.flatnonzero(cut_b) + 1
    group_a, group_b = cut_a.cumsum() - cut_a, cut_b.cumsum() - cut_b
    written = np.empty(len(a) + len(b), object)
    written[np.arange(len(a)) + np.concatenate([[0], done_b])[group_a]] = np.where(cut_a, left.final[a], left.inner[a])
    written[np.arange(len(b)) + done_a[group_b]] = np.where(cut_b, right.final[b], right.inner[b])
    return a[cut_a], b[cut_b], "".join(written.tolist())[:-1]


def align_texts(texts: DataFrame, ranks: str, pattern: str, pieces: str) -> DataFrame:
    """``key, copies, n_a, n_b, n_groups, groups_sha256, a, b, links`` of distinct texts: the linked pairs of ids and how often the text has each."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = sides(ranks, pattern, pieces)
        for batch in slices(batches, 64):
            texts = batch.column("text").to_pylist()
            out: list[list] = [[] for _ in range(7)]
            for text, a, b in zip(texts, left.encode(texts), right.encode(texts), strict=True):
                whole = (" " + text).encode()
                row = 0, 0, 0, "", [], [], []
                if b"".join(map(left.tokens.__getitem__, a)) == whole and b"".join(map(right.tokens.__getitem__, b)) == whole:
                    ends_a, ends_b, written = groups_of(np.array(a, np.int64), np.array(b, np.int64), left, right)
                    pairs, links = np.unique(ends_a << 32 | ends_b, return_counts=True)
                    row = len(a), len(b), len(ends_a), hashlib.sha256(written.encode()).hexdigest(), pairs >> 32, pairs & 0xFFFFFFFF, links
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            lengths = np.cumsum([0, *map(len, out[4])]).astype(np.int32)
            many = [pa.ListArray.from_arrays(lengths, np.fromiter(chain.from_iterable(c), kind, lengths[-1])) for c, kind in zip(out[4:], (np.int32, np.int32, np.int64), strict=True)]
            columns = [*(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string()), *many]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("copies"), *columns], ["key", "copies", "n_a", "n_b", "n_groups", "groups_sha256", "a", "b", "links"])

    return texts.select("key", "copies", "text").mapInArrow(
        work, "key binary, copies long, n_a long, n_b long, n_groups long, groups_sha256 string, a array<int>, b array<int>, links array<long>"
    )


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``a, b, count, texts, best``: links of each pair in the corpus, texts that have it, and whether no other pair of ``b`` has more."""
    pairs = aligned.select("copies", F.explode(F.arrays_zip("a", "b", "links")).alias("p")).select("p.*", "copies")
    counts = pairs.groupBy("a", "b").agg(F.sum(F.col("links") * F.col("copies")).alias("count"), F.count("*").alias("texts"))
    # the pairs of one id are as many as the other vocabulary has ids, whatever the corpus
    return counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("b")))


def align(docs: DataFrame, ranks: str, pattern: str, pieces: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of each document."""
    key = F.unhex(F.sha2(F.col("text").cast("binary"), 256))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    texts = rows.filter(F.length("text") > 0).groupBy("text").agg(F.count("*").alias("copies")).withColumn("key", key)
    aligned = cut_lineage(align_texts(texts, ranks, pattern, pieces).withColumn("uid", F.monotonically_increasing_id()))
    counts = cut_lineage(pair_counts(aligned))
    of_text = aligned.select("uid", F.explode(F.arrays_zip("a", "b", "links")).alias("p")).select("uid", "p.*")
    met = weighted_join(of_text, counts, ["a", "b"], "texts")
    measured = met.groupBy("uid").agg(
        F.sum("links").alias("n_links"),
        F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"),
        F.sum(F.col("links") * F.col("count")).alias("count_sum"),
    )
    plain = aligned.select("uid", "key", "copies", "n_a", "n_b", "n_groups", "groups_sha256")
    of_key = cut_lineage(plain.join(measured, "uid", "left").drop("uid"))
    found = weighted_join(rows.select("doc_id", key.alias("key")), of_key, ["key"], "copies", "left")
    numbers = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    return found.select("doc_id", *numbers, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))


def op12_alignment(spark, folder: str) -> DataFrame:
    return align(table(spark, folder, "documents"), *vocabulary(), model())
