"""A training corpus from raw documents: language, lines, near copies, source weights, packed sequences.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before kept. Stages but the last give
the columns of ``documents``: language ID drops documents without a language or between two; line dedup takes
lines out and drops a document only if nothing is left of one that had lines; near dedup keeps one document of
each group; mixing gives a document as often as its source's weight says, not at all if that is zero times. Packing
turns what is left into pieces of sequences.

A stage starts when the stage before has been written, so it first gives back the states of that one; ``run`` gives
back the output of a stage as well once the next one is written. Documents of any length and ties are left to the
operators: whole texts count, and of equal documents the smallest id stays.

Models and statistics of a stage are those of its own input. Empty tables give empty results, null texts have no
language, and columns besides those of ``documents`` are not passed on.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm import lines, mixing, near_text, packing
from attestry.llm.common import table, with_row_id
from attestry.llm.language import UNKNOWN, LanguageModel
from attestry.operators.keyed import give_back, shared_folder, states

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Folders of the states of the stage that ran last.
_OPEN: list[str] = []


def _stage(work: Stage) -> Stage:
    """``work``, which first gives back what the stage before left, unless ``docs`` is still a plan over it."""

    @wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = {f.rsplit("/", 1)[0].rsplit("/", 1)[-1] for f in docs.inputFiles()}
        over = [folder for folder in _OPEN if folder.rsplit("/", 1)[-1] not in read]
        if len(over) == len(_OPEN):
            give_back(spark, over)
            _OPEN.clear()
        with states() as mine:
            result = work(spark, docs, sf_dir)
        _OPEN.extend(mine)
        return result

    return run_stage


def _documents(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


@_stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has one language; ``lang`` becomes what the text says."""
    docs = docs.select(*COLUMNS)
    labelled = LanguageModel.fit(docs).label(docs)
    kept = labelled.filter((F.col("lang_pred") != UNKNOWN) & ~F.col("ambiguous"))
    return _documents(kept.withColumn("lang", F.col("lang_pred")))


@_stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand earlier; one that is left with nothing of its lines goes."""
    left = lines.dedup_lines(docs.select(*COLUMNS))
    return _documents(left.filter((F.col("lines_dropped") == 0) | F.col("text").rlike(r"\S")))


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is alike in 0.8 of its five-word shingles: the one with the smallest id.

    Rows are told apart by a hash of id and text; rows that repeat both are one document.
    """
    rows = docs.select(*COLUMNS).withColumn("_key", F.xxhash64("doc_id", "text"))
    found = near_text.near_duplicates(rows, doc_id="_key").select(F.col("doc_id").alias("_key"), F.col("component_id").alias("_group")).distinct()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", "_key")).alias("_first")
    kept = found.join(rows.select("_key", "doc_id"), "_key").groupBy("_group").agg(first).select(F.col("_first._key").alias("_key"))
    return _documents(rows.join(kept, "_key", "left_semi").dropDuplicates(["_key"]))


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    rows = with_row_id(docs.select(*COLUMNS))
    copies = mixing.mix(rows, doc_id="_uid").select(F.col("doc_id").alias("_uid"), "copies", "size")
    taken = rows.join(copies.filter((F.col("copies") > 0) & (F.col("size") > 0)), "_uid")
    return _documents(taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))))


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens."""
    return packing.pack(docs.select(*COLUMNS), *packing.vocabulary(), exact=packing.exact_vocabulary(), digests=True)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", near_dedup),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: No SQL has the language model, the sketches, the rounding or the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder, before = f"{shared_folder(spark)}/corpus-pipeline/{uuid.uuid4().hex}", None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if before:
            give_back(spark, [before])
        before = f"{folder}/{name}"
        docs = spark.read.parquet(before)
    result = STAGES[-1][1](spark, docs, sf_dir)
    _OPEN.clear()  # the result still reads the states of its stage; they are the caller's
    return result
