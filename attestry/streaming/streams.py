"""Journals, changes and verdicts as streams."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from attestry.operators.digests import PAIR
from attestry.operators.journals import fence_spans
from attestry.operators.pairs import invalidated_pairs
from attestry.sources.verdict_store import fold_batch

STAMPED = "graph_id string, node_path string, ts string, body string"
STAMPED_COLUMNS = ["graph_id", "node_path", "ts", "body"]
CHANGED = "graph_id string, path string, hash string, was string, ms long"
CHANGED_COLUMNS = ["graph_id", "path", "hash", "was", "ms"]


def screen_entries(entries: DataFrame) -> DataFrame:
    """Adds ``fault``: empty text, or a level-2 header outside a code fence; null if the entry is fine."""
    numbered = F.transform(F.split("body", "\n", -1), lambda t, i: F.struct((i + 1).cast("long").alias("line"), t.alias("text")))
    fences = fence_spans("body")
    header = F.exists(
        numbered,
        lambda n: n["text"].startswith("## ")
        & ~F.exists(fences, lambda f: (n["line"] >= f["first"]) & (f["last"].isNull() | (n["line"] <= f["last"]))),
    )
    return entries.withColumn("fault", F.when(~F.col("body").rlike(r"\S"), "empty").when(header, "level2_header"))


def _text(ms: int) -> str:
    at = datetime.fromtimestamp(0, timezone.utc) + timedelta(milliseconds=ms)
    return at.strftime("%Y-%m-%dT%H:%M:%S.") + f"{at.microsecond // 1000:03d}Z"


def with_rocksdb(spark: SparkSession) -> None:
    """Keyed state with timers and lists lives in the RocksDB store; it is set for the session."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Stamper(StatefulProcessor):
    """Holds entries back until the watermark has passed them, then stamps them in the order of their arrival."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long")
        self.waiting = handle.getListState("waiting", "ms long, body string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            self.waiting.appendList(list(zip(pdf["ms"].tolist(), pdf["body"].tolist())))
            first = min(pdf["ms"].min(), pdf["ms"].min() if first is None else first)
        if first is not None:
            self.handle.registerTimer(int(first))
        yield pd.DataFrame(columns=STAMPED_COLUMNS)

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        held = list(self.waiting.get())
        due, rest = sorted((ms, body) for ms, body in held if ms < passed), [(ms, body) for ms, body in held if ms >= passed]
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(min(ms for ms, _ in rest))
        else:
            self.waiting.clear()
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        for ms, body in due:
            last = ms if last is None else max(ms, last + 1)
            out.append((*key, _text(last), body if body.endswith("\n") else body + "\n"))
        if due:
            self.last.update((last,))
        yield pd.DataFrame(out, columns=STAMPED_COLUMNS)

    def close(self) -> None:
        pass


def journal_stream(entries: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Journal entries ``(graph_id, node_path, arrived, body)`` with strictly rising times; faulty ones drop out.

    Entries of a node are stamped in the order of ``arrived``, ties by text, however they reach the stream: each
    waits until the watermark, ``delay`` behind the newest entry, has passed it. The state of a node is its last
    time and what arrived within ``delay``. Entries older than the watermark when they come are dropped. An entry
    with a null time or text is faulty.
    """
    with_rocksdb(entries.sparkSession)
    good = screen_entries(entries).filter("fault is null and arrived is not null and body is not null").withWatermark("arrived", delay)
    # the time column itself goes along: the engine filters late rows by it
    rows = good.select("graph_id", "node_path", "arrived", F.unix_millis("arrived").alias("ms"), "body")
    return rows.groupBy("graph_id", "node_path").transformWithStateInPandas(_Stamper(), STAMPED, "Append", "EventTime")


def rejected_entries(entries: DataFrame) -> DataFrame:
    """Entries the journal does not take, with the reason."""
    return screen_entries(entries).filter("fault is not null")


class _Digests(StatefulProcessor):
    """Keeps the latest digest of a path and passes on what changes it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", "ms long, hash string")

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: TimerValues) -> None:
        self.latest.update((-(2**62), initialState["hash"].iloc[0]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        at, known = self.latest.get() if self.latest.exists() else (-(2**62), None)
        start, was, out = at, known, []
        for ms, digest in sorted({pair for pdf in rows for pair in zip(pdf["ms"].tolist(), pdf["hash"].tolist())}):
            if ms < start:
                continue
            if digest != known:
                out.append((*key, digest, known, ms))
            at, known = ms, digest
        if (at, known) != (start, was):
            self.latest.update((at, known))
        yield pd.DataFrame(out, columns=CHANGED_COLUMNS)

    def close(self) -> None:
        pass


def digest_changes(changes: DataFrame, known: DataFrame) -> DataFrame:
    """Events ``(graph_id, path, hash, at)`` that change a path's digest: ``(graph_id, path, hash, was, ms)``.

    The latest digest of each path is state, started from ``known`` ``(graph_id, path, hash)``, so a change, its way
    back and the same change again are three events. Repeats drop out, and so do events older than the latest
    one seen in an earlier batch; equal times follow by digest. Events with a null time or digest are passed over.
    """
    with_rocksdb(changes.sparkSession)
    real = changes.filter("at is not null and hash is not null").select("graph_id", "path", "hash", F.unix_millis("at").alias("ms"))
    start = known.groupBy("graph_id", "path").agg(F.max("hash").alias("hash")).filter("hash is not null").groupBy("graph_id", "path")
    return real.groupBy("graph_id", "path").transformWithStateInPandas(_Digests(), CHANGED, "Append", "None", start)


def change_stream(
    changes: DataFrame, pair_files: DataFrame, rules_refs: DataFrame, verdicts: DataFrame, touched: DataFrame, scope: DataFrame,
    known: DataFrame, path: str,
) -> DataStreamWriter:
    """File changes ``(graph_id, path, hash, at)`` to stale pairs, written below ``path`` by batch.

    Only events that change the latest digest count (see ``digest_changes``); a batch written twice after a failure
    replaces itself.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        stale = invalidated_pairs(batch.select("graph_id", "path"), pair_files, rules_refs, verdicts, touched, scope)
        stale.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return digest_changes(changes, known).writeStream.foreachBatch(write)


def verdict_stream(verdicts: DataFrame, path: str, name: str = "verdicts") -> DataStreamWriter:
    """Fold finished verdicts into the store below ``path`` as they come.

    The store's manifest is the commit log: a batch repeated after a failure is passed over, and one cut off does
    not count. Compact the store from time to time, while this runs.
    """
    return verdicts.writeStream.foreachBatch(lambda batch, batch_id: fold_batch(batch, path, name, batch_id) and None)
