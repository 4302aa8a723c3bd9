"""Streams over events, drained to the end in two runs of one checkpoint, so that state is carried over."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.operators.keyed import shared_folder
from attestry.plans.inputs import Inputs
from attestry.plans.registry import query
from attestry.streaming import streams


def _instant(ts: Column) -> Column:
    """A time without zone, read as UTC whatever the session's zone."""
    return F.from_utc_timestamp(ts.cast("timestamp"), F.current_timezone())


def _drained(i: Inputs, runs: list[DataFrame], make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What the stream gives when ``runs`` come one after the other, each in a job of its own that goes on from the checkpoint."""
    at = f"{shared_folder(i.spark)}/attestry-streams/{uuid.uuid4().hex}"
    for rows in runs:
        rows.write.mode("append").parquet(f"{at}/in")
        out = make(i.spark.readStream.schema(rows.schema).parquet(f"{at}/in"))
        job = out.writeStream.format("parquet").option("checkpointLocation", f"{at}/checkpoint").option("path", f"{at}/out").outputMode("append").trigger(availableNow=True).start()
        job.awaitTermination()
    return i.spark.read.schema(out.schema).parquet(f"{at}/out")


@query(
    """SELECT node_path, strftime(make_timestamp((max(ms - k) OVER (PARTITION BY node_path ORDER BY k) + k) * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS ts, concat(body, chr(10)) AS body
       FROM (SELECT node_path, body, ms, row_number() OVER (PARTITION BY node_path ORDER BY ms, body) AS k FROM (
               SELECT concat('u', user_id % 40) AS node_path, concat(event_type, ' ', event_id) AS body, event_id % 11 = 0 AS faulty,
                      epoch_ms(CAST(date_trunc('hour', ts) AS TIMESTAMP)) AS ms, max(epoch_ms(CAST(date_trunc('hour', ts) AS TIMESTAMP))) OVER () AS newest FROM events)
             WHERE NOT faulty AND ms < newest - 21600000)"""
)
def journal_stream(i: Inputs) -> DataFrame:
    """Events as journal entries of whole hours, so that many share a time; a third of the last hours of the first run comes with the second."""
    faulty = F.col("event_id") % 11 == 0
    rows = i.base("events").select(
        "event_id", F.lit("g0").alias("graph_id"), F.concat(F.lit("u"), F.col("user_id") % 40).alias("node_path"), _instant(F.date_trunc("hour", "ts")).alias("arrived"),
        F.when(faulty, F.concat(F.lit("## "), "event_type")).otherwise(F.concat_ws(" ", "event_type", "event_id")).alias("body"),
    )
    half = rows.agg(F.timestamp_seconds(F.avg(F.unix_seconds("arrived"))).alias("half"))
    cut = rows.join(F.broadcast(half))
    later = (F.col("arrived") > F.col("half")) | ((F.col("arrived") > F.col("half") - F.expr("interval 2 hours")) & (F.col("event_id") % 3 == 0))
    runs = [cut.filter(~later), cut.filter(later)]
    entries = [r.select("graph_id", "node_path", "arrived", "body") for r in runs]
    return _drained(i, entries, lambda s: streams.journal_stream(s, "6 hours")).select("node_path", "ts", "body")


@query(
    """SELECT path, hash, was, ms FROM (SELECT path, hash, ms, coalesce(lag(hash) OVER (PARTITION BY path ORDER BY ms, hash), CASE WHEN path < 'f5' THEN 'click' END) AS was
         FROM (SELECT DISTINCT concat('f', user_id % 90) AS path, event_type AS hash, epoch_us(CAST(ts AS TIMESTAMP)) // 1000 AS ms FROM events)) WHERE hash IS DISTINCT FROM was"""
)
def digest_changes(i: Inputs) -> DataFrame:
    """Events as changes of files that come and go back; some files have a digest from the start."""
    rows = i.base("events").select(F.lit("g0").alias("graph_id"), F.concat(F.lit("f"), F.col("user_id") % 90).alias("path"), F.col("event_type").alias("hash"), _instant(F.col("ts")).alias("at"))
    known = rows.filter("path < 'f5'").select("graph_id", "path", F.lit("click").alias("hash")).distinct()
    half = rows.agg(F.timestamp_seconds(F.avg(F.unix_seconds("at"))).alias("half"))
    cut = rows.join(F.broadcast(half))
    runs = [cut.filter("at <= half").drop("half"), cut.filter("at > half").drop("half")]
    return _drained(i, runs, lambda s: streams.digest_changes(s, known)).drop("graph_id")
