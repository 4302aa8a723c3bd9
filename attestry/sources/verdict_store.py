"""The verdict store: read, write, export, stamp."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.functions.text import json_object, json_string
from attestry.operators.digests import PAIR, touched_json
from attestry.operators.keyed import give_back, set_digest

VERDICT = (
    "graph_id string, kind string, rule_id string, unit_key string, verdict string, hash string, reason string, "
    "touched array<struct<key:string,hash:string>>"
)
COLUMNS = [c.split(" ")[0] for c in VERDICT.split(", ")]
#: a part has the columns of a verdict but its kind
PART = VERDICT.replace("kind string, ", "")
FACTS = "graph_id string, node_path string, source string, last_ts string, prefix_hash string"
SCOPES = {"all": ("judged", "computed"), "deterministic": ("computed",), "logs": ()}


def _shape() -> Column:
    return F.coalesce(
        F.col("kind").isin("judged", "computed") & F.col("verdict").isin("approved", "refused") & F.col("graph_id").isNotNull()
        & F.col("rule_id").isNotNull() & F.col("unit_key").rlike("^(node|file):.") & F.col("hash").rlike("^[0-9a-f]{64}$"),
        F.lit(False),
    )


def _unhidden(valid: DataFrame) -> DataFrame:
    computed = valid.filter("kind = 'computed'")
    judged = valid.filter("kind = 'judged'").join(computed.select("graph_id", "rule_id").distinct(), ["graph_id", "rule_id"], "left_anti")
    return judged.select(*COLUMNS).unionByName(computed.select(*COLUMNS))


def _invalid(graph: Column, what: Column) -> list[Column]:
    return [graph.alias("graph_id"), F.lit("error").alias("severity"), F.lit("lock-invalid").alias("code"), what.alias("what")]


def parse_verdicts(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Store lines ``(value)`` in JSON as verdicts, and the invalid ones.

    Malformed, incomplete or unknown records never give a partial read. Where a rule is in both partitions, the
    computed one hides its judged rows.
    """
    keys = F.json_object_keys("value")
    rows = lines.select("value", F.from_json("value", VERDICT + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("v"), keys.alias("k"))
    whole = F.col("_bad").isNull() & F.col("k").isNotNull() & (F.size(F.array_except("k", F.array(*[F.lit(c) for c in COLUMNS]))) == 0)
    rows = rows.select("value", "k", "v.*").withColumn("_good", F.coalesce(whole, F.lit(False)) & _shape())
    invalid = rows.filter("NOT _good").select(*_invalid(F.get_json_object("value", "$.graph_id"), F.col("value")))
    return _unhidden(rows.filter("_good")), invalid


# The store below ``path``: ``parts/<name>/<id>`` and ``batches/<id>`` hold rows, ``manifest/<number>.json`` says which of
# them count. A folder counts from the moment its manifest stands; the manifest with the highest number is the store.


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, path: str) -> list[int]:
    fs, at = _fs(spark, f"{path}/manifest")
    names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """A manifest as a dict: ``version``, ``parts`` (name to folder, digest), ``batches`` to fold in, ``streams`` (last batch of each)."""
    known = versions(spark, path)
    if not known:
        return {"version": 0, "parts": {}, "batches": [], "streams": {}}
    fs, at = _fs(spark, f"{path}/manifest/{known[-1] if version is None else version:012d}.json")
    stream = fs.open(at)
    try:
        return json.loads(str(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
    finally:
        stream.close()


def commit(spark: SparkSession, path: str, change: Callable[[dict], dict | None], tries: int = 20) -> int | None:
    """Put the next manifest: ``change`` makes it of the newest one, or gives None where nothing is to do.

    The file is written aside and renamed, so a reader sees a whole one or none. Where another writer was first,
    ``change`` is asked again with what that one left. Returns the new version, or None.
    """
    for _ in range(tries):
        now = manifest(spark, path)
        after = change(json.loads(json.dumps(now)))
        if after is None:
            return None
        after["version"] = now["version"] + 1
        fs, aside = _fs(spark, f"{path}/manifest/_{uuid.uuid4().hex}")
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps(after).encode()))
        out.close()
        final = _fs(spark, f"{path}/manifest/{after['version']:012d}.json")[1]
        if not fs.exists(final) and fs.rename(aside, final):
            return after["version"]
        fs.delete(aside, False)
    raise RuntimeError(f"other writers were first {tries} times at {path}")


def _digest(rows: DataFrame) -> str:
    line = F.to_json(F.struct(*[F.col(c) for c in rows.columns]), {"ignoreNullFields": "false"})
    found = set_digest(rows.select(F.lit(0).alias("_k"), line.alias("_l")), ["_k"], F.col("_l")).first()
    return found.digest if found else ""


def read_verdicts(spark: SparkSession, path: str, version: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Verdicts, node facts and invalid records of the store, newest version unless one is named.

    Rows of batches that are not yet compacted win over those of the parts, later batches over earlier ones.
    """
    m = manifest(spark, path, version)
    stored = spark.createDataFrame([], VERDICT)
    for kind in SCOPES["all"]:
        if kind in m["parts"]:
            part = spark.read.schema(PART).parquet(f"{path}/{m['parts'][kind]['folder']}")
            stored = stored.unionByName(part.withColumn("kind", F.lit(kind)).select(*COLUMNS))
    if m["batches"]:
        rest = [c for c in COLUMNS if c not in PAIR]
        rows = stored.withColumn("_at", F.lit(-1))
        for at, batch in enumerate(m["batches"]):
            rows = rows.unionByName(spark.read.schema(VERDICT).parquet(f"{path}/{batch['folder']}").withColumn("_at", F.lit(at)))
        stored = rows.groupBy(*PAIR).agg(F.max(F.struct("_at", *rest)).alias("v")).select(*PAIR, "v.*").select(*COLUMNS)
    good = stored.withColumn("_good", _shape())
    facts = f"{path}/{m['parts']['facts']['folder']}" if "facts" in m["parts"] else None
    node_facts = spark.createDataFrame([], FACTS) if facts is None else spark.read.schema(FACTS).parquet(facts)
    what = F.to_json(F.struct(*COLUMNS))
    return _unhidden(good.filter("_good")), node_facts, good.filter("NOT _good").select(*_invalid(F.col("graph_id"), what))


def write_verdicts(verdicts: DataFrame, node_facts: DataFrame, path: str, scope: str = "all") -> list[str]:
    """Write the store split by kind, facts apart; returns the parts that changed.

    ``scope`` is all, deterministic (computed verdicts and facts) or logs (facts only). Parts are written to new
    folders and count once the manifest names them, so a job that fails in between leaves the store as it was, and
    rows may come from the store itself. A part with the digest it had stays. Batches that the store held when the
    write began are replaced by it; those that come in meanwhile stay to be folded in. A batch cannot be taken
    apart, so with a narrower scope all of them stay.
    """
    spark = verdicts.sparkSession
    before = manifest(spark, path)
    frames = {kind: verdicts.filter(F.col("kind") == kind).select(*[c for c in COLUMNS if c != "kind"]) for kind in SCOPES[scope]}
    frames["facts"] = node_facts.select(*[c.split(" ")[0] for c in FACTS.split(", ")])
    made: dict[str, dict] = {}
    for name, rows in frames.items():
        folder = f"parts/{name}/{uuid.uuid4().hex}"
        rows.write.parquet(f"{path}/{folder}")
        digest = _digest(spark.read.schema(rows.schema).parquet(f"{path}/{folder}"))
        if before["parts"].get(name, {}).get("digest") == digest:
            give_back(spark, [f"{path}/{folder}"])
        else:
            made[name] = {"folder": folder, "digest": digest}
    gone = {b["folder"] for b in before["batches"]} if scope == "all" else set()

    def change(m: dict) -> dict | None:
        if not made and not gone:
            return None
        m["parts"].update(made)
        m["batches"] = [b for b in m["batches"] if b["folder"] not in gone]
        return m

    commit(spark, path, change)
    return list(made)


def fold_batch(batch: DataFrame, path: str, stream: str, batch_id: int) -> bool:
    """Fold one batch of a stream into the store; False for a batch that is in already.

    Batch ids of a stream only grow, so the last one taken says which are in. A batch cut off before its manifest
    leaves a folder that does not count.
    """
    spark = batch.sparkSession
    done = lambda m: m["streams"].get(stream, -1) >= batch_id
    if done(manifest(spark, path)):
        return False
    folder = f"batches/{uuid.uuid4().hex}"
    batch.select(*COLUMNS).write.parquet(f"{path}/{folder}")

    def change(m: dict) -> dict | None:
        if done(m):
            return None
        m["batches"].append({"folder": folder, "stream": stream, "id": batch_id})
        m["streams"][stream] = batch_id
        return m

    return commit(spark, path, change) is not None


def compact(spark: SparkSession, path: str) -> int | None:
    """Fold the batches into the parts; readers of earlier versions and running streams go on."""
    m = manifest(spark, path)
    if not m["batches"]:
        return None
    verdicts, facts, invalid = read_verdicts(spark, path, m["version"])
    if not invalid.isEmpty():
        raise ValueError("the store has invalid records")
    write_verdicts(verdicts, facts, path)
    return manifest(spark, path)["version"]


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete what only versions before the last ``keep`` name, and what none names; run it while nobody writes."""
    known = versions(spark, path)
    live = set()
    for v in known[-keep:]:
        m = manifest(spark, path, v)
        live |= {p["folder"] for p in m["parts"].values()} | {b["folder"] for b in m["batches"]}
    dead = [f"{path}/manifest/{v:012d}.json" for v in known[:-keep]]
    for top in ["batches", *[f"parts/{n}" for n in (*SCOPES["all"], "facts")]]:
        fs, at = _fs(spark, f"{path}/{top}")
        names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
        dead += [f"{path}/{top}/{n}" for n in names if f"{top}/{n}" not in live]
    give_back(spark, dead)
    return len(dead)


def export_verdict_lines(verdicts: DataFrame) -> DataFrame:
    """One canonical line per verdict, keys in code-point order, rows by rule then unit."""
    touched = F.when(F.col("touched").isNotNull(), touched_json(F.col("touched")))
    body = json_object(
        hash=json_string("hash"), reason=F.when(F.col("reason").isNotNull(), json_string("reason")), touched=touched, verdict=json_string("verdict")
    )
    line = F.concat(json_string("rule_id"), F.lit(" "), json_string("unit_key"), F.lit(": "), body)
    return verdicts.select(*PAIR, line.alias("line")).orderBy(*PAIR)


def store_content_hash(store_files: DataFrame) -> DataFrame:
    """One digest per graph over the committed store files ``(graph_id, name, bytes)``; nothing stored is ``""``.

    It is the digest of the set of ``name:sha256`` lines, so no task holds the files of a graph.
    """
    lines = store_files.filter(F.col("bytes").isNotNull()).select("graph_id", F.concat("name", F.lit(":"), F.sha2("bytes", 256)).alias("_l"))
    known = store_files.select("graph_id").distinct()
    return known.join(set_digest(lines, ["graph_id"], F.col("_l"), "hash"), "graph_id", "left").select("graph_id", F.coalesce("hash", F.lit("")).alias("hash"))
