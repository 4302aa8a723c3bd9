"""Digests of nodes, listings and pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions.paths import path_prefixes, parent_path, base_name
from attestry.functions.text import json_object, json_string, sha256_text
from attestry.operators.keyed import salted_join, set_digest, shuffled_join

PAIR = ["graph_id", "rule_id", "unit_key"]
#: Stands for an unreadable file among the lines of a node; no line of a path is empty.
VOID = ""
EMPTY_SET_HASH = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def source_fingerprint(node_files: DataFrame) -> DataFrame:
    """Digest per node over its ``path:hash`` lines; a null hash (unreadable) voids the node."""
    line = F.concat("path", F.lit(":"), F.coalesce("hash", F.lit("")))
    # the void flag rides along as a line of its own kind, so that the input is read once
    rows = node_files.select("graph_id", "node_path", F.when(F.col("hash").isNotNull(), line).alias("_line"))
    whole = set_digest(rows.select("graph_id", "node_path", F.coalesce("_line", F.lit(VOID)).alias("_line")), ["graph_id", "node_path"], F.col("_line"), "_fp", mark=VOID)
    return whole.select("graph_id", "node_path", F.when(~F.col("_marked"), F.col("_fp")).alias("fingerprint"))


def node_set_hash(groups: DataFrame, keys: list[str], member: str, name: str = "hash") -> DataFrame:
    """Order-free digest of the members of each group; a group without members has the digest of nothing."""
    known = groups.select(*keys).distinct()
    filled = set_digest(groups.filter(F.col(member).isNotNull()).select(*keys, member).distinct(), keys, F.col(member), name)
    return known.join(filled, keys, "left").withColumn(name, F.coalesce(name, F.lit(EMPTY_SET_HASH)))


def directory_entries(files: DataFrame) -> DataFrame:
    """Direct children of every directory: ``(graph_id, dir, name, kind)``."""
    own = files.select("graph_id", parent_path("path").alias("dir"), base_name("path").alias("name"), F.lit("file").alias("kind"))
    dirs = files.select("graph_id", F.explode(path_prefixes("path", with_self=False)).alias("d")).distinct()
    sub = dirs.select("graph_id", parent_path("d").alias("dir"), base_name("d").alias("name"), F.lit("dir").alias("kind"))
    return own.distinct().unionByName(sub)


def listing_hash(files: DataFrame) -> DataFrame:
    """Digest of each directory listing: sorted ``name:kind`` lines."""
    rows = directory_entries(files)
    return set_digest(rows, ["graph_id", "dir"], F.concat("name", F.lit(":"), "kind"), "hash")


def subject_json(pair_files: DataFrame, name: str = "files_json") -> DataFrame:
    """Per pair the JSON string of the digest of its subjects, one ``[path, hash]`` line each."""
    item = F.concat(F.lit("["), json_string("path"), F.lit(","), json_string("hash"), F.lit("]"))
    whole = set_digest(pair_files, PAIR, item, "_d")
    return whole.select(*PAIR, F.concat(F.lit('"'), "_d", F.lit('"')).alias(name))


def scope_json(per: Column, files: Column | None = None) -> Column:
    """Canonical scope; ``files`` is the canonical JSON of the scope predicate or null."""
    return json_object(per=json_string(F.coalesce(per, F.lit("node"))), files=files if files is not None else F.lit(None).cast("string"))


def pair_text(
    rule_id: Column, files_json: Column, node: Column, rule_hash: Column, scope: Column, verdict: Column,
    kind: Column, description: Column, references_json: Column, tier: Column, companion_hash: Column, touched_json: Column,
) -> Column:
    """Canonical JSON of a pair.

    Judged pairs carry description, references and tier name, and companion digest and observations only if
    there are any; computed pairs always carry the observation list.
    """
    common = {
        "aspect": json_string(rule_id), "files": files_json, "node": json_string(node),
        "rule": json_string(rule_hash), "scope": scope, "verdict": json_string(verdict),
    }
    none = F.lit(None).cast("string")
    some = F.when(touched_json != "[]", touched_json)
    judged = json_object(
        **common,
        aspectDescription=json_string(F.coalesce(description, F.lit(""))),
        kind=F.lit('"llm"'),
        references=F.coalesce(references_json, F.lit("[]")),
        tier=json_object(name=json_string(tier)),
        companionHash=F.when(companion_hash.isNotNull(), json_string(companion_hash)).otherwise(none),
        touched=some,
    )
    computed = json_object(**common, kind=F.lit('"deterministic"'), touched=F.coalesce(touched_json, F.lit("[]")))
    return F.when(kind == "judged", judged).otherwise(computed)


def references_json(refs: Column) -> Column:
    """``[[path, hash, description], …]`` ordered by path from an array of such structs."""
    item = lambda r: F.concat(
        F.lit("["), json_string(r["path"]), F.lit(","), json_string(r["hash"]), F.lit(","),
        json_string(F.coalesce(r["description"], F.lit(""))), F.lit("]"),
    )
    return F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(refs), item), ","), F.lit("]"))


def touched_json(touched: Column) -> Column:
    """``[[key, hash], …]`` ordered by key."""
    item = lambda t: F.concat(F.lit("["), json_string(t["key"]), F.lit(","), json_string(t["hash"]), F.lit("]"))
    body = F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(touched), item), ","), F.lit("]"))
    return F.coalesce(body, F.lit("[]"))


def pair_input_hash(
    pairs: DataFrame, pair_files: DataFrame, rules: DataFrame, verdicts: DataFrame, touched_now: DataFrame | None = None
) -> DataFrame:
    """Content address of each pair that has a verdict: column ``hash_now``.

    ``rules`` carries ``description``, ``rule_hash``, ``scope_per`` and, where used, ``scope_files`` (canonical
    JSON), ``refs_json``, ``tier``, ``companion_hash``. ``touched_now`` holds re-observed ``(…, key, hash)``.
    """
    optional = ["scope_files", "refs_json", "tier", "companion_hash"]
    have = [c for c in optional if c in rules.columns]
    meta = rules.select("graph_id", "rule_id", "description", "rule_hash", "scope_per", *have)
    for c in optional:
        if c not in have:
            meta = meta.withColumn(c, F.lit(None).cast("string"))
    rows = shuffled_join(pairs.select(*PAIR, "kind", "node_path"), verdicts.select(*PAIR, "verdict"), PAIR)
    rows = shuffled_join(rows, subject_json(pair_files), PAIR)
    if touched_now is not None:
        # observations of a unit are bounded by what one check run looked at
        seen = touched_now.groupBy(*PAIR).agg(F.collect_list(F.struct("key", "hash")).alias("_t"))
        rows = rows.join(seen, PAIR, "left").withColumn("_touched", touched_json(F.col("_t"))).drop("_t")
    else:
        rows = rows.withColumn("_touched", F.lit("[]"))
    rows = salted_join(rows, meta, ["graph_id", "rule_id"])
    text = pair_text(
        F.col("rule_id"), F.col("files_json"), F.col("node_path"), F.col("rule_hash"),
        scope_json(F.col("scope_per"), F.col("scope_files")), F.col("verdict"), F.col("kind"), F.col("description"),
        F.col("refs_json"), F.coalesce("tier", F.lit("standard")), F.col("companion_hash"), F.col("_touched"),
    )
    return rows.select(*PAIR, sha256_text(text).alias("hash_now"))
