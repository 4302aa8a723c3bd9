import hashlib
import random

import pytest
from pyspark.sql import functions as F

from attestry.functions.paths import glob_to_regex, normalize_path, path_prefixes
from attestry.operators import ownership as own
from attestry.operators.keyed import BROADCAST_BYTES, COPIES_BYTES, cut_lineage, entry_matches_file, estimated_bytes, salted_join, set_digest, shuffled_join, small_broadcasts, top_n


def plan_of(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_keeps_meaning(spark, how):
    big = spark.createDataFrame([("g", "hot" if i % 3 else f"k{i}", i) for i in range(300)], "graph_id string, k string, v int")
    small = spark.createDataFrame([("g", "hot", "a"), ("g", "hot", "b"), ("g", "k3", "c")], "graph_id string, k string, w string")
    want = sorted(map(tuple, big.join(small, ["graph_id", "k"], how).collect()), key=str)
    assert sorted(map(tuple, salted_join(big, small, ["graph_id", "k"], how).collect()), key=str) == want


@pytest.fixture(scope="module")
def sides(spark, tmp_path_factory):
    """A data-sized side and one whose files are below the planner's limit for broadcasts, though it has 200,000 rows."""
    at = str(tmp_path_factory.mktemp("sides"))
    keys = spark.range(200_000).select(F.lit("g").alias("graph_id"), F.concat(F.lit("r1/n1/c"), "id").alias("k"), (F.col("id") % 7).alias("w"))
    keys.coalesce(1).write.parquet(f"{at}/small")
    keys.select("graph_id", F.when(F.col("w") < 3, "r1/n1/c5").otherwise(F.col("k")).alias("k"), F.xxhash64("k").alias("v")).coalesce(1).write.parquet(f"{at}/big")
    return spark.read.parquet(f"{at}/big"), spark.read.parquet(f"{at}/small")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_broadcasts_no_copies(spark, sides, how):
    big, small = sides
    assert BROADCAST_BYTES < estimated_bytes(small) < 10 * 1024 * 1024
    joined = salted_join(big, small, ["graph_id", "k"], how)
    assert "Broadcast" not in plan_of(joined)
    assert joined.count() == big.join(small, ["graph_id", "k"], how).count() == (0 if how == "left_anti" else 200_000)
    assert "Broadcast" not in plan_of(shuffled_join(big, small, ["graph_id", "k"], how))


def test_a_side_beyond_the_limit_is_not_copied(spark, sides, monkeypatch):
    from attestry.operators import keyed

    big, small = sides
    assert "_salt" in plan_of(salted_join(big, small, ["graph_id", "k"]))
    monkeypatch.setattr(keyed, "COPIES_BYTES", estimated_bytes(small))
    assert "_salt" not in plan_of(salted_join(big, small, ["graph_id", "k"]))
    assert estimated_bytes(small) < COPIES_BYTES


def test_code_edges_broadcast_no_owners(spark, sides):
    from attestry.operators.dependencies import code_edges

    big, small = sides
    resolved = big.select("graph_id", F.col("k").alias("file"), F.col("v").alias("line"), F.col("k").alias("target"))
    owners = small.select("graph_id", F.col("k").alias("path"), F.col("k").alias("node_path"))
    edges = code_edges(resolved, owners)
    assert "Broadcast" not in plan_of(edges) and edges.count() == 200_000


def test_states_are_written_without_large_broadcasts(spark, sides):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    with small_broadcasts(spark):
        assert "BroadcastHashJoin" not in plan_of(sides[0].join(sides[1], ["graph_id", "k"]))
    assert spark.conf.get(name) == before
    cut_lineage(spark.range(3))
    try:
        for limit in ("-1", "1k", "100MB"):
            spark.conf.set(name, limit)
            with small_broadcasts(spark):
                assert spark.conf.get(name) == (limit if limit != "100MB" else str(BROADCAST_BYTES))
            assert spark.conf.get(name) == limit
    finally:
        spark.conf.set(name, before)


def test_checks_broadcast_no_rules(spark, sides):
    from attestry.operators import cascade, checks, waivers

    big, small = sides
    rules = small.select("graph_id", F.col("k").alias("rule_id"), F.lit("draft").alias("status"))
    sites = big.select("graph_id", F.lit("node").alias("site_kind"), F.col("k").alias("site"), F.col("k").alias("rule_id"))
    implies = small.select("graph_id", F.col("k").alias("implier"), F.col("k").alias("implied"))
    markers = big.select("graph_id", F.lit("f").alias("file"), F.col("v").alias("line"), F.col("k").alias("rule_id"), F.lit("disable").alias("kind"), F.lit(False).alias("wildcard"), F.lit("").alias("reason"))
    lost, orphans, risks = checks.dangling_rules(sites, implies, rules), cascade.orphan_rules(rules, sites, implies), waivers.waiver_risk(markers, rules)
    for frame in (lost, orphans, risks):
        assert "BroadcastHashJoin" not in plan_of(frame)
    assert lost.count() == 0
    # big names k5 and all keys with w >= 3; an implication of a rule to itself reaches no other
    named = {r.k for r in big.select("k").distinct().collect()}
    assert orphans.count() == 200_000 - len(named) and risks.filter("risk = 'inert'").count() == 200_000


def test_partitions_of_written_tables_follow_what_is_read(spark, sides, monkeypatch):
    from attestry.operators import keyed

    big, _ = sides
    first, size = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(first, None), spark.conf.get(size)
    monkeypatch.setattr(keyed, "PARTITION_BYTES", keyed.read_bytes(big) // 9)
    rows = big.groupBy("k").count()
    with keyed.sized_shuffles(rows):
        assert spark.conf.get(first) == "9" and spark.conf.get(size) == str(keyed.SHUFFLED_BYTES)
        assert "hashpartitioning(k" in plan_of(big.groupBy("k").count()) and ", 9)" in plan_of(big.groupBy("k").count())
    assert (spark.conf.get(first, None), spark.conf.get(size)) == before
    assert keyed.dealt_by(big, ["k"]).rdd.getNumPartitions() == 9


@pytest.mark.parametrize("repeats", [1, 3, 4096])
def test_determinism_check_counts_repeats(spark, monkeypatch, repeats):
    from attestry.operators import reports

    shape = "rule_id string, line int"
    a = spark.createDataFrame([("a", 1)] * 7 + [("b", None)] * 2 + [(None, 3)] + [("same", 1)] * 3, shape)
    b = spark.createDataFrame([("a", 1)] * 2 + [("b", None)] * 6 + [("same", 1)] * 3 + [("c", 4)], shape)
    monkeypatch.setattr(reports, "REPEATS", repeats)
    got = sorted(map(tuple, reports.determinism_check(a, b).select("rule_id", "line", "run").collect()), key=str)
    assert got == sorted([("a", 1, 1)] * 5 + [(None, 3, 1)] + [("b", None, 2)] * 4 + [("c", 4, 2)], key=str)


def test_determinism_check_deals_rows_by_what_is_read(spark, sides, monkeypatch):
    from attestry.operators import keyed, reports

    big, small = sides
    monkeypatch.setattr(keyed, "PARTITION_BYTES", keyed.read_bytes(big) // 9)
    assert "REPARTITION_BY_NUM" in plan_of(reports.determinism_check(big.select("k"), small.select("k")))


@pytest.mark.parametrize(
    ("glob", "path", "hit"),
    [
        ("src/*.py", "src/a.py", True), ("src/*.py", "src/x/a.py", False), ("src/**", "src/x/a.py", True), ("src/**", "src", False),
        ("**/a.py", "a.py", True), ("**/a.py", "x/y/a.py", True), ("a/**/b", "a/b", True), ("a/**/b", "a/x/y/b", True),
        ("*.{ts,js}", "a.js", True), ("*.{ts,js}", "a.py", False), ("[ab]*.c", "b1.c", True), ("[!a]*.c", "a1.c", False),
        ("a?c*", "abc", True), ("*", ".hidden", True), ("a+(b)*.c", "a+(b)x.c", True),
    ],
)
def test_glob(glob, path, hit):
    import re

    assert bool(re.search(glob_to_regex(glob), path)) is hit


def test_paths(spark):
    row = spark.range(1).select(normalize_path(F.lit(" ./a\\b// ")).alias("n"), path_prefixes(F.lit("a/b/c")).alias("p")).first()
    assert row.n == "a/b" and row.p == ["a", "a/b", "a/b/c"]


def block_digest(lines):
    """The definition of a set digest, written out."""
    blocks = {}
    for line in sorted(lines):
        blocks.setdefault(hashlib.sha256(line.encode()).hexdigest()[:3], []).append(line)
    parts = sorted(f"{b}:{hashlib.sha256(chr(10).join(ls).encode()).hexdigest()}" for b, ls in blocks.items())
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()


def test_set_digest_has_one_definition_at_every_size(spark):
    for n in (1, 50, 99_999, 150_000):
        rows = spark.range(n).select(F.lit("g").alias("graph_id"), F.concat(F.lit("l"), "id").alias("l"))
        want = block_digest([f"l{i}" for i in range(n)])
        assert set_digest(rows, ["graph_id"], F.col("l"), "d").first()["d"] == want
        assert set_digest(rows.repartition(5), ["graph_id"], F.col("l"), "d", mark="l3").first().asDict() == {"graph_id": "g", "d": want, "_marked": n > 3}


def test_top_n_over_a_hot_group(spark):
    rows = spark.createDataFrame([("g", "hot", i) for i in range(200)] + [("g", "cold", 1)], "graph_id string, k string, v int")
    got = sorted((r.k, r.v, r["rank"]) for r in top_n(rows, ["graph_id", "k"], [F.col("v").desc()], 3).collect())
    assert got == [("cold", 1, 1), ("hot", 197, 3), ("hot", 198, 2), ("hot", 199, 1)]


def test_prefix_joins_use_no_nested_loop(spark):
    files = spark.createDataFrame([("g", "a/b.py")], "graph_id string, path string")
    maps = spark.createDataFrame([("g", "n", "a", 0), ("g", "m", "*/b.*", 0)], "graph_id string, node_path string, entry string, ord int")
    nodes = spark.createDataFrame([("g", "n", 0), ("g", "m", 1)], "graph_id string, node_path string, ord int")
    for df in (entry_matches_file(files, maps), own.resolve_owner(files, maps), own.expand_mapping(nodes, maps, files), own.mapping_overlap(nodes, maps, files)):
        text = plan_of(df)
        assert "NestedLoop" not in text and "Cartesian" not in text
    assert own.resolve_owner(files, maps).first().node_path == "m"


def test_child_carves_out_of_its_parent_only_below_the_parents_entries(spark):
    files = spark.createDataFrame([("g", p) for p in ("src/a.py", "src/x/b.py", "lib/c.py")], "graph_id string, path string")
    nodes = spark.createDataFrame([("g", "n"), ("g", "n/k")], "graph_id string, node_path string")
    maps = spark.createDataFrame([("g", "n", "src"), ("g", "n", "l*/*.py"), ("g", "n/k", "src/x"), ("g", "n/k", "lib/c.py")], "graph_id string, node_path string, entry string")
    got = {(r.node_path, r.path) for r in own.expand_mapping(nodes, maps, files).collect()}
    assert got == {("n", "src/a.py"), ("n", "lib/c.py"), ("n/k", "src/x/b.py"), ("n/k", "lib/c.py")}


def test_weighted_join_splits_keys_by_weight(spark):
    from attestry.operators.keyed import cut_lineage, weighted_join

    big = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(3000)] + [(None, -1), ("none", -2)], "k string, v int")
    small = cut_lineage(big.filter("k <> 'none'").groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("top")))
    want = sorted(map(tuple, big.join(small.drop("n"), "k", "left").collect()), key=str)
    joined = weighted_join(big, small, ["k"], "n", "left", parts=16)
    assert joined.columns == ["k", "v", "top"]
    assert sorted(map(tuple, joined.collect()), key=str) == want
    assert weighted_join(big.limit(0), small.limit(0), ["k"], "n").collect() == []


def test_states_are_given_back(spark):
    from pathlib import Path

    from attestry.operators.keyed import cut_lineage, give_back, shared_folder, states

    root = Path(shared_folder(spark).removeprefix("file:")) / "attestry-state"
    with states() as mine:
        first = cut_lineage(spark.range(5))
        second = cut_lineage(first.withColumn("two", F.col("id") * 2), done=(first, spark.range(1)))
    assert len(mine) == 2 and [(root / m.rsplit("/", 1)[-1]).exists() for m in mine] == [False, True]
    assert second.count() == 5
    give_back(spark, mine)
    assert not any((root / m.rsplit("/", 1)[-1]).exists() for m in mine)
    cut_lineage(spark.range(2))
    assert len(mine) == 2
