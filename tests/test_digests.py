import json

from pyspark.sql import functions as F

from attestry.functions.text import escape_xml, json_string, tail_truncate
from attestry.operators import digests as dig
from attestry.operators import pairs as prs

# Fixed value: digest of the judged pair below.
JUDGED = "fd7fe9e450d66fcdbcf20425d9634bde5325f499e0d5988703986badee73e36d"


def test_judged_pair_digest(spark):
    pair = spark.createDataFrame(
        [("g", "input-validation", "node:billing/cancel", "judged", "billing/cancel")],
        "graph_id string, rule_id string, unit_key string, kind string, node_path string",
    )
    files = [("src/billing/utils.ts", "c" * 64), ("src/billing/cancel.ts", "b" * 64)]
    subjects = spark.createDataFrame([("g", "input-validation", "node:billing/cancel", p, h) for p, h in files], "graph_id string, rule_id string, unit_key string, path string, hash string")
    refs = F.array(F.struct(F.lit("docs/validation-catalogue.md").alias("path"), F.lit("d" * 64).alias("hash"), F.lit("Input validation catalogue").alias("description")))
    rules = spark.createDataFrame(
        [("g", "input-validation", "Every handler must validate its input before processing.", "a" * 64, None, "standard")],
        "graph_id string, rule_id string, description string, rule_hash string, scope_per string, tier string",
    ).withColumn("refs_json", dig.references_json(refs))
    verdict = pair.select("graph_id", "rule_id", "unit_key", F.lit("approved").alias("verdict"))
    assert dig.pair_input_hash(pair, subjects, rules, verdict).first().hash_now == JUDGED


# Fixed value: digest of the listing below.
LISTING = "21a84d3ba22ba63c103456cfa2e8bb9b36ded4f7eebdce02974f9bc702d76b6d"


def test_listing_digest(spark):
    files = spark.createDataFrame([("g", f"d/{n}") for n in ("utils.ts", "cancel.ts", "types/a.ts")], "graph_id string, path string")
    assert {r.dir: r.hash for r in dig.listing_hash(files).collect()}["d"] == LISTING


def test_json_string_agrees_with_json(spark):
    texts = ['a"b\\c', "tab\tnl\n", "\x1f\x0b!", "\\\x1f", "\\u001F", "\\\\\x1e\x1f", "é😀/", "", "\\" * 70 + "\x1f", "\\" * 71 + "u001F\x1e", "\x7f\u2028"]
    got = [r.j for r in spark.createDataFrame([(t,) for t in texts], "t string").select(json_string("t").alias("j")).collect()]
    assert got == [json.dumps(t, ensure_ascii=False) for t in texts]


def test_escape_and_tail(spark):
    row = spark.createDataFrame([('<a b="1">&\x01\t', "x" * 30 + "\n## [t]\nnew\n")], "x string, y string").select(
        escape_xml("x").alias("x"), escape_xml("x", True).alias("xa"), tail_truncate("y", 16).alias("y")
    ).first()
    assert row.x == '&lt;a b="1"&gt;&amp;&#x01;\t' and '&quot;1&quot;' in row.xa and row.y == "## [t]\nnew\n"


def test_states_and_gate_order(spark):
    key = "graph_id string, rule_id string, unit_key string"
    pairs = spark.createDataFrame([("g", r, "file:x", "judged", "enforced") for r in "abcdef"], key + ", kind string, status string")
    stored = spark.createDataFrame([("g", "a", "file:x", "approved", "1"), ("g", "b", "file:x", "refused", "1"), ("g", "c", "file:x", "approved", "0"), ("g", "f", "file:x", "approved", "1")], key + ", verdict string, hash string")
    now = pairs.select("graph_id", "rule_id", "unit_key", F.lit("1").alias("hash_now"))
    budget = spark.createDataFrame([("g", r, "file:x", r in "bd") for r in "abcdef"], key + ", over boolean")
    failed = spark.createDataFrame([("g", "e", "file:x")], key)
    got = {r.rule_id: (r.state, r.oversized) for r in prs.verify_pairs(pairs, stored, now, budget, failed).collect()}
    assert got == {
        "a": ("verified", False), "b": ("refused", True), "c": ("unverified", False), "d": ("too-large", False),
        "e": ("companion-error", False), "f": ("verified", False),
    }
