import random
import re

from attestry.operators import pairs as prs

PAIR = "graph_id string, rule_id string, unit_key string"


def test_stale_pairs_agree_with_loops_and_are_not_dealt_out_again(spark):
    rng = random.Random(4)
    files = [f"{d}/f{k}" for d in ("a", "a/b", "c") for k in range(5)] + ["top"]
    kinds = {f"r{k}": "judged" if k % 2 else "computed" for k in range(6)}
    nodes = {f"u{k}": rng.choice("xyz") for k in range(8)}
    units = [(r, u) for r in kinds for u in nodes]
    subject = [(r, u, p) for r, u in units for p in rng.sample(files, 2)]
    changed = rng.sample(files, 9) + ["top"]
    refs = {(r, rng.choice(files)) for r in kinds for _ in range(4)}
    keys = sorted({(*rng.choice(units), rng.choice(["read:", "exists:"]) + rng.choice(files)) for _ in range(60)} | {(*rng.choice(units), "list:" + rng.choice(["a", "a/b", "."])) for _ in range(20)} | {(*rng.choice(units), "graph:g")})
    judged = sorted(rng.sample(units, 20))
    entries = [("x", "a"), ("x", "a/b"), ("y", "c"), ("y", "top")]
    rows = lambda data, schema: spark.createDataFrame([("g", *d) for d in data], schema)
    docs = [("graph", "g", "c/f0"), ("graph", "g", changed[0])]
    got = prs.invalidated_pairs(
        rows([(p,) for p in changed], "graph_id string, path string"),
        rows([(r, u, kinds[r], nodes[u], p) for r, u, p in subject], PAIR + ", kind string, node_path string, path string"),
        rows(sorted(refs), "graph_id string, rule_id string, path string"), rows(judged, PAIR), rows(keys, PAIR + ", key string"),
        rows(entries, "graph_id string, node_path string, entry string"), rows(docs, "graph_id string, kind string, target string, path string"),
    )
    want = {(p, r, u, "own") for r, u, p in subject} | {(p, r, u, "reference") for r, u in units if kinds[r] == "judged" for s, p in refs if s == r}
    for r, u, key in keys:
        k, t = key.split(":")
        seen = [p for p in files if (p.rpartition("/")[0] or ".") == t] if k == "list" else [t] if k != "graph" else [p for _, _, p in docs]
        want |= {(p, r, u, "observe-companion" if kinds[r] == "judged" else "observe-computed") for p in seen}
    want = {w for w in want if w[0] in changed}
    taken = {w[:3] for w in want}
    cold = [(r, u) for r, u in units if kinds[r] == "computed" and (r, u) not in judged]
    hit = {(n, p) for n, e in entries for p in changed if p == e or p.startswith(e + "/")}
    want |= {(p, r, u, "potential") for r, u in cold for n, p in hit if nodes[u] == n and (p, r, u) not in taken}
    found = [(r.changed, r.rule_id, r.unit_key, r.reason) for r in got.collect()]
    assert sorted(found) == sorted(want)
    # pairs times changed files are not shuffled: not to drop repeats, nor to take out what is certain
    assert not re.search(r"hashpartitioning\([^)]*changed", got._jdf.queryExecution().executedPlan().toString())
