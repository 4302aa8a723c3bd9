import json
import random

from attestry.operators import cascade as cas
from attestry.operators import predicates as pred
from attestry.operators import reach

EDGE = "graph_id string, source string, target string, type string"


def test_cycles_agree_with_reachability(spark):
    rnd = random.Random(3)
    edges = {(f"v{rnd.randint(0, 24)}", f"v{rnd.randint(0, 24)}") for _ in range(34)}
    df = spark.createDataFrame([("g", s, t, "uses") for s, t in edges], EDGE)
    reached = {}
    for v in {x for e in edges for x in e}:
        seen, todo = set(), [v]
        while todo:
            for s, t in edges:
                if s == todo[-1] and t not in seen:
                    seen.add(t)
                    todo.insert(0, t)
            todo.pop()
        reached[v] = seen
    want = {v: min(w for w in reached[v] if v in reached[w]) for v in reached if v in reached[v]}
    assert {r.node: r.component for r in reach.structural_cycles(df).collect()} == want


def test_dependents_on_a_cycle_include_the_target(spark):
    df = spark.createDataFrame([("g", "a", "b", "uses"), ("g", "b", "a", "calls"), ("g", "c", "a", "uses"), ("g", "d", "c", "emits")], EDGE)
    aims = spark.createDataFrame([("g", "a")], "graph_id string, node_path string")
    got = {(r.node_path, r.depth) for r in reach.reverse_dependents(df, aims).collect()}
    assert got == {("b", 1), ("c", 1), ("a", 2)}


RULE = "graph_id string, rule_id string, status string, condition string, ord int"
ATT = "graph_id string, node_path string, rule_id string, channel int, origin string, label string, status string, condition string"


def _brute(attached, rules, implies, passes):
    rank = {"draft": 0, "advisory": 1, "enforced": 2}
    default = {r: rank[s or "enforced"] for r, s, _ in rules}
    when = {r: c for r, _, c in rules}
    out = {}
    for node in {a[0] for a in attached}:
        ok = lambda c: c is None or passes[node, c]  # noqa: B023, E731
        state = {}
        for n, r, s, c in attached:
            if n == node and ok(c) and ok(when.get(r)):
                state[r] = max(state.get(r, -1), rank[s] if s else default.get(r, 2))
        changed = True
        while changed:
            changed = False
            for a, b, c, inherit in implies:
                if state.get(a, 0) > 0 and ok(c) and ok(when.get(b)):
                    d = default.get(b, 2)
                    new = d if inherit == "own-default" else max(state[a], d)
                    if new > state.get(b, -1):
                        state[b], changed = new, True
        out |= {(node, r): s for r, s in state.items()}
    return out


def test_cascade_agrees_with_a_plain_fixpoint(spark):
    rnd = random.Random(5)
    names = [f"r{i}" for i in range(12)]
    rules = [(r, rnd.choice(["draft", "advisory", "enforced", None]), rnd.choice([None, None, "A"])) for r in names]
    implies = [(rnd.choice(names), rnd.choice([*names, "ghost"]), rnd.choice([None, None, "B"]), rnd.choice(["strictest", "own-default", None])) for _ in range(16)]
    implies = list({(a, b): (a, b, c, i) for a, b, c, i in implies}.values())
    attached = [(f"n{k}", rnd.choice(names), rnd.choice(["draft", "advisory", None]), rnd.choice([None, None, "B"])) for k in range(8) for _ in range(3)]
    passes = {(f"n{k}", c): rnd.random() < 0.5 for k in range(8) for c in "AB"}
    got = cas.effective_ranks(
        spark.createDataFrame([("g", n, r, 1, f"own:{i}", "", s, c) for i, (n, r, s, c) in enumerate(attached)], ATT),
        spark.createDataFrame([("g", r, s, c, i) for i, (r, s, c) in enumerate(rules)], RULE),
        spark.createDataFrame([("g", *x) for x in implies], "graph_id string, implier string, implied string, condition string, inherit string"),
        spark.createDataFrame([("g", n, c, p) for (n, c), p in passes.items()], "graph_id string, node_path string, condition string, pass boolean"),
    )
    assert {(r.node_path, r.rule_id): r["rank"] for r in got.collect()} == _brute(attached, rules, implies, passes)


def test_file_predicates_in_tables_agree_with_columns(spark):
    files = spark.createDataFrame(
        [("g", "a/x.py", "import os"), ("g", "a/y.txt", "hello 2024"), ("g", "b/z.py", None), ("g", "b/bin", "\0data")],
        "graph_id string, path string, content string",
    )
    trees = [
        {"path": "a/*"}, {"content": "import|\\d{4}"}, {"path": "**/*.py", "content": "os"}, {"not": {"content": "hello"}},
        {"any_of": [{"path": "b/**"}, {"content": "x"}]}, {"any_of": [{"path": "nope"}, {"content": "x"}]}, {"all_of": []}, {"any_of": []}, {"not": {"any_of": []}},
    ]
    for tree in trees:
        col = {r.path: (r.result, r.unreadable) for r in pred.eval_file_predicate(files, tree).collect()}
        demand = files.selectExpr("graph_id", "path", f"'{json.dumps(tree)}' AS condition".replace("\\", "\\\\"))
        table = {r.path: (r["pass"], r.unreadable) for r in pred.eval_path_predicates(demand, files).collect()}
        assert table == col, tree


def test_conditions_are_asked_only_where_a_rule_can_reach_the_hop(spark):
    import random

    from attestry.operators import cascade

    rng = random.Random(5)
    names = [f"r{n}" for n in range(24)]
    hops = {(f"r{n}", f"r{n + 1}"): None for n in range(11)}  # a chain of eleven hops, and a part with cycles
    hops |= {tuple(rng.sample(names[12:], 2)): rng.choice([None, "c1", "c2"]) for _ in range(10)}
    hops["r10", "r11"] = "end"
    when = {"r5": "at five", "r20": "at twenty"}
    rules = spark.createDataFrame([("g", r, when.get(r)) for r in names], "graph_id string, rule_id string, condition string")
    implies = spark.createDataFrame([("g", a, b, c) for (a, b), c in hops.items()], "graph_id string, implier string, implied string, condition string")
    want = set()
    for rule in names:
        seen, todo = set(), [rule]
        while todo:
            at = todo.pop()
            if at not in seen:
                seen.add(at)
                todo += [b for a, b in hops if a == at]
        for (a, b), c in hops.items():
            if a in seen:
                want |= {(rule, x) for x in (c, when.get(b)) if x}
    assert {(r.rule_id, r.condition) for r in cascade.condition_reach(rules, implies).collect()} == want
    attached = spark.createDataFrame([("g", "n1", "r0", None), ("g", "n1", "r0", None), ("g", "n2", "r6", "own"), ("g", "n3", "r23", None)], "graph_id string, node_path string, rule_id string, condition string")
    asked = {(r.node_path, r.condition) for r in cascade.condition_demand(attached, rules, implies).collect()}
    assert {c for n, c in asked if n == "n1"} == {"at five", "end"} and {c for n, c in asked if n == "n2"} == {"own", "end"}
    assert {c for n, c in asked if n == "n3"} == {c for r, c in want if r == "r23"} | ({when["r23"]} if "r23" in when else set())
    assert cascade.condition_demand(attached, rules, implies.limit(0)).count() == 1


def test_groups_of_issues_follow_their_first_member(spark):
    from attestry.operators import checks

    rows = [
        ("g", "warning", "unverified", "n2", "r2", "a"), ("g", "error", "unverified", "n1", "r1", "b"), ("g", "error", "aspect-violation-enforced", "n1", "r1", "u"),
        ("g", "warning", "aspect-violation-advisory", "n1", "r1", "w"), ("g", "warning", "zeta", "n1", None, "z"), ("g", "error", "log-format", None, None, "5"), ("g", "error", "log-format", "n", None, "1"),
    ]
    issues = spark.createDataFrame(rows, "graph_id string, severity string, code string, node_path string, rule_id string, what string")
    got = [(r.label, r.group_rule, r.severity, r.members, r.nodes, r.shared_what, r.divergent, r["rank"]) for r in checks.group_issues(issues).collect()]
    assert got == [
        ("unverified", None, "error", 2, 2, "b", True, 2), ("enforced", "r1", "error", 1, 1, "u", False, 3), ("log-format", None, "error", 2, 2, "5", True, 8),
        ("advisory", "r1", "warning", 1, 1, "w", False, 11), ("zeta", None, "warning", 1, 1, "z", False, 11),
    ]


def test_long_ways_and_cycles_settle_in_few_rounds(spark):
    tail = [(f"a{k}", f"a{k + 1}") for k in range(60)] + [("a60", "r0")]
    ring = [(f"r{k}", f"r{(k + 1) % 50}") for k in range(50)]
    # eight nodes with one way out, closed by a node with two, and a way that ends there
    knot = [("k", "b0"), ("k", "end")] + [(f"b{k}", f"b{k + 1}") for k in range(7)] + [("b7", "k")] + [("x0", "x1"), ("x1", "k")]
    edges = spark.createDataFrame([("g", s, t, "uses") for s, t in tail + ring + knot], EDGE)
    got = {r.node: r.component for r in reach.structural_cycles(edges, max_rounds=24).collect()}
    assert got == {f"r{k}": "r0" for k in range(50)} | {n: "b0" for n in ["k", *(f"b{k}" for k in range(8))]}
