from pyspark.sql import functions as F

from attestry.operators import dependencies as dep

TREE = {
    "py/app/main.py": "import lib.util\nfrom .near import x\n'''\nimport lib.other\n'''\n", "py/lib/util.py": "", "py/lib/other.py": "", "py/app/near/__init__.py": "",
    "ts/a/use.ts": "import { A } from '../b/t.js';\nimport type { B } from '../c/t';\n// import '../d/t'\nexport * from '../e';\nconst z = require('../d/t');\n",
    "ts/b/t.ts": "", "ts/c/t.ts": "", "ts/d/t.tsx": "", "ts/e/index.ts": "",
    "go/cmd/main.go": 'package main\nimport (\n  "ex.com/m/store"\n  "fmt"\n)\n', "go/store/a.go": "", "go/store/a_test.go": "",
    "j/src/com/a/A.java": "package com.a;\nimport com.b.B;\nimport static com.c.C.make;\nimport com.d.*;\n", "j/src/com/b/B.java": "", "j/src/com/c/C.java": "", "j/src/com/d/D.java": "",
    "k/a.kt": "package k.a\nimport k.b.Thing\n", "k/sub/b.kt": "package k.b\nclass Thing\n",
    "php/src/A/A.php": "<?php\nuse App\\B\\{B, C as D};\nuse function App\\E\\f;\n", "php/src/B/B.php": "", "php/src/B/C.php": "", "php/src/E/f.php": "",
    "rs/src/lib.rs": "mod one;\nuse crate::one::{two, Three};\n", "rs/src/one.rs": "", "rs/src/one/two.rs": "",
    "rb/a.rb": "require_relative 'x/b'\n# require_relative 'x/c'\n", "rb/x/b.rb": "", "rb/x/c.rb": "",
    "c/a.c": '#include "x/b.h"\n#if 0\n#include "x/c.h"\n#endif\n#include <x/c.h>\n', "c/x/b.h": "", "c/x/c.h": "",
}
WANT = {
    ("py/app/main.py", 1, "py/lib/util.py"), ("py/app/main.py", 2, "py/app/near/__init__.py"),
    ("ts/a/use.ts", 1, "ts/b/t.ts"), ("ts/a/use.ts", 4, "ts/e/index.ts"), ("ts/a/use.ts", 5, "ts/d/t.tsx"),
    ("go/cmd/main.go", 3, "go/store/a.go"),
    ("j/src/com/a/A.java", 2, "j/src/com/b/B.java"), ("j/src/com/a/A.java", 3, "j/src/com/c/C.java"), ("j/src/com/a/A.java", 4, "j/src/com/d/D.java"),
    ("k/a.kt", 2, "k/sub/b.kt"),
    ("php/src/A/A.php", 2, "php/src/B/B.php"), ("php/src/A/A.php", 2, "php/src/B/C.php"),
    ("rs/src/lib.rs", 1, "rs/src/one.rs"), ("rs/src/lib.rs", 2, "rs/src/one/two.rs"), ("rs/src/lib.rs", 2, "rs/src/one.rs"),
    ("rb/a.rb", 1, "rb/x/b.rb"), ("c/a.c", 1, "c/x/b.h"),
}


def test_imports_resolve_to_files(spark):
    files = spark.createDataFrame([("g", p, t) for p, t in TREE.items()], "graph_id string, path string, content string")
    manifests = spark.createDataFrame(
        [("g", "go", "go", "ex.com/m", "go"), ("g", "php", "php", "App\\", "php/src"), ("g", "rs", "rust", "rs", "rs/src")],
        "graph_id string, dir string, kind string, name string, value string",
    )
    facts = dep.extract_imports(files)
    uses, owners = dep.uses_of(facts), files.select("graph_id", "path", F.col("path").alias("node_path"))
    symbols = dep.unique_symbols(facts.filter("fact = 'declaration'").withColumnRenamed("spec", "symbol"))
    found = dep.resolve_candidates(uses, symbols, dep.probe_module_paths(uses, files, manifests, owners), owners)
    assert {(r.file, r.line, r.target) for r in found.collect() if r.file != r.target} == WANT


def test_ambiguous_candidates_silence_a_use_and_absent_ones_pass(spark):
    cand = "array<struct<kind:string,spec:string,is_package:boolean>>"
    uses = spark.createDataFrame(
        [("g", "f", 1, "u1", "k", [("symbol", "none", False), ("symbol", "one", False)]), ("g", "f", 2, "u2", "k", [("symbol", "two", False), ("symbol", "one", False)]),
         ("g", "f", 3, "u3", "k", [("symbol", "free", False), ("symbol", "one", False)])],
        f"graph_id string, file string, line long, use_id string, language string, candidates {cand}",
    )
    decl = spark.createDataFrame([("g", "k", "one", "a"), ("g", "k", "two", "a"), ("g", "k", "two", "b"), ("g", "k", "free", "z")], "graph_id string, language string, symbol string, file string")
    owners = spark.createDataFrame([("g", "a", "na"), ("g", "b", "nb"), ("g", "z", None)], "graph_id string, path string, node_path string")
    none = spark.createDataFrame([], "graph_id string, file string, line long, use_id string, pos int, target string")
    got = {(r.use_id, r.target) for r in dep.resolve_candidates(uses, dep.unique_symbols(decl), none, owners).collect()}
    assert got == {("u1", "na"), ("u3", "na")}


def test_project_wide_imports_reach_declared_symbols_only(spark):
    import itertools
    import random

    rng = random.Random(4)
    facts = {("g", lang, p) for lang, p in itertools.product("xy", ["A", "A.B", "C"]) if rng.random() < 0.8}
    symbols = {("g", rng.choice("xy"), f"{rng.choice(['A', 'A.B', 'C', 'D'])}.{rng.choice('pqr')}") for _ in range(30)} | {("g", "x", "plain")}
    uses = [("g", rng.choice("xyz"), k, [(f"own.{rng.choice('pqr')}",)] * rng.randint(0, 2)) for k in range(40)]
    key = "graph_id string, language string, "
    got = dep.global_imports(
        spark.createDataFrame(sorted(facts), key + "spec string"), spark.createDataFrame(uses, key + "use_id int, candidates array<struct<spec:string>>"),
        spark.createDataFrame(sorted(symbols), key + "symbol string"),
    )
    want = set()
    for g, lang, use, own in uses:
        name = own[0][0].rsplit(".", 1)[1] if own else None
        found = sorted(s for h, m, s in symbols if m == lang and s.rsplit(".", 1)[-1] == name and (g, lang, s.rpartition(".")[0]) in facts)
        want |= {(use, s, len(own) + k) for k, s in enumerate(found)}
    assert {(r.use_id, r.symbol, r.pos) for r in got.collect()} == want


def cross_node_uses():
    """Uses, declared relations and nodes with rows that come twice, empty and null paths, and the undeclared uses by loops."""
    import random

    rng = random.Random(7)
    paths = ["a", "a/b", "a/b/c", "a/b/d", "e", "e/f", "e/f/g", "é/h", ""]
    edges = [("g", rng.choice(paths), rng.choice(paths), f"f{rng.randint(0, 3)}", rng.randint(1, 2)) for _ in range(120)] + [("g", None, "a", "f", 1), ("g", "a", None, "f", 1), (None, "a", "e", "f", 1)]
    relations = [("g", rng.choice(paths), rng.choice(paths), rng.choice(["uses", "emits"])) for _ in range(14)] + [("g", None, "a", "uses"), ("g", "a", None, "uses"), (None, "a", "e", "uses")]
    line = lambda a, b: a == b or a.startswith(b + "/") or b.startswith(a + "/")
    declared = {(s, t) for g, s, t, _ in relations if g}
    above = lambda t: ["/".join(t.split("/")[: k + 1]) for k in range(len(t.split("/")))]
    known = {e for e in edges if e[1] is not None and e[2] is not None and not line(e[1], e[2])}
    return edges, relations, {e for e in known if e[0] is None or not any((e[1], t) in declared for t in above(e[2]))}


def test_undeclared_uses_equal_loops(spark):
    edges, relations, want = cross_node_uses()
    uses = spark.createDataFrame(edges, "graph_id string, source string, target string, file string, line int")
    declared = spark.createDataFrame(relations * 2, "graph_id string, source string, target string, type string")
    got = dep.undeclared_dependencies(uses.unionByName(uses), declared)
    # a use without a graph meets nothing at the last join
    assert got.columns == uses.columns and sorted(map(tuple, got.collect())) == sorted(e for e in want if e[0])
    pairs = [r[:3] for r in map(tuple, dep.undeclared_pairs(dep.detected_edges(uses), declared).collect())]
    assert sorted(pairs, key=str) == sorted({e[:3] for e in want}, key=str)


def test_boundary_classes_equal_loops(spark):
    edges, relations, want = cross_node_uses()
    uses = spark.createDataFrame(edges, "graph_id string, source string, target string, file string, line int")
    declared = spark.createDataFrame(relations, "graph_id string, source string, target string, type string")
    kinds = {p: "shut" if p.startswith("e") else "free" for p in ("a", "a/b", "a/b/c", "e", "e/f", "e/f/g")}
    nodes = spark.createDataFrame([("g", p, k) for p, k in kinds.items()] * 2, "graph_id string, node_path string, type string")
    types = spark.createDataFrame([("g", "shut", {}, "deny"), ("g", "free", {}, "allow")], "graph_id string, type string, relations map<string,array<string>>, relation_default string")
    cross = {(r.source, r.target) for r in dep.detected_edges(uses).filter("graph_id = 'g'").collect()}
    near = {(s, t) for g, s, t, k in relations if g and s is not None and t is not None and k == "uses" and not (s == t or s.startswith(t + "/") or t.startswith(s + "/"))}
    loops = {(s, t, "undeclared") for g, s, t, *_ in want} | {(s, t, "declared-only") for s, t in near - cross if t in kinds}
    loops |= {(s, t, "forbidden-type") for s, t in cross if kinds.get(s) == "shut" and t in kinds}
    got = [(r.source, r.target, r["class"]) for r in dep.boundary_report(nodes, declared, uses, types).collect()]
    assert len(loops) > 20 and set(got) == loops and len(got) == len({(e[0], e[1], e[2]) for e in want}) + len(loops) - len({(e[1], e[2]) for e in want})


def test_ancestors_are_asked_only_of_pairs_not_declared_and_sorts_compare_a_hash(spark, monkeypatch):
    from attestry.operators import keyed

    monkeypatch.setattr(keyed, "BROADCAST_BYTES", 0)
    edges, relations, _ = cross_node_uses()
    uses = spark.createDataFrame(edges, "graph_id string, source string, target string, file string, line int")
    declared = spark.createDataFrame(relations, "graph_id string, source string, target string, type string")
    plan = dep.undeclared_dependencies(uses, declared)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Generate explode"):]
    assert "LeftAnti" in below and "LeftAnti" not in plan[: plan.index("Generate explode")]
    joins = [line for line in plan.splitlines() if "Join " in line]
    assert len(joins) == 3 and all(line.split("((", 1)[1].lstrip("(").startswith(("_h#", "_v#")) for line in joins), joins
