"""Predicates as data: over files (path glob, content regex) and over graph shape.

A file predicate given as a dict becomes one Catalyst column. Predicates kept in tables are flattened to rows
of leaves and evaluated with a fixed number of joins, however many predicates there are.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions.paths import extension, glob_regex, glob_to_regex
from attestry.operators.keyed import cut_lineage, salted_join, shuffled_join

# Extensions that are never text.
BINARY_EXTENSIONS = [
    ".gif", ".png", ".jpg", ".jpeg", ".webp", ".bmp", ".ico", ".svgz",
    ".woff", ".woff2", ".ttf", ".otf", ".eot",
    ".zip", ".gz", ".tgz", ".tar", ".bz2", ".7z",
    ".pdf", ".mp4", ".mov", ".webm", ".mp3", ".wav", ".wasm", ".bin",
]

# Language of an extension.
LANGUAGES = {
    ".ts": "typescript",
    ".tsx": "tsx",
    ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".jsx": "javascript",
    ".py": "python",
    ".go": "go",
    ".rs": "rust",
    ".java": "java",
    ".cs": "csharp",
    ".c": "c", ".h": "c",
    ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".hh": "cpp", ".hxx": "cpp",
    ".php": "php",
    ".rb": "ruby",
    ".json": "json",
    ".kt": "kotlin", ".kts": "kotlin",
    ".yaml": "yaml", ".yml": "yaml",
    ".toml": "toml",
}


def guard_content(files: DataFrame, probe_bytes: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """Flags ``is_binary`` (a NUL in the text, or in its first ``probe_bytes``) and ``too_large`` (over ``max_bytes``, if given)."""
    raw = F.encode("content", "UTF-8")
    head = raw if probe_bytes is None else F.substring(raw, 1, probe_bytes)
    return files.withColumn("is_binary", F.coalesce(F.contains(head, F.lit(b"\x00")), F.lit(False))).withColumn(
        "too_large", F.lit(False) if max_bytes is None else F.octet_length("content") > max_bytes
    )


def _leaf_content(pattern: str) -> tuple[Column, Column]:
    plain = ~F.col("is_binary")
    hit = F.when(F.col("content").isNull() | F.col("is_binary") | F.col("too_large"), False).otherwise(F.col("content").rlike(pattern))
    return hit, F.col("content").isNull() | (plain & F.col("too_large"))


def _file_column(pred: dict) -> tuple[Column, Column, Column]:
    """(result, unreadable, satisfied fraction) of a predicate."""
    no, yes = F.lit(False), F.lit(True)
    if "all_of" in pred or "any_of" in pred:
        every = "all_of" in pred
        parts = [_file_column(p) for p in pred["all_of" if every else "any_of"]]
        result, unread = (yes if every else no), no
        for r, u, _ in parts:
            result = (result & r) if every else (result | r)
            unread = unread | u
        if not parts:
            return result, no, F.lit(1.0 if every else 0.0)
        scores = [s for _, _, s in parts]
        if every:
            return result, unread, sum(scores[1:], scores[0]) / F.lit(float(len(parts)))
        return result, unread & ~result, F.greatest(*scores) if len(scores) > 1 else scores[0]
    if "not" in pred:
        r, u, s = _file_column(pred["not"])
        return ~r, u, F.lit(1.0) - s
    if pred.get("path") is not None and pred.get("content") is not None:
        return _file_column({"all_of": [{"path": pred["path"]}, {"content": pred["content"]}]})
    if pred.get("path") is not None:
        hit, unread = F.col("path").rlike(glob_to_regex(pred["path"])), no
    elif pred.get("content") is not None:
        hit, unread = _leaf_content(pred["content"])
    else:
        hit, unread = no, no
    return hit, unread, F.when(hit, 1.0).otherwise(0.0)


def eval_file_predicate(files: DataFrame, predicate: dict, graph_dir: str | None = None) -> DataFrame:
    """Adds ``result``, ``unreadable`` and ``score``. Patterns are Java regex; paths in ``graph_dir`` pass."""
    guarded = files if "is_binary" in files.columns else guard_content(files)
    result, unread, score = _file_column(predicate)
    if graph_dir is not None:
        exempt = F.col("path").startswith(graph_dir.rstrip("/") + "/")
        result, unread, score = result | exempt, unread & ~exempt, F.when(exempt, 1.0).otherwise(score)
    return guarded.withColumns({"result": result, "unreadable": unread, "score": score}).drop("is_binary", "too_large")


def classify_files(files: DataFrame, types: list[tuple[str, dict]], k: int = 3) -> tuple[DataFrame, DataFrame]:
    """Types that match each file, and the ``k`` closest ones that do not; ``types`` in declaration order."""
    guarded = guard_content(files)
    tested = []
    for ord_, (name, predicate) in enumerate(types):
        result, unread, score = _file_column(predicate)
        tested.append(
            F.struct(
                F.lit(name).alias("type"), F.lit(ord_).alias("ord"), result.alias("result"),
                unread.alias("unreadable"), score.alias("score"),
            )
        )
    rows = guarded.select("graph_id", "path", F.array(*tested).alias("_t"))
    matches = rows.select("graph_id", "path", F.explode(F.filter("_t", lambda t: t["result"])).alias("t")).select("graph_id", "path", "t.type", "t.ord")
    # as many entries in a row as there are types: ranked in the row, nothing is moved
    misses = F.transform(F.filter("_t", lambda t: ~t["result"]), lambda t: F.struct((-t["score"]).alias("s"), t["ord"].alias("ord"), t["type"].alias("type"), t["score"].alias("score")))
    closest = rows.select("graph_id", "path", F.posexplode(F.slice(F.array_sort(misses), 1, k)).alias("rank", "c")).select(
        "graph_id", "path", (F.col("rank") + 1).alias("rank"), "c.type", "c.score"
    )
    return matches, closest


def strict_classification(
    files: DataFrame, types: list[tuple[str, dict, bool]], nodes: DataFrame, mappings: DataFrame
) -> DataFrame:
    """Issues of strict types: overlap of two on a file, no owner, owner of another type, and mapped files that
    do not match the type of their node. ``types`` holds (type, predicate, strict)."""
    from attestry.operators.ownership import first_owner

    guarded = guard_content(files)
    tested = []
    for name, predicate, strict in types:
        result, unread, _ = _file_column(predicate)
        tested.append(
            F.struct(F.lit(name).alias("type"), F.lit(strict).alias("strict"), result.alias("result"), unread.alias("unreadable"))
        )
    per_file = guarded.select("graph_id", "path", F.array(*tested).alias("tests"))
    strict_hits = F.array_sort(
        F.transform(F.filter("tests", lambda t: t["strict"] & t["result"]), lambda t: t["type"])
    )
    blocked = F.exists("tests", lambda t: t["strict"] & t["unreadable"])
    judged = per_file.withColumn("hits", strict_hits).withColumn("blocked", blocked)
    owned = shuffled_join(judged, first_owner(files, nodes, mappings), ["graph_id", "path"], "left")
    owned = salted_join(owned, nodes.select("graph_id", "node_path", F.col("type").alias("node_type")), ["graph_id", "node_path"], "left")
    own_test = F.filter("tests", lambda t: t["type"] == F.col("node_type"))
    single = ~F.col("blocked") & (F.size("hits") == 1)
    faults = F.array_compact(
        F.array(
            F.when(F.col("blocked"), F.struct(F.lit("file-unreadable").alias("code"), F.lit("").alias("what"))),
            F.when(
                ~F.col("blocked") & (F.size("hits") > 1),
                F.struct(F.lit("strict-overlap-conflict").alias("code"), F.array_join("hits", "|").alias("what")),
            ),
            F.when(
                single & F.col("node_path").isNull(),
                F.struct(F.lit("type-strict-orphan").alias("code"), F.col("hits")[0].alias("what")),
            ),
            F.when(
                single & F.col("node_path").isNotNull() & (F.col("node_type") != F.col("hits")[0]),
                F.struct(F.lit("type-strict-misplaced").alias("code"), F.col("hits")[0].alias("what")),
            ),
            F.when(
                F.col("node_path").isNotNull() & F.exists(own_test, lambda t: ~t["result"] & ~t["unreadable"]),
                F.struct(F.lit("type-when-mismatch").alias("code"), F.col("node_type").alias("what")),
            ),
        )
    )
    return owned.select("graph_id", "path", "node_path", F.explode(faults).alias("f")).select(
        "graph_id", F.lit("error").alias("severity"), "f.code", "node_path", "path", "f.what"
    )


# --- predicates kept in tables -------------------------------------------------------------------------------

LEAF_SCHEMA = (
    "condition string, leaf int, steps array<string>, kind string, part int, parts int, rel_type string, "
    "target string, target_type string, port string, value string"
)


def _parts(clause: dict) -> list[dict]:
    return [
        {"rel_type": rel, "target": m.get("target"), "target_type": m.get("target_type"), "port": m.get("consumes_port")}
        for rel, m in clause.items()
        if m is not None
    ]


def _atoms(pred: dict) -> list[tuple[str, list[dict]]]:
    """Leaves of an atomic clause, all of which must hold."""
    out: list[tuple[str, list[dict]]] = []
    if "path" in pred or "content" in pred:
        for key in ("path", "content"):
            if pred.get(key) is not None:
                out.append((key, [{"value": pred[key]}]))
        return out
    if pred.get("relations"):
        out.append(("relations", _parts(pred["relations"])))
    if pred.get("descendants"):
        d = pred["descendants"]
        out.append(("has_descendant", [{}]))
        if d.get("type") is not None:
            out.append(("descendant_type", [{"value": d["type"]}]))
        if d.get("has_port") is not None:
            out.append(("descendant_port", [{"value": d["has_port"]}]))
        if d.get("relations"):
            out.append(("descendant_relations", _parts(d["relations"])))
    if pred.get("node"):
        n = pred["node"]
        if n.get("type") is not None:
            out.append(("node_type", [{"value": n["type"]}]))
        if n.get("has_port") is not None:
            out.append(("node_port", [{"value": n["has_port"]}]))
        if n.get("has_mapping") is not None:
            out.append(("node_mapping", [{"value": str(bool(n["has_mapping"])).lower()}]))
    return out


def _flatten(text: str) -> list[tuple]:
    rows: list[tuple] = []
    counter = iter(range(1 << 30))

    def leaf(kind: str, steps: list[str], parts: list[dict]) -> None:
        lid = next(counter)
        for i, p in enumerate(parts):
            rows.append(
                (text, lid, steps, kind, i, len(parts), p.get("rel_type"), p.get("target"), p.get("target_type"), p.get("port"), p.get("value"))
            )

    def walk(pred: dict, steps: list[str]) -> None:
        for op in ("all_of", "any_of"):
            if op in pred:
                here = [*steps, f"{op}:{next(counter)}"]
                if not pred[op]:
                    leaf("true" if op == "all_of" else "false", here, [{}])
                for child in pred[op]:
                    walk(child, here)
                return
        if "not" in pred:
            walk(pred["not"], [*steps, f"not:{next(counter)}"])
            return
        atoms = _atoms(pred)
        here = [*steps, f"all_of:{next(counter)}"]
        if not atoms:
            leaf("true", here, [{}])
        for kind, parts in atoms:
            leaf(kind, here, parts)

    walk(json.loads(text), [f"all_of:{next(counter)}"])
    return rows


def flatten_predicates(conditions: DataFrame) -> DataFrame:
    """Leaves of the distinct predicates in column ``condition`` (JSON), one row per part of a leaf."""
    names = [f.split(" ")[0] for f in LEAF_SCHEMA.split(", ")]

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pd.DataFrame([r for text in pdf["condition"] for r in _flatten(text)], columns=names)

    return conditions.select("condition").filter("condition is not null").distinct().mapInPandas(batches, LEAF_SCHEMA)


def combine_leaves(leaves: DataFrame, keys: list[str], max_depth: int) -> DataFrame:
    """Fold leaf results ``(truth, unreadable, steps)`` up the predicate tree, deepest level first."""
    group = [*keys, "condition"]
    cur = leaves.select(*group, "steps", "truth", "unreadable")
    for level in range(max_depth, 0, -1):
        deep = cur.filter(F.size("steps") == level)
        op = F.substring_index(F.element_at("steps", -1), ":", 1)
        up = (
            deep.groupBy(*group, "steps")
            .agg(F.bool_and("truth").alias("_all"), F.bool_or("truth").alias("_any"), F.bool_or("unreadable").alias("_u"))
            .select(
                *group,
                F.slice("steps", 1, level - 1).alias("steps"),
                F.when(op == "all_of", F.col("_all")).when(op == "any_of", F.col("_any")).otherwise(~F.col("_any")).alias("truth"),
                F.when(op == "any_of", F.col("_u") & ~F.col("_any")).otherwise(F.col("_u")).alias("unreadable"),
            )
        )
        cur = cur.filter(F.size("steps") < level).unionByName(up)
    return cur.groupBy(*group).agg(F.bool_and("truth").alias("pass"), F.bool_or("unreadable").alias("unreadable"))


def _depth_of(flat: DataFrame) -> int:
    return flat.agg(F.max(F.size("steps"))).first()[0] or 0


def eval_path_predicates(demand: DataFrame, files: DataFrame) -> DataFrame:
    """Results of file predicates for demanded ``(graph_id, path, condition)`` rows."""
    flat = flatten_predicates(demand)
    deepest = _depth_of(flat)
    if deepest == 0:
        return demand.select("graph_id", "path", "condition").distinct().select(
            "*", F.lit(True).alias("pass"), F.lit(False).alias("unreadable")
        )
    leaves = flat.withColumn("regex", F.when(F.col("kind") == "path", glob_regex(F.col("value"))).otherwise(F.col("value")))
    asked = cut_lineage(salted_join(demand.select("graph_id", "path", "condition").distinct(), leaves, ["condition"]))
    on_path = asked.filter("kind <> 'content'").withColumn(
        "truth", F.when(F.col("kind") == "path", F.expr("path rlike regex")).otherwise(F.col("kind") == "true")
    ).withColumn("unreadable", F.lit(False))
    # content is read once per (file, pattern), not once per rule that asks for it
    patterns = asked.filter("kind = 'content'").select("graph_id", "path", "regex").distinct()
    guarded = guard_content(files.select("graph_id", "path", "content"))
    tested = shuffled_join(patterns, guarded, ["graph_id", "path"], "left").select(
        "graph_id", "path", "regex",
        F.when(F.col("content").isNull() | F.col("is_binary") | F.col("too_large"), False)
        .otherwise(F.expr("content rlike regex")).alias("truth"),
        (F.col("content").isNull() | (~F.col("is_binary") & F.col("too_large"))).alias("unreadable"),
    )
    on_content = shuffled_join(asked.filter("kind = 'content'"), tested, ["graph_id", "path", "regex"])
    both = on_path.unionByName(on_content.select(*on_path.columns))
    return combine_leaves(both, ["graph_id", "path"], deepest)


def eval_node_predicate(
    demand: DataFrame, nodes: DataFrame, relations: DataFrame, ports: DataFrame, mappings: DataFrame
) -> DataFrame:
    """Results of graph predicates for demanded ``(graph_id, node_path, condition)`` rows.

    ``relations`` carries ``consumes`` as an array of port names.
    """
    from attestry.operators.ownership import node_closure

    flat = flatten_predicates(demand)
    deepest = _depth_of(flat)
    node = ["graph_id", "node_path"]
    wanted = demand.select(*node, "condition").filter("condition is not null").distinct()
    if deepest == 0:
        return wanted.select("*", F.lit(True).alias("pass"))
    # a dozen atom kinds read these rows, so they are written once
    asked = cut_lineage(salted_join(wanted, flat, ["condition"]))
    leaf = [*node, "condition", "leaf", "steps"]
    types = nodes.select(*node, "type")
    has_port = ports.select(*node, "port").distinct()
    mapped = mappings.filter(F.trim("entry") != "").select(*node).distinct()
    down = node_closure(nodes)
    rel = shuffled_join(
        relations, types.select("graph_id", F.col("node_path").alias("target"), F.col("type").alias("_tt")), ["graph_id", "target"], "left"
    ).select("graph_id", F.col("source").alias("node_path"), F.col("type").alias("rel_type"), F.col("target").alias("_t"), "_tt", "consumes")

    def met(rows: DataFrame) -> DataFrame:
        """Parts some relation of the row's ``node_path`` meets."""
        ok = (
            (F.col("target").isNull() | (F.col("_t") == F.col("target")))
            & (F.col("target_type").isNull() | (F.col("_tt") == F.col("target_type")))
            & (F.col("port").isNull() | F.array_contains(F.coalesce("consumes", F.array().cast("array<string>")), F.col("port")))
        )
        return shuffled_join(rows, rel, ["graph_id", "node_path", "rel_type"]).filter(F.coalesce(ok, F.lit(False)))

    def full(rows: DataFrame, by: list[str]) -> DataFrame:
        return rows.groupBy(*by).agg(F.countDistinct("part").alias("_got"), F.max("parts").alias("_need")).filter("_got = _need")

    kinds = lambda *ks: asked.filter(F.col("kind").isin(*ks))
    hits = [
        kinds("true").select(*leaf),
        shuffled_join(kinds("node_type"), types.withColumnRenamed("type", "value"), [*node, "value"], "left_semi").select(*leaf),
        shuffled_join(kinds("node_port"), has_port.withColumnRenamed("port", "value"), [*node, "value"], "left_semi").select(*leaf),
        shuffled_join(kinds("node_mapping").filter("value = 'true'"), mapped, node, "left_semi").select(*leaf),
        shuffled_join(kinds("node_mapping").filter("value = 'false'"), mapped, node, "left_anti").select(*leaf),
        full(met(kinds("relations")), leaf).select(*leaf),
    ]
    ancestors = down.select("graph_id", F.col("ancestor").alias("node_path"), "descendant")
    hits.append(shuffled_join(kinds("has_descendant"), ancestors.select(*node).distinct(), node, "left_semi").select(*leaf))
    below_type = shuffled_join(
        ancestors, types.select("graph_id", F.col("node_path").alias("descendant"), F.col("type").alias("value")), ["graph_id", "descendant"]
    ).select(*node, "value").distinct()
    hits.append(shuffled_join(kinds("descendant_type"), below_type, [*node, "value"], "left_semi").select(*leaf))
    below_port = shuffled_join(
        ancestors, has_port.select("graph_id", F.col("node_path").alias("descendant"), F.col("port").alias("value")), ["graph_id", "descendant"]
    ).select(*node, "value").distinct()
    hits.append(shuffled_join(kinds("descendant_port"), below_port, [*node, "value"], "left_semi").select(*leaf))
    # the relation clause is asked of every descendant once, then carried up
    clause = flat.filter("kind = 'descendant_relations'").drop("steps")
    holders = full(
        salted_join(
            rel.filter("rel_type is not null"), clause.select("condition", "leaf", "part", "parts", "rel_type", "target", "target_type", "port"), ["rel_type"]
        ).filter(
            F.coalesce(
                (F.col("target").isNull() | (F.col("_t") == F.col("target")))
                & (F.col("target_type").isNull() | (F.col("_tt") == F.col("target_type")))
                & (F.col("port").isNull() | F.array_contains(F.coalesce("consumes", F.array().cast("array<string>")), F.col("port"))),
                F.lit(False),
            )
        ),
        [*node, "condition", "leaf"],
    )
    carried = shuffled_join(
        ancestors, holders.select("graph_id", F.col("node_path").alias("descendant"), "condition", "leaf"), ["graph_id", "descendant"]
    ).select(*node, "condition", "leaf").distinct()
    hits.append(shuffled_join(kinds("descendant_relations"), carried, [*node, "condition", "leaf"], "left_semi").select(*leaf))

    true_leaves = hits[0]
    for h in hits[1:]:
        true_leaves = true_leaves.unionByName(h)
    every = asked.select(*leaf).distinct()
    judged = shuffled_join(every, true_leaves.distinct().withColumn("truth", F.lit(True)), leaf, "left").withColumn(
        "truth", F.coalesce("truth", F.lit(False))
    )
    return cut_lineage(combine_leaves(judged.withColumn("unreadable", F.lit(False)), node, deepest).drop("unreadable"))


def drop_binary_subjects(pair_files: DataFrame, path: str = "path") -> DataFrame:
    """Judged rules never see binary files."""
    return pair_files.filter(~((F.col("kind") == "judged") & extension(path).isin(*BINARY_EXTENSIONS)))


# Files that never hold waivers.
NOISE_NAMES = [".windsurfrules", ".clinerules", "log.md"]
NOISE_SUFFIXES = [".md", ".mdc", ".markdown", ".txt"]
NOISE_PREFIXES = [".cursor/", ".github/copilot"]


def drop_noise_files(files: DataFrame, graph_dir: str) -> DataFrame:
    """Drop graph, agent-rule, journal and prose files before a waiver scan."""
    name = F.substring_index("path", "/", -1)
    noise = (F.col("path") == graph_dir) | F.col("path").startswith(graph_dir.rstrip("/") + "/") | name.isin(*NOISE_NAMES)
    for prefix in NOISE_PREFIXES:
        noise = noise | F.col("path").startswith(prefix)
    for suffix in NOISE_SUFFIXES:
        noise = noise | F.lower(name).endswith(suffix)
    return files.filter(~noise)


def detect_language(files: DataFrame) -> DataFrame:
    """Language of each file by extension, null if none is known."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return files.withColumn("language", F.try_element_at(table, extension("path")))


def select_tier(rules: DataFrame, tiers: DataFrame) -> DataFrame:
    """Tier of each rule: its own if named, else the default, else the only one; else an error."""
    known = tiers.select("graph_id", F.col("tier").alias("_known"))
    summary = tiers.groupBy("graph_id").agg(
        F.count("*").alias("_n"),
        F.max(F.when(F.col("is_default"), F.col("tier"))).alias("_default"),
        F.min("tier").alias("_only"),
    )
    named = rules.join(known, (rules["graph_id"] == known["graph_id"]) & (rules["tier"] == known["_known"]), "left").drop(known["graph_id"])
    joined = salted_join(named, summary, ["graph_id"], "left")
    chosen = (
        F.when(F.col("tier").isNotNull(), F.col("_known"))
        .when(F.col("_default").isNotNull(), F.col("_default"))
        .when(F.col("_n") == 1, F.col("_only"))
    )
    fault = (
        F.when(F.coalesce("_n", F.lit(0)) == 0, "no-tiers")
        .when(F.col("tier").isNotNull() & F.col("_known").isNull(), "unknown-tier")
        .when(F.col("tier").isNull() & F.col("_default").isNull() & (F.col("_n") > 1), "no-default")
    )
    return joined.withColumn("chosen_tier", chosen).withColumn("tier_error", fault).drop("_known", "_n", "_default", "_only")

