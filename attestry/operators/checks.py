"""Integrity checks over the graph tables of a whole fleet.

Each gives rows ``(graph_id, severity, code, node_path, rule_id, what)``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions.paths import parent_path, path_prefixes
from attestry.operators.dependencies import allowed_relation_types
from attestry.operators.keyed import salted_join, shuffled_join, top_n
from attestry.operators.predicates import flatten_predicates
from attestry.operators.reach import structural_cycles

ISSUE = ["graph_id", "severity", "code", "node_path", "rule_id", "what"]


def issue(rows: DataFrame, code: str | Column, what: Column | None = None, severity: str | Column = "error") -> DataFrame:
    """Issue rows from any rows; absent node or rule columns become null."""
    null = F.lit(None).cast("string")
    return rows.select(
        "graph_id",
        (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"),
        (F.lit(code) if isinstance(code, str) else code).alias("code"),
        (F.col("node_path") if "node_path" in rows.columns else null).alias("node_path"),
        (F.col("rule_id") if "rule_id" in rows.columns else null).alias("rule_id"),
        (what if what is not None else F.lit("")).alias("what"),
    )


def as_issues(rows: DataFrame, code: str | None = None, severity: str = "error") -> DataFrame:
    """Rows of any check in the shape of issues.

    ``severity``, ``code``, ``node_path`` and ``rule_id`` are kept where a check gives them; all its other columns
    make up ``what``, in their order.
    """
    if "code" not in rows.columns and code is None:
        raise ValueError("rows without a code need one")
    others = [c for c in rows.columns if c not in ISSUE]
    what = [*([F.col("what")] if "what" in rows.columns else []), *[F.col(c).cast("string") for c in others]]
    return issue(
        rows, F.col("code") if "code" in rows.columns else code, F.concat_ws(" ", *what), F.col("severity") if "severity" in rows.columns else severity
    )


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def dangling_relations(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """Relations whose target is no node, with the nearest node by common leading segments."""
    known = nodes.select("graph_id", F.col("node_path").alias("target"))
    lost = shuffled_join(relations.select("graph_id", F.col("source").alias("node_path"), "target", "type"), known, ["graph_id", "target"], "left_anti")
    # the nearest node shares the longest prefix; each prefix keeps one node before the join
    by_prefix = (
        nodes.select("graph_id", "node_path", F.explode(path_prefixes("node_path")).alias("prefix"))
        .groupBy("graph_id", "prefix").agg(F.min("node_path").alias("suggestion"))
    )
    targets = lost.select("graph_id", "target").distinct().withColumn("prefix", F.explode(path_prefixes("target")))
    near = salted_join(targets, by_prefix, ["graph_id", "prefix"]).groupBy("graph_id", "target").agg(
        F.max_by("suggestion", F.length("prefix")).alias("suggestion")
    )
    return salted_join(lost, near, ["graph_id", "target"], "left")


def siblings_of_targets(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """Existing nodes under the parent of each dangling target, in long form."""
    lost = dangling_relations(nodes, relations).select("graph_id", "target").distinct().withColumn("parent", parent_path("target"))
    below = nodes.select("graph_id", parent_path("node_path").alias("parent"), F.col("node_path").alias("sibling"))
    return salted_join(below, lost.select("graph_id", "parent").distinct(), ["graph_id", "parent"]).distinct()


def unpaired_events(relations: DataFrame) -> DataFrame:
    """``emits`` without the reverse ``listens``, and the reverse."""
    ev = relations.select("graph_id", "source", "target", "type", "event_name")
    emits, listens = ev.filter("type = 'emits'"), ev.filter("type = 'listens'")
    back = lambda df: df.select("graph_id", F.col("target").alias("source"), F.col("source").alias("target")).distinct()
    a = shuffled_join(emits, back(listens), ["graph_id", "source", "target"], "left_anti")
    b = shuffled_join(listens, back(emits), ["graph_id", "source", "target"], "left_anti")
    return a.unionByName(b)


def high_fan_out(relations: DataFrame, limit: int = 10) -> DataFrame:
    """Nodes with more direct relations than the limit."""
    n = relations.groupBy("graph_id", F.col("source").alias("node_path")).agg(F.count("*").alias("n"))
    return n.filter(F.col("n") > limit)


def duplicate_keys(rules: DataFrame) -> DataFrame:
    """Rule ids declared more than once, with the number of declarations and the first name."""
    return rules.groupBy("graph_id", "rule_id").agg(F.count("*").alias("n"), F.min("name").alias("first_name")).filter("n > 1")


def dangling_rules(attachments_raw: DataFrame, implies: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules that are named but do not exist: by nodes, types, flows, ports and implications."""
    known = rules.select("graph_id", "rule_id").distinct()
    named = salted_join(attachments_raw, known, ["graph_id", "rule_id"], "left_anti")
    code = F.when(F.col("site_kind") == "port", "port-missing-aspect").otherwise("aspect-undefined")
    sites = named.withColumn("node_path", F.when(F.col("site_kind").isin("node", "port"), F.col("site")))
    heads = shuffled_join(implies.select("graph_id", F.col("implied").alias("rule_id"), "implier"), known, ["graph_id", "rule_id"], "left_anti")
    return issue(sites, code, F.concat_ws(":", "site_kind", "site")).unionByName(issue(heads, "implied-aspect-missing", F.col("implier")))


def condition_references(conditions: DataFrame, types: DataFrame, nodes: DataFrame, ports: DataFrame) -> DataFrame:
    """Types, nodes and ports named in conditions ``(graph_id, condition)`` that do not exist."""
    asked = conditions.select("graph_id", "condition").filter("condition is not null").distinct()
    atoms = salted_join(asked, flatten_predicates(conditions), ["condition"])
    value_types = atoms.filter("kind in ('node_type', 'descendant_type')").select("graph_id", F.col("value").alias("type"))
    named_types = value_types.unionByName(atoms.filter("target_type is not null").select("graph_id", F.col("target_type").alias("type"))).distinct()
    bad_types = shuffled_join(named_types, types.select("graph_id", "type"), ["graph_id", "type"], "left_anti")
    targets = atoms.filter("target is not null").select("graph_id", F.col("target").alias("named")).distinct()
    bad_nodes = shuffled_join(targets, nodes.select("graph_id", F.col("node_path").alias("named")), ["graph_id", "named"], "left_anti")
    p = ports.select("graph_id", F.col("node_path").alias("target"), "port").distinct()
    aimed = atoms.filter("port is not null and target is not null").select("graph_id", "target", "port").distinct()
    aimed = shuffled_join(aimed, nodes.select("graph_id", F.col("node_path").alias("target")), ["graph_id", "target"], "left_semi")
    bad_aimed = shuffled_join(aimed, p, ["graph_id", "target", "port"], "left_anti")
    loose = atoms.filter("port is not null and target is null").select("graph_id", "port").distinct()
    bad_loose = shuffled_join(loose, p.select("graph_id", "port").distinct(), ["graph_id", "port"], "left_anti")
    return union([
        issue(bad_types, "when-unknown-type", F.col("type")),
        issue(bad_nodes, "when-unknown-node", F.col("named")),
        issue(bad_aimed, "when-unknown-port", F.concat_ws(":", "target", "port")),
        issue(bad_loose, "when-unknown-port", F.col("port")),
    ])


def type_model(nodes: DataFrame, types: DataFrame, mappings: DataFrame) -> DataFrame:
    """Unknown node types and parent types, strict types without predicate, mapped nodes of a type without one."""
    t = types.select("graph_id", "type")
    unknown = salted_join(nodes, t, ["graph_id", "type"], "left_anti")
    parents = types.select("graph_id", "type", F.explode("parents").alias("parent"))
    bad_parent = shuffled_join(parents, t.withColumnRenamed("type", "parent"), ["graph_id", "parent"], "left_anti")
    strict = types.filter("strict and predicate is null")
    bare = types.filter("predicate is null").select("graph_id", "type")
    mapped = mappings.filter(F.trim("entry") != "").select("graph_id", "node_path").distinct()
    loose = shuffled_join(salted_join(nodes, bare, ["graph_id", "type"], "left_semi"), mapped, ["graph_id", "node_path"], "left_semi")
    return union([
        issue(unknown, "type-invalid", F.col("type")),
        issue(bad_parent, "type-unknown-parent", F.concat_ws(" < ", "type", "parent")),
        issue(strict, "enforce-strict-without-when", F.col("type")),
        issue(loose, "type-without-when-with-mapping", F.col("type")),
    ])


def type_constraints(nodes: DataFrame, relations: DataFrame, types: DataFrame) -> DataFrame:
    """Relations the type matrix forbids, and parents of a forbidden type."""
    typed = nodes.select("graph_id", "node_path", "type")
    rel = relations.select("graph_id", "source", "target", F.col("type").alias("rel"))
    rel = salted_join(rel, typed.select("graph_id", F.col("node_path").alias("source"), F.col("type").alias("from_type")), ["graph_id", "source"])
    rel = salted_join(rel, typed.select("graph_id", F.col("node_path").alias("target"), F.col("type").alias("to_type")), ["graph_id", "target"])
    # the matrix is asked once per (type, type), not once per relation
    pairs = rel.select("graph_id", "from_type", "to_type").distinct()
    ruled = allowed_relation_types(types, pairs)
    known = types.select("graph_id", F.col("type").alias("from_type"))
    ruled = shuffled_join(ruled, known, ["graph_id", "from_type"], "left_semi")
    bad = salted_join(rel, ruled, ["graph_id", "from_type", "to_type"]).filter(~F.array_contains("allowed", F.col("rel")))
    bad = bad.withColumnRenamed("source", "node_path")
    # the parent is the nearest directory above that is a node
    up = nodes.select("graph_id", "node_path", "type", F.explode(path_prefixes("node_path", with_self=False)).alias("anc"))
    up = salted_join(up, typed.select("graph_id", F.col("node_path").alias("anc"), F.col("type").alias("parent_type")), ["graph_id", "anc"])
    near = up.groupBy("graph_id", "node_path", "type").agg(F.max_by("parent_type", F.length("anc")).alias("parent_type"))
    lim = types.filter("parents is not null").select("graph_id", "type", "parents")
    wrong = salted_join(near, lim, ["graph_id", "type"]).filter(~F.array_contains("parents", F.col("parent_type")))
    return issue(bad, "relation-target-forbidden", F.concat_ws(" ", "rel", "target")).unionByName(
        issue(wrong, "parent-type-forbidden", F.col("parent_type"))
    )


def port_contracts(relations: DataFrame, ports: DataFrame) -> DataFrame:
    """Relations that consume no port of a node with ports, an unknown one, or any where there are none."""
    has = ports.select("graph_id", F.col("node_path").alias("target")).distinct().withColumn("_has", F.lit(True))
    rel = salted_join(relations.select("graph_id", F.col("source").alias("node_path"), "target", "type", "consumes"), has, ["graph_id", "target"], "left")
    none = F.coalesce(F.size("consumes"), F.lit(0)) <= 0
    without = rel.filter(F.col("_has").isNull() & ~none)
    missing = rel.filter(F.col("_has") & none)
    used = rel.filter(F.col("_has") & ~none).withColumn("port", F.explode("consumes"))
    unknown = salted_join(used, ports.select("graph_id", F.col("node_path").alias("target"), "port").distinct(), ["graph_id", "target", "port"], "left_anti")
    text = F.concat_ws(" ", "type", "target")
    return union([
        issue(without, "consumes-without-ports", text),
        issue(missing, "port-missing-consumes", text),
        issue(unknown, "port-undefined", F.concat_ws(" ", "type", "target", "port")),
    ])


def broken_flows(flow_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Flow members that are no nodes."""
    lost = shuffled_join(flow_nodes, nodes.select("graph_id", "node_path"), ["graph_id", "node_path"], "left_anti")
    return issue(lost, "flow-node-broken", F.col("flow"))


def missing_descriptions(nodes: DataFrame, rules: DataFrame, flows: DataFrame) -> DataFrame:
    """Nodes, rules and flows without text."""
    empty = F.coalesce(F.trim("description"), F.lit("")) == ""
    return union([
        issue(nodes.filter(empty), "description-missing", F.lit("node"), "warning"),
        issue(rules.filter(empty), "description-missing", F.lit("rule"), "warning"),
        issue(flows.filter(empty), "description-missing", F.concat(F.lit("flow "), "flow"), "warning"),
    ])


def rule_sources(rules: DataFrame, rule_files: DataFrame, implies: DataFrame) -> DataFrame:
    """Rule kind against its sources; ``rule_files`` has ``source`` in text, check, companion."""
    has = rule_files.groupBy("graph_id", "rule_id").agg(
        *[F.max(F.col("source") == s).alias(s) for s in ("text", "check", "companion")]
    )
    leads = implies.select("graph_id", F.col("implier").alias("rule_id")).distinct().withColumn("_imp", F.lit(True))
    rows = shuffled_join(shuffled_join(rules.select("graph_id", "rule_id", "kind"), has, ["graph_id", "rule_id"], "left"), leads, ["graph_id", "rule_id"], "left")
    t, c, k = [F.coalesce(x, F.lit(False)) for x in ("text", "check", "companion")]
    kind = F.col("kind")
    bundle, judged, computed = kind == "bundle", kind == "judged", kind == "computed"
    both = ~bundle & t & c
    faults = F.array_compact(F.array(
        F.when(bundle & (t | c), "aspect-unexpected-rule-source"),
        F.when(bundle & F.col("_imp").isNull(), "aspect-empty"),
        F.when(both, "aspect-both-rule-sources"),
        F.when(both, "aspect-unexpected-rule-source"),
        F.when(judged & ~t, "aspect-missing-rule-source"),
        F.when(judged & c & ~t, "aspect-unexpected-rule-source"),
        F.when(computed & ~c, "aspect-missing-rule-source"),
        F.when(computed & t & ~c, "aspect-unexpected-rule-source"),
        F.when(~bundle & k & c, "aspect-companion-with-check"),
        F.when(k & ~(~bundle & c) & (bundle | ~t), "aspect-companion-without-content"),
    ))
    return issue(rows.withColumn("_c", F.explode(faults)), F.col("_c"), kind)


def rule_references(rules: DataFrame, files: DataFrame, tiers: DataFrame) -> DataFrame:
    """Reference files that do not exist, empty reference lists, unknown tiers, no tiers at all."""
    judged = rules.filter("kind = 'judged'")
    refs = judged.select("graph_id", "rule_id", F.explode("refs.path").alias("path"))
    broken = shuffled_join(refs, files.select("graph_id", "path"), ["graph_id", "path"], "left_anti")
    hollow = judged.filter(F.col("refs").isNotNull() & (F.size("refs") == 0))
    known = tiers.select("graph_id", "tier").distinct()
    unknown = salted_join(judged.filter("tier is not null").select("graph_id", "rule_id", "tier"), known, ["graph_id", "tier"], "left_anti")
    graphs = rules.select("graph_id").distinct().join(tiers.select("graph_id").distinct(), ["graph_id"], "left_anti")
    return union([
        issue(broken, "aspect-reference-broken", F.col("path")),
        issue(hollow, "aspect-references-empty-array", severity="warning"),
        issue(unknown, "aspect-tier-unknown", F.col("tier")),
        issue(graphs, "config-reviewer-missing"),
    ])


def pair_issues(states: DataFrame) -> DataFrame:
    """Issues from pair states: severity follows status, over budget is always an error."""
    hard = F.when(F.col("status") == "enforced", "error").otherwise("warning")
    s = F.col("state")
    first = (
        F.when(s == "refused", F.struct(hard.alias("severity"), F.when(F.col("status") == "enforced", "aspect-violation-enforced").otherwise("aspect-violation-advisory").alias("code")))
        .when(s == "unverified", F.struct(hard.alias("severity"), F.lit("unverified").alias("code")))
        .when(s == "too-large", F.struct(F.lit("error").alias("severity"), F.lit("prompt-too-large").alias("code")))
        .when(s == "companion-error", F.struct(hard.alias("severity"), F.lit("aspect-companion-runtime-error").alias("code")))
    )
    over = F.when(F.col("oversized"), F.struct(F.lit("error").alias("severity"), F.lit("prompt-too-large").alias("code")))
    rows = states.withColumn("_i", F.explode(F.array_compact(F.array(first, over))))
    return issue(rows, F.col("_i.code"), F.col("unit_key"), F.col("_i.severity"))


def validate(
    nodes: DataFrame, relations: DataFrame, ports: DataFrame, types: DataFrame, mappings: DataFrame, rules: DataFrame,
    implies: DataFrame, attachments_raw: DataFrame, flows: DataFrame, flow_nodes: DataFrame,
) -> DataFrame:
    """Union of the checks; graphs whose type model is broken skip those that rest on it."""
    model = type_model(nodes, types, mappings)
    fatal = model.filter("code in ('type-unknown-parent', 'enforce-strict-without-when')").select("graph_id").distinct()
    lost = dangling_relations(nodes, relations)
    cyclic = structural_cycles(relations.filter("type in ('uses', 'calls', 'extends', 'implements')"))
    loops = structural_cycles(implies.select("graph_id", F.col("implier").alias("source"), F.col("implied").alias("target")))
    rests = type_constraints(nodes, relations, types).join(fatal, ["graph_id"], "left_anti")
    return union([
        model,
        rests.select(*ISSUE),
        issue(lost, "relation-broken", F.col("target")),
        issue(cyclic.withColumnRenamed("node", "node_path"), "structural-cycle", F.col("component")),
        issue(loops.withColumnRenamed("node", "rule_id"), "aspect-implies-cycle", F.col("component")),
        issue(unpaired_events(relations).withColumnRenamed("source", "node_path"), "event-unpaired", F.concat_ws(" ", "type", "target")),
        issue(high_fan_out(relations), "high-fan-out", F.col("n").cast("string"), "warning"),
        issue(duplicate_keys(rules), "duplicate-aspect-id", F.col("n").cast("string")),
        dangling_rules(attachments_raw, implies, rules),
        port_contracts(relations, ports),
        broken_flows(flow_nodes, nodes),
        missing_descriptions(nodes, rules, flows),
    ])


# Urgency of issue codes, most urgent first.
PRIORITY = [
    "lock-invalid", "log-entry-missing", "unverified", "aspect-violation-enforced", "prompt-too-large",
    "aspect-companion-runtime-error", "log-conflict", "log-integrity", "log-format", "mapped-file-gitignored",
]

# Labels of issue codes that are shown by another name.
LABELS = {"aspect-violation-advisory": "advisory", "aspect-violation-enforced": "enforced"}


def priority_rank(code: Column, severity: Column) -> Column:
    table = F.create_map(*[x for i, c in enumerate(PRIORITY) for x in (F.lit(c), F.lit(i))])
    rest = F.when(severity == "error", len(PRIORITY)).otherwise(len(PRIORITY) + 1)
    return F.coalesce(F.try_element_at(table, code), rest)


def top_issues(issues: DataFrame, n: int) -> DataFrame:
    """The ``n`` most urgent issues of each graph."""
    order = [priority_rank(F.col("code"), F.col("severity")), F.col("code"), F.col("rule_id"), F.col("node_path"), F.col("what")]
    return top_n(issues, ["graph_id"], order, n)


def next_action(issues: DataFrame) -> DataFrame:
    """The one thing to do next per graph: the most urgent error, else an advisory violation."""
    rank = priority_rank(F.col("code"), F.col("severity"))
    live = issues.filter("severity = 'error' or code = 'aspect-violation-advisory'")
    best = F.struct(rank.alias("r"), "code", F.coalesce("node_path", F.lit("")).alias("node_path"), F.coalesce("rule_id", F.lit("")).alias("rule_id"))
    return live.groupBy("graph_id").agg(F.min(best).alias("b"), F.count_if(F.col("severity") == "error").alias("errors")).select(
        "graph_id", F.col("b.code").alias("code"), F.col("b.node_path").alias("node_path"), F.col("b.rule_id").alias("rule_id"), "errors"
    )


def group_issues(issues: DataFrame) -> DataFrame:
    """Issue groups by code, and by rule where one is set (never for ``unverified``), most urgent first.

    The member of the smallest node, then the smallest text, stands for its group: severity, rank and shared text are its own.
    """
    key = F.when(F.col("code") == "unverified", F.lit(None).cast("string")).otherwise(F.col("rule_id"))
    node = F.coalesce("node_path", F.lit(""))
    groups = issues.withColumn("group_rule", key).groupBy("graph_id", "code", "group_rule").agg(
        F.min(F.struct(node.alias("node"), "what", "severity")).alias("_first"),
        F.count("*").alias("members"),
        F.countDistinct(node).alias("nodes"),
        (F.min("what") != F.max("what")).alias("divergent"),
    )
    groups = groups.select(
        "graph_id", "code", "group_rule", F.col("_first.severity").alias("severity"), "members", "nodes", F.col("_first.what").alias("shared_what"), "divergent"
    )
    label = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair]), "code"), F.col("code"))
    rank = priority_rank(F.col("code"), F.col("severity"))
    return groups.withColumns({"label": label, "rank": rank}).orderBy("graph_id", "rank", "label", F.coalesce("group_rule", F.lit("")))


def group_members(issues: DataFrame) -> DataFrame:
    """Members of the groups in long form, keyed like group_issues."""
    key = F.when(F.col("code") == "unverified", F.lit(None).cast("string")).otherwise(F.col("rule_id"))
    return issues.select("graph_id", "code", key.alias("group_rule"), "node_path", "what").distinct()


def summary_by_node(issues: DataFrame) -> DataFrame:
    """Errors and warnings per node."""
    return issues.filter("node_path is not null").groupBy("graph_id", "node_path").agg(
        F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings")
    )


def check_report(parts: list[DataFrame | tuple[DataFrame, str]], states: DataFrame, coverage: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The full gate: all issues, and one summary row per graph.

    ``parts`` are the rows of any checks (validation, dependencies, journals, waivers, store, mapped but ignored),
    with the code to give them where they have none of their own; ``coverage`` is coverage_summary.
    """
    shaped = [as_issues(*p) if isinstance(p, tuple) else as_issues(p) for p in parts]
    uncovered = issue(coverage.filter("required > 0"), "unmapped-files", F.col("required").cast("string")).unionByName(
        issue(coverage.filter("middle > 0"), "unmapped-files", F.col("middle").cast("string"), "warning")
    )
    issues = union([*shaped, pair_issues(states), uncovered])
    counts = issues.groupBy("graph_id").agg(
        F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings")
    )
    verified = states.groupBy("graph_id").agg(F.count("*").alias("pairs"), F.count_if(F.col("state") == "verified").alias("verified"))
    act = next_action(issues).select("graph_id", F.col("code").alias("next_code"))
    summary = coverage.join(verified, ["graph_id"], "full_outer").join(counts, ["graph_id"], "full_outer").join(act, ["graph_id"], "left")
    return issues, summary
