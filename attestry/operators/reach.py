"""Reachability over relations: dependents, chains, cycles, trapped types.

Loops are breadth-first over DataFrames: the frontier meets the edges, arrivals already known drop out, and
each round is checkpointed in the cluster's shared folder. A graph that is finished leaves the frontier.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.operators.keyed import cut_lineage, salted_join, shuffled_join

# Relation types with a structural meaning, and the event ones.
STRUCTURAL = ["uses", "calls", "extends", "implements"]
EVENTS = ["emits", "listens"]


def _merge(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def reverse_dependents(
    relations: DataFrame, targets: DataFrame, types: list[str] = STRUCTURAL, max_rounds: int = 100_000
) -> DataFrame:
    """Direct and transitive dependents of each target with the length of the shortest path.

    A target on a cycle is its own dependent.
    """
    back = (
        relations.filter(F.col("type").isin(*types))
        .select("graph_id", F.col("target").alias("_at"), F.col("source").alias("node_path"))
        .distinct()
    )
    key = ["graph_id", "target", "node_path"]
    frontier = targets.select("graph_id", F.col("node_path").alias("target")).distinct().withColumn("_at", F.col("target"))
    levels: list[DataFrame] = []
    for level in range(1, max_rounds):
        step = salted_join(frontier, back, ["graph_id", "_at"]).select(*key).distinct()
        if levels:
            step = shuffled_join(step, _merge([x.select(*key) for x in levels]), key, "left_anti")
        fresh = cut_lineage(step.withColumn("depth", F.lit(level)))
        if fresh.isEmpty():
            return _merge(levels) if levels else fresh
        levels.append(fresh)
        if len(levels) > 12:
            levels = [cut_lineage(_merge(levels))]
        frontier = fresh.select("graph_id", "target", F.col("node_path").alias("_at"))
    raise RuntimeError("dependents did not settle")


def _chains(back: DataFrame, seeds: DataFrame, max_rounds: int) -> DataFrame:
    """First arrivals from ``seeds`` (graph_id, target, node_path, path) with one shortest path each."""
    key = ["graph_id", "target", "node_path"]
    frontier = seeds
    levels = [seeds.withColumn("depth", F.lit(0))]
    for level in range(1, max_rounds):
        step = (
            salted_join(frontier.withColumnRenamed("node_path", "_at"), back, ["graph_id", "_at"])
            .withColumn("path", F.concat("path", F.array("node_path")))
            .groupBy(*key)
            .agg(F.min("path").alias("path"))
        )
        step = shuffled_join(step, _merge([x.select(*key) for x in levels]), key, "left_anti")
        fresh = cut_lineage(step.withColumn("depth", F.lit(level)))
        if fresh.isEmpty():
            return _merge(levels).filter("depth > 0")
        levels.append(fresh)
        if len(levels) > 12:
            levels = [cut_lineage(_merge(levels))]
        frontier = fresh.drop("depth")
    raise RuntimeError("chains did not settle")


def dependency_chains(relations: DataFrame, targets: DataFrame, max_rounds: int = 100_000) -> DataFrame:
    """For transitive-only dependents, one shortest path from the target; the smallest path on ties."""
    back = (
        relations.filter(F.col("type").isin(*STRUCTURAL))
        .select("graph_id", F.col("target").alias("_at"), F.col("source").alias("node_path"))
        .distinct()
    )
    seeds = targets.select("graph_id", F.col("node_path").alias("target")).distinct()
    seeds = seeds.select("graph_id", "target", F.col("target").alias("node_path"), F.array("target").alias("path"))
    return _chains(back, seeds, max_rounds).filter("depth > 1").select(
        "graph_id", "target", "node_path", F.array_join("path", " <- ").alias("chain"), "depth"
    )


def indirect_dependents(relations: DataFrame, seeds: DataFrame, max_rounds: int = 100_000) -> DataFrame:
    """Dependents of a set of nodes over structural and event relations, outside the set, with the shortest chain."""
    back = (
        relations.filter(F.col("type").isin(*STRUCTURAL, *EVENTS))
        .select("graph_id", F.col("target").alias("_at"), F.col("source").alias("node_path"))
        .distinct()
    )
    start = seeds.select("graph_id", "node_path").distinct().select(
        "graph_id", F.lit("").alias("target"), "node_path", F.array("node_path").alias("path")
    )
    return _chains(back, start, max_rounds).select(
        "graph_id", "node_path", F.array_join("path", " <- ").alias("chain"), "depth"
    )


def structural_cycles(edges: DataFrame, max_rounds: int = 100_000) -> DataFrame:
    """Members of each cycle of a directed graph: rows ``(graph_id, node, component)``.

    ``edges`` has ``source`` and ``target``. Nodes with one way out are followed by doubled steps, which settles all
    that end in a cycle of such nodes in as many rounds as the logarithm of their number. From the rest, nodes without
    a way in or out are trimmed until none is left; on what remains the smallest label is carried forward, and a
    backward walk inside one label from its root gives one component per label and pass.
    """
    e = edges.select("graph_id", F.col("source").alias("s"), F.col("target").alias("t")).distinct()
    loops = e.filter("s = t").select("graph_id", F.col("s").alias("node"), F.col("s").alias("component"))
    # leaves go first while they are many, so that few nodes are followed
    live = _trim(cut_lineage(e.filter("s <> t")), max_rounds, 0.125)
    single, live = _single_cycles(live, max_rounds)
    found: list[DataFrame] = [loops, single]
    for _ in range(max_rounds):
        live = _trim(live, max_rounds)
        if live.isEmpty():
            break
        label = _spread_labels(live, max_rounds)
        inside = shuffled_join(live, label.select("graph_id", F.col("node").alias("s"), F.col("label").alias("ls")), ["graph_id", "s"])
        inside = shuffled_join(inside, label.select("graph_id", F.col("node").alias("t"), F.col("label").alias("lt")), ["graph_id", "t"])
        inside = cut_lineage(inside.filter("ls = lt").select("graph_id", "s", "t", F.col("ls").alias("label")))
        comp = _backward_from_roots(inside, max_rounds)
        found.append(comp.select("graph_id", F.col("node"), F.col("label").alias("component")))
        done = comp.select("graph_id", "node").distinct()
        live = cut_lineage(
            shuffled_join(shuffled_join(inside.select("graph_id", "s", "t"), done.withColumnRenamed("node", "s"), ["graph_id", "s"], "left_anti"), done.withColumnRenamed("node", "t"), ["graph_id", "t"], "left_anti")
        )
    members = _merge(found)
    # a node with a self-loop inside a larger cycle keeps the larger one
    sized = members.groupBy("graph_id", "node").agg(F.min("component").alias("component"))
    return sized


def _single_cycles(live: DataFrame, max_rounds: int) -> tuple[DataFrame, DataFrame]:
    """Cycles ``(graph_id, node, component)`` of nodes with one way out each, and the edges of nodes that do not end in one.

    A node with one way out, and only such nodes behind it for good, ends in a cycle that nothing leaves: it is on that
    cycle or on none. ``to`` is 1, 2, 4, ... steps on and ``low`` the smallest node on the way there. A way that meets
    a node with none or several ways out ends there. What is left after as many steps as there are nodes goes round
    for ever, and where it stands is its cycle, once over and complete.
    """
    key = ["graph_id", "s"]
    single = live.groupBy(*key).agg(F.min("t").alias("to"), F.count("*").alias("n")).filter("n = 1").drop("n")
    way = cut_lineage(single.withColumn("low", F.least("s", "to")))
    steps, size = 1, way.count()
    nodes = size
    for _ in range(max_rounds):
        if not size:
            return way.select("graph_id", F.col("s").alias("node"), F.col("low").alias("component")), live
        if steps > nodes:
            break
        ahead = way.select("graph_id", F.col("s").alias("to"), F.col("to").alias("_to"), F.col("low").alias("_low"))
        on = shuffled_join(way, ahead, ["graph_id", "to"])
        way = cut_lineage(on.select(*key, F.col("_to").alias("to"), F.least("low", "_low").alias("low")), (way,))
        steps, size = steps * 2, way.count()
    else:
        raise RuntimeError("ways did not settle")
    on_cycle = cut_lineage(way.select("graph_id", F.col("to").alias("s")).distinct())
    cycles = shuffled_join(way, on_cycle, key, "left_semi").select("graph_id", F.col("s").alias("node"), F.col("low").alias("component"))
    return cycles, cut_lineage(shuffled_join(live, way.select(*key), key, "left_anti").select("graph_id", "s", "t"))


def _trim(live: DataFrame, max_rounds: int, least: float = 0.0) -> DataFrame:
    """Edges without nodes that have no way in or out, layer by layer, until a layer has none or less than ``least`` of all."""
    size = live.count()
    for _ in range(max_rounds):
        kept = shuffled_join(live, live.select("graph_id", F.col("t").alias("s")).distinct(), ["graph_id", "s"], "left_semi")
        kept = cut_lineage(shuffled_join(kept, live.select("graph_id", F.col("s").alias("t")).distinct(), ["graph_id", "t"], "left_semi").select("graph_id", "s", "t"), (live,))
        n = kept.count()
        if n == size or size - n < size * least:
            return kept
        live, size = kept, n
    raise RuntimeError("trimming did not settle")


def _spread_labels(live: DataFrame, max_rounds: int) -> DataFrame:
    """Smallest label that reaches each node."""
    nodes = live.select("graph_id", F.col("s").alias("node")).unionByName(live.select("graph_id", F.col("t").alias("node"))).distinct()
    label = cut_lineage(nodes.withColumn("label", F.col("node")))
    changed = label
    for _ in range(max_rounds):
        push = (
            salted_join(live, changed.withColumnRenamed("node", "s"), ["graph_id", "s"])
            .groupBy("graph_id", F.col("t").alias("node"))
            .agg(F.min("label").alias("new"))
        )
        changed = cut_lineage(
            shuffled_join(push, label, ["graph_id", "node"]).filter("new < label").select("graph_id", "node", F.col("new").alias("label"))
        )
        if changed.isEmpty():
            return label
        label = cut_lineage(
            shuffled_join(label, changed.withColumnRenamed("label", "new"), ["graph_id", "node"], "left").select(
                "graph_id", "node", F.coalesce("new", "label").alias("label")
            )
        )
    raise RuntimeError("labels did not settle")


def _backward_from_roots(inside: DataFrame, max_rounds: int) -> DataFrame:
    """Nodes that reach the root of their own label without leaving it."""
    key = ["graph_id", "node", "label"]
    roots = (
        inside.select("graph_id", F.col("s").alias("node"), "label")
        .unionByName(inside.select("graph_id", F.col("t").alias("node"), "label"))
        .filter("node = label")
        .distinct()
    )
    # a root alone is no cycle: it must have a way in
    roots = shuffled_join(roots, inside.select("graph_id", F.col("t").alias("node")).distinct(), ["graph_id", "node"], "left_semi")
    levels = [cut_lineage(roots.select(*key))]
    frontier = levels[0]
    for _ in range(max_rounds):
        step = salted_join(
            inside, frontier.withColumnRenamed("node", "t"), ["graph_id", "t", "label"]
        ).select("graph_id", F.col("s").alias("node"), "label").distinct()
        fresh = cut_lineage(shuffled_join(step, _merge(levels), key, "left_anti").select(*key))
        if fresh.isEmpty():
            return _merge(levels)
        levels.append(fresh)
        if len(levels) > 12:
            levels = [cut_lineage(_merge(levels))]
        frontier = fresh
    raise RuntimeError("backward walk did not settle")


def trapped_types(type_parents: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """Types that cannot reach a parentless type over parent links.

    ``type_parents`` has one row ``(graph_id, type, parent)`` per link and a null parent for a parentless type.
    Types with a link to an unknown type are left to the type-model check.
    """
    key = ["graph_id", "type"]
    types = type_parents.select(*key).distinct()
    links = type_parents.filter("parent is not null")
    unknown = shuffled_join(links, types.withColumnRenamed("type", "parent"), ["graph_id", "parent"], "left_anti").select(*key).distinct()
    reached = shuffled_join(types, links.select(*key).distinct(), key, "left_anti")
    delta = reached
    for i in range(max_rounds):
        step = shuffled_join(links, delta.withColumnRenamed("type", "parent"), ["graph_id", "parent"], "left_semi").select(*key).distinct()
        delta = cut_lineage(shuffled_join(step, reached, key, "left_anti"))
        if delta.isEmpty():
            break
        reached = reached.unionByName(delta)
        if i % 8 == 7:
            reached = cut_lineage(reached)
    return shuffled_join(shuffled_join(types, reached, key, "left_anti"), unknown, key, "left_anti").select(
        "graph_id", F.lit("error").alias("severity"), F.lit("type-parent-trapped").alias("code"), "type"
    )


def event_dependents(relations: DataFrame, targets: DataFrame) -> DataFrame:
    """Nodes tied to a target by events: emitters and listeners of it, and listeners on what it emits to."""
    return _event_rows(relations, targets).distinct()


def _event_rows(relations: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows of ``event_dependents``, some more than once."""
    events = relations.filter(F.col("type").isin(*EVENTS)).select("graph_id", "source", "target", "type", "event_name")
    aims = targets.select("graph_id", F.col("node_path").alias("target")).distinct()
    direct = salted_join(events, aims, ["graph_id", "target"]).select(
        "graph_id", "target", F.col("source").alias("node_path"), "type", "event_name"
    )
    emitted = events.filter("type = 'emits'").select("graph_id", F.col("source").alias("target"), F.col("target").alias("_hub")).distinct()
    emitted = salted_join(emitted, aims, ["graph_id", "target"])
    listeners = events.filter("type = 'listens'").select(
        "graph_id", F.col("target").alias("_hub"), F.col("source").alias("node_path"), "type", "event_name"
    )
    through = shuffled_join(emitted, listeners, ["graph_id", "_hub"]).filter("node_path <> target")
    return direct.unionByName(through.select(*direct.columns))


def co_rule_nodes(effective: DataFrame, targets: DataFrame, threshold: int = 20) -> DataFrame:
    """Nodes that share a non-ubiquitous effective rule with a target: one row per shared rule.

    A rule effective on more than ``threshold`` nodes is ubiquitous by definition, so no rule joins more than
    ``threshold`` nodes per target.
    """
    rows = effective.select("graph_id", "node_path", "rule_id").distinct()
    rare = rows.groupBy("graph_id", "rule_id").agg(F.count("*").alias("n")).filter(F.col("n") <= threshold).drop("n")
    held = shuffled_join(rows, rare, ["graph_id", "rule_id"], "left_semi")
    mine = shuffled_join(held, targets.select("graph_id", "node_path").distinct(), ["graph_id", "node_path"], "left_semi")
    return shuffled_join(mine.withColumnRenamed("node_path", "target"), held, ["graph_id", "rule_id"]).filter("node_path <> target").select(
        "graph_id", "target", "node_path", F.col("rule_id").alias("shared")
    )


def refused_nodes(verdicts: DataFrame, mappings: DataFrame) -> DataFrame:
    """Nodes with a stored refusal of a rule; file units go to their owner."""
    from attestry.operators.ownership import owner_of_unit

    refused = verdicts.filter("verdict = 'refused'").select("graph_id", "rule_id", "unit_key")
    return owner_of_unit(refused, mappings).filter("node_path is not null").select("graph_id", "rule_id", "node_path").distinct()


def blast_radius(
    relations: DataFrame,
    nodes: DataFrame,
    targets: DataFrame,
    flow_nodes: DataFrame | None = None,
    effective: DataFrame | None = None,
) -> DataFrame:
    """What a change to each target node touches: rows ``(graph_id, target, node_path, why)``.

    ``why`` is dependent, descendant, event, flow (members of a flow of the target) or rule (shares a rare rule).
    """
    from attestry.operators.ownership import node_closure

    pick = lambda df, why: df.select("graph_id", "target", "node_path", F.lit(why).alias("why"))
    aims = targets.select("graph_id", F.col("node_path").alias("target")).distinct()
    out = pick(reverse_dependents(relations, targets), "dependent")
    below = salted_join(
        node_closure(nodes).select("graph_id", F.col("ancestor").alias("target"), F.col("descendant").alias("node_path")),
        aims, ["graph_id", "target"],
    )
    out = out.unionByName(pick(below, "descendant")).unionByName(pick(_event_rows(relations, targets), "event"))
    if flow_nodes is not None:
        mine = shuffled_join(flow_nodes.select("graph_id", "flow", F.col("node_path").alias("target")), aims, ["graph_id", "target"], "left_semi")
        # a flow is reported by name, not spread to all pairs of its members
        out = out.unionByName(
            mine.select("graph_id", "target", F.concat(F.lit("flow:"), "flow").alias("node_path"), F.lit("flow").alias("why"))
        )
    if effective is not None:
        out = out.unionByName(pick(co_rule_nodes(effective, targets), "rule"))
    return out.distinct()


def radius_totals(radius: DataFrame) -> DataFrame:
    """Touched nodes per target and reason."""
    return radius.groupBy("graph_id", "target", "why").agg(F.count("*").alias("n"))


def rule_radius(effective: DataFrame, rules: DataFrame, implies: DataFrame) -> DataFrame:
    """What a change to a rule touches: nodes it is effective on and the rules that imply it directly."""
    on = effective.select("graph_id", "rule_id", F.col("node_path").alias("item"), F.lit("node").alias("why"))
    by = implies.select("graph_id", F.col("implied").alias("rule_id"), F.col("implier").alias("item"), F.lit("implier").alias("why"))
    known = rules.select("graph_id", "rule_id")
    return salted_join(on.unionByName(by), known, ["graph_id", "rule_id"], "left_semi").distinct()


def flow_radius(flow_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """What a change to a flow touches: its members and all their descendants."""
    from attestry.operators.ownership import node_closure

    closure = node_closure(nodes, with_self=True).select("graph_id", F.col("ancestor").alias("node_path"), "descendant")
    return salted_join(closure, flow_nodes.select("graph_id", "flow", "node_path").distinct(), ["graph_id", "node_path"]).select(
        "graph_id", "flow", F.col("descendant").alias("node_path")
    ).distinct()


def type_radius(nodes: DataFrame) -> DataFrame:
    """What a change to a type touches: nodes of the type and their descendants, which inherit its rules."""
    from attestry.operators.ownership import node_closure

    closure = node_closure(nodes, with_self=True).select("graph_id", F.col("ancestor").alias("node_path"), "descendant")
    return salted_join(closure, nodes.select("graph_id", "node_path", "type"), ["graph_id", "node_path"]).select(
        "graph_id", "type", F.col("descendant").alias("node_path")
    ).distinct()
