"""Counts and roll-ups for people: rules, nodes, types, flows, context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.operators.keyed import dealt_by, salted_join, shuffled_join, top_n
from attestry.operators.ownership import node_closure

# Node states from best to worst.
STATE_RANK = ["verified", "no-rule", "warning", "unverified", "refused"]


def display_state(state: Column | str, status: Column | str) -> Column:
    """State shown to people: a refusal counts as a warning unless enforced; all else is unverified."""
    s = F.col(state) if isinstance(state, str) else state
    t = F.col(status) if isinstance(status, str) else status
    return F.when(s == "verified", "verified").when(s == "refused", F.when(t == "enforced", "refused").otherwise("warning")).otherwise("unverified")


def rule_tally(rules: DataFrame, states: DataFrame, effective: DataFrame) -> DataFrame:
    """Per rule: units by shown state; bundles judge nothing; a rule without pairs is vacuous, with the reason."""
    shown = states.withColumn("_d", display_state("state", "status"))
    counts = shown.groupBy("graph_id", "rule_id").agg(
        F.count("*").alias("units"), *[F.count_if(F.col("_d") == d).alias(d) for d in ("verified", "refused", "warning", "unverified")]
    )
    reach = effective.groupBy("graph_id", "rule_id").agg(F.count_if(F.col("status") != "draft").alias("_live"), F.count("*").alias("_n"))
    rows = shuffled_join(shuffled_join(rules.select("graph_id", "rule_id", "kind"), counts, ["graph_id", "rule_id"], "left"), reach, ["graph_id", "rule_id"], "left")
    why = (
        F.when((F.col("kind") == "bundle") | (F.coalesce("units", F.lit(0)) > 0), F.lit(None))
        .when(F.coalesce("_n", F.lit(0)) == 0, "no-node")
        .when(F.col("_live") == 0, "draft")
        .otherwise("empty-subjects")
    )
    return rows.withColumn("vacuous", why).drop("_live", "_n").fillna(0, ["units", "verified", "refused", "warning", "unverified"])


def state_counts(nodes: DataFrame, rules: DataFrame, flow_nodes: DataFrame, states: DataFrame) -> DataFrame:
    """Headline counts, one row per graph."""
    g = ["graph_id"]
    n = nodes.groupBy(*g).agg(F.count("*").alias("nodes"))
    r = rules.groupBy(*g).agg(F.count("*").alias("rules"), F.count_if(F.col("status") == "draft").alias("drafts"))
    f = flow_nodes.groupBy(*g).agg(F.countDistinct("flow").alias("flows"))
    p = states.groupBy(*g).agg(
        F.count("*").alias("pairs"),
        F.count_if(F.col("kind") == "judged").alias("judged"),
        F.count_if(F.col("kind") == "computed").alias("computed"),
        *[F.count_if(F.col("state") == s).alias(s.replace("-", "_")) for s in ("verified", "refused", "unverified", "too-large", "companion-error")],
    )
    out = n.join(r, g, "full_outer").join(f, g, "full_outer").join(p, g, "full_outer")
    return out.fillna(0, [c for c in out.columns if c != "graph_id"])


def type_catalogue(types: DataFrame, nodes: DataFrame) -> DataFrame:
    """Node count per type, zero included, with its parents and flags."""
    n = nodes.groupBy("graph_id", "type").agg(F.count("*").alias("n_nodes"))
    return shuffled_join(types, n, ["graph_id", "type"], "left").fillna(0, ["n_nodes"])


def hubs(relations: DataFrame) -> DataFrame:
    """Fan-in and fan-out per node, zeros left out."""
    out = relations.groupBy("graph_id", F.col("source").alias("node_path")).agg(F.count("*").alias("n")).withColumn("direction", F.lit("out"))
    into = relations.groupBy("graph_id", F.col("target").alias("node_path")).agg(F.count("*").alias("n")).withColumn("direction", F.lit("in"))
    return out.unionByName(into).orderBy("graph_id", "direction", F.col("n").desc(), "node_path")


def invert_relations(relations: DataFrame) -> DataFrame:
    """Incoming relations per node, in long form."""
    return relations.select("graph_id", F.col("target").alias("node_path"), "source", "type")


def group_failures(failures: DataFrame, n: int) -> DataFrame:
    """Failures by rule and cause: rows of the first ``n`` units of each group with the count of the group."""
    key = ["graph_id", "rule_id", "why", "next"]
    counts = failures.groupBy(*key).agg(F.count("*").alias("failures"), F.countDistinct("unit_key").alias("units"))
    first = top_n(failures.select(*key, "unit_key").distinct(), key, [F.col("unit_key")], n)
    return shuffled_join(first, counts, key)


def _rank(state: Column) -> Column:
    table = F.create_map(*[x for i, s in enumerate(STATE_RANK) for x in (F.lit(s), F.lit(i))])
    return table[state]


def node_states(nodes: DataFrame, states: DataFrame, issues: DataFrame | None = None, fresh: DataFrame | None = None) -> DataFrame:
    """Own state of each node: worst of its pairs; a warning issue promotes; changed sources are at least
    unverified; no checked pair means no-rule."""
    key = ["graph_id", "node_path"]
    worst = states.withColumn("_r", _rank(display_state("state", "status"))).groupBy(*key).agg(F.max("_r").alias("_w"))
    rows = shuffled_join(nodes.select(*key), worst, key, "left").withColumn("_w", F.coalesce("_w", F.lit(STATE_RANK.index("no-rule"))))
    if issues is not None:
        warned = issues.filter("severity = 'warning' and node_path is not null").select(*key).distinct().withColumn("_i", F.lit(True))
        promoted = F.when(F.col("_i"), F.greatest("_w", F.lit(STATE_RANK.index("warning")))).otherwise(F.col("_w"))
        rows = shuffled_join(rows, warned, key, "left").withColumn("_w", promoted)
    if fresh is not None:
        stale = fresh.filter("changed").select(*key).withColumn("_s", F.lit(True))
        rows = shuffled_join(rows, stale, key, "left").withColumn(
            "_w", F.when(F.col("_s"), F.greatest("_w", F.lit(STATE_RANK.index("unverified")))).otherwise(F.col("_w"))
        )
    return rows.select(*key, "_w")


def rollup_state(nodes: DataFrame, states: DataFrame, issues: DataFrame | None = None, fresh: DataFrame | None = None) -> DataFrame:
    """Own state of each node and the true worst state of its whole subtree."""
    key = ["graph_id", "node_path"]
    own = node_states(nodes, states, issues, fresh)
    # every node pushes its rank to all its ancestors; the maximum combines before the shuffle
    up = node_closure(nodes, with_self=True).select("graph_id", F.col("ancestor").alias("_a"), F.col("descendant").alias("node_path"))
    total = shuffled_join(up, own, key).groupBy("graph_id", F.col("_a").alias("node_path")).agg(F.max("_w").alias("_t"))
    name = lambda c: F.array(*[F.lit(s) for s in STATE_RANK])[F.col(c)]
    return shuffled_join(own, total, key).select(*key, name("_w").alias("state"), name("_t").alias("rollup"))


def flow_state(flow_nodes: DataFrame, nodes: DataFrame, states: DataFrame) -> DataFrame:
    """Per flow, over its members and their descendants: nothing-checked, attention or verified."""
    key = ["graph_id", "node_path"]
    per_node = states.groupBy(*key).agg(F.bool_or(F.col("state") != "verified").alias("_bad"))
    down = node_closure(nodes, with_self=True).select("graph_id", F.col("ancestor").alias("node_path"), "descendant")
    members = salted_join(down, flow_nodes.select("graph_id", "flow", "node_path").distinct(), key).select(
        "graph_id", "flow", F.col("descendant").alias("node_path")
    ).distinct()
    rows = shuffled_join(members, per_node, key, "left").groupBy("graph_id", "flow").agg(
        F.count("*").alias("members"), F.bool_or("_bad").alias("_bad"), F.count("_bad").alias("_n")
    )
    state = F.when(F.col("_n") == 0, "nothing-checked").when(F.col("_bad"), "attention").otherwise("verified")
    return rows.select("graph_id", "flow", "members", state.alias("state"))


def residue(states_by_node: DataFrame, mappings: DataFrame, uncovered: DataFrame) -> DataFrame:
    """What nothing checks: mapped nodes in state no-rule, and uncovered files."""
    mapped = mappings.filter(F.trim("entry") != "").select("graph_id", "node_path").distinct()
    idle = shuffled_join(states_by_node.filter("state = 'no-rule'"), mapped, ["graph_id", "node_path"], "left_semi")
    return idle.select("graph_id", F.lit("node").alias("kind"), F.col("node_path").alias("item")).unionByName(
        uncovered.select("graph_id", F.lit("file").alias("kind"), F.col("path").alias("item"))
    )


#: Copies of one row that are made from one array.
REPEATS = 4096


def determinism_check(run1: DataFrame, run2: DataFrame) -> DataFrame:
    """Findings that differ between two runs of one rule."""
    cols = sorted(run1.columns)
    rows = run1.select(*cols).withColumn("_n", F.lit(1)).unionByName(run2.select(*cols).withColumn("_n", F.lit(-1)))
    # one count of each row over both runs; it is on one side only, as often as it is there more
    more = dealt_by(rows, cols).groupBy(*cols).agg(F.sum("_n").alias("_n")).filter("_n <> 0")
    more = more.withColumn("run", F.when(F.col("_n") > 0, 1).otherwise(2)).withColumn("_n", F.abs("_n"))
    # repeated in stretches, so that a row there very often makes no long array
    some = more.withColumn("_s", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / REPEATS))))
    return some.withColumn("_i", F.explode(F.sequence(F.lit(1), F.least(F.lit(REPEATS), F.col("_n") - F.col("_s") * REPEATS)))).select(*cols, "run")


def node_context(
    targets: DataFrame, nodes: DataFrame, effective: DataFrame, sources: DataFrame, flow_nodes: DataFrame, relations: DataFrame,
    node_files: DataFrame, latest: DataFrame | None = None,
) -> DataFrame:
    """What there is to know about each target node, in long form: ``(graph_id, node_path, section, item, detail)``.

    Sections: rule, flow, dependency (ancestors left out), dependent, parent, files, journal.
    """
    key = ["graph_id", "node_path"]
    t = targets.select(*key).distinct()
    part = lambda df, s, item, detail: df.select(*key, F.lit(s).alias("section"), item.alias("item"), detail.alias("detail"))
    rules = shuffled_join(salted_join(effective, t, key, "left_semi"), sources, [*key, "rule_id"], "left")
    out = part(rules, "rule", F.col("rule_id"), F.concat_ws(" | ", "status", "source"))
    line = node_closure(nodes, with_self=True).select("graph_id", F.col("descendant").alias("node_path"), F.col("ancestor").alias("_a"))
    line = shuffled_join(line, t, key, "left_semi")
    member = flow_nodes.select("graph_id", F.col("node_path").alias("_a"), "flow").distinct()
    out = out.unionByName(part(shuffled_join(line, member, ["graph_id", "_a"]).select(*key, "flow").distinct(), "flow", F.col("flow"), F.lit("")))
    dep = salted_join(relations.select("graph_id", F.col("source").alias("node_path"), "target", "type"), t, key)
    dep = dep.filter(~F.col("node_path").startswith(F.concat("target", F.lit("/"))))
    out = out.unionByName(part(dep, "dependency", F.col("target"), F.col("type")))
    back = salted_join(relations.select("graph_id", F.col("target").alias("node_path"), "source", "type"), t, key)
    out = out.unionByName(part(back, "dependent", F.col("source"), F.col("type")))
    parent = shuffled_join(nodes.filter("parent_path is not null"), t, key, "left_semi")
    out = out.unionByName(part(parent, "parent", F.col("parent_path"), F.lit("")))
    n = salted_join(node_files, t, key, "left_semi").groupBy(*key).agg(F.count("*").alias("n"))
    out = out.unionByName(part(n, "files", F.lit("count"), F.col("n").cast("string")))
    if latest is not None:
        out = out.unionByName(part(shuffled_join(latest, t, key, "left_semi"), "journal", F.lit("latest"), F.col("ts")))
    return out
