"""Which rules reach a node, through which channel, and how strictly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions.paths import path_prefixes
from attestry.operators.keyed import cut_lineage, first_by, salted_join, shuffled_join

# Status lattice and its ranks.
STATUSES = ["draft", "advisory", "enforced"]
NODE_RULE = ["graph_id", "node_path", "rule_id"]


def status_rank(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c == "draft", 0).when(c == "advisory", 1).when(c == "enforced", 2)


def rank_status(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c == 0, "draft").when(c == 1, "advisory").when(c == 2, "enforced")


def port_attachments(relations: DataFrame, ports_raw: DataFrame) -> DataFrame:
    """Rules a consumer takes on through the ports it consumes.

    ``relations`` carries ``consumes``; ``ports_raw`` holds the attach rows of kind ``port`` with ``site`` the
    target node and ``port`` its port.
    """
    used = relations.select(
        "graph_id", F.col("source").alias("node_path"), F.col("target").alias("site"), F.explode("consumes").alias("port")
    ).distinct()
    asks = ports_raw.filter("site_kind = 'port'").select("graph_id", "site", "port", "rule_id", "status", "condition", "ord")
    return salted_join(used, asks, ["graph_id", "site", "port"])


def attachments(
    nodes: DataFrame, attachments_raw: DataFrame, flow_nodes: DataFrame, relations: DataFrame
) -> DataFrame:
    """Every rule that reaches a node, by six channels: own, ancestor, own type, ancestor type, flow, port.

    Columns ``channel``, ``origin`` (machine-readable), ``label`` (for people), ``status``, ``condition``,
    ``seq`` (order inside the channel).
    """
    own_rows = attachments_raw.filter("site_kind = 'node'")
    type_rows = attachments_raw.filter("site_kind = 'type'").select(
        "graph_id", F.col("site").alias("type"), "rule_id", "status", "condition", "ord"
    )
    flow_rows = attachments_raw.filter("site_kind = 'flow'").select(
        "graph_id", F.col("site").alias("flow"), "rule_id", "status", "condition", "ord"
    )
    typed = nodes.select("graph_id", "node_path", "type")
    # a rule at or above a node: one prefix explode serves channels 1-5
    line = typed.select(
        "graph_id",
        "node_path",
        F.explode(path_prefixes("node_path")).alias("site"),
    ).withColumn("dist", F.size(F.split("node_path", "/")) - F.size(F.split("site", "/")))

    def shape(rows: DataFrame, channel: Column, origin: Column, label: Column, seq: Column) -> DataFrame:
        return rows.select(
            *NODE_RULE, channel.cast("int").alias("channel"), origin.alias("origin"), label.alias("label"),
            "status", "condition", seq.alias("seq"),
        )

    c = F.col
    at_nodes = salted_join(line, own_rows.select("graph_id", "site", "rule_id", "status", "condition", "ord"), ["graph_id", "site"])
    mine = c("dist") == 0
    by_node = shape(
        at_nodes,
        F.when(mine, 1).otherwise(2),
        F.when(mine, F.concat(F.lit("own:"), c("node_path"))).otherwise(F.concat(F.lit("ancestor:"), c("site"))),
        F.when(mine, F.lit("own declaration")).otherwise(F.concat(F.lit("inherited from parent '"), c("site"), F.lit("'"))),
        F.struct(c("dist").alias("a"), c("ord").alias("b"), c("site").alias("c")),
    )
    site_types = typed.select("graph_id", c("node_path").alias("site"), "type")
    at_types = salted_join(salted_join(line, site_types, ["graph_id", "site"]), type_rows, ["graph_id", "type"])
    by_type = shape(
        at_types,
        F.when(mine, 3).otherwise(4),
        F.when(mine, F.concat(F.lit("type:"), c("type"))).otherwise(
            F.concat(F.lit("ancestor-type:"), c("type"), F.lit("@"), c("site"))
        ),
        F.when(mine, F.concat(F.lit("architecture (type: "), c("type"), F.lit(")"))).otherwise(
            F.concat(F.lit("inherited from parent (type: "), c("type"), F.lit(")"))
        ),
        F.struct(c("dist").alias("a"), c("ord").alias("b"), c("site").alias("c")),
    )
    member = flow_nodes.select("graph_id", "flow", c("node_path").alias("site")).distinct()
    in_flow = salted_join(line, member, ["graph_id", "site"]).groupBy("graph_id", "node_path", "flow").agg(
        F.min(F.struct("dist", "site")).alias("via")
    )
    at_flows = salted_join(in_flow, flow_rows, ["graph_id", "flow"])
    by_flow = shape(
        at_flows,
        F.lit(5),
        F.concat(F.lit("flow:"), c("flow")),
        F.when(c("via.dist") == 0, F.concat(F.lit("flow '"), c("flow"), F.lit("'"))).otherwise(
            F.concat(F.lit("flow '"), c("flow"), F.lit("' (via parent '"), c("via.site"), F.lit("')"))
        ),
        F.struct(F.lit(0).alias("a"), c("ord").alias("b"), c("flow").alias("c")),
    )
    by_port = shape(
        port_attachments(relations, attachments_raw),
        F.lit(6),
        F.concat(F.lit("port:"), c("port"), F.lit("@"), c("site")),
        F.concat(F.lit("port '"), c("port"), F.lit("' on '"), c("site"), F.lit("'")),
        F.struct(F.lit(0).alias("a"), c("ord").alias("b"), F.concat(c("site"), F.lit("|"), c("port")).alias("c")),
    )
    return by_node.unionByName(by_type).unionByName(by_flow).unionByName(by_port)


def condition_reach(rules: DataFrame, implies: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Conditions that implications ask for once a rule is in force: ``(graph_id, rule_id, condition)``.

    A hop asks its own condition and that of the rule it leads to. Each round goes ``2^k`` hops up at once, so rounds
    are the logarithm of the longest chain, cycles included: if no rule gains a condition over the lengths of one round,
    none would over longer ones. Runs jobs while the plan is built; grows with the rules, not with the nodes.
    """
    when = rules.filter("condition is not null").select("graph_id", F.col("rule_id").alias("implied"), F.col("condition").alias("_when"))
    edges = shuffled_join(implies.select("graph_id", F.col("implier").alias("rule_id"), "implied", "condition"), when, ["graph_id", "implied"], "left")
    both = edges.select("graph_id", "rule_id", F.explode(F.array("condition", "_when")).alias("condition"))
    known = cut_lineage(both.filter("condition is not null").distinct())
    if known.isEmpty():
        return known
    jump = cut_lineage(edges.select("graph_id", "rule_id", F.col("implied").alias("_to")).distinct())
    for _ in range(max_rounds):
        ahead = known.withColumnRenamed("rule_id", "_to")
        fresh = shuffled_join(salted_join(jump, ahead, ["graph_id", "_to"]).select(*known.columns).distinct(), known, known.columns, "left_anti")
        fresh = cut_lineage(fresh)
        if fresh.isEmpty():
            return known
        known = cut_lineage(known.unionByName(fresh), done=(known, fresh))
        onward = jump.select("graph_id", F.col("rule_id").alias("_to"), F.col("_to").alias("_end"))
        jump = cut_lineage(salted_join(jump, onward, ["graph_id", "_to"]).select("graph_id", "rule_id", F.col("_end").alias("_to")).distinct(), done=(jump,))
    raise RuntimeError("conditions of implications did not settle")


def condition_demand(attached: DataFrame, rules: DataFrame, implies: DataFrame | None = None) -> DataFrame:
    """(node, condition) rows the cascade has to know; feed them to eval_node_predicate.

    A node is asked the conditions of its attachments and of their rules, and those of implications only where a rule
    attached to it can reach the hop.
    """
    rule_when = rules.filter("condition is not null").select("graph_id", "rule_id", F.col("condition").alias("_when"))
    held = attached.select(*NODE_RULE).distinct()
    direct = attached.filter("condition is not null").select("graph_id", "node_path", "condition")
    by_rule = salted_join(held, rule_when, ["graph_id", "rule_id"]).select("graph_id", "node_path", F.col("_when").alias("condition"))
    out = direct.unionByName(by_rule)
    if implies is not None:
        out = out.unionByName(salted_join(held, condition_reach(rules, implies), ["graph_id", "rule_id"]).select(*out.columns))
    return out.distinct()


def passing(attached: DataFrame, rules: DataFrame, passes: DataFrame | None = None) -> DataFrame:
    """Attachments whose own condition and whose rule's condition both hold, with ``rank`` resolved.

    ``passes`` is the output of eval_node_predicate; without it no condition may be set.
    """
    meta = rules.select("graph_id", "rule_id", F.col("status").alias("_default"), F.col("condition").alias("_when"))
    rows = salted_join(attached, meta, ["graph_id", "rule_id"], "left")
    if passes is not None:
        ok = passes.filter("pass").select("graph_id", "node_path", "condition")
        site = ok.withColumn("_site_ok", F.lit(True))
        rule = ok.select("graph_id", "node_path", F.col("condition").alias("_when"), F.lit(True).alias("_rule_ok"))
        rows = shuffled_join(shuffled_join(rows, site, ["graph_id", "node_path", "condition"], "left"), rule, ["graph_id", "node_path", "_when"], "left")
        rows = rows.filter(
            (F.col("condition").isNull() | F.col("_site_ok")) & (F.col("_when").isNull() | F.col("_rule_ok"))
        ).drop("_site_ok", "_rule_ok")
    rank = F.coalesce(status_rank("status"), status_rank("_default"), F.lit(2))
    return rows.withColumn("rank", rank).withColumn("default_rank", F.coalesce(status_rank("_default"), F.lit(2))).drop("_when", "_default")


def implied_closure(rules: DataFrame, implies: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Status each rule passes on over unconditional implications, for every status it may have itself.

    Rows ``(graph_id, rule_id, rank_in, implied, rank_out)``. Statuses form a chain and every hop is
    monotone, so the strictest status over all paths is what the cascade of any node would reach; nodes then
    need one join with this table. Drafts pass nothing on. Each round goes on from the paths found in the round
    before by all paths known, so paths double in length and the number of rounds is the logarithm of the longest
    chain; runs jobs while the plan is built.
    """
    default = rules.select("graph_id", F.col("rule_id").alias("implied"), F.coalesce(status_rank("status"), F.lit(2)).alias("_d"))
    hops = shuffled_join(implies.select("graph_id", F.col("implier").alias("rule_id"), "implied", "inherit"), default, ["graph_id", "implied"], "left")
    hops = hops.withColumn("_d", F.coalesce("_d", F.lit(2))).withColumn("rank_in", F.explode(F.array(F.lit(1), F.lit(2))))
    out = F.when(F.col("inherit") == "own-default", F.col("_d")).otherwise(F.greatest("rank_in", "_d"))
    key = ["graph_id", "rule_id", "rank_in", "implied"]
    path = [*key, "rank_out"]
    known = fresh = cut_lineage(hops.select(*key, out.alias("rank_out")).distinct())
    for _ in range(max_rounds):
        tail = known.select(
            "graph_id", F.col("rule_id").alias("_mid"), F.col("rank_in").alias("_r"), F.col("implied").alias("_end"), F.col("rank_out").alias("_out")
        )
        head = fresh.select("graph_id", "rule_id", "rank_in", F.col("implied").alias("_mid"), F.col("rank_out").alias("_r"))
        longer = salted_join(head, tail, ["graph_id", "_mid", "_r"]).select(
            "graph_id", "rule_id", "rank_in", F.col("_end").alias("implied"), F.col("_out").alias("rank_out")
        )
        fresh = cut_lineage(shuffled_join(longer.distinct(), known, path, "left_anti").select(*path))
        if fresh.isEmpty():
            return known.groupBy(*key).agg(F.max("rank_out").alias("rank_out"))
        known = known.unionByName(fresh)
    raise RuntimeError("implication closure did not settle")


def effective_ranks(
    attached: DataFrame,
    rules: DataFrame,
    implies: DataFrame,
    passes: DataFrame | None = None,
    max_rounds: int = 1_000,
) -> DataFrame:
    """(node, rule, rank) of the cascade."""
    base = passing(attached, rules, passes).groupBy(*NODE_RULE).agg(F.max("rank").alias("rank"))
    when = rules.filter("condition is not null").select("graph_id", F.col("rule_id").alias("implied"), F.col("condition").alias("_when"))
    edges = shuffled_join(implies, when, ["graph_id", "implied"], "left")
    gated = edges.filter(F.col("condition").isNotNull() | F.col("_when").isNotNull())
    plain = implies
    has_gates = passes is not None and not gated.isEmpty()
    if has_gates:
        plain = edges.filter(F.col("condition").isNull() & F.col("_when").isNull())
    closure = implied_closure(rules, plain).select(
        "graph_id", "rule_id", F.col("rank_in").alias("rank"), "implied", "rank_out"
    )

    def close(state: DataFrame) -> DataFrame:
        onward = salted_join(state, closure, ["graph_id", "rule_id", "rank"]).select(
            "graph_id", "node_path", F.col("implied").alias("rule_id"), F.col("rank_out").alias("rank")
        )
        return state.select(*NODE_RULE, "rank").unionByName(onward).groupBy(*NODE_RULE).agg(F.max("rank").alias("rank"))

    state = close(base)
    if not has_gates:
        return state
    default = rules.select("graph_id", F.col("rule_id").alias("implied"), F.coalesce(status_rank("status"), F.lit(2)).alias("_d"))
    gated = shuffled_join(gated, default, ["graph_id", "implied"], "left").select(
        "graph_id", F.col("implier").alias("rule_id"), "implied", "condition", "_when",
        F.coalesce("inherit", F.lit("strictest")).alias("inherit"), F.coalesce("_d", F.lit(2)).alias("_d"),
    )
    ok = passes.filter("pass").select("graph_id", "node_path", "condition")
    state = cut_lineage(state)
    for _ in range(max_rounds):
        hop = salted_join(state.filter("rank > 0"), gated, ["graph_id", "rule_id"])
        hop = shuffled_join(hop, ok.withColumn("_e", F.lit(True)), ["graph_id", "node_path", "condition"], "left")
        hop = shuffled_join(
            hop,
            ok.select("graph_id", "node_path", F.col("condition").alias("_when"), F.lit(True).alias("_r")),
            ["graph_id", "node_path", "_when"], "left",
        ).filter((F.col("condition").isNull() | F.col("_e")) & (F.col("_when").isNull() | F.col("_r")))
        gained = hop.select(
            "graph_id", "node_path", F.col("implied").alias("rule_id"),
            F.when(F.col("inherit") == "own-default", F.col("_d")).otherwise(F.greatest("rank", "_d")).alias("rank"),
        )
        grown = cut_lineage(close(state.unionByName(gained).groupBy(*NODE_RULE).agg(F.max("rank").alias("rank"))))
        risen = shuffled_join(grown, state.withColumnRenamed("rank", "_old"), NODE_RULE, "left").filter(
            F.col("_old").isNull() | (F.col("rank") > F.col("_old"))
        )
        state = grown
        if risen.isEmpty():
            return state
    raise RuntimeError("conditional implications did not settle")


def effective_rules(
    attached: DataFrame, rules: DataFrame, implies: DataFrame, passes: DataFrame | None = None
) -> DataFrame:
    """Rules in force per node with their status: strictest passing channel, then implications."""
    return effective_ranks(attached, rules, implies, passes).select(*NODE_RULE, rank_status("rank").alias("status"))


def uncomputable_nodes(effective: DataFrame, cyclic_rules: DataFrame) -> DataFrame:
    """Nodes whose effective rules enter an implication cycle; ``cyclic_rules`` comes from structural_cycles."""
    return salted_join(effective, cyclic_rules.select("graph_id", "rule_id").distinct(), ["graph_id", "rule_id"], "left_semi").select(
        "graph_id", "node_path"
    ).distinct()


def status_sources(attached: DataFrame, rules: DataFrame, passes: DataFrame | None = None) -> DataFrame:
    """All passing channels of a rule on a node with origin and declared status."""
    return passing(attached, rules, passes).select(*NODE_RULE, "channel", "origin", rank_status("rank").alias("declared"))


def rule_source(attached: DataFrame, effective: DataFrame, implies: DataFrame, rules: DataFrame) -> DataFrame:
    """Label of the first channel that attaches a rule, conditions ignored; else the implying rule."""
    first = first_by(attached, NODE_RULE, [F.col("channel"), F.col("seq")], ["label"])
    order = rules.select("graph_id", F.col("rule_id").alias("implier"), F.col("ord").alias("_o"))
    by = shuffled_join(implies, order, ["graph_id", "implier"]).groupBy("graph_id", F.col("implied").alias("rule_id")).agg(
        F.min_by("implier", F.struct("_o", "implier")).alias("_by")
    )
    rows = shuffled_join(effective.select(*NODE_RULE), first, NODE_RULE, "left")
    rows = salted_join(rows, by, ["graph_id", "rule_id"], "left")
    implied = F.concat(F.lit("implied by '"), F.col("_by"), F.lit("'"))
    return rows.select(*NODE_RULE, F.coalesce("label", implied, F.lit("unknown source")).alias("source"))


def not_applicable(attached: DataFrame, effective: DataFrame) -> DataFrame:
    """Rules attached by own or own-type declaration that a condition filtered out."""
    direct = attached.filter(F.col("channel").isin(1, 3)).select(*NODE_RULE).distinct()
    return shuffled_join(direct, effective.select(*NODE_RULE), NODE_RULE, "left_anti")


def orphan_rules(rules: DataFrame, attachments_raw: DataFrame, implies: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """Rules nothing mentions, directly or by implication."""
    key = ["graph_id", "rule_id"]
    delta = attachments_raw.select(*key).distinct()
    reached = delta
    hop = implies.select("graph_id", F.col("implier").alias("rule_id"), "implied").distinct()
    for i in range(max_rounds):
        new = salted_join(delta, hop, key).select("graph_id", F.col("implied").alias("rule_id")).distinct()
        delta = cut_lineage(shuffled_join(new, reached, key, "left_anti"))
        if delta.isEmpty():
            break
        reached = reached.unionByName(delta)
        if i % 8 == 7:
            reached = cut_lineage(reached)
    return shuffled_join(rules, reached, key, "left_anti").select(
        "graph_id", F.lit("warning").alias("severity"), F.lit("orphan-rule").alias("code"), "rule_id"
    )


def status_downgrades(
    attached: DataFrame, rules: DataFrame, passes: DataFrame | None = None
) -> DataFrame:
    """Explicit attach statuses below the strictest of all other channels and the rule default."""
    rows = passing(attached, rules, passes)
    # the two strictest channels of each group answer "strictest of the others" for every member
    best = rows.groupBy(*NODE_RULE).agg(
        F.max(F.struct("rank", "channel", "origin")).alias("m1"), F.max("default_rank").alias("dr")
    )
    joined = salted_join(rows.filter("status is not null"), best, NODE_RULE)
    lead = (F.col("m1.channel") == F.col("channel")) & (F.col("m1.origin") == F.col("origin"))
    # the leading row is never below the others, so only the rule default can stand above it
    floor = F.when(lead, F.col("dr")).otherwise(F.greatest("m1.rank", "dr"))
    return joined.filter(F.col("rank") < floor).select(
        *NODE_RULE, "channel", "origin", rank_status("rank").alias("declared"), rank_status(floor).alias("required")
    )


def rule_usage(
    effective: DataFrame, nodes: DataFrame, attachments_raw: DataFrame, flow_nodes: DataFrame, rules: DataFrame
) -> DataFrame:
    """Nodes each rule is effective on, by channel: type, then flow (declared members), own, else implied."""
    type_rules = attachments_raw.filter("site_kind = 'type'").select("graph_id", F.col("site").alias("type"), "rule_id").distinct()
    flow_rules = attachments_raw.filter("site_kind = 'flow'").select("graph_id", F.col("site").alias("flow"), "rule_id").distinct()
    own = attachments_raw.filter("site_kind = 'node'").select("graph_id", F.col("site").alias("node_path"), "rule_id").distinct()
    in_flow = shuffled_join(flow_nodes, flow_rules, ["graph_id", "flow"]).select("graph_id", "node_path", "rule_id").distinct()
    rows = salted_join(effective.select(*NODE_RULE), nodes.select("graph_id", "node_path", "type"), ["graph_id", "node_path"])
    rows = salted_join(rows, type_rules.withColumn("_t", F.lit(True)), ["graph_id", "type", "rule_id"], "left")
    rows = shuffled_join(rows, in_flow.withColumn("_f", F.lit(True)), NODE_RULE, "left")
    rows = shuffled_join(rows, own.withColumn("_o", F.lit(True)), NODE_RULE, "left")
    via = F.when(F.col("_t"), "type").when(F.col("_f"), "flow").when(F.col("_o"), "own").otherwise("implied")
    counts = rows.withColumn("via", via).groupBy("graph_id", "rule_id").agg(
        F.count("*").alias("n_nodes"),
        *[F.count_if(F.col("via") == v).alias(f"via_{v}") for v in ("type", "flow", "own", "implied")],
    )
    names = ["n_nodes", "via_type", "via_flow", "via_own", "via_implied"]
    return shuffled_join(rules.select("graph_id", "rule_id"), counts, ["graph_id", "rule_id"], "left").fillna(0, names)

