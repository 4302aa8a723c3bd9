"""Queries on the rule cascade and the integrity of the graph tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.operators import cascade as cas
from attestry.operators import checks as chk
from attestry.operators import predicates as pred
from attestry.operators import reach
from attestry.operators import reports as rep
from attestry.operators.keyed import shuffled_join
from attestry.plans.inputs import Inputs
from attestry.plans.registry import query
from attestry.plans.verdict_queries import STATES, states

LINE = (
    "line",
    """SELECT n.graph_id, n.node_path, n.type, a.node_path AS site, a.type AS site_type,
              len(string_split(n.node_path, '/')) - len(string_split(a.node_path, '/')) AS dist
       FROM nodes n JOIN nodes a ON a.node_path = n.node_path OR starts_with(n.node_path, concat(a.node_path, '/'))""",
)
VIA = (
    "via",
    """SELECT l.node_path, f.flow, arg_min(f.node_path, l.dist) AS via, min(l.dist) AS dist
       FROM line l JOIN flow_nodes f ON f.node_path = l.site GROUP BY ALL""",
)
ATTACHED = (
    "attached",
    """SELECT l.node_path, rule_id, CASE WHEN dist = 0 THEN 1 ELSE 2 END AS channel,
              CASE WHEN dist = 0 THEN concat('own:', l.node_path) ELSE concat('ancestor:', l.site) END AS origin,
              CASE WHEN dist = 0 THEN 'own declaration' ELSE concat('inherited from parent ''', l.site, '''') END AS label, status, dist AS s1, ord AS s2, l.site AS s3
       FROM line l JOIN attachments_raw r ON r.site_kind = 'node' AND r.site = l.site
       UNION ALL
       SELECT l.node_path, rule_id, CASE WHEN dist = 0 THEN 3 ELSE 4 END,
              CASE WHEN dist = 0 THEN concat('type:', site_type) ELSE concat('ancestor-type:', site_type, '@', l.site) END,
              CASE WHEN dist = 0 THEN concat('architecture (type: ', site_type, ')') ELSE concat('inherited from parent (type: ', site_type, ')') END, status, dist, ord, l.site
       FROM line l JOIN attachments_raw r ON r.site_kind = 'type' AND r.site = l.site_type
       UNION ALL
       SELECT v.node_path, rule_id, 5, concat('flow:', flow),
              CASE WHEN dist = 0 THEN concat('flow ''', flow, '''') ELSE concat('flow ''', flow, ''' (via parent ''', via, ''')') END, status, 0, ord, flow
       FROM via v JOIN attachments_raw r ON r.site_kind = 'flow' AND r.site = v.flow
       UNION ALL
       SELECT c.source, rule_id, 6, concat('port:', c.port, '@', c.target), concat('port ''', c.port, ''' on ''', c.target, ''''), status, 0, ord, concat(c.target, '|', c.port)
       FROM (SELECT DISTINCT source, target, port FROM consumes) c
       JOIN attachments_raw r ON r.site_kind = 'port' AND r.site = c.target AND r.port = c.port""",
)
RANK = "CASE {0} WHEN 'draft' THEN 0 WHEN 'advisory' THEN 1 WHEN 'enforced' THEN 2 END"
RANKED = (
    "ranked",
    f"""SELECT a.*, coalesce({RANK.format('a.status')}, {RANK.format('r.status')}, 2) AS rank, coalesce({RANK.format('r.status')}, 2) AS dr
        FROM attached a LEFT JOIN rules r ON r.rule_id = a.rule_id""",
)
NAME = "CASE {0} WHEN 0 THEN 'draft' WHEN 1 THEN 'advisory' ELSE 'enforced' END"


def spread(implies: str = "implies", base: str = "ranked", gate: str = "") -> tuple[str, str]:
    """Statuses carried over implications, one row per path value."""
    return (
        "spread",
        f"""SELECT DISTINCT node_path, rule_id, rank FROM {base}
            UNION
            SELECT s.node_path, i.implied, CASE WHEN i.inherit = 'own-default' THEN coalesce({RANK.format('r.status')}, 2)
                   ELSE greatest(s.rank, coalesce({RANK.format('r.status')}, 2)) END
            FROM spread s JOIN {implies} i ON i.implier = s.rule_id LEFT JOIN rules r ON r.rule_id = i.implied {gate} WHERE s.rank > 0""",
    )


EFFECTIVE = ("effective", f"SELECT node_path, rule_id, {NAME.format('max(rank)')} AS status FROM spread GROUP BY ALL")
CASCADE = (LINE, VIA, ATTACHED, RANKED, spread(), EFFECTIVE)


def _attached(i: Inputs) -> DataFrame:
    return cas.attachments(i.nodes, i.attachments_raw, i.flow_nodes, i.relations_full)


def attached(i: Inputs) -> DataFrame:
    """Attachments of the organisation graph, written once for the queries that start from them."""
    return i._stage("attached", lambda: _attached(i))


def _effective(i: Inputs) -> DataFrame:
    return cas.effective_rules(attached(i), i.rules, i.implies)


def effective(i: Inputs) -> DataFrame:
    """Rules in force in the organisation graph, written once for the queries that start from them."""
    return i._stage("effective", lambda: _effective(i))


@query("SELECT node_path, rule_id, channel, origin, label FROM attached", LINE, VIA, ATTACHED)
def attachments(i: Inputs) -> DataFrame:
    return _attached(i).select("node_path", "rule_id", "channel", "origin", "label")


@query(
    """SELECT c.source AS node_path, c.target AS site, c.port, r.rule_id FROM (SELECT DISTINCT source, target, port FROM consumes) c
       JOIN attachments_raw r ON r.site_kind = 'port' AND r.site = c.target AND r.port = c.port"""
)
def port_attachments(i: Inputs) -> DataFrame:
    return cas.port_attachments(i.relations_full, i.attachments_raw).select("node_path", "site", "port", "rule_id")


@query("SELECT node_path, rule_id, status FROM effective", *CASCADE, recursive=True)
def effective_rules(i: Inputs) -> DataFrame:
    return _effective(i).drop("graph_id")


HOLDS = (
    "holds",
    """SELECT n.node_path, k.kind FROM nodes n JOIN (SELECT DISTINCT kind FROM rules) k ON
         CASE k.kind WHEN 'bundle' THEN n.type = 'supplier'
              WHEN 'judged' THEN n.node_path IN (SELECT r.source FROM relations r WHERE r.type = 'uses')
                   OR n.node_path IN (SELECT parent_path FROM nodes WHERE type = 'supplier')
                   OR n.node_path IN (SELECT regexp_replace(parent_path, '/.*$', '') FROM nodes WHERE type = 'supplier')
              ELSE TRUE END""",
)
PASSING = (
    "passing",
    "SELECT a.* FROM ranked a JOIN rules k ON k.rule_id = a.rule_id JOIN holds h ON h.node_path = a.node_path AND h.kind = k.kind",
)
GATED = spread(base="passing", gate="JOIN holds h ON h.node_path = s.node_path AND h.kind = r.kind")


def _passes(i: Inputs, rows: DataFrame) -> DataFrame:
    return i._stage("passes", lambda: _pass_rows(i, rows))


def _pass_rows(i: Inputs, rows: DataFrame) -> DataFrame:
    demand = cas.condition_demand(rows, i.rules_when, i.implies)
    return pred.eval_node_predicate(demand, i.nodes, i.relations_full, i.ports, i.nodes.select("graph_id", "node_path", F.lit("").alias("entry")))


@query("SELECT node_path, rule_id, status FROM effective", LINE, VIA, ATTACHED, RANKED, HOLDS, PASSING, GATED, EFFECTIVE, recursive=True)
def effective_rules_conditional(i: Inputs) -> DataFrame:
    rows = attached(i)
    return cas.effective_rules(rows, i.rules_when, i.implies, _passes(i, rows)).drop("graph_id")


CONDITIONS = {
    "uses_or_above": '{"any_of":[{"relations":{"uses":{"target_type":"supplier"}}},{"descendants":{"type":"supplier"}}]}',
    "two_kinds": '{"relations":{"uses":{"target_type":"supplier"},"calls":{"consumes_port":"R"}}}',
    "not_customer": '{"not":{"all_of":[{"relations":{"extends":{}}},{"node":{"has_port":"R"}}]}}',
    "above_ports": '{"descendants":{"has_port":"A","relations":{"emits":{"consumes_port":"N"}}},"node":{"has_mapping":false}}',
    "nothing": '{"any_of":[]}',
}


@query(
    """SELECT node_path, 'uses_or_above' AS name, (type NOT IN ('region', 'nation', 'supplier') AND node_path IN (SELECT source FROM relations WHERE type = 'uses'))
              OR EXISTS (SELECT 1 FROM nodes s WHERE s.type = 'supplier' AND starts_with(s.node_path, concat(n.node_path, '/'))) AS pass FROM nodes n
       UNION ALL SELECT node_path, 'two_kinds', node_path IN (SELECT source FROM relations WHERE type = 'uses')
              AND node_path IN (SELECT source FROM consumes WHERE type = 'calls' AND port = 'R') FROM nodes
       UNION ALL SELECT node_path, 'not_customer', NOT (node_path IN (SELECT source FROM relations WHERE type = 'extends')
              AND node_path IN (SELECT node_path FROM ports WHERE port = 'R')) FROM nodes
       UNION ALL SELECT n.node_path, 'above_ports', EXISTS (SELECT 1 FROM ports p WHERE p.port = 'A' AND starts_with(p.node_path, concat(n.node_path, '/')))
              AND EXISTS (SELECT 1 FROM consumes c WHERE c.type = 'emits' AND c.port = 'N' AND starts_with(c.source, concat(n.node_path, '/'))) FROM nodes n
       UNION ALL SELECT node_path, 'nothing', FALSE FROM nodes"""
)
def eval_node_predicate(i: Inputs) -> DataFrame:
    names = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(c).alias("condition")) for n, c in CONDITIONS.items()]))
    demand = i.nodes.select("graph_id", "node_path", names.alias("c")).select("graph_id", "node_path", "c.*")
    empty = i.nodes.select("graph_id", "node_path", F.lit("").alias("entry"))
    result = pred.eval_node_predicate(demand, i.nodes, i.relations_full, i.ports, empty)
    return shuffled_join(demand, result, ["graph_id", "node_path", "condition"]).select("node_path", "name", "pass")


CYCLE = ("cyclic", "SELECT 'p3' AS rule_id UNION ALL SELECT 'p7'")


@query("SELECT node_path, rule_id, status FROM effective", LINE, VIA, ATTACHED, RANKED, spread("implies_cyclic"), EFFECTIVE, recursive=True)
def effective_rules_cyclic(i: Inputs) -> DataFrame:
    return cas.effective_rules(attached(i), i.rules, i.implies_cyclic).drop("graph_id")


@query(
    "SELECT DISTINCT node_path FROM effective JOIN cyclic ON cyclic.rule_id = effective.rule_id",
    LINE, VIA, ATTACHED, RANKED, spread("implies_cyclic"), EFFECTIVE, CYCLE, recursive=True,
)
def uncomputable_nodes(i: Inputs) -> DataFrame:
    edges = i.implies_cyclic.select("graph_id", F.col("implier").alias("source"), F.col("implied").alias("target"))
    loops = reach.structural_cycles(edges).withColumnRenamed("node", "rule_id")
    return cas.uncomputable_nodes(cas.effective_rules(attached(i), i.rules, i.implies_cyclic), loops).select("node_path")


@query(f"SELECT node_path, rule_id, channel, origin, {NAME.format('rank')} AS declared FROM ranked", LINE, VIA, ATTACHED, RANKED)
def status_sources(i: Inputs) -> DataFrame:
    return cas.status_sources(attached(i), i.rules).drop("graph_id")


@query(
    """SELECT e.node_path, e.rule_id, coalesce(f.label, concat('implied by ''', b.implier, ''''), 'unknown source') AS source
       FROM effective e
       LEFT JOIN (SELECT node_path, rule_id, label FROM attached QUALIFY row_number() OVER (PARTITION BY node_path, rule_id ORDER BY channel, s1, s2, s3) = 1) f
         ON f.node_path = e.node_path AND f.rule_id = e.rule_id
       LEFT JOIN (SELECT implied, arg_min(implier, ord) AS implier FROM implies JOIN rules ON rule_id = implier GROUP BY implied) b ON b.implied = e.rule_id""",
    *CASCADE, recursive=True,
)
def rule_source(i: Inputs) -> DataFrame:
    rows = attached(i)
    return cas.rule_source(rows, effective(i), i.implies, i.rules).drop("graph_id")


@query(
    """SELECT DISTINCT node_path, rule_id FROM attached WHERE channel IN (1, 3)
       EXCEPT SELECT node_path, rule_id FROM effective""",
    LINE, VIA, ATTACHED, RANKED, HOLDS, PASSING, GATED, EFFECTIVE, recursive=True,
)
def not_applicable(i: Inputs) -> DataFrame:
    rows = attached(i)
    return cas.not_applicable(rows, cas.effective_rules(rows, i.rules_when, i.implies, _passes(i, rows))).drop("graph_id")


@query(
    "SELECT rule_id, 'orphan-rule' AS code FROM rules WHERE rule_id NOT IN (SELECT rule_id FROM reached)",
    ("reached", "SELECT DISTINCT rule_id FROM attachments_raw UNION SELECT implied FROM reached JOIN implies ON implier = rule_id"),
    recursive=True,
)
def orphan_rules(i: Inputs) -> DataFrame:
    return cas.orphan_rules(i.rules, i.attachments_raw, i.implies).select("rule_id", "code")


@query(
    f"""SELECT node_path, rule_id, channel, origin, {NAME.format('rank')} AS declared, {NAME.format('anchor')} AS required FROM (
          SELECT a.node_path, a.rule_id, a.channel, a.origin, a.rank, greatest(max(a.dr), coalesce(max(b.rank), 0)) AS anchor
          FROM ranked a LEFT JOIN ranked b ON b.node_path = a.node_path AND b.rule_id = a.rule_id AND b.origin <> a.origin
          WHERE a.status IS NOT NULL GROUP BY a.node_path, a.rule_id, a.channel, a.origin, a.rank) WHERE rank < anchor""",
    LINE, VIA, ATTACHED, RANKED,
)
def status_downgrades(i: Inputs) -> DataFrame:
    return cas.status_downgrades(attached(i), i.rules).drop("graph_id")


@query(
    """SELECT r.rule_id, count(e.node_path) AS n_nodes, count(*) FILTER (via = 'type') AS via_type, count(*) FILTER (via = 'flow') AS via_flow,
              count(*) FILTER (via = 'own') AS via_own, count(*) FILTER (via = 'implied') AS via_implied
       FROM rules r LEFT JOIN (
         SELECT e.node_path, e.rule_id, CASE
           WHEN EXISTS (SELECT 1 FROM attachments_raw a WHERE a.site_kind = 'type' AND a.site = n.type AND a.rule_id = e.rule_id) THEN 'type'
           WHEN EXISTS (SELECT 1 FROM attachments_raw a JOIN flow_nodes f ON f.flow = a.site WHERE a.site_kind = 'flow' AND f.node_path = e.node_path AND a.rule_id = e.rule_id) THEN 'flow'
           WHEN EXISTS (SELECT 1 FROM attachments_raw a WHERE a.site_kind = 'node' AND a.site = e.node_path AND a.rule_id = e.rule_id) THEN 'own'
           ELSE 'implied' END AS via
         FROM effective e JOIN nodes n ON n.node_path = e.node_path) e ON e.rule_id = r.rule_id GROUP BY r.rule_id""",
    *CASCADE, recursive=True,
)
def rule_usage(i: Inputs) -> DataFrame:
    return cas.rule_usage(effective(i), i.nodes, i.attachments_raw, i.flow_nodes, i.rules).drop("graph_id")


# --- integrity -------------------------------------------------------------------------------------------------

# nodes without the suppliers of the first regions, so that references dangle
CUT = ("cut", "SELECT * FROM nodes WHERE NOT (type = 'supplier' AND starts_with(node_path, 'r0/')) AND node_path <> 'r1/n1'")


def _cut(i: Inputs) -> DataFrame:
    return i.nodes.filter("NOT (type = 'supplier' AND startswith(node_path, 'r0/')) AND node_path <> 'r1/n1'")


@query(
    """SELECT r.source AS node_path, r.target, r.type, s.suggestion FROM relations r LEFT JOIN cut n ON n.node_path = r.target
       LEFT JOIN (
         SELECT t.target, min(c.node_path) AS suggestion FROM (SELECT DISTINCT target FROM relations) t
         JOIN (SELECT node_path FROM cut) c ON starts_with(concat(c.node_path, '/'), concat(regexp_replace(t.target, '/[^/]*$', ''), '/')) GROUP BY t.target) s
       ON s.target = r.target WHERE n.node_path IS NULL""",
    CUT,
)
def dangling_relations(i: Inputs) -> DataFrame:
    return chk.dangling_relations(_cut(i), i.relations).select("node_path", "target", "type", "suggestion")


@query(
    """SELECT DISTINCT regexp_replace(c.node_path, '/[^/]*$', '') AS parent, c.node_path AS sibling FROM cut c
       WHERE len(string_split(c.node_path, '/')) = 3 AND regexp_replace(c.node_path, '/[^/]*$', '') IN (
         SELECT regexp_replace(target, '/[^/]*$', '') FROM relations WHERE target NOT IN (SELECT node_path FROM cut))""",
    CUT,
)
def siblings_of_targets(i: Inputs) -> DataFrame:
    return chk.siblings_of_targets(_cut(i), i.relations).select("parent", "sibling")


@query(
    """SELECT source, target, type FROM relations r WHERE type IN ('emits', 'listens') AND NOT EXISTS (
         SELECT 1 FROM both_ways b WHERE b.source = r.target AND b.target = r.source AND b.type <> r.type AND b.type IN ('emits', 'listens'))
       UNION ALL SELECT target, source, 'listens' FROM relations r WHERE type = 'emits' AND NOT EXISTS (
         SELECT 1 FROM relations b WHERE b.source = r.source AND b.target = r.target AND b.type = 'emits')""",
    ("both_ways", "SELECT source, target, type FROM relations UNION ALL SELECT target, source, 'listens' FROM relations WHERE type = 'emits'"),
)
def unpaired_events(i: Inputs) -> DataFrame:
    answer = i.relations.filter("type = 'emits'").select(
        "graph_id", F.col("target").alias("source"), F.col("source").alias("target"), F.lit("listens").alias("type"), "event_name"
    )
    return chk.unpaired_events(i.relations.unionByName(answer)).select("source", "target", "type")


@query("SELECT source AS node_path, count(*) AS n FROM relations GROUP BY source HAVING count(*) > 10")
def high_fan_out(i: Inputs) -> DataFrame:
    return chk.high_fan_out(i.relations).drop("graph_id")


@query("SELECT p_brand AS rule_id, count(*) AS n, min(p_name) AS first_name FROM part GROUP BY p_brand HAVING count(*) > 1")
def duplicate_keys(i: Inputs) -> DataFrame:
    rows = i.base("part").select(F.lit("g0").alias("graph_id"), F.col("p_brand").alias("rule_id"), F.col("p_name").alias("name"))
    return chk.duplicate_keys(rows).drop("graph_id")


@query(
    """SELECT CASE site_kind WHEN 'port' THEN 'port-missing-aspect' ELSE 'aspect-undefined' END AS code, rule_id, concat(site_kind, ':', site) AS what
       FROM attachments_raw WHERE rule_id NOT IN (SELECT rule_id FROM rules WHERE kind <> 'bundle')
       UNION ALL SELECT 'implied-aspect-missing', implied, implier FROM implies WHERE implied NOT IN (SELECT rule_id FROM rules WHERE kind <> 'bundle')"""
)
def dangling_rules(i: Inputs) -> DataFrame:
    return chk.dangling_rules(i.attachments_raw, i.implies, i.rules.filter("kind <> 'bundle'")).select("code", "rule_id", "what")


@query(
    """SELECT DISTINCT 'when-unknown-type' AS code, p_brand AS what FROM part
       UNION ALL SELECT DISTINCT 'when-unknown-node', concat('x', p_size) FROM part
       UNION ALL SELECT DISTINCT 'when-unknown-port', p_type FROM part"""
)
def condition_references(i: Inputs) -> DataFrame:
    text = F.format_string(
        '{"any_of":[{"node":{"type":"%s"}},{"relations":{"uses":{"target":"x%s"},"calls":{"consumes_port":"%s","target_type":"supplier"}}}]}',
        "p_brand", F.col("p_size").cast("string"), "p_type",
    )
    rows = i.base("part").select(F.lit("g0").alias("graph_id"), text.alias("condition"))
    return chk.condition_references(rows, i.types, i.nodes, i.ports).select("code", "what")


@query(
    """SELECT 'type-invalid' AS code, node_path, type AS what FROM nodes WHERE type = 'supplier'
       UNION ALL SELECT 'type-unknown-parent', CAST(NULL AS STRING), concat(type, ' < ', parent) FROM (SELECT DISTINCT type, parent FROM type_parents)
         WHERE type IN (SELECT type FROM type_names WHERE type <> 'supplier') AND parent NOT IN (SELECT type FROM type_names WHERE type <> 'supplier')
       UNION ALL SELECT 'enforce-strict-without-when', CAST(NULL AS STRING), 'region'
       UNION ALL SELECT 'type-without-when-with-mapping', node_path, type FROM nodes WHERE type = 'region'"""
)
def type_model(i: Inputs) -> DataFrame:
    mapped = i.nodes.select("graph_id", "node_path", F.col("name").alias("entry"))
    return chk.type_model(i.nodes, i.types.filter("type <> 'supplier'"), mapped).select("code", "node_path", "what")


ALLOWED = (
    "allowed",
    """SELECT f.type AS from_type, t.type AS to_type, k.rel FROM type_names f CROSS JOIN type_names t
       CROSS JOIN (SELECT unnest(['uses', 'calls', 'extends', 'implements', 'emits', 'listens']) AS rel) k
       WHERE CASE WHEN EXISTS (SELECT 1 FROM type_matrix m WHERE m.type = f.type AND m.rel = k.rel)
             THEN EXISTS (SELECT 1 FROM type_matrix m WHERE m.type = f.type AND m.rel = k.rel AND m.target IN ('*', t.type))
             ELSE length(f.type) <= 8 END""",
)


@query(
    """SELECT f.type AS from_type, t.type AS to_type, coalesce(string_agg(a.rel, ',' ORDER BY list_position(['uses', 'calls', 'extends', 'implements', 'emits', 'listens'], a.rel)), '') AS allowed
       FROM type_names f CROSS JOIN type_names t LEFT JOIN allowed a ON a.from_type = f.type AND a.to_type = t.type GROUP BY ALL""",
    ALLOWED,
)
def allowed_relation_types(i: Inputs) -> DataFrame:
    from attestry.operators.dependencies import allowed_relation_types as allowed

    names = i.type_names
    pairs = names.select("graph_id", F.col("type").alias("from_type")).join(names.select("graph_id", F.col("type").alias("to_type")), "graph_id")
    return allowed(i.types, pairs).select("from_type", "to_type", F.array_join("allowed", ",").alias("allowed"))


@query(
    """SELECT 'relation-target-forbidden' AS code, r.source AS node_path, concat(r.type, ' ', r.target) AS what
       FROM relations r JOIN nodes s ON s.node_path = r.source JOIN nodes t ON t.node_path = r.target
       WHERE NOT EXISTS (SELECT 1 FROM allowed a WHERE a.from_type = s.type AND a.to_type = t.type AND a.rel = r.type)
       UNION ALL SELECT 'parent-type-forbidden', n.node_path, p.type FROM nodes n JOIN nodes p ON p.node_path = n.parent_path
       WHERE n.type IN (SELECT type FROM type_parents WHERE parent IS NOT NULL)
         AND NOT EXISTS (SELECT 1 FROM type_parents x WHERE x.type = n.type AND x.parent = p.type)""",
    ALLOWED,
)
def type_constraints(i: Inputs) -> DataFrame:
    return chk.type_constraints(i.nodes, i.relations, i.types).select("code", "node_path", "what")


@query(
    """SELECT 'port-missing-consumes' AS code, source AS node_path, concat(type, ' ', target) AS what FROM relations r
       WHERE EXISTS (SELECT 1 FROM ports p WHERE p.node_path = r.target AND port <> 'N' AND NOT starts_with(p.node_path, 'r0/'))
         AND NOT EXISTS (SELECT 1 FROM consumes c WHERE c.source = r.source AND c.target = r.target AND c.type = r.type)
       UNION ALL SELECT 'port-undefined', source, concat(type, ' ', target, ' ', port) FROM consumes c WHERE port = 'N' AND NOT starts_with(target, 'r0/')
       UNION ALL SELECT DISTINCT 'consumes-without-ports', source, concat(type, ' ', target) FROM consumes WHERE starts_with(target, 'r0/')"""
)
def port_contracts(i: Inputs) -> DataFrame:
    ports = i.ports.filter("port <> 'N' AND NOT startswith(node_path, 'r0/')")
    return chk.port_contracts(i.relations_full, ports).select("code", "node_path", "what")


@query("SELECT node_path, flow AS what FROM flow_nodes WHERE node_path NOT IN (SELECT node_path FROM cut)", CUT)
def broken_flows(i: Inputs) -> DataFrame:
    return chk.broken_flows(i.flow_nodes, _cut(i)).select("node_path", "what")


@query(
    """SELECT node_path, CAST(NULL AS STRING) AS rule_id, 'node' AS what FROM nodes WHERE trim(description) = ''
       UNION ALL SELECT CAST(NULL AS STRING), CAST(NULL AS STRING), concat('flow ', flow) FROM flows"""
)
def missing_descriptions(i: Inputs) -> DataFrame:
    return chk.missing_descriptions(i.nodes, i.rules, i.flows).select("node_path", "rule_id", "what")


@query(
    """SELECT r.rule_id, u.code FROM (
         SELECT r.rule_id, r.kind, p_size % 2 = 0 AS t, p_size % 3 = 0 AS c, p_size % 5 = 0 AS k, r.rule_id IN (SELECT implier FROM implies) AS imp
         FROM rules r JOIN part ON r.rule_id = concat('p', p_partkey)) r, (SELECT unnest(['aspect-unexpected-rule-source', 'aspect-empty', 'aspect-both-rule-sources',
           'aspect-missing-rule-source', 'aspect-companion-with-check', 'aspect-companion-without-content']) AS code) u
       WHERE CASE u.code
         WHEN 'aspect-unexpected-rule-source' THEN (kind = 'bundle' AND (t OR c)) OR (kind <> 'bundle' AND t AND c) OR (kind = 'judged' AND c AND NOT t) OR (kind = 'computed' AND t AND NOT c)
         WHEN 'aspect-empty' THEN kind = 'bundle' AND NOT imp
         WHEN 'aspect-both-rule-sources' THEN kind <> 'bundle' AND t AND c
         WHEN 'aspect-missing-rule-source' THEN (kind = 'judged' AND NOT t) OR (kind = 'computed' AND NOT c)
         WHEN 'aspect-companion-with-check' THEN kind <> 'bundle' AND k AND c
         ELSE k AND (kind = 'bundle' OR (NOT c AND NOT t)) END"""
)
def rule_sources(i: Inputs) -> DataFrame:
    part = i.base("part").select(F.lit("g0").alias("graph_id"), F.concat(F.lit("p"), "p_partkey").alias("rule_id"), "p_size")
    kinds = F.array_compact(F.array(*[F.when(F.col("p_size") % n == 0, s) for n, s in ((2, "text"), (3, "check"), (5, "companion"))]))
    files = part.select("graph_id", "rule_id", F.explode(kinds).alias("source"))
    return chk.rule_sources(i.rules, files, i.implies).select("rule_id", "code")


@query(
    """SELECT 'aspect-reference-broken' AS code, rule_id, concat('src', p_size, '/en/', p_partkey, '.txt') AS what FROM rules JOIN part ON rule_id = concat('p', p_partkey)
       WHERE kind = 'judged' AND p_size % 4 <> 0 AND concat('src', p_size, '/en/', p_partkey, '.txt') NOT IN (SELECT path FROM files)
       UNION ALL SELECT 'aspect-references-empty-array', rule_id, '' FROM rules JOIN part ON rule_id = concat('p', p_partkey) WHERE kind = 'judged' AND p_size % 4 = 0
       UNION ALL SELECT 'aspect-tier-unknown', rule_id, 'deep' FROM rules WHERE kind = 'judged' AND tier = 'deep'"""
)
def rule_references(i: Inputs) -> DataFrame:
    part = i.base("part").select(F.concat(F.lit("p"), "p_partkey").alias("rule_id"), "p_size", "p_partkey")
    path = F.concat(F.lit("src"), "p_size", F.lit("/en/"), "p_partkey", F.lit(".txt"))
    refs = F.when(F.col("p_size") % 4 == 0, F.array().cast("array<struct<path:string,description:string>>")).otherwise(
        F.array(F.struct(path.alias("path"), F.lit("").alias("description")))
    )
    rules = i.rules.join(part, "rule_id").withColumn("refs", refs)
    return chk.rule_references(rules, i.files, i.tiers.filter("tier = 'standard'")).select("code", "rule_id", "what")


def issues(i: Inputs) -> DataFrame:
    """Issues of the organisation graph, written once for the reports on them."""
    return i._stage("issues", lambda: _issues(i))


def _issues(i: Inputs) -> DataFrame:
    return chk.validate(
        i.nodes, i.relations_full, i.ports, i.types, i.nodes.select("graph_id", "node_path", F.lit("").alias("entry")), i.rules,
        i.implies_cyclic, i.attachments_raw, i.flows, i.flow_nodes,
    )


ISSUES = (
    "issues",
    """SELECT 'error' AS severity, 'relation-target-forbidden' AS code, r.source AS node_path, CAST(NULL AS STRING) AS rule_id, concat(r.type, ' ', r.target) AS what
       FROM relations r JOIN nodes s ON s.node_path = r.source JOIN nodes t ON t.node_path = r.target
       WHERE NOT EXISTS (SELECT 1 FROM allowed a WHERE a.from_type = s.type AND a.to_type = t.type AND a.rel = r.type) AND FALSE
       UNION ALL SELECT 'error', 'enforce-strict-without-when', NULL, NULL, 'region'
       UNION ALL SELECT 'error', 'aspect-implies-cycle', NULL, 'p3', 'p3' UNION ALL SELECT 'error', 'aspect-implies-cycle', NULL, 'p7', 'p3'
       UNION ALL SELECT 'error', 'event-unpaired', source, NULL, concat(type, ' ', target) FROM relations WHERE type IN ('emits', 'listens')
       UNION ALL SELECT 'warning', 'high-fan-out', source, NULL, CAST(count(*) AS STRING) FROM relations GROUP BY source HAVING count(*) > 10
       UNION ALL SELECT 'error', 'port-missing-consumes', source, NULL, concat(type, ' ', target) FROM relations r
         WHERE NOT EXISTS (SELECT 1 FROM consumes c WHERE c.source = r.source AND c.target = r.target AND c.type = r.type)
       UNION ALL SELECT 'warning', 'description-missing', node_path, NULL, 'node' FROM nodes WHERE trim(description) = ''
       UNION ALL SELECT 'warning', 'description-missing', NULL, NULL, concat('flow ', flow) FROM flows""",
)


@query("SELECT severity, code, node_path, rule_id, what FROM issues", ALLOWED, ISSUES)
def validate(i: Inputs) -> DataFrame:
    return _issues(i).drop("graph_id")


@query(
    """SELECT *, CASE code WHEN 'aspect-violation-advisory' THEN 'advisory' WHEN 'aspect-violation-enforced' THEN 'enforced' ELSE code END AS label,
              CASE code WHEN 'unverified' THEN 2 WHEN 'aspect-violation-enforced' THEN 3 ELSE CASE severity WHEN 'error' THEN 10 ELSE 11 END END AS rank
       FROM (SELECT code, group_rule, first(severity ORDER BY coalesce(node_path, ''), what, severity) AS severity, count(*) AS members, count(DISTINCT coalesce(node_path, '')) AS nodes,
                    first(what ORDER BY coalesce(node_path, ''), what, severity) AS shared_what, min(what) <> max(what) AS divergent
             FROM (SELECT *, CASE WHEN code <> 'unverified' THEN rule_id END AS group_rule FROM (
               SELECT * FROM issues
               UNION ALL SELECT CASE WHEN status = 'enforced' THEN 'error' ELSE 'warning' END,
                                CASE WHEN state = 'unverified' THEN 'unverified' WHEN status = 'enforced' THEN 'aspect-violation-enforced' ELSE 'aspect-violation-advisory' END, node_path, rule_id, unit_key
                         FROM states WHERE state <> 'verified')) GROUP BY code, group_rule)""",
    ALLOWED, ISSUES, *STATES,
)
def group_issues(i: Inputs) -> DataFrame:
    return chk.group_issues(issues(i).unionByName(chk.pair_issues(states(i)))).drop("graph_id")


@query("SELECT DISTINCT code, rule_id AS group_rule, node_path, what FROM issues", ALLOWED, ISSUES)
def group_members(i: Inputs) -> DataFrame:
    return chk.group_members(issues(i)).drop("graph_id")


@query(
    """SELECT node_path, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings
       FROM issues WHERE node_path IS NOT NULL GROUP BY node_path""",
    ALLOWED, ISSUES,
)
def summary_by_node(i: Inputs) -> DataFrame:
    return chk.summary_by_node(issues(i)).drop("graph_id")


@query(
    """SELECT code, node_path, rule_id, what, CAST(row_number() OVER (ORDER BY CASE severity WHEN 'error' THEN 10 ELSE 11 END, code,
              rule_id NULLS FIRST, node_path NULLS FIRST, what) AS INT) AS rank FROM issues QUALIFY rank <= 25""",
    ALLOWED, ISSUES,
)
def top_issues(i: Inputs) -> DataFrame:
    return chk.top_issues(issues(i), 25).drop("graph_id", "severity")


@query("SELECT 'aspect-implies-cycle' AS code, '' AS node_path, 'p3' AS rule_id, count(*) FILTER (severity = 'error') AS errors FROM issues", ALLOWED, ISSUES)
def next_action(i: Inputs) -> DataFrame:
    return chk.next_action(issues(i)).drop("graph_id")


# --- reports on the graph -----------------------------------------------------------------------------------------


@query("SELECT t.type, count(n.node_path) AS n_nodes FROM type_names t LEFT JOIN nodes n ON n.type = t.type GROUP BY t.type")
def type_catalogue(i: Inputs) -> DataFrame:
    return rep.type_catalogue(i.types, i.nodes).select("type", "n_nodes")


@query(
    """SELECT source AS node_path, 'out' AS direction, count(*) AS n FROM relations GROUP BY source
       UNION ALL SELECT target, 'in', count(*) FROM relations GROUP BY target"""
)
def hubs(i: Inputs) -> DataFrame:
    return rep.hubs(i.relations).drop("graph_id")


@query("SELECT target AS node_path, source, type FROM relations")
def invert_relations(i: Inputs) -> DataFrame:
    return rep.invert_relations(i.relations).drop("graph_id")


@query(
    """SELECT node_path, 'rule' AS section, rule_id AS item, status AS detail FROM effective WHERE node_path IN (SELECT path FROM suppliers)
       UNION ALL SELECT DISTINCT s.path, 'flow', f.flow, '' FROM suppliers s JOIN flow_nodes f ON starts_with(s.path, concat(f.node_path, '/'))
       UNION ALL SELECT target, 'dependent', source, type FROM relations
       UNION ALL SELECT path, 'parent', regexp_replace(path, '/[^/]*$', ''), '' FROM suppliers""",
    *CASCADE, recursive=True,
)
def node_context(i: Inputs) -> DataFrame:
    targets = i.suppliers.select(F.lit("g0").alias("graph_id"), F.col("path").alias("node_path"))
    none = i.paths.select("graph_id", F.lit("").alias("node_path"), "path")
    sources = i.nodes.select("graph_id", "node_path", F.lit("").alias("rule_id"), F.lit(None).cast("string").alias("source")).filter("rule_id <> ''")
    return rep.node_context(targets, i.nodes, effective(i), sources, i.flow_nodes, i.relations, none).drop("graph_id")


@query(
    """SELECT flow, count(*) AS members FROM (SELECT DISTINCT f.flow, n.node_path FROM flow_nodes f
         JOIN nodes n ON n.node_path = f.node_path OR starts_with(n.node_path, concat(f.node_path, '/'))) GROUP BY flow"""
)
def flow_radius(i: Inputs) -> DataFrame:
    return reach.flow_radius(i.flow_nodes, i.nodes).groupBy("flow").agg(F.count("*").alias("members"))


@query(
    """SELECT DISTINCT a.type, n.node_path FROM nodes a JOIN nodes n ON n.node_path = a.node_path OR starts_with(n.node_path, concat(a.node_path, '/'))"""
)
def type_radius(i: Inputs) -> DataFrame:
    return reach.type_radius(i.nodes).drop("graph_id")


@query(
    """SELECT rule_id, node_path AS item, 'node' AS why FROM effective UNION SELECT implied, implier, 'implier' FROM implies""",
    *CASCADE, recursive=True,
)
def rule_radius(i: Inputs) -> DataFrame:
    return reach.rule_radius(effective(i), i.rules, i.implies).drop("graph_id")
