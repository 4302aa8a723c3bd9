"""Queries on reachability, waivers, journals and code dependencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.functions.text import json_string
from attestry.operators import dependencies as dep
from attestry.operators import hooks
from attestry.operators import journals as jou
from attestry.operators import ownership as own
from attestry.operators import reach
from attestry.operators import visibility as vis
from attestry.operators import waivers as wai
from attestry.operators.search import search as ranked_search
from attestry.plans.cascade_queries import CASCADE, effective
from attestry.plans.inputs import Inputs
from attestry.plans.registry import query
from attestry.streaming.streams import screen_entries

BACK = ("back", "SELECT DISTINCT target AS src, source AS node FROM part_edges WHERE type IN ('uses', 'calls', 'extends', 'implements')")


@query(
    "SELECT target, node AS node_path, CAST(min(depth) AS INT) AS depth FROM walk GROUP BY ALL",
    BACK, ("walk", "SELECT src AS target, node, 1 AS depth FROM back UNION SELECT w.target, b.node, w.depth + 1 FROM walk w JOIN back b ON b.src = w.node"),
    recursive=True,
)
def reverse_dependents(i: Inputs) -> DataFrame:
    return reach.reverse_dependents(i.part_edges, i.part_nodes).drop("graph_id")


@query(
    "SELECT target, node AS node_path, chain, CAST(depth AS INT) AS depth FROM walk WHERE depth > 1",
    BACK,
    ("walk", """SELECT src AS target, node, concat(src, ' <- ', node) AS chain, 1 AS depth FROM back
                UNION SELECT w.target, b.node, concat(w.chain, ' <- ', b.node), w.depth + 1 FROM walk w JOIN back b ON b.src = w.node"""),
    recursive=True,
)
def dependency_chains(i: Inputs) -> DataFrame:
    return reach.dependency_chains(i.part_edges, i.part_nodes).drop("graph_id")


@query(
    """SELECT node AS node_path, chain, CAST(depth AS INT) AS depth FROM walk
       QUALIFY row_number() OVER (PARTITION BY node ORDER BY depth, chain) = 1""",
    ("seeds", "SELECT concat('p', p_partkey) AS node FROM part WHERE p_type = 'PROMO'"),
    ("walk", """SELECT e.source AS node, concat(e.target, ' <- ', e.source) AS chain, 1 AS depth FROM part_edges e WHERE e.target IN (SELECT node FROM seeds) AND e.source NOT IN (SELECT node FROM seeds)
                UNION SELECT e.source, concat(w.chain, ' <- ', e.source), w.depth + 1 FROM walk w JOIN part_edges e ON e.target = w.node WHERE e.source NOT IN (SELECT node FROM seeds)"""),
    recursive=True,
)
def indirect_dependents(i: Inputs) -> DataFrame:
    seeds = i.base("part").filter("p_type = 'PROMO'").select(F.lit("g0").alias("graph_id"), F.concat(F.lit("p"), "p_partkey").alias("node_path"))
    return reach.indirect_dependents(i.part_edges, seeds).drop("graph_id")


@query(
    "SELECT a AS node, min(b) AS component FROM (SELECT a, b FROM walk WHERE (b, a) IN (SELECT (a, b) FROM walk)) GROUP BY a",
    ("walk", "SELECT source AS a, target AS b FROM referrals UNION SELECT w.a, r.target FROM walk w JOIN referrals r ON r.source = w.b"),
    recursive=True,
)
def structural_cycles(i: Inputs) -> DataFrame:
    return reach.structural_cycles(i.referrals).drop("graph_id")


@query(
    """SELECT type, 'type-parent-trapped' AS code FROM (SELECT DISTINCT type FROM type_parents) WHERE type NOT IN (SELECT type FROM free)
         AND type NOT IN (SELECT type FROM type_parents WHERE parent IS NOT NULL AND parent NOT IN (SELECT type FROM type_parents))""",
    ("free", """SELECT type FROM (SELECT type, count(parent) AS n FROM type_parents GROUP BY type) WHERE n = 0
                UNION SELECT p.type FROM free f JOIN type_parents p ON p.parent = f.type"""),
    recursive=True,
)
def trapped_types(i: Inputs) -> DataFrame:
    return reach.trapped_types(i.type_parents).select("type", "code")


@query("SELECT target, source AS node_path, type FROM relations WHERE type IN ('emits', 'listens')")
def event_dependents(i: Inputs) -> DataFrame:
    targets = i.suppliers.select(F.lit("g0").alias("graph_id"), F.col("path").alias("node_path"))
    return reach.event_dependents(i.relations, targets).select("target", "node_path", "type")


RARE = ("rare", "SELECT node_path, rule_id FROM effective WHERE rule_id IN (SELECT rule_id FROM effective GROUP BY rule_id HAVING count(*) <= 20)")


@query(
    "SELECT a.node_path AS target, b.node_path, a.rule_id AS shared FROM rare a JOIN rare b ON b.rule_id = a.rule_id AND b.node_path <> a.node_path",
    *CASCADE, RARE, recursive=True,
)
def co_rule_nodes(i: Inputs) -> DataFrame:
    return reach.co_rule_nodes(effective(i), i.nodes).drop("graph_id")


@query(
    """SELECT DISTINCT concat('q', doc_id % 7) AS rule_id, concat('q/', quality) AS node_path FROM labels WHERE toxic = 1"""
)
def refused_nodes(i: Inputs) -> DataFrame:
    docs = i.files.join(i.base("labels"), "doc_id")
    rows = docs.select(
        "graph_id", F.concat(F.lit("q"), F.col("doc_id") % 7).alias("rule_id"), F.concat(F.lit("file:"), "path").alias("unit_key"),
        F.when(F.col("toxic") == 1, "refused").otherwise("approved").alias("verdict"),
    )
    return reach.refused_nodes(rows, i.label_mappings).drop("graph_id")


REACHING = (
    "reaching",
    """SELECT DISTINCT target, source AS node FROM relations WHERE type IN ('uses', 'calls', 'extends', 'implements')
       UNION SELECT w.target, r.source FROM reaching w JOIN relations r ON r.target = w.node AND r.type IN ('uses', 'calls', 'extends', 'implements')""",
)


@query(
    """SELECT target, why, count(*) AS n FROM (
         SELECT target, node, 'dependent' AS why FROM reaching
         UNION SELECT site, node_path, 'descendant' FROM line WHERE dist > 0
         UNION SELECT target, source, 'event' FROM relations WHERE type IN ('emits', 'listens')
         UNION SELECT e.source, l.source, 'event' FROM relations e JOIN relations l ON l.target = e.target AND l.type = 'listens' AND l.source <> e.source WHERE e.type = 'emits'
         UNION SELECT node_path, concat('flow:', flow), 'flow' FROM flow_nodes
         UNION SELECT a.node_path, b.node_path, 'rule' FROM rare a JOIN rare b ON b.rule_id = a.rule_id AND b.node_path <> a.node_path
       ) GROUP BY target, why""",
    *CASCADE, RARE, REACHING, recursive=True,
)
def blast_radius(i: Inputs) -> DataFrame:
    return reach.radius_totals(reach.blast_radius(i.relations, i.nodes, i.nodes, i.flow_nodes, effective(i))).drop("graph_id")


# --- waivers ----------------------------------------------------------------------------------------------------


def marker_text(i: Inputs) -> DataFrame:
    """One text per user with a marker on every line."""
    word = F.when(F.col("kind") == "single", "waive").otherwise(F.concat(F.lit("waive-"), "kind"))
    line = F.concat(F.lit("# "), word, F.lit("( "), "rule_id", F.lit(" , x) "), F.when(F.col("kind") != "enable", F.col("reason")).otherwise(F.lit("")))
    rows = i.markers.groupBy("graph_id", "file").agg(F.array_sort(F.collect_list(F.struct("line", line.alias("t")))).alias("l"))
    return rows.select("graph_id", F.col("file").alias("path"), F.array_join(F.transform("l", lambda s: s["t"]), "\n").alias("content"))


@query(
    """SELECT file, line, unnest([rule_id, 'x']) AS rule_id, kind, CASE kind WHEN 'enable' THEN '' ELSE trim(reason) END AS reason FROM markers"""
)
def marker_scan(i: Inputs) -> DataFrame:
    return wai.marker_scan(marker_text(i)).select("file", "line", "rule_id", "kind", "reason")


@query("SELECT file, line, rule_id FROM markers WHERE kind <> 'enable' AND reason = ''")
def waiver_faults(i: Inputs) -> DataFrame:
    return wai.waiver_faults(i.markers).select("file", "line", "rule_id")


SPANS = (
    "spans",
    """SELECT file, rule_id, line + 1 AS start_line, line + 1 AS end_line, wildcard FROM markers WHERE kind = 'single'
       UNION ALL
       SELECT file, rule_id, min(line) + 1, coalesce(any_value(nxt) - 1, any_value(total_lines)), wildcard FROM (
         SELECT d.file, d.rule_id, d.line, d.wildcard, total_lines,
                (SELECT min(e.line) FROM markers e WHERE e.file = d.file AND e.rule_id = d.rule_id AND e.kind = 'enable' AND e.line > d.line) AS nxt
         FROM markers d JOIN marker_files m ON m.file = d.file WHERE d.kind = 'disable') GROUP BY file, rule_id, wildcard, nxt""",
)


@query("SELECT file, rule_id, start_line, end_line, wildcard FROM spans", SPANS)
def waived_ranges(i: Inputs) -> DataFrame:
    return wai.waived_ranges(i.markers, i.marker_files).drop("graph_id")


@query(
    """SELECT rule_id, unit_key, file, line, message, count(*) AS n FROM findings f WHERE NOT EXISTS (
         SELECT 1 FROM spans s WHERE s.file = f.file AND f.line BETWEEN s.start_line AND s.end_line AND (s.wildcard OR s.rule_id = f.rule_id)) GROUP BY ALL""",
    SPANS,
)
def drop_waived(i: Inputs) -> DataFrame:
    left = wai.drop_waived(i.findings, wai.waived_ranges(i.markers, i.marker_files))
    return left.groupBy("rule_id", "unit_key", "file", "line", "message").agg(F.count("*").alias("n"))


OPEN = (
    "open_marks",
    """SELECT file, rule_id, line FROM (
         SELECT *, min(s) OVER (PARTITION BY file, rule_id ORDER BY line ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM (
           SELECT *, sum(CASE kind WHEN 'disable' THEN 1 ELSE -1 END) OVER (PARTITION BY file, rule_id ORDER BY line) AS s FROM markers WHERE kind <> 'single'))
       WHERE kind = 'disable' AND (later IS NULL OR later >= s)""",
)


@query("SELECT file, rule_id, line FROM open_marks", OPEN)
def unclosed_waivers(i: Inputs) -> DataFrame:
    return wai.unclosed_waivers(i.markers).select("file", "rule_id", "line")


@query(
    """SELECT m.file, m.line, m.rule_id, CASE WHEN wildcard THEN 'wildcard' WHEN r.rule_id IS NULL THEN 'typo' WHEN r.status = 'draft' THEN 'inert'
              WHEN m.kind = 'disable' AND o.line IS NOT NULL THEN 'unbounded' END AS risk
       FROM markers m LEFT JOIN (SELECT * FROM rules WHERE kind <> 'bundle') r ON r.rule_id = m.rule_id
       LEFT JOIN open_marks o ON o.file = m.file AND o.rule_id = m.rule_id AND o.line = m.line WHERE m.kind <> 'enable'""",
    OPEN,
)
def waiver_risk(i: Inputs) -> DataFrame:
    return wai.waiver_risk(i.markers, i.rules.filter("kind <> 'bundle'")).select("file", "line", "rule_id", "risk")


# --- journals -----------------------------------------------------------------------------------------------------

TEXTS = (
    "entries",
    """SELECT node_path, pos, ts, body, CAST(sum(n) OVER (PARTITION BY node_path ORDER BY pos) - n AS BIGINT) AS start,
              CAST(sum(n) OVER (PARTITION BY node_path ORDER BY pos) AS BIGINT) AS "end"
       FROM (SELECT node_path, pos, ts, concat(body, chr(10)) AS body, strlen(concat('## [', ts, ']', chr(10), body, chr(10))) AS n FROM journal_entries)""",
)
WHOLE = ("whole", "SELECT node_path, string_agg(concat('## [', ts, ']', chr(10), body, chr(10)), '' ORDER BY pos) AS content FROM journal_entries GROUP BY node_path")


@query('SELECT node_path, pos, ts, body, start, "end" FROM entries', TEXTS)
def journal_split(i: Inputs) -> DataFrame:
    return jou.journal_split(i.journals).select("node_path", "pos", "ts", "body", "start", "end")


FAULTS = (
    "faults",
    """SELECT node_path, pos, ts, 'out_of_order' AS reason FROM (SELECT *, lag(ts) OVER (PARTITION BY node_path ORDER BY pos) AS p FROM journal_entries) WHERE ts <= p
       UNION ALL SELECT node_path, pos, ts, 'duplicate_datetime' FROM (SELECT *, row_number() OVER (PARTITION BY node_path, ts ORDER BY pos) AS k FROM journal_entries) WHERE k > 1""",
)


@query("SELECT node_path, pos, ts, reason FROM faults", FAULTS)
def journal_order(i: Inputs) -> DataFrame:
    return jou.journal_order(i.journal_entries).select("node_path", "pos", "ts", "reason")


ROUGH = (
    "rough",
    """SELECT *, CAST(sum(n) OVER (PARTITION BY node_path ORDER BY pos) - n + 1 + CASE length(node_path) WHEN 3 THEN 1 ELSE 0 END AS BIGINT) AS line FROM rough_entries""",
)


@query(
    """SELECT node_path, line, 'invalid_datetime' AS reason FROM rough WHERE k = 0
       UNION ALL SELECT node_path, line, 'invalid_header' FROM rough WHERE k = 1
       UNION ALL SELECT node_path, line + 1, 'level2_header_in_body' FROM rough WHERE k = 2
       UNION ALL SELECT DISTINCT node_path, 1, 'invalid_start' FROM rough WHERE length(node_path) = 3
       UNION ALL SELECT node_path, max(line + n), 'unclosed_code_fence' FROM rough WHERE node_path LIKE '%7' GROUP BY node_path
       UNION ALL SELECT node_path, line, 'out_of_order' FROM (SELECT *, lag(ts) OVER (PARTITION BY node_path ORDER BY pos) AS p FROM rough WHERE k > 1) WHERE ts <= p
       UNION ALL SELECT node_path, line, 'duplicate_datetime' FROM (SELECT *, row_number() OVER (PARTITION BY node_path, ts ORDER BY pos) AS c FROM rough WHERE k > 1) WHERE c > 1""",
    ROUGH,
)
def journal_format(i: Inputs) -> DataFrame:
    return jou.journal_format(i.rough_journals).select("node_path", "line", "reason")


@query(
    """SELECT node_path, CAST(row_number() OVER (PARTITION BY node_path ORDER BY pos) AS BIGINT) AS pos, line,
              CASE k WHEN 0 THEN substr(ts, 1, 10) WHEN 1 THEN 'soon' ELSE ts END AS ts FROM rough""",
    ROUGH,
)
def journal_headers(i: Inputs) -> DataFrame:
    """Headers of texts with fences, bad headers and stray lines."""
    lines = jou.journal_lines(i.rough_journals)
    return lines.filter("ts <> '' AND NOT fenced").select("node_path", "pos", "line", "ts")


@query("SELECT j.node_path, arg_max(ts, pos) AS ts, sha256(any_value(content)) AS prefix_hash FROM journal_entries j JOIN whole w ON w.node_path = j.node_path GROUP BY j.node_path", WHOLE)
def latest_entry(i: Inputs) -> DataFrame:
    return jou.latest_entry(i.journals, jou.journal_split(i.journals)).drop("graph_id")


@query("SELECT node_path, pos, ts FROM journal_entries QUALIFY row_number() OVER (PARTITION BY node_path ORDER BY pos DESC) <= 10")
def recent_entries(i: Inputs) -> DataFrame:
    return jou.recent_entries(i.journal_entries).select("node_path", "pos", "ts")


@query(
    """SELECT node_path, CASE WHEN length(node_path) = 2 THEN 'boundary_missing' ELSE 'prefix_modified' END AS reason
       FROM (SELECT node_path, arg_max(ts, pos) AS ts, max(pos) AS last FROM journal_entries GROUP BY node_path) l
       WHERE length(node_path) < 4
          -- a time that came twice binds to its first entry, whose prefix is not that of the last
          OR EXISTS (SELECT 1 FROM journal_entries e WHERE e.node_path = l.node_path AND e.ts = l.ts AND e.pos < l.last)"""
)
def journal_integrity(i: Inputs) -> DataFrame:
    n = F.length("node_path")
    split = jou.journal_split(i.journals)
    facts = jou.latest_entry(i.journals, split).select(
        "graph_id", "node_path", F.when(n == 2, "1999-01-01T00:00:00.000Z").otherwise(F.col("ts")).alias("last_ts"),
        F.when(n == 3, F.reverse("prefix_hash")).otherwise(F.col("prefix_hash")).alias("prefix_hash"),
    )
    return jou.journal_integrity(i.journals, split, facts).drop("graph_id")


@query("SELECT node_path, 'log-entry-missing' AS code FROM (SELECT DISTINCT node_path FROM journal_entries) WHERE length(node_path) = 3")
def journal_gate(i: Inputs) -> DataFrame:
    nodes = i.journals.select("graph_id", "node_path", F.when(F.length("node_path") == 4, "free").otherwise("kept").alias("type"))
    types = nodes.select("graph_id", "type").distinct().withColumn("log_required", F.col("type") == "kept")
    prints = nodes.select("graph_id", "node_path", F.lit("new").alias("fingerprint"))
    latest = jou.latest_entry(i.journals, i._stage("journal_split", lambda: jou.journal_split(i.journals)))
    facts = latest.select("graph_id", "node_path", F.lit("old").alias("source"), F.when(F.length("node_path") == 3, F.col("ts")).otherwise("x").alias("last_ts"))
    return jou.journal_gate(nodes, types, prints, latest, facts).select("node_path", "code")


@query(
    """SELECT node_path, 'entry_missing' AS reason, '2030-01-01T00:00:00.002Z' AS ts FROM whole WHERE length(node_path) = 2
       UNION ALL SELECT node_path, 'entry_invented', '2030-01-01T00:00:00.003Z' FROM whole WHERE length(node_path) = 3
       UNION ALL SELECT node_path, 'prefix_broken', '' FROM whole WHERE length(node_path) = 4""",
    WHOLE,
)
def merge_journals(i: Inputs) -> DataFrame:
    one = lambda k: F.lit(f"## [2030-01-01T00:00:00.00{k}Z]\nnote {k}\n")
    base, n = F.col("content"), F.length("node_path")
    merged = (
        F.when(n == 2, F.concat(base, one(1))).when(n == 3, F.concat(base, one(1), one(2), one(3)))
        .otherwise(F.concat(F.lit("## [2020-01-01T00:00:00.000Z]\nx\n"), base))
    )
    rows = i.journals.select("graph_id", "node_path", base.alias("base"), F.concat(base, one(1)).alias("left"), F.concat(base, one(2)).alias("right"), merged.alias("merged"))
    return jou.merge_journals(rows).drop("graph_id")


@query(
    """SELECT conv_id, turn, CASE WHEN role = 'user' AND conv_id % 3 = 0 THEN 'level2_header' END AS fault FROM conversations"""
)
def screen_journal_entries(i: Inputs) -> DataFrame:
    head = F.when(F.col("conv_id") % 3 == 0, "## head\n").otherwise("```\n## fenced\n```\n")
    body = F.concat(F.when(F.col("role") == "user", head).otherwise("ok\n"), F.regexp_replace("text", "(?m)^(#|`)", "_"))
    rows = i.base("conversations").select("conv_id", "turn", body.alias("body"))
    return screen_entries(rows).select("conv_id", "turn", "fault")


# --- dependencies ---------------------------------------------------------------------------------------------------


@query("SELECT DISTINCT source, target FROM code_edges")
def detected_edges(i: Inputs) -> DataFrame:
    return dep.detected_edges(i.code_edges).drop("graph_id")


BAD = (
    "bad",
    """SELECT DISTINCT source, target, file, line FROM code_edges e WHERE NOT EXISTS (SELECT 1 FROM declared d WHERE d.source = e.source AND d.target = e.target)
         AND NOT EXISTS (SELECT 1 FROM declared d WHERE d.source = e.source AND d.target = regexp_replace(e.target, '/[^/]*$', ''))""",
)


@query("SELECT source, target, file, line FROM bad", BAD)
def undeclared_dependencies(i: Inputs) -> DataFrame:
    return dep.undeclared_dependencies(i.code_edges, i.declared).drop("graph_id")


@query(
    """SELECT DISTINCT source, target, 'undeclared' AS class FROM bad
       UNION ALL SELECT DISTINCT d.source, d.target, 'declared-only' FROM declared d JOIN nodes n ON n.node_path = d.target
         WHERE (d.source, d.target) NOT IN (SELECT (source, target) FROM code_edges) AND NOT starts_with(d.source, concat(d.target, '/'))
       UNION ALL SELECT DISTINCT e.source, e.target, 'forbidden-type' FROM code_edges e JOIN nodes s ON s.node_path = e.source JOIN nodes t ON t.node_path = e.target
         WHERE length(s.type) > 8 AND NOT EXISTS (SELECT 1 FROM type_matrix m WHERE m.type = s.type AND m.rel IN ('uses', 'calls', 'extends', 'implements') AND m.target IN ('*', t.type))""",
    BAD,
)
def boundary_report(i: Inputs) -> DataFrame:
    return dep.boundary_report(i.nodes, i.declared, i.code_edges, i.types).drop("graph_id")


@query(
    """SELECT p_type AS language, p_name AS symbol, count(DISTINCT p_brand) AS n_files, min(p_brand) AS file FROM part GROUP BY ALL"""
)
def unique_symbols(i: Inputs) -> DataFrame:
    rows = i.base("part").select(F.lit("g0").alias("graph_id"), F.col("p_type").alias("language"), F.col("p_name").alias("symbol"), F.col("p_brand").alias("file"))
    return dep.unique_symbols(rows).drop("graph_id")


def customer_code(i: Inputs) -> DataFrame:
    """Python sources of all customers, which import the suppliers they buy from, and of all suppliers."""
    module = F.translate(F.regexp_replace("target", "^g", ""), "/", ".")
    line = F.when(F.col("type") == "uses", F.concat(F.lit("import "), module)).when(
        F.col("type") == "calls", F.concat(F.lit("from "), module, F.lit(" import thing as t  # import r0.n0.s0"))
    ).otherwise(F.concat(F.lit("text = '''\nimport "), module, F.lit("\n'''")))
    body = i.relations.groupBy("graph_id", "source").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("content"))
    users = body.select("graph_id", F.concat("source", F.lit(".py")).alias("path"), "content")
    return users.unionByName(i.suppliers.select(F.lit("g0").alias("graph_id"), F.concat("path", F.lit(".py")).alias("path"), F.lit("thing = 1\n").alias("content")))


@query("SELECT DISTINCT source, target FROM relations WHERE type IN ('uses', 'calls')")
def code_dependencies(i: Inputs) -> DataFrame:
    files = i._stage("customer_code", lambda: customer_code(i))
    facts = i._stage("customer_facts", lambda: dep.extract_imports(files))
    uses = dep.uses_of(facts)
    owners = files.select("graph_id", "path", F.regexp_replace("path", r"\.py$", "").alias("node_path"))
    targets = dep.probe_module_paths(uses, files)
    symbols = dep.unique_symbols(facts.filter("fact = 'declaration'").withColumnRenamed("spec", "symbol"))
    found = dep.resolve_candidates(uses, symbols, targets, owners)
    return dep.detected_edges(dep.code_edges(found, owners)).drop("graph_id")


@query(
    """SELECT source AS file, CASE type WHEN 'uses' THEN replace(target, '/', '.') ELSE replace(target, '/', '.') END AS spec FROM relations WHERE type = 'uses'
       UNION ALL SELECT source, replace(target, '/', '.') FROM relations WHERE type = 'calls' UNION ALL SELECT source, concat(replace(target, '/', '.'), '.thing') FROM relations WHERE type = 'calls'"""
)
def extract_imports(i: Inputs) -> DataFrame:
    files = i._stage("customer_code", lambda: customer_code(i))
    return dep.extract_imports(files).filter("fact = 'use'").select(F.regexp_replace("file", r"\.py$", "").alias("file"), "spec")


@query("SELECT path AS file, length(content) AS n FROM files")
def incremental_facts(i: Inputs) -> DataFrame:
    files = i.files.withColumn("language", F.lit("text"))
    extract = lambda df: df.select("graph_id", F.col("path").alias("file"), F.length("content").alias("n"))
    keyed = dep.fact_keys(files.filter("lang = 'en'"), "1")
    cache = keyed.select("fact_key", F.length("content").alias("n")).distinct()
    return dep.incremental_facts(files, cache, extract, "1")[0].select("file", "n")


@query("SELECT path, 'cached-only' AS side FROM files WHERE lang = 'en' UNION ALL SELECT path, 'fresh-only' FROM files WHERE lang = 'fr'")
def audit_cache(i: Inputs) -> DataFrame:
    rows = i.files.select("path", "lang")
    return dep.audit_cache(rows.filter("lang <> 'fr'"), rows.filter("lang <> 'en'")).select("path", "side")


@query(
    """SELECT p.p_partkey AS use_id, s.symbol, CAST(row_number() OVER (PARTITION BY p.p_partkey ORDER BY s.symbol) AS INT) AS pos FROM part p
       JOIN (SELECT DISTINCT p_type, p_size % 10 AS n, concat(p_brand, '.Name', p_size % 10) AS symbol, p_brand FROM part WHERE p_partkey % 3 > 0) s ON s.p_type = p.p_type AND s.n = p.p_size % 10
       WHERE EXISTS (SELECT 1 FROM part f WHERE f.p_type = s.p_type AND f.p_brand = s.p_brand AND f.p_size > 25)"""
)
def global_imports(i: Inputs) -> DataFrame:
    part = i.base("part").withColumns({"graph_id": F.lit("g0"), "language": F.col("p_type"), "name": F.concat(F.lit("Name"), F.col("p_size") % 10)})
    own_candidate = F.struct(F.lit("symbol").alias("kind"), F.concat(F.lit("own."), "name").alias("spec"), F.lit(False).alias("is_package"))
    uses = part.select("graph_id", "language", F.col("p_partkey").alias("use_id"), F.array(own_candidate).alias("candidates"))
    facts = part.filter("p_size > 25").select("graph_id", "language", F.col("p_brand").alias("spec"))
    symbols = part.filter("p_partkey % 3 > 0").select("graph_id", "language", F.concat("p_brand", F.lit("."), "name").alias("symbol"))
    return dep.global_imports(facts, uses, symbols).select("use_id", "symbol", "pos")


_TERMS = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}_]+'), lambda t: t <> '')"
SEARCH = (
    ("fields", " UNION ALL ".join(
        f"SELECT lang AS graph_id, concat(source, '/', lang, '/', doc_id, '.txt') AS doc, '{field}' AS field, {boost} AS boost, {_TERMS.format(column)} AS terms FROM documents"
        for field, column, boost in (("name", "concat(source, '/', lang, '/', doc_id, '.txt')", 2.0), ("description", "lang", 3.0), ("body", "text", 1.0))
    )),
    ("post", "SELECT graph_id, doc, field, boost, any_value(len(terms)) AS len, term, count(*) AS tf FROM (SELECT *, unnest(terms) AS term FROM fields) GROUP BY graph_id, doc, field, boost, term"),
    ("average", "SELECT graph_id, field, avg(len(terms)) AS avg_len, count(*) AS n_docs FROM fields GROUP BY graph_id, field"),
    ("vocab", "SELECT graph_id, term, field, boost, count(*) AS df FROM post GROUP BY ALL"),
    ("asked", f"SELECT DISTINCT item_id AS query_id, unnest({_TERMS.format('text')}) AS q FROM benchmark"),
    # levenshtein counts bytes there: letters beyond ASCII, which these terms have in small form, become capitals
    ("near", """SELECT q, term, max(CASE WHEN term = q THEN 1.0 ELSE greatest(CASE WHEN starts_with(term, q) THEN 0.375 * length(q) / length(term) ELSE 0 END,
                  CASE WHEN abs(length(q) - length(term)) <= round(length(q) * 0.2) AND levenshtein(translate(q, 'äöüßàâçéèêëîïôùûñíóáú', 'ABCDEFGHIJKLMNOPQRSTU'), translate(term, 'äöüßàâçéèêëîïôùûñíóáú', 'ABCDEFGHIJKLMNOPQRSTU')) <= round(length(q) * 0.2)
                       THEN 0.45 * length(term) / (length(term) + levenshtein(translate(q, 'äöüßàâçéèêëîïôùûñíóáú', 'ABCDEFGHIJKLMNOPQRSTU'), translate(term, 'äöüßàâçéèêëîïôùûñíóáú', 'ABCDEFGHIJKLMNOPQRSTU'))) ELSE 0 END) END) AS w
                FROM (SELECT DISTINCT q FROM asked) JOIN (SELECT DISTINCT term FROM vocab) ON starts_with(term, q) OR abs(length(q) - length(term)) <= round(length(q) * 0.2) GROUP BY q, term"""),
    ("weighted", """SELECT v.graph_id, n.q, n.term, v.field, a.avg_len, n.w * v.boost * ln(1 + (a.n_docs - v.df + 0.5) / (v.df + 0.5)) AS w
                    FROM near n JOIN vocab v ON v.term = n.term JOIN average a ON a.graph_id = v.graph_id AND a.field = v.field WHERE n.w > 0"""),
    ("per_word", """SELECT p.graph_id, w.q, p.doc, sum(w.w * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * p.len / greatest(w.avg_len, 1.0)))) AS s, min(p.term) AS shown
                    FROM post p JOIN weighted w ON w.graph_id = p.graph_id AND w.term = p.term AND w.field = p.field GROUP BY ALL"""),
    ("scored", """SELECT p.graph_id, a.query_id, p.doc, round(sum(p.s), 6) AS raw, array_to_string(list_sort(list_distinct(list(p.shown))), ' ') AS terms
                  FROM per_word p JOIN asked a ON a.q = p.q GROUP BY ALL"""),
    ("placed", "SELECT *, row_number() OVER (PARTITION BY graph_id, query_id ORDER BY raw DESC, doc) AS rank, max(raw) OVER (PARTITION BY graph_id, query_id) AS top FROM scored"),
)


@query("SELECT graph_id, query_id, doc, CAST(rank AS INT) AS rank, round(raw / top, 2) AS score, terms FROM placed WHERE rank <= 5", *SEARCH)
def search(i: Inputs) -> DataFrame:
    docs = i.files.select(F.col("lang").alias("graph_id"), F.col("path").alias("doc"), F.col("path").alias("name"), F.col("lang").alias("description"), F.col("content").alias("body"))
    graphs = i.base("documents").select(F.col("lang").alias("graph_id")).distinct()
    asked = i.base("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return ranked_search(docs, graphs.crossJoin(asked))  # one row for each language and query


@query(
    """SELECT conv_id, turn, vote_no, CASE role WHEN 'user' THEN vote_no < 9 ELSE FALSE END AS satisfied FROM conversations, (SELECT unnest(range(3)) AS vote_no)"""
)
def run_judges(i: Inputs) -> DataFrame:
    rows = i.base("conversations").select(
        F.lit("g0").alias("graph_id"), F.col("conv_id").cast("string").alias("rule_id"), F.col("turn").cast("string").alias("unit_key"),
        F.concat(F.col("role"), F.lit(": "), "text").alias("text"),
    )

    def judge(text: str) -> str:
        return '{"satisfied": %s, "reason": "seen"}' % str(text.startswith("user:")).lower()

    replies = hooks.run_judges(rows, judge, 3)
    read = hooks.parse_judgements(replies, "reply")
    return read.select(F.col("rule_id").cast("long").alias("conv_id"), F.col("unit_key").cast("long").alias("turn"), "vote_no", "satisfied")


# ancestors of the nodes, scope rows and pairs of who sees whom in the organisation graph, every relation included
SCOPED = (
    ("parts", "SELECT node_path, type, parent_path, string_split(node_path, '/') AS p FROM nodes"),
    ("ups", "SELECT node_path, type, parent_path, unnest([array_to_string(p[1:k], '/') FOR k IN range(1, len(p) + 1)]) AS top FROM parts"),
    ("numbered", "SELECT node_path, first, first + (SELECT count(*) FROM ups u WHERE u.top = l.node_path) - 1 AS last FROM (SELECT node_path, row_number() OVER (ORDER BY replace(node_path, '/', chr(1))) AS first FROM nodes) l"),
    ("scoped", """SELECT node_path, top, bool_or(whole) AS whole FROM (SELECT node_path, top, top = node_path AS whole FROM ups
                  UNION ALL SELECT source, target, TRUE FROM relations) GROUP BY ALL"""),
    ("sees", "SELECT DISTINCT s.node_path, u.node_path AS visible_node, u.type, u.parent_path FROM scoped s JOIN ups u ON u.top = s.top WHERE s.whole OR u.node_path = s.top"),
)


@query(
    """SELECT s.node_path, s.top, s.whole, a.first, CASE WHEN s.whole THEN a.last ELSE a.first END AS last FROM scoped s JOIN numbered a ON a.node_path = s.top
       WHERE NOT EXISTS (SELECT 1 FROM scoped c WHERE c.node_path = s.node_path AND c.whole AND starts_with(s.top, concat(c.top, '/')))""",
    *SCOPED,
)
def visible_stretches(i: Inputs) -> DataFrame:
    return vis.numbered_stretches(vis.scope_rows(i.nodes, i.relations), vis.tree_labels(i.nodes)).drop("graph_id")


ASKS = (
    "asks",
    """SELECT node_path, unnest(['node', 'children', 'relations-to', 'relations-from']) AS topic, node_path AS target FROM nodes
       UNION SELECT node_path, unnest(['node', 'children']), parent_path FROM nodes WHERE parent_path IS NOT NULL
       UNION SELECT source, unnest(['node', 'relations-from']), target FROM relations
       UNION SELECT target, 'node', source FROM relations
       UNION SELECT node_path, 'by-type', unnest(['supplier', 'nation', 'none']) FROM nodes
       UNION SELECT node_path, 'flow', unnest(['F', 'O', 'none']) FROM nodes
       UNION SELECT node_path, 'node', 'nowhere' FROM nodes""",
)
ANSWERS = (
    ("permitted", """SELECT a.* FROM asks a WHERE topic IN ('by-type', 'flow') OR EXISTS (SELECT 1 FROM sees s WHERE s.node_path = a.node_path AND s.visible_node = a.target)"""),
    ("facts", """SELECT 'node' AS topic, node_path AS target, node_path AS item, type AS detail FROM nodes
                 UNION SELECT 'children', parent_path, node_path, type FROM nodes WHERE parent_path IS NOT NULL
                 UNION SELECT 'relations-to', source, target, type FROM relations UNION SELECT 'relations-from', target, source, type FROM relations
                 UNION SELECT 'flow', f.flow, f.node_path, n.type FROM flow_nodes f JOIN nodes n ON n.node_path = f.node_path
                 UNION SELECT 'by-type', type, node_path, type FROM nodes"""),
)


@query(
    """SELECT p.node_path, p.topic, p.target, f.item, f.detail FROM permitted p JOIN facts f ON f.topic = p.topic AND f.target = p.target
         JOIN sees s ON s.node_path = p.node_path AND s.visible_node = f.item
       UNION ALL SELECT DISTINCT node_path, 'observed', concat(CASE topic WHEN 'children' THEN 'graph-children' WHEN 'by-type' THEN 'graph-bytype' WHEN 'flow' THEN 'graph-flow' ELSE 'graph' END, ':', target), '', '' FROM permitted
       UNION ALL SELECT node_path, concat('refused ', topic), target, '', '' FROM asks WHERE (node_path, topic, target) NOT IN (SELECT (node_path, topic, target) FROM permitted)""",
    *SCOPED, ASKS, *ANSWERS,
)
def graph_lookups(i: Inputs) -> DataFrame:
    every = lambda *topics: F.explode(F.array(*[F.lit(t) for t in topics]))
    nodes, rel = i.nodes.select("graph_id", "node_path", "parent_path"), i.relations
    cols = ["graph_id", "node_path", "topic", "target"]
    asks = nodes.select("graph_id", "node_path", every("node", "children", "relations-to", "relations-from").alias("topic"), F.col("node_path").alias("target"))
    for more in (
        nodes.filter("parent_path is not null").select("graph_id", "node_path", every("node", "children").alias("topic"), F.col("parent_path").alias("target")),
        rel.select("graph_id", F.col("source").alias("node_path"), every("node", "relations-from").alias("topic"), "target"),
        rel.select("graph_id", F.col("target").alias("node_path"), F.lit("node").alias("topic"), F.col("source").alias("target")),
        nodes.select("graph_id", "node_path", F.lit("by-type").alias("topic"), every("supplier", "nation", "none").alias("target")),
        nodes.select("graph_id", "node_path", F.lit("flow").alias("topic"), every("F", "O", "none").alias("target")),
        nodes.select("graph_id", "node_path", F.lit("node").alias("topic"), F.lit("nowhere").alias("target")),
    ):
        asks = asks.unionByName(more.select(*cols))
    units = asks.withColumns({"rule_id": F.lit("r"), "unit_key": F.concat(F.lit("node:"), "node_path")})
    answers, observed, refused = vis.graph_lookups(units, vis.scope_rows(i.nodes, rel), i.nodes, rel, i.flow_nodes)
    node = F.substring_index("unit_key", ":", -1).alias("node_path")
    nothing = [F.lit("").alias("item"), F.lit("").alias("detail")]
    return (
        answers.select(node, "topic", "target", "item", "detail")
        .unionByName(observed.select(node, F.lit("observed").alias("topic"), F.col("key").alias("target"), *nothing))
        .unionByName(refused.select(node, F.concat(F.lit("refused "), "topic").alias("topic"), "target", *nothing))
    )


@query("SELECT doc_id, replace(to_json(concat(text, chr(92), chr(31), chr(9), '\"')), 'u001F', 'u001f') AS literal FROM documents")
def json_strings(i: Inputs) -> DataFrame:
    return i.base("documents").select("doc_id", json_string(F.concat("text", F.lit('\\\x1f\t"'))).alias("literal"))
