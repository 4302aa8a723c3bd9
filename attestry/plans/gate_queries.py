"""The whole gate: issues of all kinds of checks in one report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.functions.text import sha256_text
from attestry.operators import cascade as cas
from attestry.operators import checks as chk
from attestry.operators import dependencies as dep
from attestry.operators import journals as jou
from attestry.operators import ownership as own
from attestry.operators import waivers as wai
from attestry.plans import cascade_queries, ownership_queries, text_queries
from attestry.plans.inputs import Inputs
from attestry.plans.registry import ORACLES, query
from attestry.plans.text_queries import BAD, FAULTS
from attestry.plans.verdict_queries import STATES, states
from attestry.sources import verdict_store as store

REACHED = ("reached", "SELECT DISTINCT rule_id FROM attachments_raw UNION SELECT implied FROM reached JOIN implies ON implier = rule_id")
ISSUES = (
    "issues",
    """SELECT CASE WHEN state = 'unverified' THEN 'unverified' WHEN status = 'enforced' THEN 'aspect-violation-enforced' ELSE 'aspect-violation-advisory' END AS code,
              CASE WHEN status = 'enforced' THEN 'error' ELSE 'warning' END AS severity, unit_key AS what FROM states WHERE state <> 'verified'
       UNION ALL SELECT 'log-format', 'error', concat(pos * 2 - 1, ' ', reason) FROM faults
       UNION ALL SELECT 'relation-undeclared-dependency', 'error', concat_ws(' ', source, target, file, line) FROM bad
       UNION ALL SELECT 'orphan-rule', 'warning', '' FROM rules WHERE rule_id NOT IN (SELECT rule_id FROM reached)
       UNION ALL SELECT 'waiver-without-reason', 'error', concat(file, ' ', line) FROM markers WHERE kind <> 'enable' AND reason = ''
       UNION ALL SELECT 'mapped-file-gitignored', 'error', concat(f.path, ' ', CASE WHEN bool_or(m.entry = f.path) THEN 'single' ELSE 'indirect' END)
         FROM files f JOIN (SELECT path, entry FROM matched UNION ALL SELECT path, entry FROM paths JOIN label_mappings ON entry = path) m ON m.path = f.path WHERE f.lang = 'es' GROUP BY f.path
       UNION ALL SELECT 'lock-invalid', 'error', concat('{"hash":"', sha256(CAST(doc_id AS VARCHAR)), '"') FROM labels""",
)


# the checks of graph, rules, mappings and journals that have queries of their own: code, severity and what of each
CHECKS = {
    "validate": "code, severity, what",
    "condition_references": "code, 'error' AS severity, what",
    "rule_sources": "code, 'error' AS severity, '' AS what",
    "rule_references": "code, CASE code WHEN 'aspect-references-empty-array' THEN 'warning' ELSE 'error' END AS severity, what",
    "strict_classification": "code, 'error' AS severity, concat_ws(' ', what, path) AS what",
    "mapping_overlap": "'overlapping-mapping' AS code, 'error' AS severity, concat_ws(' ', place_kind, place, n, first_node) AS what",
    "mapping_paths": "CASE fault WHEN 'escape' THEN 'mapping-escapes-repo' ELSE 'mapping-path-missing' END AS code, 'error' AS severity, entry AS what",
    "trapped_types": "code, 'error' AS severity, type AS what",
    "status_downgrades": "'aspect-status-downgrade' AS code, 'error' AS severity, concat_ws(' ', channel, origin, declared, required) AS what",
    "journal_gate": "code, 'error' AS severity, '' AS what",
    "journal_integrity": "'log-integrity' AS code, 'error' AS severity, reason AS what",
}
CHECKED = ("checked", " UNION ALL ".join(f"SELECT {shown} FROM ({ORACLES[name]})" for name, shown in CHECKS.items()))


def _checks(i: Inputs) -> list[DataFrame]:
    """Issues of the checks in ``CHECKS``, each from its operator."""
    graph = lambda rows: rows.withColumn("graph_id", F.lit("g0"))
    fault = F.when(F.col("fault") == "escape", "mapping-escapes-repo").otherwise("mapping-path-missing")
    warn = F.when(F.col("code") == "aspect-references-empty-array", "warning").otherwise("error")
    return [
        cascade_queries.issues(i),
        graph(cascade_queries.condition_references(i)),
        graph(cascade_queries.rule_sources(i)),
        graph(cascade_queries.rule_references(i)).withColumn("severity", warn),
        graph(ownership_queries.strict_classification(i)).select("graph_id", "code", "what", "path"),
        graph(ownership_queries.mapping_overlap(i)).select("graph_id", F.lit("overlapping-mapping").alias("code"), "node_path", "place_kind", "place", "n", "first_node"),
        graph(ownership_queries.mapping_paths(i)).select("graph_id", fault.alias("code"), "node_path", "entry"),
        graph(text_queries.trapped_types(i)),
        graph(cascade_queries.status_downgrades(i)).select("graph_id", F.lit("aspect-status-downgrade").alias("code"), "node_path", "rule_id", "channel", "origin", "declared", "required"),
        graph(text_queries.journal_gate(i)),
        graph(text_queries.journal_integrity(i)).select("graph_id", F.lit("log-integrity").alias("code"), "node_path", "reason"),
    ]


@query(
    """SELECT code, severity, what, count(*) AS n FROM (SELECT * FROM issues UNION ALL SELECT * FROM checked) GROUP BY ALL
       UNION ALL SELECT CASE WHEN EXISTS (SELECT 1 FROM checked WHERE code = 'log-entry-missing') THEN 'log-entry-missing' ELSE 'unverified' END,
                        'next', CAST(count(*) FILTER (state = 'verified') AS VARCHAR), count(*) FROM states""",
    REACHED, *STATES, FAULTS, BAD, ISSUES, CHECKED,
    recursive=True,
)
def check_report(i: Inputs) -> DataFrame:
    broken = F.concat(F.lit('{"hash":"'), sha256_text(F.col("doc_id").cast("string")), F.lit('"'))
    lines = i.base("labels").select(broken.alias("value"))
    parts = [
        (jou.journal_format(i.journals), "log-format"),
        (dep.undeclared_dependencies(i.code_edges, i.declared).select("graph_id", "source", "target", "file", "line"), "relation-undeclared-dependency"),
        cas.orphan_rules(i.rules, i.attachments_raw, i.implies),
        wai.waiver_faults(i.markers),
        (own.ignored_but_mapped(i.paths, i.patterns, i.dmappings.unionByName(i.label_mappings)), "mapped-file-gitignored"),
        store.parse_verdicts(lines)[1],
        *_checks(i),
    ]
    issues, summary = chk.check_report(parts, states(i), own.coverage_summary(i.paths, i.dmappings, i.roots))
    found = issues.groupBy("code", "severity", "what").agg(F.count("*").alias("n"))
    # broken lines name no graph: their issues stand apart from the summary of one
    whole = summary.filter("graph_id is not null").select(F.col("next_code").alias("code"), F.lit("next").alias("severity"), F.col("verified").cast("string").alias("what"), F.col("pairs").alias("n"))
    return found.unionByName(whole)
