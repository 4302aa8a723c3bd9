"""Queries on expected pairs, digests, verdicts and what changes invalidate."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions.text import content_hash, json_object, json_string, sha256_text
from attestry.operators import cascade as cas
from attestry.operators import checks as chk
from attestry.operators import digests as dig
from attestry.operators import hooks
from attestry.operators import ownership as own
from attestry.operators import pairs as prs
from attestry.operators import reports as rep
from attestry.operators import visibility as vis
from attestry.operators.keyed import shared_folder
from attestry.plans.inputs import Inputs
from attestry.plans.ownership_queries import CLEAN, MATCH, NODE_FILES
from attestry.plans.registry import query
from attestry.sources import verdict_store as store

PAIR = dig.PAIR
# effective rules of the document graph: a source's rules hold on its shelves too; bundles pass on their large rule
DEFF = (
    "deff",
    """SELECT n.node_path, u.rule_id, CASE max(u.rank) WHEN 0 THEN 'draft' WHEN 1 THEN 'advisory' ELSE 'enforced' END AS status
       FROM dnodes n JOIN dattach a ON n.node_path = a.site OR starts_with(n.node_path, concat(a.site, '/'))
       JOIN (SELECT r.rule_id AS at, r.rule_id, CASE status WHEN 'draft' THEN 0 WHEN 'advisory' THEN 1 ELSE 2 END AS rank FROM drules r
             UNION ALL
             SELECT i.implier, i.implied, greatest(CASE p.status WHEN 'advisory' THEN 1 ELSE 2 END, CASE q.status WHEN 'draft' THEN 0 WHEN 'advisory' THEN 1 ELSE 2 END)
             FROM dimplies i JOIN drules p ON p.rule_id = i.implier JOIN drules q ON q.rule_id = i.implied WHERE p.status <> 'draft') u ON u.at = a.rule_id
       GROUP BY n.node_path, u.rule_id""",
)
PAIR_FILES = (
    "pair_files",
    """SELECT e.rule_id, r.kind, CASE r.scope_per WHEN 'file' THEN concat('file:', f.path) ELSE concat('node:', e.node_path) END AS unit_key,
              e.node_path, e.status, f.path, d.content, d.hash, d.doc_id
       FROM deff e JOIN drules r ON r.rule_id = e.rule_id AND r.kind <> 'bundle' JOIN node_files f ON f.node_path = e.node_path JOIN files d ON d.path = f.path
       WHERE e.status <> 'draft' AND (r.scope_files IS NULL OR d.lang = 'en' OR regexp_matches(d.content, '[0-9]{4}'))""",
)
BASE_PAIRS = (CLEAN, MATCH, NODE_FILES, DEFF, PAIR_FILES)
# the digest of a set of lines, as ``keyed.set_digest`` defines it


def digest_sql(keys: str, lines: str, name: str) -> str:
    return (
        f"SELECT {keys}, sha256(string_agg(concat(block, ':', d), chr(10) ORDER BY concat(block, ':', d))) AS {name} FROM ("
        f"SELECT {keys}, left(sha256(line), 3) AS block, sha256(string_agg(line, chr(10) ORDER BY line)) AS d FROM ({lines}) GROUP BY {keys}, left(sha256(line), 3)) GROUP BY {keys}"
    )


SUBJECTS = (
    "subjects",
    digest_sql("rule_id, unit_key", """SELECT rule_id, unit_key, concat('["', path, '","', hash, '"]') AS line FROM pair_files""", "subjects_hash"),
)
HASHED = (
    "hashed",
    """SELECT rule_id, unit_key, node_path, kind, status, verdict, spoiled,
         sha256(CASE WHEN kind = 'judged' THEN concat('{"aspect":"', rule_id, '","aspectDescription":"', description, '","files":"', files,
                  '","kind":"llm","node":"', node_path, '","references":[],"rule":"', sha256(body), '","scope":{"per":"', scope_per, '"},"tier":{"name":"', tier, '"},"verdict":"', verdict, '"}')
                ELSE concat('{"aspect":"', rule_id, '","files":"', files, '","kind":"deterministic","node":"', node_path, '","rule":"', sha256(body), '","scope":{',
                  CASE WHEN scope_files IS NULL THEN '' ELSE concat('"files":', scope_files, ',') END, '"per":"', scope_per, '"},"touched":[],"verdict":"', verdict, '"}') END) AS hash_now
       FROM (SELECT p.rule_id, p.unit_key, p.node_path, p.kind, min(p.status) AS status, any_value(s.subjects_hash) AS files,
                    any_value(r.description) AS description, any_value(r.body) AS body, any_value(r.scope_per) AS scope_per, any_value(r.scope_files) AS scope_files,
                    any_value(r.tier) AS tier, CASE WHEN max(l.quality) = 1 THEN 'approved' ELSE 'refused' END AS verdict, max(l.doc_id) % 3 = 0 AS spoiled
             FROM pair_files p JOIN drules r ON r.rule_id = p.rule_id JOIN subjects s ON s.rule_id = p.rule_id AND s.unit_key = p.unit_key
             LEFT JOIN labels l ON l.doc_id = p.doc_id GROUP BY p.rule_id, p.unit_key, p.node_path, p.kind HAVING count(l.doc_id) > 0)""",
)


def doc_effective(i: Inputs) -> DataFrame:
    """Rules in force in the document graph, written once."""
    return i._stage("doc_effective", lambda: _doc_effective(i))


def _doc_effective(i: Inputs) -> DataFrame:
    rows = cas.attachments(
        i.dnodes, i.dattach, i.flow_nodes.filter("flow = ''"),
        i.relations.filter("type = ''").withColumn("consumes", F.array(F.lit(""))),
    )
    return cas.effective_rules(rows, i.drules, i.dimplies)


def doc_rules(i: Inputs) -> DataFrame:
    return i.drules.withColumn("rule_hash", sha256_text("body"))


def _pair_files(i: Inputs) -> DataFrame:
    node_files = own.expand_mapping(i.dnodes, i.dmappings, i.paths)
    return prs.expected_pairs(doc_effective(i), node_files, i.drules, i.files)[0]


def pair_files(i: Inputs) -> DataFrame:
    """Expected pairs of the document graph, written once: every query below starts from them."""
    return i._stage("pair_files", lambda: _pair_files(i))


def labelled(i: Inputs) -> DataFrame:
    """Subjects of pairs that are labelled."""
    docs = i.files.select("graph_id", "path", "doc_id", "hash").join(i.base("labels"), "doc_id")
    return pair_files(i).join(docs, ["graph_id", "path"])


def verdicts_of(i: Inputs) -> DataFrame:
    """Stored verdicts: a pair with labelled subjects has one, over all its subjects; every third one is spoiled."""

    def make() -> DataFrame:
        tokens = labelled(i).groupBy(*PAIR).agg(
            F.when(F.max("quality") == 1, "approved").otherwise("refused").alias("verdict"), (F.max("doc_id") % 3 == 0).alias("spoiled")
        )
        subjects = pair_files(i).join(i.files.select("graph_id", "path", "hash"), ["graph_id", "path"])
        hashes = dig.pair_input_hash(prs.pairs_of(pair_files(i)), subjects, doc_rules(i), tokens)
        return tokens.join(hashes, PAIR).select(
            *PAIR, "verdict", "hash_now", F.when(F.col("spoiled"), F.reverse("hash_now")).otherwise(F.col("hash_now")).alias("hash")
        )

    return i._stage("stored_verdicts", make)


@query("SELECT rule_id, unit_key, kind, status, node_path, path FROM pair_files", *BASE_PAIRS)
def expected_pairs(i: Inputs) -> DataFrame:
    return _pair_files(i).drop("graph_id")


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def content_hashes(i: Inputs) -> DataFrame:
    crlf = F.replace("text", F.lit("\n"), F.lit("\r\n"))
    return i.base("documents").select("doc_id", content_hash(crlf).alias("hash"))


@query("SELECT doc_id, sha256(concat('{\"id\":', doc_id, ',\"text\":', to_json(text), '}')) AS digest FROM documents")
def canonical_json(i: Inputs) -> DataFrame:
    body = json_object(text=json_string("text"), id=F.col("doc_id").cast("string"))
    return i.base("documents").select("doc_id", sha256_text(body).alias("digest"))


@query(
    digest_sql("node_path", "SELECT node_path, concat(f.path, ':', d.hash) AS line FROM node_files f JOIN files d ON d.path = f.path", "fingerprint"),
    CLEAN, MATCH, NODE_FILES,
)
def source_fingerprint(i: Inputs) -> DataFrame:
    return _fingerprints(i).drop("graph_id")


def _fingerprints(i: Inputs) -> DataFrame:
    node_files = own.expand_mapping(i.dnodes, i.dmappings, i.paths)
    return dig.source_fingerprint(node_files.join(i.files.select("graph_id", "path", "hash"), ["graph_id", "path"]))


@query(
    f"""SELECT n.node_path, coalesce(d.hash, sha256('')) AS hash
       FROM nodes n LEFT JOIN ({digest_sql("parent_path", "SELECT parent_path, node_path AS line FROM nodes WHERE parent_path IS NOT NULL", "hash")}) d ON d.parent_path = n.node_path"""
)
def node_set_hash(i: Inputs) -> DataFrame:
    kids = i.nodes.select("graph_id", F.col("parent_path").alias("node_path"), F.col("node_path").alias("child"))
    rows = i.nodes.select("graph_id", "node_path").join(kids, ["graph_id", "node_path"], "left")
    return dig.node_set_hash(rows, ["graph_id", "node_path"], "child").drop("graph_id")


@query(
    digest_sql(
        "dir",
        """SELECT dir, concat(name, ':', kind) AS line FROM (
         SELECT concat(source, '/', lang) AS dir, concat(doc_id, '.txt') AS name, 'file' AS kind FROM documents
         UNION SELECT source, lang, 'dir' FROM documents UNION SELECT '', source, 'dir' FROM documents)""",
        "hash",
    )
)
def listing_hash(i: Inputs) -> DataFrame:
    return dig.listing_hash(i.paths).drop("graph_id")


@query("SELECT rule_id, unit_key, verdict, hash_now FROM hashed", *BASE_PAIRS, SUBJECTS, HASHED)
def pair_input_hash(i: Inputs) -> DataFrame:
    return verdicts_of(i).select("rule_id", "unit_key", "verdict", "hash_now")


STATE = (
    "states",
    """SELECT p.rule_id, p.unit_key, p.kind, p.node_path, p.status, h.verdict, CASE WHEN h.hash_now IS NULL OR h.spoiled THEN 'unverified'
              WHEN h.verdict = 'refused' THEN 'refused' ELSE 'verified' END AS state
       FROM (SELECT rule_id, unit_key, kind, node_path, min(status) AS status FROM pair_files GROUP BY ALL) p
       LEFT JOIN hashed h ON h.rule_id = p.rule_id AND h.unit_key = p.unit_key""",
)
STATES = (*BASE_PAIRS, SUBJECTS, HASHED, STATE)


def _states(i: Inputs) -> DataFrame:
    stored = verdicts_of(i).select(*PAIR, "verdict", "hash")
    subjects = pair_files(i).join(i.files.select("graph_id", "path", "hash"), ["graph_id", "path"])
    pairs = prs.pairs_of(pair_files(i))
    now = dig.pair_input_hash(pairs, subjects, doc_rules(i), stored)
    return prs.verify_pairs(pairs, stored, now)


def states(i: Inputs) -> DataFrame:
    return i._stage("pair_states", lambda: _states(i))


@query("SELECT rule_id, unit_key, state FROM states", *STATES)
def verify_pairs(i: Inputs) -> DataFrame:
    return _states(i).select("rule_id", "unit_key", "state")


@query("SELECT kind, status, state, count(*) AS n FROM states GROUP BY ALL", *STATES)
def pair_state_counts(i: Inputs) -> DataFrame:
    return _states(i).groupBy("kind", "status", "state").agg(F.count("*").alias("n"))


@query(
    """SELECT rule_id, unit_key, CASE WHEN status = 'enforced' THEN 'error' ELSE 'warning' END AS severity,
              CASE WHEN state = 'unverified' THEN 'unverified' WHEN status = 'enforced' THEN 'aspect-violation-enforced' ELSE 'aspect-violation-advisory' END AS code
       FROM states WHERE state <> 'verified'""",
    *STATES,
)
def pair_issues(i: Inputs) -> DataFrame:
    return chk.pair_issues(states(i)).select("rule_id", F.col("what").alias("unit_key"), "severity", "code")


@query("SELECT rule_id, unit_key, CASE WHEN state = 'refused' AND status <> 'enforced' THEN 'warning' ELSE state END AS shown FROM states", *STATES)
def display_state(i: Inputs) -> DataFrame:
    return states(i).select("rule_id", "unit_key", rep.display_state("state", "status").alias("shown"))


@query(
    """SELECT rule_id, unit_key, CASE kind WHEN 'computed' THEN 1 ELSE 2 END AS stage, CASE kind WHEN 'judged' THEN (SELECT tier FROM drules r WHERE r.rule_id = s.rule_id) END AS tier,
              CASE WHEN node_path = 'n/src3' THEN 'journal-entry-missing'
                   WHEN kind = 'judged' AND node_path IN (SELECT node_path FROM states WHERE kind = 'computed' AND state = 'refused' AND status = 'enforced') THEN 'computed-refusal' END AS skip_reason
       FROM states s WHERE state = 'unverified'""",
    *STATES,
)
def refill_order(i: Inputs) -> DataFrame:
    blocked = i.dnodes.filter("node_path = 'n/src3'")
    return prs.refill_order(states(i), i.drules, blocked).select("rule_id", "unit_key", "stage", "tier", "skip_reason")


@query(
    """SELECT node_path, count(*) AS pairs, CAST(sum(CASE WHEN kind = 'judged' THEN CASE (SELECT tier FROM drules r WHERE r.rule_id = s.rule_id) WHEN 'deep' THEN 3 ELSE 1 END ELSE 0 END) AS BIGINT) AS judge_calls,
              count(*) FILTER (kind <> 'judged') AS free_pairs, count(*) FILTER (verdict = 'approved') AS green_at_stake
       FROM states s GROUP BY node_path""",
    *STATES,
)
def review_cost(i: Inputs) -> DataFrame:
    return prs.review_cost(states(i), i.drules, i.tiers, verdicts_of(i), ["graph_id", "node_path"]).drop("graph_id")


@query(
    """SELECT r.rule_id, count(s.unit_key) AS units, count(*) FILTER (s.state = 'verified') AS verified, count(*) FILTER (s.state = 'refused' AND s.status = 'enforced') AS refused,
              count(*) FILTER (s.state = 'refused' AND s.status <> 'enforced') AS warning, count(*) FILTER (s.state = 'unverified') AS unverified,
              CASE WHEN r.kind = 'bundle' OR count(s.unit_key) > 0 THEN NULL WHEN r.rule_id NOT IN (SELECT rule_id FROM deff) THEN 'no-node'
                   WHEN r.rule_id NOT IN (SELECT rule_id FROM deff WHERE status <> 'draft') THEN 'draft' ELSE 'empty-subjects' END AS vacuous
       FROM drules r LEFT JOIN states s ON s.rule_id = r.rule_id GROUP BY r.rule_id, r.kind""",
    *STATES,
)
def rule_tally(i: Inputs) -> DataFrame:
    return rep.rule_tally(i.drules, states(i), doc_effective(i)).drop("graph_id", "kind")


@query(
    """SELECT (SELECT count(*) FROM dnodes) AS nodes, (SELECT count(*) FROM drules) AS rules, (SELECT count(*) FROM drules WHERE status = 'draft') AS drafts,
              (SELECT count(DISTINCT flow) FROM flow_nodes) AS flows, count(*) AS pairs, count(*) FILTER (kind = 'judged') AS judged, count(*) FILTER (kind = 'computed') AS computed,
              count(*) FILTER (state = 'verified') AS verified, count(*) FILTER (state = 'refused') AS refused, count(*) FILTER (state = 'unverified') AS unverified,
              CAST(0 AS BIGINT) AS too_large, CAST(0 AS BIGINT) AS companion_error FROM states""",
    *STATES,
)
def state_counts(i: Inputs) -> DataFrame:
    return rep.state_counts(i.dnodes, i.drules, i.flow_nodes, states(i)).drop("graph_id")


RANKS = ("ranks", "SELECT unnest(['verified', 'no-rule', 'warning', 'unverified', 'refused']) AS name, unnest([0, 1, 2, 3, 4]) AS r")
OWN_STATE = (
    "own_state",
    """SELECT n.node_path, coalesce(max(r.r), 1) AS r FROM dnodes n LEFT JOIN states s ON s.node_path = n.node_path
       LEFT JOIN ranks r ON r.name = CASE WHEN s.state = 'refused' AND s.status <> 'enforced' THEN 'warning' ELSE s.state END GROUP BY n.node_path""",
)


@query(
    """SELECT n.node_path, a.name AS state, b.name AS rollup FROM (
         SELECT p.node_path, p.r AS own, max(c.r) AS total FROM own_state p JOIN own_state c ON c.node_path = p.node_path OR starts_with(c.node_path, concat(p.node_path, '/')) GROUP BY ALL) n
       JOIN ranks a ON a.r = n.own JOIN ranks b ON b.r = n.total""",
    *STATES, RANKS, OWN_STATE,
)
def rollup_state(i: Inputs) -> DataFrame:
    return rep.rollup_state(i.dnodes, states(i)).drop("graph_id")


DFLOW = ("dflow", "SELECT DISTINCT lang AS flow, concat('n/', source) AS node_path FROM documents WHERE length(source) = 4 UNION SELECT 'none', 'g'")


@query(
    """SELECT m.flow, count(*) AS members, CASE WHEN count(s.node_path) = 0 THEN 'nothing-checked' WHEN bool_or(s.bad) THEN 'attention' ELSE 'verified' END AS state
       FROM (SELECT DISTINCT f.flow, n.node_path FROM dflow f JOIN dnodes n ON n.node_path = f.node_path OR starts_with(n.node_path, concat(f.node_path, '/'))) m
       LEFT JOIN (SELECT node_path, bool_or(state <> 'verified') AS bad FROM states GROUP BY node_path) s ON s.node_path = m.node_path GROUP BY m.flow""",
    *STATES, DFLOW,
)
def flow_state(i: Inputs) -> DataFrame:
    docs = i.base("documents").filter(F.length("source") == 4)
    flows = docs.select(F.lit("g0").alias("graph_id"), F.col("lang").alias("flow"), F.concat(F.lit("n/"), "source").alias("node_path")).distinct()
    lone = i.dnodes.filter("node_path = 'g'").select("graph_id", F.lit("none").alias("flow"), "node_path")
    return rep.flow_state(flows.unionByName(lone), i.dnodes, states(i)).drop("graph_id")


@query(
    """SELECT 'node' AS kind, node_path AS item FROM own_state WHERE r = 1 AND node_path IN (SELECT node_path FROM dmappings)
       UNION ALL SELECT 'file', path FROM paths WHERE path NOT IN (SELECT path FROM matched)""",
    *STATES, RANKS, OWN_STATE,
)
def residue(i: Inputs) -> DataFrame:
    rolled = rep.rollup_state(i.dnodes, states(i))
    return rep.residue(rolled, i.dmappings, own.uncovered_files(i.paths, i.dmappings)).drop("graph_id")


@query(
    """SELECT rule_id, unit_key, CAST(yes * 2 > 3 AS BOOLEAN) AS satisfied, CASE WHEN yes * 2 > 3 THEN first_yes ELSE first_no END AS reason,
              CASE WHEN yes * 2 <= 3 AND all_p THEN 'provider' ELSE 'codeViolation' END AS error_source
       FROM (SELECT rule_id, unit_key, count(*) FILTER (satisfied) AS yes, arg_min(reason, vote_no) FILTER (satisfied) AS first_yes,
                    arg_min(reason, vote_no) FILTER (NOT satisfied) AS first_no, bool_and(error_source = 'provider') FILTER (NOT satisfied) AS all_p
             FROM votes GROUP BY ALL)"""
)
def consensus(i: Inputs) -> DataFrame:
    return prs.consensus(i.votes).drop("graph_id")


BUDGET = (
    "budget",
    f"""SELECT rule_id, unit_key, chars, max_chars AS "limit", chars > max_chars AS over FROM (
         SELECT p.rule_id, p.unit_key, CAST(sum(length(e) + length(p.path)) + count(*) * length(concat('<file path="">', chr(10), chr(10), '</file>')) + (count(*) - 1) * 2
                + length(p.rule_id) + any_value(length(r.description) + length(r.body)) + length(p.node_path) + any_value(length(n.description))
                + any_value(CASE r.scope_per WHEN 'file' THEN {len(prs.PER_FILE_NOTE) + 2} ELSE 0 END) + 100 AS BIGINT) AS chars, any_value(CAST(t.max_chars AS BIGINT)) AS max_chars
         FROM (SELECT *, replace(replace(replace(content, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS e FROM pair_files WHERE kind = 'judged') p
         JOIN drules r ON r.rule_id = p.rule_id JOIN dnodes n ON n.node_path = p.node_path JOIN tiers t ON t.tier = r.tier GROUP BY p.rule_id, p.unit_key, p.node_path)""",
)


@query('SELECT rule_id, unit_key, chars, "limit", over FROM budget', *BASE_PAIRS, BUDGET)
def payload_budget(i: Inputs) -> DataFrame:
    return prs.payload_budget(pair_files(i), i.files, i.drules, i.dnodes, i.tiers, 100).drop("graph_id")


@query(
    f"""SELECT p.rule_id, p.unit_key, md5(concat('<task>', chr(10), 'Judge the files against the rule.',
              CASE WHEN any_value(r.scope_per) = 'file' THEN concat(chr(10), '{prs.PER_FILE_NOTE}') ELSE '' END, chr(10), '</task>', chr(10), '<node path="', p.node_path,
              '" description="', any_value(n.description), '" />', chr(10), '<rule id="', p.rule_id, '" description="', any_value(r.description), '">', chr(10), any_value(r.body), chr(10),
              '</rule>', chr(10), '<source-files>', chr(10),
              string_agg(concat('<file path="', p.path, '">', chr(10), replace(replace(replace(p.content, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10), '</file>'), concat(chr(10), chr(10)) ORDER BY p.path),
              chr(10), '</source-files>')) AS text_md5, FALSE AS cut
       FROM pair_files p JOIN drules r ON r.rule_id = p.rule_id JOIN dnodes n ON n.node_path = p.node_path WHERE p.kind = 'judged' GROUP BY p.rule_id, p.unit_key, p.node_path
       UNION ALL SELECT rule_id, unit_key, '', TRUE FROM budget WHERE over""",
    *BASE_PAIRS, BUDGET,
)
def build_review_text(i: Inputs) -> DataFrame:
    budget = prs.payload_budget(pair_files(i), i.files, i.drules, i.dnodes, i.tiers, 100)
    whole = prs.build_review_text(pair_files(i), i.files, i.drules, i.dnodes, "Judge the files against the rule.")
    within = prs.build_review_text(pair_files(i), i.files, i.drules, i.dnodes, "Judge the files against the rule.", budget)
    cut = whole.join(within, PAIR, "left_anti").select("rule_id", "unit_key", F.lit("").alias("text_md5"), F.lit(True).alias("cut"))
    return whole.select("rule_id", "unit_key", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.lit(False).alias("cut")).unionByName(cut)


@query(
    """SELECT rule_id, unit_key, version, verdict FROM (
         SELECT rule_id, unit_key, verdict, 0 AS version FROM hashed WHERE (rule_id, unit_key) NOT IN (SELECT (rule_id, unit_key) FROM hashed WHERE spoiled)
         UNION ALL SELECT rule_id, unit_key, 'approved', 1 FROM hashed WHERE spoiled)""",
    *BASE_PAIRS, SUBJECTS, HASHED,
)
def upsert_verdicts(i: Inputs) -> DataFrame:
    old = verdicts_of(i).withColumn("version", F.lit(0))
    new = old.filter("hash <> hash_now").withColumn("verdict", F.lit("approved")).withColumn("version", F.lit(1))
    return prs.upsert_verdicts(old, new).select("rule_id", "unit_key", "version", "verdict")


@query(
    """SELECT rule_id, unit_key FROM hashed WHERE status = 'enforced' OR regexp_matches(node_path, '^n/src5(/|$)')""",
    *BASE_PAIRS, SUBJECTS, HASHED,
)
def prune_verdicts(i: Inputs) -> DataFrame:
    stored = verdicts_of(i).select(*PAIR, "verdict")
    keep = pair_files(i).filter("status = 'enforced'")
    shut = i.dnodes.filter("node_path RLIKE '^n/src5(/|$)'")
    # units of files in french belong to the glob node as well; its longest entry decides
    maps = i.dmappings.filter("node_path <> 'g'")
    facts = i.dnodes.select("graph_id", "node_path")
    return prs.prune_verdicts(stored, keep, shut, maps, facts, i.dnodes)[0].select("rule_id", "unit_key")


@query(
    """SELECT node_path, CASE WHEN length(node_path) % 3 = 0 THEN FALSE ELSE length(node_path) % 3 = 1 END AS changed FROM (SELECT DISTINCT node_path FROM node_files)""",
    CLEAN, MATCH, NODE_FILES,
)
def freshness(i: Inputs) -> DataFrame:
    return prs.freshness(_fingerprints(i), _facts(i)).drop("graph_id")


def _facts(i: Inputs) -> DataFrame:
    kind = F.length("node_path") % 3
    return _fingerprints(i).select(
        "graph_id", "node_path", F.when(kind == 1, "old").when(kind == 2, F.col("fingerprint")).alias("source"),
        F.when(kind == 1, "2024-01-01T00:00:00.000Z").alias("last_ts"), F.when(kind == 1, "x").alias("prefix_hash"),
    )


@query(
    """SELECT n.node_path, CASE WHEN k.r = 1 AND n.type = 'shelf' AND NOT open THEN 'new' WHEN n.type = 'shelf' AND k.r = 1 THEN 'old' WHEN n.type = 'shelf' AND k.r = 2 THEN 'same'
              WHEN n.type = 'shelf' AND k.r = 0 AND NOT open THEN 'new' END AS source_is
       FROM dnodes n JOIN (SELECT DISTINCT node_path, length(node_path) % 3 AS r FROM node_files) k ON k.node_path = n.node_path
       JOIN (SELECT d.node_path, EXISTS (SELECT 1 FROM states s WHERE s.node_path = d.node_path AND s.status = 'enforced' AND s.state <> 'verified') AS open FROM dnodes d) o ON o.node_path = n.node_path
       WHERE NOT (n.type = 'shelf' AND k.r = 0 AND open)""",
    *STATES,
)
def close_nodes(i: Inputs) -> DataFrame:
    types = i.dnodes.select("graph_id", "type").distinct().withColumn("log_required", F.col("type") == "shelf")
    latest = i.dnodes.select("graph_id", "node_path", F.lit("2024-02-01T00:00:00.000Z").alias("ts"), F.lit("y").alias("prefix_hash"))
    prints = _fingerprints(i)
    new = prs.close_nodes(i.dnodes, types, prints, states(i), latest, _facts(i))
    rows = new.join(prints, ["graph_id", "node_path"])
    was = F.when(F.col("moved"), "new").when(F.col("source") == "old", "old").when(F.col("source") == F.col("fingerprint"), "same")
    return rows.select("node_path", was.alias("source_is"))


# each shelf uses the shelves of its language in sources with a longer name; french files use a whole source
DREL = (
    "drel",
    """SELECT a.node_path AS source, b.node_path AS target FROM (SELECT DISTINCT source AS s, lang, concat('n/', source, '/', lang) AS node_path FROM documents) a
       JOIN (SELECT DISTINCT source AS s, lang, concat('n/', source, '/', lang) AS node_path FROM documents) b ON a.lang = b.lang AND length(b.s) > length(a.s)
       UNION ALL SELECT 'g', 'n/src1' UNION ALL SELECT 'n', 'nowhere'""",
)
SEES = """(v.node_path = n.node_path OR starts_with(n.node_path, concat(v.node_path, '/')) OR starts_with(v.node_path, concat(n.node_path, '/'))
         OR EXISTS (SELECT 1 FROM drel r WHERE r.source = n.node_path AND (v.node_path = r.target OR starts_with(v.node_path, concat(r.target, '/')))))"""
READ = ("read_entries", f"SELECT DISTINCT n.node_path, v.entry FROM dnodes n JOIN clean v ON {SEES}")


def _scope(i: Inputs) -> tuple[DataFrame, DataFrame]:
    shelves = i.base("documents").select("source", "lang").distinct()
    one = shelves.select("lang", F.length("source").alias("_n"), F.concat(F.lit("n/"), "source", F.lit("/"), "lang").alias("source"))
    other = one.select("lang", F.col("_n").alias("_m"), F.col("source").alias("target"))
    alike = one.join(other, "lang").filter("_m > _n").select(F.lit("g0").alias("graph_id"), "source", "target")
    fixed = i.dnodes.filter("node_path IN ('g', 'n')").select("graph_id", F.col("node_path").alias("source"), F.when(F.col("node_path") == "g", "n/src1").otherwise("nowhere").alias("target"))
    return prs.read_scope(i.dnodes, i.dmappings, alike.unionByName(fixed))


@query("SELECT node_path, entry FROM read_entries", CLEAN, DREL, READ)
def read_scope(i: Inputs) -> DataFrame:
    return _scope(i)[0].drop("graph_id")


@query(f"SELECT DISTINCT n.node_path, v.node_path AS visible_node FROM dnodes n JOIN dnodes v ON {SEES}", DREL)
def visible_nodes(i: Inputs) -> DataFrame:
    return vis.visible_nodes(_scope(i)[1], i.dnodes).drop("graph_id")


@query(
    """SELECT p.rule_id, p.unit_key, p.path AS changed, 'own' AS reason, 'precise' AS mode FROM pair_files p JOIN labels l ON l.doc_id = p.doc_id WHERE toxic = 1
       UNION ALL
       SELECT DISTINCT p.rule_id, p.unit_key, f.path, 'reference', 'precise' FROM pair_files p JOIN (SELECT f.path FROM files f JOIN labels l ON l.doc_id = f.doc_id WHERE toxic = 1 AND lang = 'de') f ON TRUE WHERE p.kind = 'judged'
       UNION ALL
       SELECT DISTINCT p.rule_id, p.unit_key, f.path, CASE p.kind WHEN 'judged' THEN 'observe-companion' ELSE 'observe-computed' END, 'precise'
       FROM pair_files p JOIN (SELECT f.path, concat(f.source, '/', f.lang) AS dir FROM files f JOIN labels l ON l.doc_id = f.doc_id WHERE toxic = 1) f
         ON f.dir = regexp_replace(p.path, '/[^/]*$', '') WHERE p.status = 'enforced'
       UNION ALL
       SELECT DISTINCT p.rule_id, p.unit_key, f.path, 'potential', 'potential'
       FROM (SELECT DISTINCT rule_id, unit_key, node_path FROM pair_files WHERE kind = 'computed' AND (rule_id, unit_key) NOT IN (SELECT (rule_id, unit_key) FROM hashed)) p
       JOIN read_entries e ON e.node_path = p.node_path
       JOIN (SELECT f.path FROM files f JOIN labels l ON l.doc_id = f.doc_id WHERE toxic = 1) f ON f.path = e.entry OR starts_with(f.path, concat(e.entry, '/'))
       WHERE NOT EXISTS (SELECT 1 FROM pair_files q WHERE q.rule_id = p.rule_id AND q.unit_key = p.unit_key AND q.path = f.path)
         AND NOT EXISTS (SELECT 1 FROM pair_files q WHERE q.rule_id = p.rule_id AND q.unit_key = p.unit_key AND q.status = 'enforced' AND regexp_replace(q.path, '/[^/]*$', '') = regexp_replace(f.path, '/[^/]*$', ''))""",
    *BASE_PAIRS, SUBJECTS, HASHED, DREL, READ,
)
def invalidated_pairs(i: Inputs) -> DataFrame:
    docs = i.files.join(i.base("labels"), "doc_id").filter("toxic = 1")
    rows = pair_files(i)
    refs = rows.filter("kind = 'judged'").select("graph_id", "rule_id").distinct().join(docs.filter("lang = 'de'").select("graph_id", "path"), "graph_id")
    touched = rows.filter("status = 'enforced'").select(*PAIR, F.concat(F.lit("list:"), F.regexp_replace("path", "/[^/]*$", "")).alias("key")).distinct()
    return prs.invalidated_pairs(docs.select("graph_id", "path"), rows, refs, verdicts_of(i), touched, _scope(i)[0]).drop("graph_id")


SEEN_NODES = ("seen_nodes", f"SELECT DISTINCT n.node_path, v.node_path AS visible_node, v.type FROM dnodes n JOIN dnodes v ON {SEES}")
LISTED = (
    "listed",
    """SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS dir, concat(regexp_extract(path, '[^/]*$'), ':file') AS line FROM files
       UNION SELECT DISTINCT source, concat(lang, ':dir') FROM files""",
)
TOLD = (
    "told",
    """SELECT concat('node:', node_path) AS unit_key, node_path, key, split_part(key, ':', 1) AS kind, substr(key, length(split_part(key, ':', 1)) + 2) AS target FROM (
         SELECT concat('n/', source) AS node_path, unnest([concat('read:', path), concat('read:gone/', path), concat('exists:', path), concat('exists:', source), 'exists:nowhere',
                concat('list:', source, '/', lang), concat('list:', source), concat('list:gone/', source)]) AS key FROM files
         UNION SELECT node_path, unnest([concat('graph:', node_path), 'graph:nowhere', concat('graph-children:', node_path), 'graph-children:nowhere',
                'graph-bytype:shelf', 'graph-bytype:root', 'graph-bytype:none', 'graph-flow:source', 'graph-flow:none']) FROM dnodes)""",
)


@query(
    """SELECT unit_key, key, CASE kind
         WHEN 'read' THEN coalesce((SELECT hash FROM files f WHERE f.path = target), 'missing')
         WHEN 'exists' THEN sha256(CASE WHEN target IN (SELECT path FROM paths) THEN 'file' WHEN target IN (SELECT source FROM documents) THEN 'dir' ELSE 'false' END)
         WHEN 'list' THEN coalesce((SELECT d FROM listings l WHERE l.dir = target), 'missing')
         WHEN 'graph' THEN coalesce((SELECT sha256(description) FROM dnodes n WHERE n.node_path = target), 'missing')
         WHEN 'graph-children' THEN coalesce((SELECT d FROM children c WHERE c.parent_path = target), sha256(''))
         WHEN 'graph-bytype' THEN coalesce((SELECT d FROM bytype b WHERE b.node_path = t.node_path AND b.type = target), sha256(''))
         ELSE coalesce((SELECT d FROM byflow f WHERE f.flow = target), sha256('')) END AS hash_now
       FROM told t""",
    DREL, SEEN_NODES, LISTED, TOLD,
    ("listings", digest_sql("dir", "SELECT dir, line FROM listed", "d")),
    ("children", digest_sql("parent_path", "SELECT parent_path, node_path AS line FROM dnodes WHERE parent_path IS NOT NULL", "d")),
    ("bytype", digest_sql("node_path, type", "SELECT node_path, type, visible_node AS line FROM seen_nodes", "d")),
    ("byflow", digest_sql("flow", "SELECT type AS flow, node_path AS line FROM dnodes", "d")),
)
def reobserve(i: Inputs) -> DataFrame:
    c, lit = F.concat, F.lit
    node = c(lit("n/"), "source")
    of_files = F.array(
        c(lit("read:"), "path"), c(lit("read:gone/"), "path"), c(lit("exists:"), "path"), c(lit("exists:"), "source"), lit("exists:nowhere"),
        c(lit("list:"), "source", lit("/"), "lang"), c(lit("list:"), "source"), c(lit("list:gone/"), "source"),
    )
    of_nodes = F.array(
        c(lit("graph:"), "node_path"), lit("graph:nowhere"), c(lit("graph-children:"), "node_path"), lit("graph-children:nowhere"),
        lit("graph-bytype:shelf"), lit("graph-bytype:root"), lit("graph-bytype:none"), lit("graph-flow:source"), lit("graph-flow:none"),
    )
    asked = i.files.select("graph_id", node.alias("node_path"), F.explode(of_files).alias("key")).union(i.dnodes.select("graph_id", "node_path", F.explode(of_nodes))).distinct()
    touched = asked.select("graph_id", lit("r").alias("rule_id"), c(lit("node:"), "node_path").alias("unit_key"), "node_path", "key")
    nodes = i.dnodes.withColumn("doc", F.col("description"))
    members = i.dnodes.select("graph_id", F.col("type").alias("flow"), "node_path")
    return prs.reobserve(touched, i.files, nodes, members, _scope(i)[1]).select("unit_key", "key", "hash_now")


@query(
    """SELECT concat('node:u', user_id) AS unit_key, concat('read:', event_type) AS key, arg_min(props, event_id) AS first_hash
       FROM events GROUP BY ALL HAVING count(DISTINCT props) > 1"""
)
def conflicting_observations(i: Inputs) -> DataFrame:
    rows = i.base("events").select(
        F.lit("g0").alias("graph_id"), F.lit("r").alias("rule_id"), F.concat(F.lit("node:u"), "user_id").alias("unit_key"),
        F.concat(F.lit("read:"), "event_type").alias("key"), F.col("props").alias("hash"), F.col("event_id").alias("seq"),
    )
    return prs.conflicting_observations(rows).select("unit_key", "key", "first_hash")


PATTERNS = [("[0-9]{4}", "a year"), ("(?i)error", "an error")]
LINES = (
    "lines",
    """SELECT path, unnest(string_split(content, chr(10))) AS text, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line FROM files""",
)
FOUND = (
    "found",
    """SELECT p.rule_id, p.unit_key, p.path AS file, CAST(l.line AS BIGINT) AS line, 'a year' AS message
       FROM pair_files p JOIN lines l ON l.path = p.path WHERE p.kind = 'computed' AND regexp_matches(l.text, '[0-9]{4}')""",
)


def _findings(i: Inputs) -> DataFrame:
    rows = pair_files(i).filter("kind = 'computed'")
    patterns = i.drules.filter("kind = 'computed'").select("graph_id", "rule_id", F.lit("[0-9]{4}").alias("pattern"), F.lit("a year").alias("message"))
    return hooks.run_column_checks(rows, i.files, patterns)


@query("SELECT rule_id, unit_key, file, line, message FROM found", *BASE_PAIRS, LINES, FOUND)
def run_column_checks(i: Inputs) -> DataFrame:
    return _findings(i).drop("graph_id")


@query("SELECT rule_id, unit_key, file, line, message FROM found", *BASE_PAIRS, LINES, FOUND)
def run_python_checks(i: Inputs) -> DataFrame:
    import re

    year = re.compile("[0-9]{4}")

    def check(rule: str, unit: str, texts: list[tuple[str, str]]) -> hooks.Findings:
        return [(path, n, "a year") for path, text in texts for n, line in enumerate(text.split("\n"), 1) if year.search(line)]

    return hooks.run_python_checks(pair_files(i).filter("kind = 'computed'"), i.files, check)[0].drop("graph_id")


@query(
    """SELECT p.rule_id, p.unit_key, CASE WHEN f.reason IS NULL THEN 'approved' ELSE 'refused' END AS verdict, f.reason, f.lines
       FROM (SELECT DISTINCT rule_id, unit_key FROM pair_files WHERE kind = 'computed') p
       LEFT JOIN (SELECT c.rule_id, c.unit_key, concat(n, ' findings, sha256 ', d) AS reason, lines FROM found_digest s
                  JOIN (SELECT rule_id, unit_key, count(*) AS n, string_agg(concat(file, ':', line, ': ', message), chr(10) ORDER BY file, line, message) AS lines
                        FROM (SELECT DISTINCT rule_id, unit_key, file, line, message FROM found) GROUP BY rule_id, unit_key) c ON c.rule_id = s.rule_id AND c.unit_key = s.unit_key) f
         ON f.rule_id = p.rule_id AND f.unit_key = p.unit_key""",
    *BASE_PAIRS, LINES, FOUND, ("found_digest", digest_sql("rule_id, unit_key", "SELECT DISTINCT rule_id, unit_key, concat(file, ':', line, ': ', message) AS line FROM found", "d")),
)
def findings_to_verdicts(i: Inputs) -> DataFrame:
    pairs = prs.pairs_of(pair_files(i).filter("kind = 'computed'"))
    return hooks.findings_to_verdicts(pairs, _findings(i)).drop("graph_id")


def _twins(rule: str, unit: str, path: str) -> list[str]:
    head, lang, name = path.split("/")
    return [f"{head}/{'de' if lang == 'en' else 'en'}/{name}", path]


ASKED = (
    ("asked", """SELECT DISTINCT rule_id, unit_key, path AS subject,
                   CASE WHEN contains(path, '/en/') THEN replace(path, '/en/', '/de/') ELSE regexp_replace(path, '/[a-z]+/', '/en/') END AS path FROM pair_files WHERE kind = 'judged'"""),
    ("asked_other", "SELECT DISTINCT a.rule_id, a.unit_key, a.path FROM asked a WHERE (a.rule_id, a.unit_key, a.path) NOT IN (SELECT (rule_id, unit_key, subject) FROM asked)"),
    ("failed", "SELECT * FROM asked_other WHERE path NOT IN (SELECT path FROM paths)"),
)


@query(
    """SELECT rule_id, unit_key, path, 'failed' AS outcome FROM failed
       UNION ALL SELECT rule_id, unit_key, path, 'companion' FROM asked_other a WHERE NOT EXISTS (SELECT 1 FROM failed f WHERE f.rule_id = a.rule_id AND f.unit_key = a.unit_key)""",
    *BASE_PAIRS, *ASKED,
)
def companion_pairs(i: Inputs) -> DataFrame:
    rows = pair_files(i).filter("kind = 'judged'")
    proposals = hooks.pairing_hook(rows, _twins)
    good, failed = prs.companion_pairs(rows, proposals, _scope(i)[0], i.files, i.dmappings)
    shown = lambda rows, outcome: rows.select("rule_id", "unit_key", "path", F.lit(outcome).alias("outcome"))
    return shown(good, "companion").unionByName(shown(failed, "failed"))


@query(
    """SELECT c.conv_id, c.turn, c.conv_id % 2 = 0 AS satisfied,
              CASE c.conv_id % 5 WHEN 0 THEN 'strict' WHEN 1 THEN 'fenced' WHEN 2 THEN 'object' WHEN 3 THEN 'salvage' ELSE 'strict' END AS how,
              'codeViolation' AS error_source, CASE WHEN c.conv_id % 5 = 3 THEN 'said "no" and left' ELSE c.text END AS reason FROM conversations c"""
)
def parse_judgements(i: Inputs) -> DataFrame:
    flag = F.when(F.col("conv_id") % 2 == 0, "true").otherwise("false")
    clean = F.concat(F.lit('{"satisfied": '), flag, F.lit(', "reason": '), json_string("text"), F.lit("}"))
    torn = F.concat(F.lit('{"reason": "said "no" and left", "satisfied": "'), flag, F.lit('", "more": '), json_string("text"))
    shape = F.col("conv_id") % 5
    reply = (
        F.when(shape == 0, clean).when(shape == 1, F.concat(F.lit("My answer:\n```json\n"), clean, F.lit("\n```\n")))
        .when(shape == 2, F.concat(F.lit("I looked at it. "), clean, F.lit(" That is all.")))
        .when(shape == 3, torn).otherwise(F.concat(F.lit("  \n"), clean, F.lit("\n")))
    )
    rows = i.base("conversations").select("conv_id", "turn", reply.alias("text"))
    return hooks.parse_judgements(rows).select("conv_id", "turn", "satisfied", "how", "error_source", "reason")


@query(
    """SELECT run_key, why, unit_key, CAST(rank AS INT) AS rank, failures, units FROM (
         SELECT *, row_number() OVER (PARTITION BY run_key, why ORDER BY unit_key) AS rank, count(*) OVER (PARTITION BY run_key, why) AS units FROM (
           SELECT l_orderkey AS run_key, l_returnflag AS why, concat('node:', l_partkey, ':', l_suppkey) AS unit_key, sum(count(*)) OVER (PARTITION BY l_orderkey, l_returnflag) AS failures
           FROM lineitem GROUP BY 1, 2, 3)) WHERE rank <= 2""",
    name="group_failures",
)
def group_failures_query(i: Inputs) -> DataFrame:
    rows = i.base("lineitem").select(
        F.lit("g0").alias("graph_id"), F.col("l_orderkey").cast("string").alias("rule_id"), F.col("l_returnflag").alias("why"), F.lit("").alias("next"),
        F.concat_ws(":", F.lit("node"), "l_partkey", "l_suppkey").alias("unit_key"),
    )
    first = rep.group_failures(rows, 2)
    return first.select(F.col("rule_id").cast("long").alias("run_key"), "why", "unit_key", "rank", "failures", "units")


@query(
    """SELECT l_orderkey AS k, l_linenumber AS line, l_tax > 0.04 AS second, CAST(CASE WHEN l_tax > 0.04 THEN 2 ELSE 1 END AS INT) AS run, count(*) AS n FROM lineitem GROUP BY ALL"""
)
def determinism_check(i: Inputs) -> DataFrame:
    rows = i.base("lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), (F.col("l_tax") > 0.04).alias("second"))
    return rep.determinism_check(rows.filter("NOT second"), rows.filter("second")).groupBy("k", "line", "second", "run").agg(F.count("*").alias("n"))


@query(
    """SELECT rule_id, unit_key, concat('"', rule_id, '" "', unit_key, '": {"hash":"', hash_now, '","verdict":"', verdict, '"}') AS line FROM hashed WHERE NOT spoiled""",
    *BASE_PAIRS, SUBJECTS, HASHED,
)
def export_verdict_lines(i: Inputs) -> DataFrame:
    rows = verdicts_of(i).filter("hash = hash_now").select(
        *PAIR, "hash", "verdict", F.lit(None).cast("string").alias("reason"), F.lit(None).cast("array<struct<key:string,hash:string>>").alias("touched")
    )
    return store.export_verdict_lines(rows).drop("graph_id")


STORED = (
    "written",
    """SELECT concat('q', doc_id % 9) AS rule_id, concat('file:', doc_id) AS unit_key, CASE WHEN doc_id % 9 < 6 THEN 'computed' ELSE 'judged' END AS kind,
              CASE WHEN quality = 1 THEN 'approved' ELSE 'refused' END AS verdict, sha256(CAST(doc_id AS VARCHAR)) AS hash, doc_id, toxic FROM labels""",
)


def _verdict_rows(rows: DataFrame, verdict: Column) -> DataFrame:
    doc = F.col("doc_id").cast("string")
    return rows.select(
        F.lit("g0").alias("graph_id"), F.when(F.col("doc_id") % 9 < 6, "computed").otherwise("judged").alias("kind"), F.concat(F.lit("q"), F.col("doc_id") % 9).alias("rule_id"),
        F.concat(F.lit("file:"), doc).alias("unit_key"), verdict.alias("verdict"), sha256_text(doc).alias("hash"), F.lit(None).cast("string").alias("reason"),
        F.array(F.struct(F.concat(F.lit("read:"), doc).alias("key"), sha256_text(F.lit("x")).alias("hash"))).alias("touched"),
    )


@query(
    """SELECT rule_id, unit_key, kind, CASE WHEN toxic = 1 THEN 'refused' WHEN doc_id % 4 = 1 THEN 'approved' ELSE verdict END AS verdict, hash, concat('read:', doc_id) AS seen, 'facts' AS parts
       FROM (SELECT DISTINCT * FROM written)""",
    STORED,
)
def verdict_store(i: Inputs) -> DataFrame:
    """All labelled documents through the store: written, written again unchanged, two batches, one of them twice, compacted, read."""
    path = f"{shared_folder(i.spark)}/attestry-store/{uuid.uuid4().hex}"
    rows = i.base("labels").distinct()
    first = _verdict_rows(rows, F.when(F.col("quality") == 1, "approved").otherwise("refused"))
    facts = rows.select(F.lit("g0").alias("graph_id"), F.col("doc_id").cast("string").alias("node_path"), F.lit("f").alias("source"), F.lit(None).cast("string").alias("last_ts"), F.lit(None).cast("string").alias("prefix_hash"))
    store.write_verdicts(first, facts, path)
    changed = store.write_verdicts(first, facts.withColumn("source", F.lit("g")), path)
    fourth = _verdict_rows(rows.filter("doc_id % 4 = 1"), F.lit("approved"))
    for batch_id, batch in ((0, fourth), (1, _verdict_rows(rows.filter("toxic = 1"), F.lit("refused"))), (0, fourth)):
        store.fold_batch(batch, path, "labels", batch_id)
    store.compact(i.spark, path)
    store.vacuum(i.spark, path, keep=1)
    verdicts = store.read_verdicts(i.spark, path)[0]
    return verdicts.select("rule_id", "unit_key", "kind", "verdict", "hash", F.col("touched")[0]["key"].alias("seen"), F.lit(",".join(changed)).alias("parts"))


@query(digest_sql("graph_id", "SELECT lang AS graph_id, concat(doc_id, ':', sha256(text)) AS line FROM documents", "hash"))
def store_content_hash(i: Inputs) -> DataFrame:
    return store.store_content_hash(i.base("documents").select(F.col("lang").alias("graph_id"), F.col("doc_id").cast("string").alias("name"), F.encode("text", "UTF-8").alias("bytes")))


@query(
    """WITH lined AS (SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'judged' ELSE 'computed' END AS kind FROM labels),
            valid AS (SELECT * FROM lined WHERE NOT (kind = 'judged' AND doc_id IN (SELECT doc_id FROM lined WHERE kind = 'computed'))),
            raw AS (SELECT kind, concat('"graph_id":"g0","kind":"', kind, '","rule_id":"', doc_id, '","unit_key":"node:n","verdict":"approved","hash":"', sha256(CAST(doc_id AS VARCHAR)), '"') AS body FROM lined)
       SELECT CAST(doc_id AS VARCHAR) AS what, kind AS code, 1 AS n FROM valid
       UNION ALL SELECT concat('{', body), 'lock-invalid', count(*) FROM raw GROUP BY ALL
       UNION ALL SELECT concat('{"extra":1,', body, '}'), 'lock-invalid', count(*) FROM raw GROUP BY ALL"""
)
def parse_verdicts(i: Inputs) -> DataFrame:
    kind = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "judged").otherwise("computed")
    line = F.to_json(F.struct(
        F.lit("g0").alias("graph_id"), kind.alias("kind"), F.col("doc_id").cast("string").alias("rule_id"), F.lit("node:n").alias("unit_key"),
        F.lit("approved").alias("verdict"), sha256_text(F.col("doc_id").cast("string")).alias("hash"),
    ))
    broken = F.substring(line, F.lit(1), F.length(line) - 1)
    strange = F.regexp_replace(line, r"^\{", '{"extra":1,')
    valid, invalid = store.parse_verdicts(i.base("labels").select(F.explode(F.array(line, broken, strange)).alias("value")))
    return valid.select(F.col("rule_id").alias("what"), F.col("kind").alias("code"), F.lit(1).cast("long").alias("n")).unionByName(
        invalid.groupBy("what", "code").agg(F.count("*").alias("n"))
    )
