"""Queries on paths, ownership and file predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.functions.paths import normalize_path, path_prefixes, split_key, unit_of_file
from attestry.functions.text import tail_truncate
from attestry.operators import ownership as own
from attestry.operators import predicates as pred
from attestry.operators.keyed import entry_matches_file
from attestry.plans.inputs import Inputs
from attestry.plans.registry import query

CLEAN = ("clean", "SELECT graph_id, node_path, regexp_replace(regexp_replace(entry, '^\\./', ''), '/+$', '') AS entry, ord FROM dmappings")
GLOB_FR = r"regexp_full_match(path, '[^/]+/fr/[^/]*\.txt')"
MATCH = (
    "matched",
    f"""SELECT p.graph_id, p.path, c.node_path, c.entry, c.ord FROM paths p JOIN clean c
        ON p.path = c.entry OR starts_with(p.path, concat(c.entry, '/')) OR (c.entry = '*/fr/*.txt' AND {GLOB_FR})""",
)
OWNER = (
    "owned",
    """SELECT graph_id, path, node_path, entry AS mapping FROM matched
       QUALIFY row_number() OVER (PARTITION BY graph_id, path ORDER BY length(entry) DESC, node_path) = 1""",
)
# files of each node after the carve-out of its children
NODE_FILES = (
    "node_files",
    """SELECT DISTINCT m.graph_id, m.node_path, m.path FROM matched m WHERE NOT EXISTS (
         SELECT 1 FROM clean c JOIN clean p ON p.node_path = m.node_path AND (c.entry = p.entry OR starts_with(c.entry, concat(p.entry, '/')))
         WHERE starts_with(c.node_path, concat(m.node_path, '/')) AND (m.path = c.entry OR starts_with(m.path, concat(c.entry, '/'))))""",
)


@query(
    """SELECT doc_id, regexp_replace(regexp_replace(replace(trim(raw), chr(92), '/'), '^\\./', ''), '/+$', '') AS path
       FROM (SELECT doc_id, concat('  ./', source, chr(92), lang, '/', doc_id, '.txt//  ') AS raw FROM documents)"""
)
def normalize_paths(i: Inputs) -> DataFrame:
    raw = F.concat(F.lit("  ./"), "source", F.lit("\\"), "lang", F.lit("/"), "doc_id", F.lit(".txt//  "))
    return i.base("documents").select("doc_id", normalize_path(raw).alias("path"))


@query(
    """SELECT path, unnest(list_transform(range(1, len(string_split(path, '/')) + 1),
              lambda i: array_to_string(string_split(path, '/')[1:i], '/'))) AS prefix FROM web"""
)
def prefixes(i: Inputs) -> DataFrame:
    return i.web.select("path", F.explode(path_prefixes("path")).alias("prefix"))


@query("SELECT path, node_path, entry FROM matched", CLEAN, MATCH)
def mapping_matches(i: Inputs) -> DataFrame:
    return entry_matches_file(i.paths, i.dmappings).select("path", "node_path", "entry")


@query("SELECT p.path, o.node_path, o.mapping FROM paths p LEFT JOIN owned o ON o.path = p.path", CLEAN, MATCH, OWNER)
def resolve_owner(i: Inputs) -> DataFrame:
    return own.resolve_owner(i.paths, i.dmappings).select("path", "node_path", "mapping")


@query(
    """SELECT path, node_path, entry AS mapping, (entry = path OR contains(entry, '*')) AS direct FROM matched
       QUALIFY row_number() OVER (PARTITION BY path ORDER BY entry = path DESC, length(entry) DESC, node_path) = 1""",
    CLEAN, MATCH,
)
def find_owner(i: Inputs) -> DataFrame:
    return own.find_owner(i.paths, i.dmappings).select("path", "node_path", "mapping", "direct")


@query(
    """SELECT m.path, m.node_path FROM matched m JOIN dnodes n ON n.node_path = m.node_path
       QUALIFY row_number() OVER (PARTITION BY m.path ORDER BY n.ord, m.node_path) = 1""",
    CLEAN, MATCH,
)
def first_owner(i: Inputs) -> DataFrame:
    return own.first_owner(i.paths, i.dnodes, i.dmappings).select("path", "node_path")


@query(
    """SELECT concat('file:', p.path) AS unit_key, o.node_path FROM paths p LEFT JOIN (
         SELECT path, node_path FROM matched QUALIFY row_number() OVER (PARTITION BY path ORDER BY length(entry) DESC, ord, node_path) = 1) o
       ON o.path = p.path UNION ALL SELECT concat('node:', node_path), node_path FROM dnodes""",
    CLEAN, MATCH,
)
def owner_of_unit(i: Inputs) -> DataFrame:
    units = i.paths.select("graph_id", unit_of_file("path").alias("unit_key")).unionByName(
        i.dnodes.select("graph_id", F.concat(F.lit("node:"), "node_path").alias("unit_key"))
    )
    return own.owner_of_unit(units, i.dmappings).select("unit_key", "node_path")


@query(
    """SELECT a.node_path AS ancestor, d.node_path AS descendant,
              CAST(len(string_split(d.node_path, '/')) - len(string_split(a.node_path, '/')) AS INT) AS dist
       FROM nodes a JOIN nodes d ON starts_with(d.node_path, concat(a.node_path, '/'))"""
)
def node_closure(i: Inputs) -> DataFrame:
    return own.node_closure(i.nodes).select("ancestor", "descendant", "dist")


@query("SELECT node_path, path FROM node_files", CLEAN, MATCH, NODE_FILES)
def expand_mapping(i: Inputs) -> DataFrame:
    return own.expand_mapping(i.dnodes, i.dmappings, i.paths).select("node_path", "path")


@query(
    """SELECT p.path, m.node_path, count(*) AS n FROM paths p
       JOIN label_mappings m ON regexp_replace(m.entry, '/[^/]*$', '') = regexp_replace(p.path, '/[^/]*$', '') GROUP BY ALL"""
)
def candidate_owners(i: Inputs) -> DataFrame:
    return own.candidate_owners(i.paths, i.label_mappings).select("path", "node_path", "n")


@query(
    """SELECT node_path, type FROM nodes
       WHERE (node_path = 'r1' OR starts_with(node_path, 'r1/')) AND len(string_split(node_path, '/')) <= 2"""
)
def list_tree(i: Inputs) -> DataFrame:
    return own.list_tree(i.nodes, "r1", 1).select("node_path", "type")


@query(
    """SELECT w.path FROM web w WHERE NOT EXISTS (SELECT 1 FROM web v
         WHERE list_position(string_split(v.path, '/'), 'fr') > 1
           AND starts_with(w.path, concat(array_to_string(string_split(v.path, '/')[1:list_position(string_split(v.path, '/'), 'fr') - 1], '/'), '/')))"""
)
def drop_nested_roots(i: Inputs) -> DataFrame:
    return own.drop_nested_roots(i.web, "fr").select("path")


IGNORED = (
    "ignored",
    """SELECT graph_id, path, CASE WHEN lang = 'en' AND CAST(doc_id AS STRING) LIKE '1%' THEN TRUE
              WHEN length(source) = 4 THEN FALSE ELSE lang = 'es' END AS ignored FROM files""",
)


@query("SELECT path FROM ignored WHERE NOT ignored", IGNORED)
def apply_ignore_patterns(i: Inputs) -> DataFrame:
    return own.apply_ignore_patterns(i.paths, i.patterns).select("path")


@query(
    """SELECT f.path, CASE WHEN bool_or(m.entry = f.path) THEN 'single' ELSE 'indirect' END AS reach
       FROM files f JOIN (SELECT path, entry FROM matched UNION ALL SELECT path, entry FROM paths JOIN label_mappings ON entry = path) m
       ON m.path = f.path WHERE f.lang = 'es' GROUP BY f.path""",
    CLEAN, MATCH,
)
def ignored_but_mapped(i: Inputs) -> DataFrame:
    both = i.dmappings.unionByName(i.label_mappings)
    return own.ignored_but_mapped(i.paths, i.patterns, both).select("path", "reach")


@query(
    """SELECT doc_id, lang = 'fr' AS is_binary, lang = 'fr' AND strlen(text) < 100 AS near_head, FALSE AS too_large, strlen(text) + 1 > 10000 AS over
       FROM documents"""
)
def guard_content(i: Inputs) -> DataFrame:
    text = F.concat("text", F.when(F.col("lang") == "fr", F.lit("\0")).otherwise(F.lit(" ")))
    rows = i.base("documents").select("doc_id", text.alias("content"))
    bounded = pred.guard_content(rows, probe_bytes=100, max_bytes=10_000).select("doc_id", F.col("is_binary").alias("near_head"), F.col("too_large").alias("over"))
    return pred.guard_content(rows).select("doc_id", "is_binary", "too_large").join(bounded, "doc_id")


@query(
    """SELECT path, (lang = 'en' OR (regexp_matches(content, '[0-9]{4}') AND NOT starts_with(source, 'src1'))) AS result,
              FALSE AS unreadable FROM files"""
)
def eval_file_predicate(i: Inputs) -> DataFrame:
    tree = {"any_of": [{"path": "*/en/*.txt"}, {"all_of": [{"content": "[0-9]{4}"}, {"not": {"path": "src1*/**"}}]}]}
    return pred.eval_file_predicate(i.files, tree).select("path", "result", "unreadable")


TYPES = [
    ("english", {"path": "**/en/*.txt"}),
    ("numbered", {"all_of": [{"content": "[0-9]{4}"}, {"path": "src[1-9]/**"}]}),
    ("either", {"any_of": [{"path": "*/de/*"}, {"not": {"content": "[0-9]"}}]}),
    ("mail", {"content": "[a-z]+@[a-z]+"}),
]
TYPE_TESTS = (
    "tests",
    """SELECT path, 'english' AS type, 0 AS ord, lang = 'en' AS result, CASE WHEN lang = 'en' THEN 1.0 ELSE 0.0 END AS score FROM files
       UNION ALL SELECT path, 'numbered', 1, regexp_matches(content, '[0-9]{4}') AND regexp_matches(source, '^src[1-9]$'),
         (CASE WHEN regexp_matches(content, '[0-9]{4}') THEN 0.5 ELSE 0.0 END + CASE WHEN regexp_matches(source, '^src[1-9]$') THEN 0.5 ELSE 0.0 END) FROM files
       UNION ALL SELECT path, 'either', 2, lang = 'de' OR NOT regexp_matches(content, '[0-9]'),
         CASE WHEN lang = 'de' OR NOT regexp_matches(content, '[0-9]') THEN 1.0 ELSE 0.0 END FROM files
       UNION ALL SELECT path, 'mail', 3, regexp_matches(content, '[a-z]+@[a-z]+'), CASE WHEN regexp_matches(content, '[a-z]+@[a-z]+') THEN 1.0 ELSE 0.0 END FROM files""",
)


@query("SELECT path, type FROM tests WHERE result", TYPE_TESTS)
def classify_matches(i: Inputs) -> DataFrame:
    return pred.classify_files(i.files, TYPES)[0].select("path", "type")


@query(
    """SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY score DESC, ord) AS INT) AS rank, type, CAST(score AS DOUBLE) AS score
       FROM tests WHERE NOT result QUALIFY rank <= 3""",
    TYPE_TESTS,
)
def classify_closest(i: Inputs) -> DataFrame:
    return pred.classify_files(i.files, TYPES)[1].select("path", "rank", "type", "score")


@query(
    """SELECT path, 'strict-overlap-conflict' AS code, 'mail|shelf' AS what FROM t WHERE english AND mail
       UNION ALL SELECT path, 'type-strict-orphan', CASE WHEN english THEN 'shelf' ELSE 'mail' END FROM t WHERE (english <> mail) AND node_path IS NULL
       UNION ALL SELECT path, 'type-strict-misplaced', CASE WHEN english THEN 'shelf' ELSE 'mail' END FROM t
         WHERE (english <> mail) AND node_path IS NOT NULL AND node_type <> CASE WHEN english THEN 'shelf' ELSE 'mail' END
       UNION ALL SELECT path, 'type-when-mismatch', node_type FROM t WHERE node_path IS NOT NULL AND node_type = 'shelf' AND NOT english""",
    CLEAN, MATCH,
    ("firsts", """SELECT m.path, m.node_path FROM matched m JOIN dnodes n ON n.node_path = m.node_path
       QUALIFY row_number() OVER (PARTITION BY m.path ORDER BY n.ord, m.node_path) = 1"""),
    ("t", """SELECT f.path, f.lang = 'en' AS english, regexp_matches(content, '[a-z]+@[a-z]+') AS mail, o.node_path, n.type AS node_type
         FROM files f LEFT JOIN firsts o ON o.path = f.path LEFT JOIN dnodes n ON n.node_path = o.node_path"""),
)
def strict_classification(i: Inputs) -> DataFrame:
    types = [("shelf", {"path": "*/en/**"}, True), ("mail", {"content": "[a-z]+@[a-z]+"}, True)]
    return pred.strict_classification(i.files, types, i.dnodes, i.dmappings).select("path", "code", "what")


@query(
    """SELECT path, kind FROM assets WHERE NOT (kind = 'judged' AND regexp_matches(path, '\\.(PNG|zip)$'))"""
)
def drop_binary_subjects(i: Inputs) -> DataFrame:
    return pred.drop_binary_subjects(i.assets).select("path", "kind")


@query("SELECT path FROM assets WHERE NOT (starts_with(path, '.cursor/') OR starts_with(path, '.graph/') OR ends_with(path, '.md'))")
def drop_noise_files(i: Inputs) -> DataFrame:
    return pred.drop_noise_files(i.assets, ".graph").select("path")


@query(
    """SELECT path, CASE WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%.tsx' THEN 'tsx' WHEN path LIKE '%.rs' THEN 'rust' END AS language
       FROM assets"""
)
def detect_language(i: Inputs) -> DataFrame:
    return pred.detect_language(i.assets).select("path", "language")


@query(
    """SELECT rule_id, CASE kind WHEN 'bundle' THEN 'standard' WHEN 'judged' THEN tier END AS chosen_tier,
              CASE kind WHEN 'computed' THEN 'unknown-tier' END AS tier_error FROM rules"""
)
def select_tier(i: Inputs) -> DataFrame:
    named = F.when(F.col("kind") == "computed", "none").when(F.col("kind") == "judged", F.col("tier"))
    return pred.select_tier(i.rules.withColumn("tier", named), i.tiers).select("rule_id", "chosen_tier", "tier_error")


TIERED = (
    "tiered",
    """SELECT path, CASE WHEN lang = 'fr' THEN 'excluded' WHEN length(source) = 4 THEN 'required' ELSE 'excluded' END AS tier FROM files""",
)
PART_COVER = ("clean", "SELECT graph_id, node_path, regexp_replace(regexp_replace(entry, '^\\./', ''), '/+$', '') AS entry, ord FROM dmappings WHERE ord = 0 AND node_path LIKE '%/%/%' OR node_path = 'g'")


def _partial(i: Inputs) -> DataFrame:
    return i.dmappings.filter("node_path LIKE '%/%/%' OR node_path = 'g'")


@query("SELECT path FROM paths EXCEPT SELECT path FROM matched", PART_COVER, MATCH)
def uncovered_files(i: Inputs) -> DataFrame:
    return own.uncovered_files(i.paths, _partial(i)).select("path")


@query(
    """SELECT count(*) AS total, count(*) FILTER (hit) AS covered, count(*) FILTER (NOT hit AND tier = 'required') AS required,
              count(*) FILTER (NOT hit AND tier = 'middle') AS middle, count(*) FILTER (NOT hit AND tier = 'excluded') AS excluded
       FROM (SELECT t.tier, t.path IN (SELECT path FROM matched) AS hit FROM tiered t)""",
    PART_COVER, MATCH, TIERED,
)
def coverage_summary(i: Inputs) -> DataFrame:
    return own.coverage_summary(i.paths, _partial(i), i.roots).drop("graph_id")


@query(
    """SELECT path, row_number() OVER (ORDER BY path) AS rank, greatest(count(*) OVER () - 5, 0) AS rest
       FROM (SELECT path FROM paths EXCEPT SELECT path FROM matched) QUALIFY rank <= 5""",
    PART_COVER, MATCH,
)
def coverage_sample(i: Inputs) -> DataFrame:
    return own.coverage_sample(own.uncovered_files(i.paths, _partial(i))).drop("graph_id")


@query(
    """SELECT place_kind, place, node_path, n, first_node FROM (
         SELECT *, count(*) OVER (PARTITION BY place_kind, place) AS n, min(node_path) OVER (PARTITION BY place_kind, place) AS first_node
         FROM claims c WHERE NOT EXISTS (SELECT 1 FROM claims d WHERE d.place_kind = c.place_kind AND d.place = c.place
                                         AND starts_with(d.node_path, concat(c.node_path, '/')))) WHERE n > 1""",
    CLEAN, MATCH,
    ("claims", "SELECT DISTINCT 'entry' AS place_kind, entry AS place, node_path FROM clean UNION SELECT DISTINCT 'file', path, node_path FROM matched"),
)
def mapping_overlap(i: Inputs) -> DataFrame:
    return own.mapping_overlap(i.dnodes, i.dmappings, i.paths).select("place_kind", "place", "node_path", "n", "first_node")


@query(
    """SELECT node_path, concat('gone/', node_path) AS entry, 'unmatched' AS fault FROM dnodes
       UNION ALL SELECT node_path, concat('../', node_path), 'escape' FROM dnodes"""
)
def mapping_paths(i: Inputs) -> DataFrame:
    bad = i.dnodes.select("graph_id", "node_path", F.explode(F.array(F.concat(F.lit("gone/"), "node_path"), F.concat(F.lit("../"), "node_path"))).alias("entry"))
    both = bad.unionByName(i.dmappings.drop("ord"))
    return own.mapping_paths(both, i.paths).select("node_path", "entry", "fault")


@query(
    """SELECT DISTINCT concat('n/', source, '/', lang) AS dir FROM documents WHERE lang = 'es'""",
)
def bare_directories(i: Inputs) -> DataFrame:
    dirs = i.dnodes.select("graph_id", F.col("node_path").alias("dir"))
    return own.bare_directories(dirs, i.dnodes.filter("node_path NOT LIKE '%/es'")).select("dir")


@query("SELECT unit_key, 'file' AS kind, substr(unit_key, 6) AS target FROM (SELECT concat('file:', path) AS unit_key FROM web)")
def unit_keys(i: Inputs) -> DataFrame:
    kind, target = split_key("unit_key")
    return i.web.select(unit_of_file("path").alias("unit_key")).select("unit_key", kind.alias("kind"), target.alias("target"))


@query(
    """SELECT doc_id, CASE WHEN strlen(text) <= 2000 THEN text WHEN t.body IS NOT NULL THEN t.body
                ELSE concat(repeat(chr(65533), 2000 - strlen(right(text, c.k))), right(text, c.k)) END AS body
       FROM documents d
       LEFT JOIN (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS body FROM (
                    SELECT doc_id, pos, line, sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos DESC) AS back
                    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)) WHERE back <= 2000 GROUP BY doc_id) t USING (doc_id)
       LEFT JOIN (SELECT doc_id, max(k) AS k FROM documents, range(1, 2001) r(k) WHERE strlen(text) > 2000 AND strlen(right(text, k)) <= 2000 GROUP BY doc_id) c USING (doc_id)"""
)
def tail_truncated(i: Inputs) -> DataFrame:
    return i.base("documents").select("doc_id", tail_truncate("text", 2000).alias("body"))
