"""Graph tables derived from the star-schema tables, as SQL that Spark and DuckDB both read.

``{sha(…)}`` stands for the hex digest of a text; everything else is common SQL.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.operators.keyed import shared_folder, shuffled_join, sized_shuffles

BASE = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)

_CUSTOMER = "concat('r', n_regionkey, '/n', n_nationkey, '/c', c_custkey)"
_SUPPLIER = "concat('r', n_regionkey, '/n', n_nationkey, '/s', s_suppkey)"
_REL_TYPE = (
    "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'uses' WHEN '2' THEN 'calls' WHEN '3' THEN 'extends' "
    "WHEN '4' THEN 'emits' ELSE 'listens' END"
)
_STATUS = "CASE {0} WHEN 0 THEN 'draft' WHEN 1 THEN 'advisory' ELSE 'enforced' END"

INPUTS: dict[str, str] = {
    # -- organisation graph: regions, nations, customers and suppliers -------------------------------------
    "nodes": f"""
        SELECT 'g0' AS graph_id, concat('r', r_regionkey) AS node_path, CAST(NULL AS STRING) AS parent_path,
               r_name AS name, 'region' AS type, r_name AS description, CAST(r_regionkey AS BIGINT) AS ord FROM region
        UNION ALL
        SELECT 'g0', concat('r', n_regionkey, '/n', n_nationkey), concat('r', n_regionkey), n_name, 'nation', n_name,
               CAST(100 + n_nationkey AS BIGINT) FROM nation
        UNION ALL
        SELECT 'g0', {_CUSTOMER}, concat('r', n_regionkey, '/n', n_nationkey), c_name, c_mktsegment,
               CASE WHEN c_acctbal > 0 THEN c_name ELSE '' END, CAST(1000 + c_custkey AS BIGINT)
        FROM customer JOIN nation ON c_nationkey = n_nationkey
        UNION ALL
        SELECT 'g0', {_SUPPLIER}, concat('r', n_regionkey, '/n', n_nationkey), s_name, 'supplier', s_name,
               CAST(1000000000 + s_suppkey AS BIGINT)
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "customers": f"SELECT c_custkey, {_CUSTOMER} AS path FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "suppliers": f"SELECT s_suppkey, {_SUPPLIER} AS path FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "orderlines": f"""
        SELECT c.path AS source, s.path AS target, {_REL_TYPE} AS type, l_returnflag AS port, l_quantity AS quantity
        FROM orders JOIN lineitem ON l_orderkey = o_orderkey
        JOIN customers c ON c.c_custkey = o_custkey JOIN suppliers s ON s.s_suppkey = l_suppkey""",
    "relations": """
        SELECT DISTINCT 'g0' AS graph_id, source, target, type,
               CASE WHEN type IN ('emits', 'listens') THEN 'order' END AS event_name FROM orderlines""",
    "consumes": "SELECT DISTINCT 'g0' AS graph_id, source, target, type, port FROM orderlines WHERE quantity > 45",
    "ports": "SELECT DISTINCT 'g0' AS graph_id, target AS node_path, port, concat('returns ', port) AS description FROM orderlines",
    "rules": f"""
        SELECT 'g0' AS graph_id, concat('p', p_partkey) AS rule_id, p_name AS name, concat(p_name, ' ', p_type) AS description,
               CASE p_type WHEN 'PROMO' THEN 'bundle' WHEN 'LARGE' THEN 'judged' WHEN 'MEDIUM' THEN 'judged' ELSE 'computed' END AS kind,
               {_STATUS.format('p_size % 3')} AS status, CAST(NULL AS STRING) AS condition,
               CASE p_type WHEN 'LARGE' THEN 'deep' ELSE 'standard' END AS tier, p_partkey AS ord FROM part""",
    "rules_when": """
        SELECT graph_id, rule_id, name, description, kind, status, tier, ord,
               CASE kind WHEN 'bundle' THEN '{"node":{"type":"supplier"}}'
                         WHEN 'judged' THEN '{"any_of":[{"relations":{"uses":{"target_type":"supplier"}}},{"descendants":{"type":"supplier"}}]}'
               END AS condition FROM rules""",
    "implies": """
        SELECT 'g0' AS graph_id, concat('p', p_partkey) AS implier, concat('p', CAST(floor(p_partkey / 2) AS BIGINT)) AS implied,
               CAST(NULL AS STRING) AS condition,
               CASE WHEN p_type = 'SMALL' THEN 'own-default' ELSE 'strictest' END AS inherit FROM part WHERE p_partkey >= 1""",
    "implies_cyclic": """
        SELECT graph_id, implier, implied, condition, inherit FROM implies
        UNION ALL SELECT 'g0', 'p3', 'p7', CAST(NULL AS STRING), 'strictest'""",
    "flows": "SELECT DISTINCT 'g0' AS graph_id, o_orderstatus AS flow, concat('orders ', o_orderstatus) AS name, '' AS description FROM orders",
    "flow_nodes": """
        SELECT DISTINCT 'g0' AS graph_id, o_orderstatus AS flow, concat('r', n_regionkey, '/n', n_nationkey) AS node_path
        FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey""",
    "attachments_raw": f"""
        SELECT 'g0' AS graph_id, 'node' AS site_kind, path AS site, CAST(NULL AS STRING) AS port, concat('p', c_custkey) AS rule_id,
               CASE c_custkey % 4 WHEN 0 THEN 'draft' WHEN 1 THEN 'advisory' WHEN 2 THEN 'enforced' END AS status,
               CAST(NULL AS STRING) AS condition, 0 AS ord FROM customers
        UNION ALL
        SELECT 'g0', 'node', path, CAST(NULL AS STRING), concat('p', s_suppkey), CAST(NULL AS STRING), CAST(NULL AS STRING), 0 FROM suppliers
        UNION ALL
        SELECT 'g0', 'node', concat('r', n_regionkey, '/n', n_nationkey), CAST(NULL AS STRING), concat('p', n_nationkey * 7), 'advisory', CAST(NULL AS STRING), 0 FROM nation
        UNION ALL
        SELECT 'g0', 'node', concat('r', r_regionkey), CAST(NULL AS STRING), concat('p', r_regionkey + 3), CAST(NULL AS STRING), CAST(NULL AS STRING), 0 FROM region
        UNION ALL
        SELECT DISTINCT 'g0', 'type', c_mktsegment, CAST(NULL AS STRING), concat('p', length(c_mktsegment)), 'enforced', CAST(NULL AS STRING), 0 FROM customer
        UNION ALL
        SELECT DISTINCT 'g0', 'type', 'nation', CAST(NULL AS STRING), concat('p', 40 + r_regionkey), CAST(NULL AS STRING), CAST(NULL AS STRING), r_regionkey FROM region
        UNION ALL
        SELECT 'g0', 'flow', flow, CAST(NULL AS STRING), concat('p', ascii(flow)), CAST(NULL AS STRING), CAST(NULL AS STRING), 0 FROM flows
        UNION ALL
        SELECT 'g0', 'port', node_path, port, concat('p', ascii(port)), CAST(NULL AS STRING), CAST(NULL AS STRING), 0 FROM ports""",
    "type_names": "SELECT DISTINCT 'g0' AS graph_id, type FROM nodes",
    "type_parents": """
        SELECT 'g0' AS graph_id, 'region' AS type, CAST(NULL AS STRING) AS parent
        UNION ALL SELECT 'g0', 'nation', 'region' UNION ALL SELECT 'g0', 'supplier', 'region'
        UNION ALL SELECT DISTINCT 'g0', c_mktsegment, 'nation' FROM customer
        UNION ALL SELECT DISTINCT 'g0', p_brand, p_type FROM part UNION ALL SELECT DISTINCT 'g0', p_type, p_brand FROM part""",
    "type_matrix": """
        SELECT DISTINCT 'g0' AS graph_id, c_mktsegment AS type, o_kind AS rel, 'supplier' AS target
        FROM customer CROSS JOIN (SELECT 'uses' AS o_kind UNION ALL SELECT 'emits') k
        UNION ALL SELECT DISTINCT 'g0', c_mktsegment, 'extends', 'nation' FROM customer
        UNION ALL SELECT 'g0', 'nation', 'calls', '*'""",
    # -- forest of parts: reachability over every part ------------------------------------------------------
    "part_edges": """
        SELECT 'g0' AS graph_id, concat('p', p_partkey) AS source, concat('p', CAST(floor(p_partkey / 2) AS BIGINT)) AS target,
               CASE WHEN p_type IN ('PROMO', 'ECONOMY') THEN 'emits' WHEN p_type = 'SMALL' THEN 'calls' ELSE 'uses' END AS type,
               CAST(NULL AS STRING) AS event_name FROM part WHERE p_partkey >= 1""",
    "part_nodes": "SELECT 'g0' AS graph_id, concat('p', p_partkey) AS node_path FROM part",
    # each customer depends on the customer its latest order names
    "referrals": """
        SELECT 'g0' AS graph_id, concat('c', o_custkey) AS source,
               concat('c', CAST((max(o_orderkey) * 31 + 7) % (SELECT count(*) FROM customer) AS BIGINT)) AS target, 'uses' AS type
        FROM orders GROUP BY o_custkey""",
    # -- document graph: files, mappings, rules, verdicts ---------------------------------------------------
    "files": "SELECT 'g0' AS graph_id, concat(source, '/', lang, '/', doc_id, '.txt') AS path, text AS content, doc_id, lang, source, {sha(text)} AS hash FROM documents",
    "paths": "SELECT graph_id, path FROM files",
    "dnodes": """
        SELECT 'g0' AS graph_id, 'n' AS node_path, CAST(NULL AS STRING) AS parent_path, 'root' AS type, 'all documents' AS description,
               CAST(0 AS BIGINT) AS ord
        UNION ALL SELECT 'g0', 'g', CAST(NULL AS STRING), 'root', 'french', CAST(1 AS BIGINT)
        UNION ALL SELECT DISTINCT 'g0', concat('n/', source), 'n', 'source', concat('from ', source), CAST(10 + length(source) AS BIGINT) FROM documents
        UNION ALL SELECT DISTINCT 'g0', concat('n/', source, '/', lang), concat('n/', source), 'shelf', lang, CAST(100 + length(source) AS BIGINT) FROM documents""",
    "dmappings": """
        SELECT DISTINCT 'g0' AS graph_id, concat('n/', source) AS node_path, concat('./', source, '/') AS entry, 0 AS ord FROM documents
        UNION ALL SELECT DISTINCT 'g0', concat('n/', source, '/', lang), concat(source, '/', lang), 0 FROM documents WHERE lang IN ('de', 'en')
        UNION ALL SELECT 'g0', 'g', '*/fr/*.txt', 0""",
    "drules": f"""
        SELECT 'g0' AS graph_id, concat(p_brand, '/', p_type) AS rule_id, min(p_name) AS name, concat(p_type, ' goods of ', p_brand) AS description,
               CASE p_type WHEN 'PROMO' THEN 'bundle' WHEN 'LARGE' THEN 'judged' WHEN 'MEDIUM' THEN 'judged' ELSE 'computed' END AS kind,
               {_STATUS.format('min(p_size) % 3')} AS status, CAST(NULL AS STRING) AS condition,
               CASE p_type WHEN 'LARGE' THEN 'deep' ELSE 'standard' END AS tier,
               CASE WHEN p_type IN ('STANDARD', 'LARGE') THEN 'node' ELSE 'file' END AS scope_per,
               CASE WHEN p_type = 'ECONOMY' THEN '{{"any_of":[{{"path":"**/en/*.txt"}},{{"content":"[0-9]{{4}}"}}]}}' END AS scope_files,
               concat('rule for ', p_brand) AS body, CAST(min(p_partkey) AS BIGINT) AS ord
        FROM part GROUP BY p_brand, p_type""",
    "dimplies": """
        SELECT DISTINCT 'g0' AS graph_id, concat(p_brand, '/PROMO') AS implier, concat(p_brand, '/LARGE') AS implied,
               CAST(NULL AS STRING) AS condition, 'strictest' AS inherit FROM part""",
    "dattach": """
        SELECT DISTINCT 'g0' AS graph_id, 'node' AS site_kind, concat('n/src', CAST(replace(p_brand, 'Brand#', '') AS INT) % 20) AS site,
               CAST(NULL AS STRING) AS port, concat(p_brand, '/', p_type) AS rule_id, CAST(NULL AS STRING) AS status,
               CAST(NULL AS STRING) AS condition, 0 AS ord FROM part WHERE p_type <> 'LARGE'""",
    "tiers": """
        SELECT 'g0' AS graph_id, 'standard' AS tier, 1 AS consensus, 1000 AS max_chars, TRUE AS is_default
        UNION ALL SELECT 'g0', 'deep', 3, 50000, FALSE""",
    "votes": """
        SELECT 'g0' AS graph_id, concat('q', d.doc_id % 7) AS rule_id, concat('file:', source, '/', lang, '/', d.doc_id, '.txt') AS unit_key,
               v AS vote_no, CASE v WHEN 0 THEN quality = 1 WHEN 1 THEN toxic = 0 ELSE n_chars % 2 = 0 END AS satisfied,
               concat('vote ', v, ' on ', d.doc_id) AS reason, CASE WHEN n_chars % 3 = 0 THEN 'provider' ELSE 'codeViolation' END AS error_source
        FROM labels l JOIN documents d ON d.doc_id = l.doc_id
        CROSS JOIN (SELECT 0 AS v UNION ALL SELECT 1 UNION ALL SELECT 2) x""",
    "roots": """
        SELECT DISTINCT 'g0' AS graph_id, source AS root, CASE WHEN length(source) = 4 THEN 'required' ELSE 'excluded' END AS tier FROM documents
        UNION ALL SELECT DISTINCT 'g0', concat('/', source, '//', lang, '/'), 'excluded' FROM documents WHERE lang = 'fr'""",
    "web": "SELECT DISTINCT 'g0' AS graph_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS path FROM pages",
    "assets": """
        SELECT 'g0' AS graph_id, concat('r', p_partkey % 7) AS rule_id,
               concat(CASE p_size WHEN 1 THEN '.cursor/' WHEN 2 THEN '.graph/' ELSE 'a/' END, p_partkey,
                      CASE p_type WHEN 'ECONOMY' THEN '.PNG' WHEN 'SMALL' THEN '.md' WHEN 'MEDIUM' THEN '.zip' WHEN 'PROMO' THEN '.py'
                                  WHEN 'STANDARD' THEN '.tsx' ELSE '.rs' END) AS path,
               CASE WHEN p_partkey % 2 = 0 THEN 'judged' ELSE 'computed' END AS kind FROM part""",
    "patterns": """
        SELECT DISTINCT 'g0' AS graph_id, '' AS dir, concat(lang, '/') AS pattern, 1 AS ord FROM documents WHERE lang = 'es'
        UNION ALL SELECT DISTINCT 'g0', source, '!*.txt', 2 FROM documents WHERE length(source) = 4
        UNION ALL SELECT DISTINCT 'g0', concat(source, '/', lang), '1*.txt', 3 FROM documents WHERE lang = 'en'""",
    "label_mappings": "SELECT 'g0' AS graph_id, concat('q/', quality) AS node_path, path AS entry, 0 AS ord FROM files JOIN labels ON labels.doc_id = files.doc_id",
    # -- code of customers that import suppliers ------------------------------------------------------------
    "code_edges": """
        SELECT 'g0' AS graph_id, c.path AS source, s.path AS target, concat('order', l_orderkey) AS file, CAST(l_linenumber AS BIGINT) AS line
        FROM orders JOIN lineitem ON l_orderkey = o_orderkey
        JOIN customers c ON c.c_custkey = o_custkey JOIN suppliers s ON s.s_suppkey = l_suppkey""",
    "declared": """
        SELECT DISTINCT graph_id, source, target, type FROM relations WHERE type IN ('uses', 'calls')
        UNION SELECT DISTINCT graph_id, source, regexp_replace(target, '/[^/]*$', ''), type FROM relations WHERE type = 'extends'""",
    # -- journals and waivers from the event stream ---------------------------------------------------------
    "journal_entries": """
        SELECT 'g0' AS graph_id, concat('u', user_id) AS node_path,
               row_number() OVER (PARTITION BY user_id ORDER BY event_id % 50, event_id) AS pos,
               CONCAT(substr(CAST(ts AS STRING), 1, 10), 'T', substr(CAST(ts AS STRING), 12, 8), '.', lpad(CAST(event_id % 1000 AS STRING), 3, '0'), 'Z') AS ts,
               event_type AS body FROM events""",
    # journals with every fault there is: entries by kind, with the lines that each takes
    "rough_entries": """
        SELECT graph_id, node_path, pos, ts, k, CASE k WHEN 2 THEN 3 WHEN 3 THEN 5 WHEN 4 THEN 4 ELSE 2 END AS n,
               CASE k WHEN 0 THEN concat('## [', substr(ts, 1, 10), ']', chr(10), body, chr(10))
                      WHEN 1 THEN concat('## [soon]', chr(10), body, chr(10))
                      WHEN 2 THEN concat('## [', ts, ']', chr(10), '## stray', chr(10), body, chr(10))
                      WHEN 3 THEN concat('## [', ts, ']', chr(10), '```', chr(10), '## [fenced]', chr(10), '## stray', chr(10), '```', chr(10))
                      WHEN 4 THEN concat('## [', ts, ']', chr(10), '````x', chr(10), '```', chr(10), '````', chr(10))
                      ELSE concat('## [', ts, ']', chr(10), body, chr(10)) END AS block
        FROM (SELECT graph_id, node_path, pos, body, k, CASE WHEN k = 6 THEN coalesce(lag(ts) OVER (PARTITION BY node_path ORDER BY pos), ts) ELSE ts END AS ts
              FROM (SELECT *, (pos + length(body)) % 11 AS k FROM journal_entries) e) r""",
    "markers": """
        SELECT 'g0' AS graph_id, concat('u', user_id, '.txt') AS file, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS line,
               CASE event_id % 5 WHEN 0 THEN '*' ELSE concat('p', event_id % 5) END AS rule_id,
               CASE event_type WHEN 'view' THEN 'single' WHEN 'click' THEN 'disable' WHEN 'purchase' THEN 'enable'
                               WHEN 'error' THEN 'disable' ELSE 'enable' END AS kind,
               event_id % 5 = 0 AS wildcard, CASE WHEN value < 5 THEN '' ELSE props END AS reason FROM events""",
    "marker_files": "SELECT 'g0' AS graph_id, concat('u', user_id, '.txt') AS file, count(*) + 10 AS total_lines FROM events GROUP BY user_id",
    "findings": """
        SELECT 'g0' AS graph_id, concat('p', l_linenumber) AS rule_id, concat('node:x', l_suppkey) AS unit_key, concat('u', l_suppkey, '.txt') AS file,
               CASE WHEN l_returnflag = 'R' THEN CAST(NULL AS BIGINT) ELSE CAST(l_quantity AS BIGINT) END AS line, l_linestatus AS message
        FROM lineitem""",
}


def duck(text: str) -> str:
    return re.sub(r"\{sha\(([^{}]*)\)\}", r"sha256(\1)", text)


def _spark(text: str) -> str:
    return re.sub(r"\{sha\(([^{}]*)\)\}", r"sha2(\1, 256)", text)


def needed(*names: str) -> list[str]:
    """Inputs behind the named ones, in dependency order."""
    out: list[str] = []

    def visit(name: str) -> None:
        if name in out:
            return
        for other in INPUTS:
            if other != name and re.search(rf"\b(FROM|JOIN)\s+{other}\b", INPUTS[name]):
                visit(other)
        out.append(name)

    for n in names:
        visit(n)
    return out


def with_inputs(sql: str, *extra: tuple[str, str], recursive: bool = False) -> str:
    """DuckDB text with the inputs it names in front, then the extra CTEs, then the query."""
    body = " ".join([s for _, s in extra] + [sql])
    named = [n for n in INPUTS if re.search(rf"\b{n}\b", body)]
    ctes = [f"{n} AS ({duck(INPUTS[n])})" for n in needed(*named)] + [f"{n} AS ({duck(s)})" for n, s in extra]
    if not ctes:
        return duck(sql)
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(ctes) + "\n" + duck(sql)


_STAGED: dict[tuple[str, str, str], str] = {}


class Inputs:
    """The derived tables over one folder of star-schema parquet files.

    A derived table is written once per application to the shared checkpoint folder and read from there by
    every query, as the tables of a real graph would be.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in INPUTS:
            raise AttributeError(name)
        return self._stage(name, lambda: self._derive(name))

    def _derive(self, name: str) -> DataFrame:
        order = needed(name)
        text = " ".join(INPUTS[n] for n in order)
        for table in BASE:
            if re.search(rf"\b(FROM|JOIN)\s+{table}\b", text):
                self.base(table).createOrReplaceTempView(table)
        ctes = ",\n".join(f"{n} AS ({_spark(INPUTS[n])})" for n in order)
        return self.spark.sql(f"WITH {ctes} SELECT * FROM {name}")

    def _stage(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.folder, name)
        if key not in _STAGED:
            path = f"{shared_folder(self.spark)}/attestry-inputs/{uuid.uuid4().hex}/{name}"
            rows = make()
            with sized_shuffles(rows):
                rows.write.parquet(path)
            _STAGED[key] = path
        return self.spark.read.parquet(_STAGED[key])

    @property
    def relations_full(self) -> DataFrame:
        return self._stage("relations_full", self._relations_full)

    def _relations_full(self) -> DataFrame:
        """Relations with the ports they consume as an array."""
        key = ["graph_id", "source", "target", "type"]
        used = self.consumes.groupBy(*key).agg(F.sort_array(F.collect_set("port")).alias("consumes"))
        return shuffled_join(self.relations, used, key, "left")

    @property
    def types(self) -> DataFrame:
        return self._stage("types", self._types)

    def _types(self) -> DataFrame:
        """Type model of the organisation graph with its relation matrix."""
        per = self.type_matrix.groupBy("graph_id", "type", "rel").agg(F.collect_set("target").alias("targets"))
        matrix = per.groupBy("graph_id", "type").agg(F.map_from_entries(F.collect_list(F.struct("rel", "targets"))).alias("relations"))
        up = self.type_parents.filter("parent is not null").groupBy("graph_id", "type").agg(F.collect_set("parent").alias("parents"))
        rows = self.type_names.join(matrix, ["graph_id", "type"], "left").join(up, ["graph_id", "type"], "left")
        return rows.withColumns({
            "relation_default": F.when(F.length("type") > 8, "deny").otherwise("allow"),
            "predicate": F.when(F.col("type") != "region", F.lit('{"path":"**"}')),
            "strict": F.col("type").isin("region", "supplier"),
            "log_required": F.col("type") == "supplier",
        })

    @property
    def journals(self) -> DataFrame:
        return self._stage("journals", self._journals)

    @property
    def rough_journals(self) -> DataFrame:
        return self._stage("rough_journals", self._rough_journals)

    def _rough_journals(self) -> DataFrame:
        """Journal text per node out of the rough entries, some with a line in front, some with a fence left open."""
        rows = self.rough_entries.groupBy("graph_id", "node_path").agg(F.array_sort(F.collect_list(F.struct("pos", "block"))).alias("l"))
        text = F.array_join(F.transform("l", lambda e: e["block"]), "")
        front = F.when(F.length("node_path") == 3, "hello\n").otherwise("")
        tail = F.when(F.col("node_path").endswith("7"), "```\nopen\n## [late]").otherwise("")
        return rows.select("graph_id", "node_path", F.concat(front, text, tail).alias("content"))

    def _journals(self) -> DataFrame:
        """Journal text per node out of its entries."""
        block = F.concat(F.lit("## ["), "ts", F.lit("]\n"), "body", F.lit("\n"))
        rows = self.journal_entries.groupBy("graph_id", "node_path").agg(
            F.array_sort(F.collect_list(F.struct("pos", block.alias("b")))).alias("l")
        )
        return rows.select("graph_id", "node_path", F.array_join(F.transform("l", lambda s: s["b"]), "").alias("content"))
