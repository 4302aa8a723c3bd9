"""File inventories, journals and graph documents as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.functions.paths import parent_path, path_prefixes
from attestry.operators.keyed import salted_join

# Version-control folders that never hold sources.
VCS = [".git", ".hg", ".svn"]


def scan_files(spark: SparkSession, root: str, name: str | None = None) -> DataFrame:
    """Every file below ``root/<graph_id>/`` as ``(graph_id, path, content, size, is_text)``; metadata folders are skipped.

    A file that is not UTF-8 has null content and ``is_text`` false. ``name`` keeps files of that name only, before
    they are read.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    raw = (reader if name is None else reader.option("pathGlobFilter", name)).load(root)
    # the root as the file system writes it, without its scheme: what stands before it is the same in every path
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toString().rstrip("/") + "/"
    full = F.try_url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    inside = F.when(full.startswith(base.replace(":///", ":/")) | full.startswith(base), full)
    plain = base.split(":", 1)[1].lstrip("/")
    rel = F.substring(F.regexp_replace(inside, "^[^:]*:/*", ""), F.lit(len(plain) + 1), F.length(inside))
    rows = raw.select(rel.alias("rel"), F.try_validate_utf8(F.col("content").cast("string")).alias("content"), F.col("length").alias("size"))
    rows = rows.select(
        F.substring_index("rel", "/", 1).alias("graph_id"), F.regexp_replace("rel", r"^[^/]*/", "").alias("path"), "content", "size", F.col("content").isNotNull().alias("is_text")
    )
    return rows.filter(~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(v) for v in VCS])))


def read_journals(spark: SparkSession, root: str, nodes: DataFrame, name: str = "log.md") -> DataFrame:
    """One text per node from ``root/<graph_id>/<node_path>/log.md``; a missing one is empty."""
    files = scan_files(spark, root, name)
    texts = files.select("graph_id", parent_path("path").alias("node_path"), "content")
    return nodes.select("graph_id", "node_path").join(texts, ["graph_id", "node_path"], "left").withColumn("content", F.coalesce("content", F.lit("")))


SITE = "array<struct<rule_id:string,status:string,condition:string>>"
NODE_DOC = (
    "name string, type string, description string, mapping array<string>, "
    "relations array<struct<target:string,type:string,event_name:string,consumes:array<string>>>, "
    f"ports map<string,struct<description:string,rules:{SITE}>>, rules {SITE}"
)
FLOW_DOC = f"name string, description string, nodes array<string>, rules {SITE}"
RULE_DOC = (
    "name string, description string, kind string, tier string, status string, scope_per string, scope_files string, "
    "condition string, body string, refs array<struct<path:string,description:string>>, has_companion boolean, "
    "implies array<struct<rule_id:string,condition:string,inherit:string>>"
)
TYPE_DOC = (
    "description string, predicate string, strict boolean, log_required boolean, relation_default string, "
    f"parents array<string>, relations map<string,array<string>>, rules {SITE}"
)


def normalize_graph(docs: DataFrame) -> dict[str, DataFrame]:
    """Nested graph documents ``(graph_id, kind, path, doc)`` as flat tables; ``doc`` is JSON text.

    ``kind`` is node, flow, rule or type and ``path`` its id. A node's parent is the nearest directory above
    that is a node. List order is kept as ``ord``.
    """
    def of(kind: str, schema: str) -> DataFrame:
        return docs.filter(F.col("kind") == kind).select("graph_id", "path", "doc", F.from_json("doc", schema).alias("d"))

    node, flow, rule, type_ = of("node", NODE_DOC), of("flow", FLOW_DOC), of("rule", RULE_DOC), of("type", TYPE_DOC)
    g, path = F.col("graph_id"), F.col("path")
    known = node.select("graph_id", path.alias("anc"))
    up = node.select("graph_id", path.alias("node_path"), F.explode(path_prefixes("path", with_self=False)).alias("anc"))
    parents = salted_join(up, known, ["graph_id", "anc"]).groupBy("graph_id", "node_path").agg(F.max_by("anc", F.length("anc")).alias("parent_path"))
    nodes = node.select(
        g, path.alias("node_path"), "d.name", "d.type", "d.description", "doc", F.xxhash64("path").alias("ord")
    ).join(parents, ["graph_id", "node_path"], "left")
    mappings = node.select(g, path.alias("node_path"), F.posexplode("d.mapping").alias("ord", "entry"))
    relations = node.select(g, path.alias("source"), F.posexplode("d.relations").alias("ord", "r")).select(
        "graph_id", "source", "r.target", "r.type", "r.event_name", "r.consumes", "ord"
    )
    port = node.select(g, path.alias("node_path"), F.explode("d.ports").alias("port", "p"))
    ports = port.select("graph_id", "node_path", "port", "p.description")

    def sites(rows: DataFrame, kind: str, site: str, rules: str, port_col=None) -> DataFrame:
        return rows.select(
            "graph_id", F.lit(kind).alias("site_kind"), F.col(site).alias("site"),
            (F.lit(None).cast("string") if port_col is None else F.col(port_col)).alias("port"), F.posexplode(rules).alias("ord", "r"),
        ).select("graph_id", "site_kind", "site", "port", "r.rule_id", "r.status", "r.condition", "ord")

    attachments = (
        sites(node, "node", "path", "d.rules").unionByName(sites(flow, "flow", "path", "d.rules"))
        .unionByName(sites(type_, "type", "path", "d.rules")).unionByName(sites(port, "port", "node_path", "p.rules", "port"))
    )
    rules = rule.select(
        g, path.alias("rule_id"), *[f"d.{c}" for c in (
            "name", "description", "kind", "tier", "status", "scope_per", "scope_files", "condition", "body", "refs", "has_companion"
        )],
    )
    implies = rule.select(g, path.alias("implier"), F.posexplode("d.implies").alias("ord", "i")).select(
        "graph_id", "implier", F.col("i.rule_id").alias("implied"), "i.condition", "i.inherit", "ord"
    )
    types = type_.select(
        g, path.alias("type"), *[f"d.{c}" for c in ("description", "predicate", "strict", "log_required", "relation_default", "parents", "relations")]
    )
    return {
        "nodes": nodes, "mappings": mappings, "relations": relations, "ports": ports,
        "flows": flow.select(g, path.alias("flow"), "d.name", "d.description"),
        "flow_nodes": flow.select(g, path.alias("flow"), F.explode("d.nodes").alias("node_path")),
        "attachments_raw": attachments, "rules": rules, "implies": implies, "types": types,
    }
