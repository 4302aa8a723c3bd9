"""Who owns a file: mapping entries against paths, containment of nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.functions.paths import depth, is_glob, normalize_path, parent_path, path_prefixes, split_key
from attestry.operators.keyed import entry_matches_file, first_by, salted_join, shuffled_join

FILE = ["graph_id", "path"]


def resolve_owner(files: DataFrame, mappings: DataFrame) -> DataFrame:
    """Owner of each file: longest matching entry, ties to the smaller node path. Unowned files get nulls."""
    # one winner per entry before the files meet the mappings
    entries = (
        mappings.withColumn("entry", normalize_path("entry"))
        .groupBy("graph_id", "entry")
        .agg(F.min("node_path").alias("node_path"))
    )
    found = entry_matches_file(files.select(*FILE), entries)
    owner = first_by(found, FILE, [-F.length("entry"), F.col("node_path")], ["node_path", "entry"])
    return shuffled_join(files, owner.withColumnRenamed("entry", "mapping"), FILE, "left")


def find_owner(files: DataFrame, mappings: DataFrame) -> DataFrame:
    """As resolve_owner, but an exact plain entry beats a longer glob; ``direct`` is exact or glob."""
    entries = (
        mappings.withColumn("entry", normalize_path("entry"))
        .groupBy("graph_id", "entry")
        .agg(F.min("node_path").alias("node_path"))
    )
    found = entry_matches_file(files.select(*FILE), entries).withColumn("exact", F.col("entry") == F.col("path"))
    owner = first_by(
        found,
        FILE,
        [F.when(F.col("exact"), 0).otherwise(1), -F.length("entry"), F.col("node_path")],
        ["node_path", "entry", "exact"],
    )
    return shuffled_join(
        files,
        owner.select(
            *FILE,
            "node_path",
            F.col("entry").alias("mapping"),
            (F.col("exact") | is_glob("entry")).alias("direct"),
        ),
        FILE,
        "left",
    )


def first_owner(files: DataFrame, nodes: DataFrame, mappings: DataFrame) -> DataFrame:
    """Owner by declaration order: the first node with a matching entry."""
    ordered = shuffled_join(
        mappings.select("graph_id", "node_path", "entry"),
        nodes.select("graph_id", "node_path", F.col("ord").alias("node_ord")), ["graph_id", "node_path"]
    )
    found = entry_matches_file(files.select(*FILE), ordered)
    return first_by(found, FILE, [F.col("node_ord"), F.col("node_path")], ["node_path"])


def owner_of_unit(verdicts: DataFrame, mappings: DataFrame) -> DataFrame:
    """Node of each unit key: ``node:`` keys name it, ``file:`` keys take the longest entry, first on ties."""
    kind, target = split_key("unit_key")
    keyed = verdicts.withColumn("_kind", kind).withColumn("_target", target)
    paths = keyed.filter(F.col("_kind") == "file").select("graph_id", F.col("_target").alias("path")).distinct()
    found = entry_matches_file(paths, mappings.select("graph_id", "node_path", "entry", "ord"))
    owner = first_by(found, FILE, [-F.length("entry"), F.col("ord"), F.col("node_path")], ["node_path"])
    joined = shuffled_join(
        keyed,
        owner.select("graph_id", F.col("path").alias("_target"), F.lit("file").alias("_kind"), F.col("node_path").alias("_owner")),
        ["graph_id", "_kind", "_target"],
        "left",
    )
    node = F.when(F.col("_kind") == "node", F.col("_target")).otherwise(F.col("_owner"))
    return joined.withColumn("node_path", node).drop("_kind", "_target", "_owner")


def node_closure(nodes: DataFrame, with_self: bool = False) -> DataFrame:
    """Ancestor-descendant pairs of the containment tree with their distance: one prefix join, no loop."""
    paths = nodes.select("graph_id", "node_path")
    up = paths.select(
        "graph_id",
        F.col("node_path").alias("descendant"),
        F.explode(path_prefixes("node_path", with_self=with_self)).alias("ancestor"),
    )
    known = paths.withColumnRenamed("node_path", "ancestor")
    return salted_join(up, known, ["graph_id", "ancestor"]).select(
        "graph_id", "ancestor", "descendant", (depth("descendant") - depth("ancestor")).alias("dist")
    )


def child_exclusions(nodes: DataFrame, mappings: DataFrame) -> DataFrame:
    """Entries of descendants that lie at or below an entry of the node itself."""
    entries = mappings.select("graph_id", "node_path", normalize_path("entry").alias("entry")).filter("entry <> ''").distinct()
    closure = node_closure(nodes)
    placed = entries.withColumnRenamed("node_path", "descendant").withColumn("parent_entry", F.explode(path_prefixes("entry")))
    below = shuffled_join(placed, closure, ["graph_id", "descendant"])
    own = entries.select("graph_id", F.col("node_path").alias("ancestor"), F.col("entry").alias("parent_entry"))
    return (
        shuffled_join(below, own, ["graph_id", "ancestor", "parent_entry"], "left_semi")
        .select("graph_id", F.col("ancestor").alias("node_path"), "entry")
        .distinct()
    )


def expand_mapping(nodes: DataFrame, mappings: DataFrame, files: DataFrame) -> DataFrame:
    """Files of each node, less those under entries of descendants that lie inside its own entries."""
    paths = files.select(*FILE)
    entries = mappings.select("graph_id", "node_path", "entry")
    own = entry_matches_file(paths, entries).select("graph_id", "node_path", "path").distinct()
    carved = entry_matches_file(paths, child_exclusions(nodes, mappings)).select("graph_id", "node_path", "path")
    return shuffled_join(own, carved, ["graph_id", "node_path", "path"], "left_anti")


def candidate_owners(files: DataFrame, mappings: DataFrame) -> DataFrame:
    """For unmapped files: nodes with entries in the same directory, by count."""
    near = (
        mappings.select("graph_id", "node_path", normalize_path("entry").alias("entry"))
        .filter("entry <> ''")
        .withColumn("dir", parent_path("entry"))
        .groupBy("graph_id", "dir", "node_path")
        .agg(F.count("*").alias("n"))
    )
    return salted_join(files.select(*FILE).withColumn("dir", parent_path("path")), near, ["graph_id", "dir"]).select(
        "graph_id", "path", "node_path", "n"
    )


def list_tree(nodes: DataFrame, root: str | None = None, max_depth: int | None = None) -> DataFrame:
    """Nodes of a subtree down to a depth."""
    out = nodes
    if root is not None:
        out = out.filter((F.col("node_path") == root) | F.col("node_path").startswith(root + "/"))
    if max_depth is not None:
        base = 0 if root is None else root.count("/") + 1
        out = out.filter(depth("node_path") - base <= max_depth)
    return out.orderBy("graph_id", "node_path")


def drop_nested_roots(files: DataFrame, marker: str) -> DataFrame:
    """Drop files below a directory that holds its own graph directory named ``marker``."""
    parts = F.split("path", "/")
    at = F.array_position(parts, marker)
    roots = (
        files.select("graph_id", parts.alias("parts"), at.alias("at"))
        .filter(F.col("at") > 1)
        .select("graph_id", F.array_join(F.slice("parts", F.lit(1), F.col("at").cast("int") - 1), "/").alias("root"))
        .distinct()
    )
    inside = salted_join(
        files.select("graph_id", "path", F.explode(path_prefixes("path", with_self=False)).alias("root")),
        roots,
        ["graph_id", "root"],
        "left_semi",
    ).select("graph_id", "path").distinct()
    return shuffled_join(files, inside, FILE, "left_anti")


def coverage_tiers(files: DataFrame, roots: DataFrame) -> DataFrame:
    """Tier of each file by the longest matching root; ``excluded`` wins on equal length, none is ``middle``."""
    from attestry.functions.paths import normalize_root

    norm = roots.withColumn("root", normalize_root("root"))
    whole = norm.filter("root = ''").groupBy("graph_id").agg(F.max(F.col("tier") == "excluded").alias("_whole_ex"))
    named = entry_matches_file(files.select(*FILE), norm.filter("root <> ''"), entry="root")
    best = named.groupBy(*FILE).agg(
        F.max(F.struct(F.length("root").alias("len"), (F.col("tier") == "excluded").alias("ex"))).alias("best")
    )
    joined = salted_join(shuffled_join(files, best, FILE, "left"), whole, ["graph_id"], "left")
    excluded = F.coalesce(F.col("best.ex"), F.col("_whole_ex"))
    tier = F.when(excluded.isNull(), "middle").when(excluded, "excluded").otherwise("required")
    return joined.withColumn("tier", tier).drop("best", "_whole_ex")


def uncovered_files(files: DataFrame, mappings: DataFrame) -> DataFrame:
    """Files no mapping entry matches."""
    hit = entry_matches_file(files.select(*FILE), mappings.select("graph_id", "entry").distinct())
    return shuffled_join(files, hit.select(*FILE).distinct(), FILE, "left_anti")


def coverage_summary(files: DataFrame, mappings: DataFrame, roots: DataFrame) -> DataFrame:
    """Covered and total files per graph; uncovered ones by tier."""
    covered = entry_matches_file(files.select(*FILE), mappings.select("graph_id", "entry").distinct())
    flagged = shuffled_join(
        coverage_tiers(files.select(*FILE), roots),
        covered.select(*FILE).distinct().withColumn("_hit", F.lit(True)), FILE, "left"
    )
    miss = F.col("_hit").isNull()
    return flagged.groupBy("graph_id").agg(
        F.count("*").alias("total"),
        F.count_if(~miss).alias("covered"),
        F.count_if(miss & (F.col("tier") == "required")).alias("required"),
        F.count_if(miss & (F.col("tier") == "middle")).alias("middle"),
        F.count_if(miss & (F.col("tier") == "excluded")).alias("excluded"),
    )


def coverage_sample(uncovered: DataFrame, n: int = 5) -> DataFrame:
    """First ``n`` uncovered files per graph by path, each with the count of the rest."""
    from attestry.operators.keyed import top_n

    first = top_n(uncovered.select(*FILE), ["graph_id"], [F.col("path")], n)
    total = uncovered.groupBy("graph_id").agg(F.count("*").alias("total"))
    return first.join(total, "graph_id").select(
        *FILE, F.col("rank").cast("long").alias("rank"), F.greatest(F.col("total") - n, F.lit(0)).alias("rest")
    )


def mapping_overlap(nodes: DataFrame, mappings: DataFrame, files: DataFrame) -> DataFrame:
    """Places claimed by nodes that are not in one line of containment.

    One row per (place, claimant): an entry several nodes declare, or a file several reach. A node whose
    descendant claims the same place has given it up, so only the lowest claimants count. ``n`` is the number
    of claimants of the place; pairs are not listed, so a place many nodes claim stays linear.
    """
    entries = mappings.select("graph_id", "node_path", normalize_path("entry").alias("entry")).filter("entry <> ''").distinct()
    same = entries.select("graph_id", F.lit("entry").alias("place_kind"), F.col("entry").alias("place"), "node_path")
    reach = (
        entry_matches_file(files.select(*FILE), entries)
        .select("graph_id", F.lit("file").alias("place_kind"), F.col("path").alias("place"), "node_path")
        .distinct()
    )
    claims = same.unionByName(reach)
    place = ["graph_id", "place_kind", "place"]
    contested = claims.groupBy(*place).agg(F.count("*").alias("_c")).filter("_c > 1").drop("_c")
    claims = shuffled_join(claims, contested, place, "left_semi")
    given_up = claims.select(
        *place, F.explode(path_prefixes("node_path", with_self=False)).alias("node_path")
    ).distinct()
    leaves = shuffled_join(claims, given_up, [*place, "node_path"], "left_anti")
    counted = leaves.groupBy(*place).agg(F.count("*").alias("n"), F.min("node_path").alias("first_node"))
    return salted_join(leaves, counted.filter("n > 1"), place)


def mapping_paths(mappings: DataFrame, files: DataFrame) -> DataFrame:
    """Entries that match no file (``unmatched``) or leave the root (``escape``)."""
    entries = mappings.select("graph_id", "node_path", normalize_path("entry").alias("entry")).filter("entry <> ''").distinct()
    outside = F.col("entry").rlike(r"^(/|[A-Za-z]:|~)|(^|/)\.\.(/|$)")
    hit = entry_matches_file(files.select(*FILE), entries.select("graph_id", "entry").distinct())
    hit = hit.select("graph_id", "entry").distinct()
    escape = entries.filter(outside).withColumn("fault", F.lit("escape"))
    return escape.unionByName(
        shuffled_join(entries.filter(~outside), hit, ["graph_id", "entry"], "left_anti").withColumn("fault", F.lit("unmatched")).select(*escape.columns)
    )


def bare_directories(directories: DataFrame, nodes: DataFrame) -> DataFrame:
    """Directories of the graph tree without a node of their own."""
    known = nodes.select("graph_id", F.col("node_path").alias("dir"))
    return shuffled_join(directories.select("graph_id", "dir").distinct(), known, ["graph_id", "dir"], "left_anti")


def apply_ignore_patterns(files: DataFrame, patterns: DataFrame, scope: str = "all") -> DataFrame:
    """Files not ignored by directory-scoped patterns ``(graph_id, dir, pattern, ord)``; the last match wins."""
    return ignored_flag(files, patterns, scope).filter(~F.col("ignored")).drop("ignored")


def ignored_flag(files: DataFrame, patterns: DataFrame, scope: str = "all") -> DataFrame:
    """Files with the flag ``ignored``: the deepest scope, then the last pattern in it, decides."""
    rules = patterns if scope == "all" else patterns.filter("dir = ''")
    body = F.regexp_replace(F.trim("pattern"), r"^!", "")
    rules = (
        rules.filter((F.trim("pattern") != "") & ~F.trim("pattern").startswith("#"))
        .select("graph_id", F.col("dir").alias("_key"), "ord", F.trim("pattern").startswith("!").alias("keep"), body.alias("p"))
        .withColumn("dir_only", F.col("p").endswith("/"))
        .withColumn("anchored", F.regexp_replace("p", "/+$", "").contains("/"))
        .withColumn("g", F.regexp_replace("p", "^/+|/+$", ""))
        .withColumn("g", F.when(F.col("anchored"), F.col("g")).otherwise(F.concat(F.lit("**/"), F.col("g"))))
    )
    from attestry.functions.paths import glob_regex

    # a matched directory takes all below it, so the tail of the regex is open
    core = F.regexp_replace(glob_regex(F.col("g")), r"\$$", "")
    tail = F.when(F.col("dir_only"), F.lit("/.*$")).otherwise(F.lit("(/.*)?$"))
    rules = rules.withColumn("_regex", F.concat(core, tail)).select("graph_id", "_key", "ord", "keep", "_regex")
    keys = files.select(*FILE).withColumn(
        "_key", F.explode(F.concat(F.array(F.lit("")), path_prefixes("path", with_self=False)))
    )
    rel = F.expr("CASE WHEN `_key` = '' THEN path ELSE substring(path, length(`_key`) + 2) END")
    hits = salted_join(keys, rules, ["graph_id", "_key"]).withColumn("_rel", rel).filter(F.expr("`_rel` rlike `_regex`"))
    last = hits.groupBy(*FILE).agg(
        F.max_by("keep", F.struct(F.length("_key").alias("d"), F.col("ord").alias("o"))).alias("keep")
    )
    return shuffled_join(files, last, FILE, "left").withColumn("ignored", ~F.coalesce("keep", F.lit(True))).drop("keep")


def ignored_but_mapped(files: DataFrame, patterns: DataFrame, mappings: DataFrame) -> DataFrame:
    """Tracked but ignored files a mapping reaches.

    ``reach`` is ``indirect`` if only a directory or glob entry covers the file (counted as covered, never
    reviewed) and ``single`` if an entry names it.
    """
    ignored = ignored_flag(files.select(*FILE), patterns, "root").filter("ignored").select(*FILE)
    hit = entry_matches_file(ignored, mappings.select("graph_id", "entry"))
    return hit.groupBy(*FILE).agg(
        F.when(F.max(F.col("entry") == F.col("path")), "single").otherwise("indirect").alias("reach")
    )


