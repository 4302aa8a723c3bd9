"""Expected pairs, stored verdicts, and what is still valid."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.functions.paths import extension, parent_path, split_key, unit_of_file, unit_of_node
from attestry.functions.text import MISSING, escape_xml, sha256_text, utf16_length
from attestry.operators.digests import EMPTY_SET_HASH, PAIR, directory_entries, listing_hash, node_set_hash, pair_input_hash
from attestry.operators.keyed import cut_lineage, salted_join, shuffled_join
from attestry.operators.predicates import BINARY_EXTENSIONS, eval_path_predicates

#: Told to a judge that sees one file of a component.
PER_FILE_NOTE = "Only one file of the component is given here. Do not count it as a fault that the rest is missing."


def expected_pairs(
    effective: DataFrame,
    node_files: DataFrame,
    rules: DataFrame,
    files: DataFrame | None = None,
    include_draft: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """The work set in long form, and the subjects that block it.

    First: rows ``(graph_id, rule_id, kind, unit_key, node_path, status, path)``, one per subject of a pair.
    Second: subjects that could not be read or filtered. ``rules`` carries ``kind``, ``scope_per`` and
    ``scope_files`` (predicate JSON or null); ``files`` carries ``content`` (null if unreadable).
    """
    live = effective if include_draft else effective.filter("status <> 'draft'")
    meta = rules.filter("kind <> 'bundle'").select("graph_id", "rule_id", "kind", "scope_per", "scope_files")
    # the filter, the pairs and the blocked subjects all start here
    asked = cut_lineage(salted_join(live, meta, ["graph_id", "rule_id"]))
    # files per node are the long side, rules per node the short one
    rows = salted_join(node_files.select("graph_id", "node_path", "path"), asked, ["graph_id", "node_path"])
    blocked = None
    if files is not None:
        filters = asked.filter("scope_files is not null").select("graph_id", "node_path", F.col("scope_files").alias("condition")).distinct()
        demand = salted_join(node_files.select("graph_id", "node_path", "path"), filters, ["graph_id", "node_path"])
        result = eval_path_predicates(demand, files).withColumnRenamed("condition", "scope_files")
        rows = rows.join(result, ["graph_id", "path", "scope_files"], "left")
        blocked = rows.filter("unreadable").select(
            "graph_id", "rule_id", "node_path", "path", F.lit("content filter not evaluated").alias("reason")
        )
        rows = rows.filter(F.col("scope_files").isNull() | F.col("pass"))
    rows = rows.filter(~((F.col("kind") == "judged") & extension("path").isin(*BINARY_EXTENSIONS)))
    if files is not None:
        dead = files.filter("content is null").select("graph_id", "path")
        unread = rows.join(dead, ["graph_id", "path"], "left_semi")
        blocked = blocked.unionByName(
            unread.select("graph_id", "rule_id", "node_path", "path", F.lit("unreadable").alias("reason"))
        ).distinct()
        rows = rows.join(dead, ["graph_id", "path"], "left_anti")
    unit = F.when(F.coalesce("scope_per", F.lit("node")) == "file", unit_of_file("path")).otherwise(unit_of_node("node_path"))
    out = rows.select("graph_id", "rule_id", "kind", unit.alias("unit_key"), "node_path", "status", "path")
    if blocked is None:
        blocked = out.select("graph_id", "rule_id", "node_path", "path", F.lit("").alias("reason")).limit(0)
    return out, blocked


def pairs_of(pair_files: DataFrame) -> DataFrame:
    """One row per pair, with the number of subjects."""
    return pair_files.groupBy(*PAIR).agg(
        F.min("kind").alias("kind"), F.min("node_path").alias("node_path"), F.min("status").alias("status"), F.count("*").alias("n_subjects")
    )


def reobserve(
    touched: DataFrame,
    files: DataFrame,
    nodes: DataFrame,
    flow_nodes: DataFrame,
    scope: DataFrame | None = None,
) -> DataFrame:
    """Current value of every stored observation.

    ``touched`` holds ``(graph_id, rule_id, unit_key, node_path, key)``; ``files`` carries ``hash`` and
    ``nodes`` carries ``doc``. Gone files, directories and documents give ``missing``; existence hashes its
    token; sets hash their members, also when empty. ``scope`` (``visibility.scope_rows``) bounds by-type sets.
    """
    kind, target = split_key("key")
    rows = touched.withColumn("_kind", kind).withColumn("_target", target)
    g = "graph_id"
    read = files.select(g, F.lit("read").alias("_kind"), F.col("path").alias("_target"), F.col("hash").alias("_now"))
    docs = nodes.select(g, F.lit("graph").alias("_kind"), F.col("node_path").alias("_target"), sha256_text("doc").alias("_now"))
    dirs = listing_hash(files).select(g, F.lit("list").alias("_kind"), F.col("dir").alias("_target"), F.col("hash").alias("_now"))
    is_file = files.select(g, F.lit("exists").alias("_kind"), F.col("path").alias("_target"), F.lit("file").alias("_now"))
    is_dir = (
        directory_entries(files).filter("kind = 'dir'")
        .select(g, F.lit("exists").alias("_kind"), F.concat(F.when(F.col("dir") == "", "").otherwise(F.concat("dir", F.lit("/"))), "name").alias("_target"), F.lit("dir").alias("_now"))
    )
    exists = is_file.unionByName(is_dir).withColumn("_now", sha256_text("_now"))
    child = nodes.select(g, parent_path("node_path").alias("_target"), "node_path").filter("_target <> ''")
    children = node_set_hash(child, [g, "_target"], "node_path", "_now").withColumn("_kind", F.lit("graph-children"))
    flows = node_set_hash(flow_nodes.select(g, F.col("flow").alias("_target"), "node_path"), [g, "_target"], "node_path", "_now").withColumn(
        "_kind", F.lit("graph-flow")
    )
    table = read
    for part in (docs, dirs, exists, children, flows):
        table = table.unionByName(part.select(*read.columns))
    # a target many units looked at is looked up once, then handed out over the salts
    asked = rows.select(g, "_kind", "_target").distinct()
    simple = salted_join(rows, asked.join(table, [g, "_kind", "_target"]), [g, "_kind", "_target"], "left")
    if scope is not None:
        from attestry.operators.visibility import members_by_type

        typed = rows.filter("_kind = 'graph-bytype'").select(g, "node_path", F.col("_target").alias("type"))
        members = members_by_type(typed, scope, nodes).withColumnRenamed("type", "_target")
        by_type = node_set_hash(members, [g, "node_path", "_target"], "visible_node", "_bt").withColumn("_kind", F.lit("graph-bytype"))
        simple = simple.join(by_type, [g, "node_path", "_target", "_kind"], "left")
    else:
        simple = simple.withColumn("_bt", F.lit(None).cast("string"))
    sets = F.col("_kind").isin("graph-children", "graph-bytype", "graph-flow")
    absent = F.when(sets, EMPTY_SET_HASH).when(F.col("_kind") == "exists", sha256_text(F.lit("false"))).otherwise(MISSING)
    return simple.select(*touched.columns, F.coalesce("_bt", "_now", absent).alias("hash_now"))


def verify_pairs(
    pairs: DataFrame, verdicts: DataFrame, hashes: DataFrame, budget: DataFrame | None = None, companion_errors: DataFrame | None = None
) -> DataFrame:
    """State of each pair: verified, refused, unverified, too-large, companion-error.

    ``hashes`` holds ``hash_now``; ``budget`` (PAIR, chars, limit, over) applies to judged pairs. A valid
    verdict over budget keeps its state and is flagged ``oversized``.
    """
    rows = shuffled_join(pairs, verdicts.select(*PAIR, "verdict", "hash"), PAIR, "left")
    rows = shuffled_join(rows, hashes.select(*PAIR, "hash_now"), PAIR, "left")
    if budget is not None:
        rows = rows.join(budget.select(*PAIR, F.col("over").alias("_over")), PAIR, "left")
    else:
        rows = rows.withColumn("_over", F.lit(False))
    if companion_errors is not None:
        rows = rows.join(companion_errors.select(*PAIR).distinct().withColumn("_ce", F.lit(True)), PAIR, "left")
    else:
        rows = rows.withColumn("_ce", F.lit(None).cast("boolean"))
    valid = F.coalesce(F.col("hash") == F.col("hash_now"), F.lit(False))
    over = F.coalesce("_over", F.lit(False))
    state = (
        F.when(F.coalesce("_ce", F.lit(False)), "companion-error")
        .when(valid & (F.col("verdict") == "refused"), "refused")
        .when(valid, "verified")
        .when(over, "too-large")
        .otherwise("unverified")
    )
    return rows.select(*pairs.columns, state.alias("state"), (valid & over).alias("oversized"))


def payload_budget(
    pair_files: DataFrame, files: DataFrame, rules: DataFrame, nodes: DataFrame, tiers: DataFrame, frame_chars: int = 0
) -> DataFrame:
    """Size of the review text of each judged pair against the limit of its tier; a tier that sets none has none.

    Sizes come from lengths alone; no text is put together. ``frame_chars`` is the length of the fixed text
    around the parts. ``rules`` carries ``description``, ``body``,
    ``tier`` and optionally ``ref_chars`` (length of the reference block).
    """
    per_file = files.select("graph_id", "path", (utf16_length(escape_xml("content")) + utf16_length(escape_xml("path", True))).alias("_c"))
    judged = pair_files.filter("kind = 'judged'")
    sized = judged.join(per_file, ["graph_id", "path"], "left").groupBy(*PAIR).agg(
        F.min("node_path").alias("node_path"), F.sum(F.coalesce("_c", F.lit(0))).alias("_files"), F.count("*").alias("_n")
    )
    ref = F.col("ref_chars") if "ref_chars" in rules.columns else F.lit(0)
    meta = rules.select(
        "graph_id", "rule_id", "tier", "scope_per",
        (utf16_length(escape_xml("rule_id", True)) + utf16_length(escape_xml(F.coalesce("description", F.lit("")), True))
         + utf16_length(F.coalesce("body", F.lit(""))) + ref).alias("_rule"),
    )
    node = nodes.select(
        "graph_id", "node_path",
        (utf16_length(escape_xml("node_path", True)) + utf16_length(escape_xml(F.coalesce("description", F.lit("")), True))).alias("_node"),
    )
    limits = tiers.select("graph_id", "tier", "max_chars")
    rows = salted_join(salted_join(sized, meta, ["graph_id", "rule_id"]), node, ["graph_id", "node_path"], "left")
    rows = salted_join(rows, limits, ["graph_id", "tier"], "left")
    per_file_frame = F.when(F.col("scope_per") == "file", len(PER_FILE_NOTE) + 2).otherwise(0)
    chars = (
        F.col("_files") + F.col("_n") * len('<file path="">\n\n</file>') + (F.col("_n") - 1) * 2
        + F.col("_rule") + F.coalesce("_node", F.lit(0)) + F.lit(frame_chars) + per_file_frame
    )
    over = F.coalesce(chars > F.col("max_chars"), F.lit(False))
    return rows.select(*PAIR, chars.cast("long").alias("chars"), F.col("max_chars").cast("long").alias("limit"), over.alias("over"))


def upsert_verdicts(old: DataFrame, new: DataFrame, version: str = "version") -> DataFrame:
    """Merge new verdicts into the store: the last write per (rule, unit) wins, new over old."""
    rows = old.withColumn("_gen", F.lit(0)).unionByName(new.withColumn("_gen", F.lit(1)), allowMissingColumns=True)
    order = F.struct("_gen", F.coalesce(version, F.lit(0))) if version in rows.columns else F.struct("_gen")
    cols = [c for c in old.columns if c not in PAIR]
    best = rows.groupBy(*PAIR).agg(F.max_by(F.struct(*cols), order).alias("_v"))
    return best.select(*PAIR, "_v.*").select(*old.columns)


def prune_verdicts(
    verdicts: DataFrame, pairs_all: DataFrame, uncomputable: DataFrame, mappings: DataFrame, node_facts: DataFrame, nodes: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Drop verdicts outside the expected set (drafts included) unless their owner is uncomputable; drop facts
    of vanished nodes."""
    from attestry.operators.ownership import owner_of_unit

    inside = shuffled_join(verdicts, pairs_all.select(*PAIR).distinct(), PAIR, "left_semi")
    outside = shuffled_join(verdicts, pairs_all.select(*PAIR).distinct(), PAIR, "left_anti")
    kept = salted_join(owner_of_unit(outside, mappings), uncomputable.select("graph_id", "node_path").distinct(), ["graph_id", "node_path"], "left_semi")
    facts = node_facts.join(nodes.select("graph_id", "node_path"), ["graph_id", "node_path"], "left_semi")
    return inside.unionByName(kept.select(*verdicts.columns)), facts


def freshness(fingerprints: DataFrame, node_facts: DataFrame) -> DataFrame:
    """Whether a node's sources differ from the stored fingerprint; nothing stored: no; unreadable: yes."""
    rows = fingerprints.join(node_facts.select("graph_id", "node_path", "source"), ["graph_id", "node_path"], "left")
    changed = F.when(F.col("source").isNull(), False).when(F.col("fingerprint").isNull(), True).otherwise(F.col("fingerprint") != F.col("source"))
    return rows.select("graph_id", "node_path", changed.alias("changed"))


def refill_order(states: DataFrame, rules: DataFrame, blocked_nodes: DataFrame | None = None) -> DataFrame:
    """What to refill and in which stage: computed first, judged after; nodes without a fresh journal entry
    block; judged pairs of a node with an enforced computed refusal are skipped.

    ``blocked_nodes`` comes from the journal gate.
    """
    todo = states.filter("state = 'unverified'")
    refused = states.filter("kind = 'computed' and state = 'refused' and status = 'enforced'").select("graph_id", "node_path").distinct()
    rows = salted_join(todo, refused.withColumn("_ref", F.lit(True)), ["graph_id", "node_path"], "left")
    if blocked_nodes is not None:
        rows = salted_join(rows, blocked_nodes.select("graph_id", "node_path").distinct().withColumn("_blk", F.lit(True)), ["graph_id", "node_path"], "left")
    else:
        rows = rows.withColumn("_blk", F.lit(None).cast("boolean"))
    rows = salted_join(rows, rules.select("graph_id", "rule_id", "tier"), ["graph_id", "rule_id"], "left")
    stage = F.when(F.col("kind") == "computed", 1).otherwise(2)
    skip = F.when(F.col("_blk"), "journal-entry-missing").when((F.col("kind") == "judged") & F.col("_ref"), "computed-refusal")
    return rows.select(*PAIR, "node_path", stage.alias("stage"), F.when(stage == 2, F.col("tier")).alias("tier"), skip.alias("skip_reason"))


def close_nodes(
    nodes: DataFrame, types: DataFrame, fingerprints: DataFrame, states: DataFrame, latest: DataFrame, node_facts: DataFrame,
    blocked_nodes: DataFrame | None = None,
) -> DataFrame:
    """New facts per node.

    A node whose type keeps no journal only carries its journal baseline. Else the source baseline moves if the
    fingerprint changed, the newest entry is fresh and every enforced pair is verified; a node without files
    only takes over its newest entry. ``moved`` tells which source baselines moved.
    """
    key = ["graph_id", "node_path"]
    shut = states.filter("status = 'enforced' and state <> 'verified'").select(*key)
    if blocked_nodes is not None:
        shut = shut.unionByName(blocked_nodes.select(*key))
    rows = salted_join(nodes.select(*key, "type"), types.select("graph_id", "type", "log_required"), ["graph_id", "type"], "left")
    rows = (
        rows.join(fingerprints.select(*key, F.col("fingerprint").alias("_fp"), F.lit(True).alias("_files")), key, "left")
        .join(shut.distinct().withColumn("_shut", F.lit(True)), key, "left")
        .join(latest.select(*key, F.struct(F.col("ts").alias("last_ts"), "prefix_hash").alias("_new")), key, "left")
        .join(
            node_facts.select(*key, F.col("source").alias("_src"), F.when(F.col("last_ts").isNotNull(), F.struct("last_ts", "prefix_hash")).alias("_old")),
            key, "left",
        )
    )
    keeps = F.coalesce("log_required", F.lit(False))
    fresh = F.col("_new").isNotNull() & ~F.col("_new.last_ts").eqNullSafe(F.col("_old.last_ts"))
    moves = keeps & F.col("_fp").isNotNull() & ~F.col("_fp").eqNullSafe(F.col("_src")) & fresh & F.col("_shut").isNull()
    takes = ~keeps | moves | F.col("_files").isNull()
    log = F.when(takes, F.coalesce("_new", "_old")).otherwise(F.col("_old"))
    source = F.when(moves, F.col("_fp")).when(keeps, F.col("_src"))
    return (
        rows.select(*key, source.alias("source"), log.alias("_log"), moves.alias("moved"))
        .select(*key, "source", "_log.last_ts", "_log.prefix_hash", "moved")
        .filter(F.col("source").isNotNull() | F.col("last_ts").isNotNull())
    )


def consensus(votes: DataFrame) -> DataFrame:
    """Majority over votes ``(PAIR, vote_no, satisfied, reason, error_source)``; a tie refuses.

    The reason is that of the first vote on the winning side; the source is ``provider`` only if every losing
    vote is.
    """
    yes = F.count_if("satisfied")
    tally = votes.groupBy(*PAIR).agg(
        yes.alias("yes"),
        F.count("*").alias("n"),
        F.min(F.when(F.col("satisfied"), F.struct("vote_no", "reason"))).alias("_first_yes"),
        F.min(F.when(~F.col("satisfied"), F.struct("vote_no", "reason"))).alias("_first_no"),
        F.bool_and(F.when(~F.col("satisfied"), F.col("error_source") == "provider")).alias("_all_provider"),
    )
    won = F.col("yes") * 2 > F.col("n")
    return tally.select(
        *PAIR,
        won.alias("satisfied"),
        F.when(won, F.col("_first_yes.reason")).otherwise(F.col("_first_no.reason")).alias("reason"),
        F.when(~won & F.coalesce("_all_provider", F.lit(False)), "provider").otherwise("codeViolation").alias("error_source"),
    )


def build_review_text(
    pair_files: DataFrame, files: DataFrame, rules: DataFrame, nodes: DataFrame, instructions: str, budget: DataFrame | None = None
) -> DataFrame:
    """Text a judge reads for each pair: instructions, node, rule, then the subjects in path order.

    With ``budget`` only pairs within their limit get a text, which bounds the size of each group; those over
    it are never sent and show as too-large in verify_pairs.
    """
    if budget is not None:
        pair_files = salted_join(pair_files, budget.filter("over").select(*PAIR), PAIR, "left_anti")
    block = F.concat(
        F.lit('<file path="'), escape_xml("path", True), F.lit('">\n'), escape_xml(F.coalesce("content", F.lit(""))), F.lit("\n</file>")
    )
    judged = pair_files.filter("kind = 'judged'").join(files.select("graph_id", "path", "content"), ["graph_id", "path"], "left")
    joined = judged.groupBy(*PAIR).agg(
        F.min("node_path").alias("node_path"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", block.alias("b")))), lambda s: s["b"]), "\n\n").alias("_files"),
    )
    rows = salted_join(joined, rules.select("graph_id", "rule_id", "description", "body", "scope_per"), ["graph_id", "rule_id"])
    rows = salted_join(rows, nodes.select("graph_id", "node_path", F.col("description").alias("_nd")), ["graph_id", "node_path"], "left")
    empty = F.lit("")
    text = F.concat(
        F.lit("<task>\n" + instructions),
        F.when(F.col("scope_per") == "file", F.lit("\n" + PER_FILE_NOTE)).otherwise(empty),
        F.lit('\n</task>\n<node path="'), escape_xml("node_path", True),
        F.lit('" description="'), escape_xml(F.coalesce("_nd", empty), True),
        F.lit('" />\n<rule id="'), escape_xml("rule_id", True),
        F.lit('" description="'), escape_xml(F.coalesce("description", empty), True),
        F.lit('">\n'), F.coalesce("body", empty), F.lit("\n</rule>\n<source-files>\n"), F.col("_files"), F.lit("\n</source-files>"),
    )
    return rows.select(*PAIR, "node_path", text.alias("text"))


def invalidated_pairs(
    changed: DataFrame, pair_files: DataFrame, rules_refs: DataFrame, verdicts: DataFrame, touched: DataFrame, scope: DataFrame,
    doc_paths: DataFrame | None = None,
) -> DataFrame:
    """Pairs each changed file makes stale: rows ``(graph_id, changed, rule_id, unit_key, reason, mode)``.

    ``rules_refs`` (graph_id, rule_id, path), ``touched`` (PAIR, key), ``scope`` (node_path, entry) of what a
    rule on a node may read, ``doc_paths`` (kind, target, path) of graph documents behind graph observations.
    """
    from attestry.operators.keyed import entry_matches_file

    pair_path = [*PAIR, "path"]
    out = ["graph_id", F.col("path").alias("changed"), "rule_id", "unit_key"]
    folder = F.when(parent_path("path") == "", ".").otherwise(parent_path("path"))
    c = changed.select("graph_id", "path").distinct()
    own = shuffled_join(pair_files.select(*pair_path), c, ["graph_id", "path"], "left_semi").distinct()
    pairs = pair_files.select(*PAIR, "kind", "node_path").distinct()
    judged = pairs.filter("kind = 'judged'").select(*PAIR).distinct()
    refs = rules_refs.select("graph_id", "rule_id", "path").distinct().join(c, ["graph_id", "path"], "left_semi")
    by_ref = salted_join(judged, refs, ["graph_id", "rule_id"])
    # what a pair asked of files one by one, and the folders it listed: the rows of a folder are many and are made last
    kind, target = split_key("key")
    why = F.when(F.col("kind") == "judged", "observe-companion").otherwise("observe-computed").alias("reason")
    seen = shuffled_join(touched.select(*PAIR, kind.alias("_k"), target.alias("_t")), pairs.select(*PAIR, why).distinct(), PAIR)
    listed = seen.filter("_k = 'list'").select(*PAIR, F.col("_t").alias("_dir"), "reason").distinct()
    single = seen.filter(F.col("_k").isin("read", "exists")).select(*PAIR, F.col("_t").alias("path"), "reason").join(c, ["graph_id", "path"], "left_semi")
    if doc_paths is not None:
        docs = doc_paths.select("graph_id", F.col("kind").alias("_k"), F.col("target").alias("_t"), "path").join(c, ["graph_id", "path"], "left_semi")
        single = single.unionByName(seen.join(docs, ["graph_id", "_k", "_t"]).select(*pair_path, "reason"))
    single = shuffled_join(single.distinct().withColumn("_dir", folder), listed.drop("reason").distinct(), [*PAIR, "_dir"], "left_anti")
    in_dir = salted_join(c.withColumn("_dir", folder), listed, ["graph_id", "_dir"])
    # each part has no row twice, and the reasons tell the parts apart
    parts = [own.withColumn("reason", F.lit("own")), by_ref.withColumn("reason", F.lit("reference")), single.drop("_dir"), in_dir.drop("_dir")]
    precise = reduce(DataFrame.unionByName, [x.select(*out, "reason", F.lit("precise").alias("mode")) for x in parts])
    hits = entry_matches_file(c, scope.select("graph_id", "node_path", "entry").distinct()).select("graph_id", "node_path", "path").distinct()
    cold = shuffled_join(pairs.filter("kind = 'computed'"), verdicts.select(*PAIR), PAIR, "left_anti")
    # listed folders drop out whole, before they are files
    hits = hits.withColumn("_dir", folder)
    at = salted_join(cold, hits.select("graph_id", "node_path", "_dir").distinct(), ["graph_id", "node_path"])
    at = shuffled_join(at, listed.drop("reason").distinct(), [*PAIR, "_dir"], "left_anti")
    maybe = salted_join(at, hits, ["graph_id", "node_path", "_dir"])
    named = shuffled_join(judged, cold.select(*PAIR).distinct(), PAIR, "left_semi")
    taken = own.unionByName(single.select(*pair_path)).unionByName(salted_join(named, refs, ["graph_id", "rule_id"]).select(*pair_path)).distinct()
    maybe = shuffled_join(maybe, taken, pair_path, "left_anti").select(*out, F.lit("potential").alias("reason"), F.lit("potential").alias("mode"))
    return precise.unionByName(maybe)


def read_scope(nodes: DataFrame, mappings: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a rule on a node may look at: entries ``(node_path, entry)``, and nodes as scope rows (see ``visibility``)."""
    from attestry.operators.visibility import scope_entries, scope_rows

    scope = scope_rows(nodes, relations)
    return scope_entries(nodes, mappings, scope), scope


def review_cost(pairs: DataFrame, rules: DataFrame, tiers: DataFrame, verdicts: DataFrame, by: list[str]) -> DataFrame:
    """Work to refill: pairs, judge calls (votes of the tier each), free pairs, green verdicts at stake."""
    votes = tiers.select("graph_id", "tier", "consensus")
    rows = salted_join(pairs, rules.select("graph_id", "rule_id", "tier"), ["graph_id", "rule_id"], "left")
    rows = salted_join(rows, votes, ["graph_id", "tier"], "left")
    green = verdicts.filter("verdict = 'approved'").select(*PAIR).distinct().withColumn("_green", F.lit(True))
    rows = shuffled_join(rows, green, PAIR, "left")
    judged = F.col("kind") == "judged"
    return rows.groupBy(*by).agg(
        F.count("*").alias("pairs"),
        F.sum(F.when(judged, F.coalesce("consensus", F.lit(1))).otherwise(0)).cast("long").alias("judge_calls"),
        F.count_if(~judged).alias("free_pairs"),
        F.count_if(F.coalesce("_green", F.lit(False))).alias("green_at_stake"),
    )


def companion_pairs(
    pair_files: DataFrame, proposals: DataFrame, scope: DataFrame, files: DataFrame, mappings: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Attach proposed companion files ``(PAIR, path)`` to units.

    Subjects drop out; a path outside the read scope or without a file makes the unit fail, with the node that
    owns the path, to which a relation is missing.
    """
    from attestry.functions.paths import normalize_path
    from attestry.operators.keyed import entry_matches_file
    from attestry.operators.ownership import resolve_owner

    asked = proposals.select(*PAIR, normalize_path("path").alias("path")).distinct()
    asked = asked.join(pair_files.select(*PAIR, "path"), [*PAIR, "path"], "left_anti")
    units = pair_files.select(*PAIR, "node_path").distinct()
    asked = asked.join(units, PAIR)
    paths = asked.select("graph_id", "path").distinct()
    allowed = entry_matches_file(paths, scope).select("graph_id", "node_path", "path").distinct().withColumn("_in", F.lit(True))
    present = files.filter("content is not null").select("graph_id", "path").withColumn("_there", F.lit(True))
    owners = resolve_owner(paths, mappings).select("graph_id", "path", F.col("node_path").alias("owner"))
    rows = asked.join(allowed, ["graph_id", "node_path", "path"], "left").join(present, ["graph_id", "path"], "left").join(owners, ["graph_id", "path"], "left")
    fault = F.when(F.col("_in").isNull(), "outside-scope").when(F.col("_there").isNull(), "unreadable")
    rows = rows.withColumn("fault", fault)
    failed = rows.filter("fault is not null").select(*PAIR, "path", "fault", F.col("owner").alias("missing_relation"))
    good = rows.join(failed.select(*PAIR).distinct(), PAIR, "left_anti").select(*PAIR, "path")
    return good, failed


def conflicting_observations(observations: DataFrame) -> DataFrame:
    """Units that saw one key with two digests in one run, with the first value."""
    seen = observations.groupBy(*PAIR, "key").agg(
        F.min("hash").alias("_lo"), F.max("hash").alias("_hi"), F.min_by("hash", "seq").alias("first_hash")
    )
    return seen.filter("_lo <> _hi").select(*PAIR, "key", "first_hash")
