"""Waivers: markers in text, the line spans they cover, and their risk.

A marker is ``<word>(rules) reason``, ``<word>-disable(rules) reason`` or ``<word>-enable(rules)``; the word is
a parameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions.paths import is_glob, normalize_path
from attestry.operators.keyed import cut_lineage, salted_join, shuffled_join, weighted_join

MARKER_WORD = "waive"
SPAN = ["graph_id", "file", "rule_id"]

# How a comment starts, by language; a marker after it is in a comment.
COMMENT_STARTS = {
    "typescript": r"//|/\*|^\s*\*", "tsx": r"//|/\*|^\s*\*", "javascript": r"//|/\*|^\s*\*",
    "go": r"//|/\*|^\s*\*", "rust": r"//|/\*|^\s*\*", "java": r"//|/\*|^\s*\*", "csharp": r"//|/\*|^\s*\*",
    "c": r"//|/\*|^\s*\*", "cpp": r"//|/\*|^\s*\*", "php": r"//|/\*|#|^\s*\*", "kotlin": r"//|/\*|^\s*\*",
    "python": r"#", "ruby": r"#", "yaml": r"#", "toml": r"#",
}


def file_lines(files: DataFrame) -> DataFrame:
    """One row per line, numbered from 1."""
    return files.select(
        "graph_id", F.col("path").alias("file"), F.posexplode(F.split("content", "\n", -1)).alias("_i", "text")
    ).select("graph_id", "file", (F.col("_i") + 1).cast("long").alias("line"), "text")


def marker_scan(files: DataFrame, word: str = MARKER_WORD, comments_only: bool = False) -> DataFrame:
    """Markers per line, one row per listed rule: disable before enable before single.

    With ``comments_only`` and a ``language`` column, lines of known languages count only after a comment sign.
    """
    base = files.filter(F.col("content").contains(word))
    lines = file_lines(base)
    if comments_only:
        table = F.create_map(*[F.lit(x) for pair in COMMENT_STARTS.items() for x in pair])
        sign = base.select("graph_id", F.col("path").alias("file"), F.try_element_at(table, F.col("language")).alias("_sign"))
        lines = shuffled_join(lines, sign, ["graph_id", "file"])
        lines = lines.filter(F.col("_sign").isNull() | F.expr(f"text rlike concat('(?:', _sign, ').*{word}')"))
    ids, why = r"\(\s*([^)]+?)\s*\)", r"\s*(.+)?$"
    disable, enable, single = rf"\b{word}-disable{ids}{why}", rf"\b{word}-enable{ids}", rf"\b{word}{ids}{why}"
    text = F.col("text")
    kind = (
        F.when(text.rlike(disable), "disable").when(text.rlike(enable), "enable").when(text.rlike(single), "single")
    )
    k = F.col("kind")
    raw = F.when(k == "disable", F.regexp_extract(text, disable, 1)).when(k == "enable", F.regexp_extract(text, enable, 1)).otherwise(
        F.regexp_extract(text, single, 1)
    )
    reason = F.when(k == "disable", F.regexp_extract(text, disable, 2)).when(k == "single", F.regexp_extract(text, single, 2)).otherwise("")
    return (
        lines.filter(text.contains(word + "(") | text.contains(word + "-disable(") | text.contains(word + "-enable("))
        .withColumn("kind", kind)
        .filter("kind is not null")
        .withColumn("reason", F.trim(F.regexp_replace(F.coalesce(reason, F.lit("")), r"^\s+|\s+$", "")))
        .withColumn("rule_id", F.explode(F.split(raw, ",")))
        .withColumn("rule_id", F.trim("rule_id"))
        .filter("rule_id <> ''")
        .select("graph_id", "file", "line", "rule_id", "kind", (F.col("rule_id") == "*").alias("wildcard"), "reason")
    )


def waiver_faults(markers: DataFrame) -> DataFrame:
    """Single and disable markers without a reason."""
    return markers.filter("kind <> 'enable' and trim(reason) = ''").select(
        "graph_id", F.lit("error").alias("severity"), F.lit("waiver-without-reason").alias("code"), "file", "line", "rule_id"
    )


def waived_ranges(markers: DataFrame, file_sizes: DataFrame) -> DataFrame:
    """Line spans waived per (file, rule).

    A single marker waives the next line. A disable opens unless one is open; an enable closes on the line
    before; an open span runs to the end of the file (``total_lines`` of ``file_sizes``).
    """
    single = markers.filter("kind = 'single'").select(
        *SPAN, (F.col("line") + 1).alias("start_line"), (F.col("line") + 1).alias("end_line"), "wildcard"
    )
    toggles = markers.filter("kind <> 'single'")
    # markers of one rule in one file: a group is at most one file's lines
    w = Window.partitionBy(*SPAN).orderBy("line")
    opens = toggles.withColumn("_prev", F.lag("kind").over(w)).withColumn(
        "_end", F.min(F.when(F.col("kind") == "enable", F.col("line"))).over(w.rowsBetween(1, Window.unboundedFollowing))
    ).filter("kind = 'disable' and (_prev is null or _prev = 'enable')")
    spans = shuffled_join(opens, file_sizes.select("graph_id", "file", "total_lines"), ["graph_id", "file"], "left").select(
        *SPAN, (F.col("line") + 1).alias("start_line"), F.coalesce(F.col("_end") - 1, F.col("total_lines")).alias("end_line"), "wildcard"
    )
    return single.unionByName(spans)


#: Lines of a file that one window looks at; what crosses is one number for each stretch.
STRETCH = 4096


def waived_lines(places: DataFrame, ranges: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """Which of the distinct ``places`` (graph, file, rule, line) lie in a span of their rule or of all rules.

    Spans open and close at lines; a place is waived if more spans are open there than none. Opens, closes and places
    are one stream for each file and rule (and one for all rules), summed in stretches of lines, so no place meets a span.
    """
    at = ["graph_id", "file", "rule_id", "wildcard"]
    rule = F.when(F.col("wildcard"), F.lit("")).otherwise(F.col("rule_id")).alias("rule_id")
    spans = ranges.filter("start_line <= end_line").select("graph_id", "file", rule, "wildcard", "start_line", "end_line")
    ends = F.explode(F.array(F.struct(F.col("start_line").alias("line"), F.lit(1).alias("by")), F.struct((F.col("end_line") + 1).alias("line"), F.lit(-1).alias("by"))))
    turns = spans.select(*at, ends.alias("_e")).groupBy(*at, "_e.line").agg(F.sum("_e.by").alias("by")).filter("by <> 0")
    both = places.withColumn("wildcard", F.lit(False)).unionByName(places.select("graph_id", "file", F.lit("").alias("rule_id"), "line", F.lit(True).alias("wildcard")).distinct())
    stream = turns.select(*at, "line", "by", F.lit(False).alias("_place")).unionByName(both.select(*at, "line", F.lit(0).cast("long").alias("by"), F.lit(True).alias("_place")))
    stream = stream.withColumn("_s", F.floor(F.col("line") / stretch))
    before = Window.partitionBy(*at).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    # one row a stretch with turns: the open spans it hands on
    sums = stream.groupBy(*at, "_s").agg(F.sum("by").alias("_sum")).withColumn("_open", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    inside = Window.partitionBy(*at, "_s").orderBy("line", "_place").rowsBetween(Window.unboundedPreceding, 0)
    running = shuffled_join(stream.withColumn("_inside", F.sum("by").over(inside)), sums.select(*at, "_s", "_open"), [*at, "_s"])
    open_ = running.filter(F.col("_place") & (F.col("_inside") + F.col("_open") > 0))
    own = open_.filter("NOT wildcard").select("graph_id", "file", "rule_id", "line")
    every = shuffled_join(places, open_.filter("wildcard").select("graph_id", "file", "line"), ["graph_id", "file", "line"], "left_semi")
    return own.unionByName(every.select(*own.columns)).distinct()


def drop_waived(findings: DataFrame, ranges: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """Remove findings on waived lines; one without file or line always stays.

    Findings are counted by place first; a place that holds many of them is split by its count.
    """
    key = ["graph_id", "file", "rule_id", "line"]
    places = cut_lineage(findings.filter("file is not null and line is not null").groupBy(*key).agg(F.count("*").alias("n")))
    waived = cut_lineage(shuffled_join(places, waived_lines(places.select(*key), ranges, stretch), key, "left_semi"))
    return weighted_join(findings, waived, key, "n", "left_anti")


def spans_of_rule(ranges: DataFrame, rule_id: str) -> DataFrame:
    """Spans that waive one rule, wildcard ones included."""
    return ranges.filter(F.col("wildcard") | (F.col("rule_id") == rule_id)).select("graph_id", "file", "start_line", "end_line")


def unclosed_waivers(markers: DataFrame) -> DataFrame:
    """Disable markers never closed, where each enable closes the latest open one."""
    w = Window.partitionBy(*SPAN).orderBy("line")
    up_to = w.rowsBetween(Window.unboundedPreceding, 0)
    after = w.rowsBetween(1, Window.unboundedFollowing)
    step = markers.filter("kind <> 'single'").withColumn("_s", F.sum(F.when(F.col("kind") == "disable", 1).otherwise(-1)).over(up_to))
    # an enable with nothing open counts for nothing: depth is the sum above its running floor
    depth = step.withColumn("_floor", F.least(F.min("_s").over(up_to), F.lit(0))).withColumn("_depth", F.col("_s") - F.col("_floor"))
    low = depth.withColumn("_low", F.min("_depth").over(after))
    return low.filter("kind = 'disable' and (_low is null or _low >= _depth)").select(*SPAN, "line", "wildcard", "reason")


def waiver_risk(markers: DataFrame, rules: DataFrame) -> DataFrame:
    """First risk of each waiver: wildcard, typo (rule unknown), inert (rule is draft), unbounded (never closed)."""
    known = rules.select("graph_id", "rule_id", F.coalesce("status", F.lit("enforced")).alias("_status"))
    rows = salted_join(markers.filter("kind <> 'enable'"), known, ["graph_id", "rule_id"], "left")
    open_ = unclosed_waivers(markers).select(*SPAN, "line").distinct().withColumn("_open", F.lit(True))
    rows = shuffled_join(rows, open_, [*SPAN, "line"], "left")
    risk = (
        F.when(F.col("wildcard"), "wildcard")
        .when(F.col("_status").isNull(), "typo")
        .when(F.col("_status") == "draft", "inert")
        .when((F.col("kind") == "disable") & F.col("_open"), "unbounded")
    )
    return rows.select(*SPAN, "line", "kind", "reason", risk.alias("risk"))


def waivers_by_node(risks: DataFrame, mappings: DataFrame) -> DataFrame:
    """Waivers of files a node names literally in its mapping."""
    entries = mappings.select("graph_id", "node_path", normalize_path("entry").alias("file")).filter(~is_glob("file")).distinct()
    return salted_join(risks, entries, ["graph_id", "file"])
