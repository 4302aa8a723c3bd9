"""Append-only journals of ``## [timestamp]`` entries: parsing, format, integrity, freshness, merges."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions.text import sha256_text
from attestry.operators.keyed import cut_lineage, salted_join, top_n

NODE = ["graph_id", "node_path"]
# The forms of a header line and of a timestamp.
HEADER = r"^## \[([^\]]+)\]\s*$"
STRICT_TS = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{1,3}Z$"


def fence_spans(content: Column | str) -> Column:
    """Code fences of a text as ``array<struct<first, last>>`` of line numbers; an unclosed one has no last.

    Folds over the fence lines only, so the state stays small however long the text is.
    """
    lines = F.split(F.col(content) if isinstance(content, str) else content, "\n", -1)
    marks = F.filter(
        F.transform(
            lines,
            lambda text, i: F.struct(
                (i + 1).cast("long").alias("line"),
                F.length(F.regexp_extract(text, r"^(`{3,})", 1)).alias("ticks"),
                (F.trim(F.regexp_replace(text, r"^`{3,}", "")) == "").alias("bare"),
            ),
        ),
        lambda m: m["ticks"] > 0,
    )
    start = F.struct(
        F.array().cast("array<struct<first:bigint,last:bigint>>").alias("out"),
        F.lit(0).cast("long").alias("first"),
        F.lit(0).alias("ticks"),
    )

    def step(acc: Column, m: Column) -> Column:
        closing = (acc["ticks"] > 0) & m["bare"] & (m["ticks"] >= acc["ticks"])
        opening = acc["ticks"] == 0
        span = F.struct(acc["first"].alias("first"), m["line"].alias("last"))
        return F.struct(
            F.when(closing, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"),
            F.when(opening, m["line"]).otherwise(acc["first"]).alias("first"),
            F.when(closing, 0).when(opening, m["ticks"]).otherwise(acc["ticks"]).alias("ticks"),
        )

    def finish(acc: Column) -> Column:
        tail = F.struct(acc["first"].alias("first"), F.lit(None).cast("long").alias("last"))
        return F.when(acc["ticks"] > 0, F.concat(acc["out"], F.array(tail))).otherwise(acc["out"])

    return F.aggregate(marks, start, step, finish)


#: Lines of a block. Windows and folds stay inside one; what crosses blocks is one small row for each.
BLOCK = 4096


def _mark(text: Column) -> dict[str, Column]:
    """What a line means to the scan: how many ticks it opens or closes a fence with, whether it may close one, its header."""
    return {
        "ticks": F.length(F.regexp_extract(text, r"^(`{3,})", 1)),
        "bare": F.trim(F.regexp_replace(text, r"^`{3,}", "")) == "",
        "head": F.regexp_extract(text, HEADER, 1) != "",
    }


def _after(open_: Column, m: Column) -> Column:
    """Ticks open after a fence line, given those open before it; 0 is none."""
    return F.when(open_ == 0, m["ticks"]).when(m["bare"] & (m["ticks"] >= open_), F.lit(0)).otherwise(open_)


def blocks_of_text(journals: DataFrame, size: int = BLOCK) -> DataFrame:
    """``block, texts, n``: each journal's lines in blocks, cut where the text is read; ``n`` counts its lines."""
    rows = journals.filter("content <> ''").select(*NODE, F.split("content", "\n", -1).alias("_l")).withColumn("n", F.size("_l").cast("long"))
    cut = lambda k: F.struct(k.alias("block"), F.slice("_l", k * size + 1, F.lit(size)).alias("texts"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / size).cast("int")), cut)
    return rows.select(*NODE, "n", F.explode(blocks).alias("_b")).select(*NODE, F.col("_b.block").cast("long").alias("block"), "_b.texts", "n")


def blocks_of_lines(lines: DataFrame, size: int = BLOCK) -> DataFrame:
    """As ``blocks_of_text``, from rows ``(line, text)`` with lines counted from 1, so that no task holds a whole journal."""
    block = F.floor((F.col("line") - 1) / size).alias("block")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"])
    blocks = lines.groupBy(*NODE, block).agg(texts.alias("texts"))
    return blocks.join(lines.groupBy(*NODE).agg(F.max("line").alias("n")), NODE)


def block_states(blocks: DataFrame) -> DataFrame:
    """What a block does to the scan, whatever stands before it: ``opened, heads, closers, size``.

    Entered with no fence open it leaves ``opened`` ticks open after ``heads`` headers. Entered with ``k`` open, the first
    of ``closers`` with ``ticks >= k`` says the same; if there is none, ``k`` stay open and no header counts. These
    functions compose, so blocks are folded apart from each other.
    """
    marks = F.filter(F.transform("texts", lambda t: F.struct(*[c.alias(n) for n, c in _mark(t).items()])), lambda m: (m["ticks"] > 0) | m["head"])
    start = F.struct(F.lit(0).alias("opened"), F.lit(0).cast("long").alias("heads"), F.array().cast("array<struct<ticks:int,opened:int,heads:bigint>>").alias("closers"))

    def moved(state: Column, m: Column) -> list[Column]:
        fence = m["ticks"] > 0
        return [
            F.when(fence, _after(state["opened"], m)).otherwise(state["opened"]).alias("opened"),
            (state["heads"] + (~fence & (state["opened"] == 0)).cast("long")).alias("heads"),
        ]

    def step(acc: Column, m: Column) -> Column:
        seen = F.transform(acc["closers"], lambda c: F.struct(c["ticks"].alias("ticks"), *moved(c, m)))
        widest = F.coalesce(F.try_element_at(acc["closers"], F.lit(-1))["ticks"], F.lit(0))
        new = F.struct(m["ticks"].alias("ticks"), F.lit(0).alias("opened"), F.lit(0).cast("long").alias("heads"))
        return F.struct(*moved(acc, m), F.when(m["bare"] & (m["ticks"] > widest), F.concat(seen, F.array(new))).otherwise(seen).alias("closers"))

    size = F.aggregate("texts", F.lit(0).cast("long"), lambda n, t: n + F.octet_length(t) + 1)
    return blocks.select(*NODE, "block", F.aggregate(marks, start, step).alias("_s"), size.alias("size")).select(*NODE, "block", "_s.*", "size")


def block_starts(states: DataFrame) -> DataFrame:
    """``open0, pos0, start0`` of each block: ticks open, headers and bytes before it. One row a block goes through a journal's group."""

    def scan(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block")
        open_ = pos = start = 0
        out = []
        for opened, heads, closers, size in zip(rows["opened"], rows["heads"], rows["closers"], rows["size"], strict=True):
            out.append((open_, pos, start))
            if open_:
                closer = next((c for c in closers if c["ticks"] >= open_), None)
                opened, heads = (closer["opened"], closer["heads"]) if closer else (open_, 0)
            open_, pos, start = int(opened), pos + int(heads), start + int(size)
        return rows[[*NODE, "block"]].assign(**dict(zip(("open0", "pos0", "start0"), zip(*out, strict=True), strict=True)))

    return states.groupBy(*NODE).applyInPandas(scan, "graph_id string, node_path string, block long, open0 int, pos0 long, start0 long")


def scan_lines(blocks: DataFrame, size: int = BLOCK) -> DataFrame:
    """``line, text, ts, pos, start, fenced, opened, fence, last`` of each line.

    ``ts`` is what a header holds, else empty; ``pos`` the headers outside fences up to here; ``start`` the byte offset;
    ``fenced`` lines lie in a code fence, its ends included; ``opened`` ticks are open behind the line.
    """
    several = blocks.filter(F.col("n") > size)
    held = blocks.join(block_starts(block_states(several)), [*NODE, "block"], "left").fillna(0, ["open0", "pos0", "start0"])
    first = F.col("block") * size + 1
    each = held.select(*NODE, "block", "n", "open0", "pos0", "start0", F.posexplode("texts").alias("_i", "text")).withColumn("line", first + F.col("_i"))
    m = _mark(F.col("text"))
    lines = each.select(
        *NODE, "block", "line", "text", F.regexp_extract("text", HEADER, 1).alias("ts"), (m["ticks"] > 0).alias("fence"), (F.col("line") == F.col("n")).alias("last"),
        (F.octet_length("text") + 1).cast("long").alias("_size"), "open0", "pos0", "start0", F.lit(None).cast("int").alias("_opened"), F.lit(True).alias("_is_line"),
    )
    # fence lines are few: their states are folded for each block and meet the lines as rows of their own
    marks = F.filter(F.transform("texts", lambda t, i: F.struct(i.alias("i"), *[c.alias(n) for n, c in _mark(t).items()])), lambda x: x["ticks"] > 0)
    start = F.struct(F.array().cast("array<struct<i:int,opened:int>>").alias("out"), F.col("open0").alias("opened"))

    def step(acc: Column, x: Column) -> Column:
        now = _after(acc["opened"], x)
        return F.struct(F.concat(acc["out"], F.array(F.struct(x["i"].alias("i"), now.alias("opened")))).alias("out"), now.alias("opened"))

    fenced = held.filter(F.exists("texts", lambda t: t.startswith("```")))
    told = fenced.select(*NODE, "block", first.alias("_first"), F.explode(F.aggregate(marks, start, step)["out"]).alias("_m"))
    events = told.select(*NODE, "block", (F.col("_first") + F.col("_m.i")).alias("line"), F.col("_m.opened").alias("_opened"), F.lit(False).alias("_is_line"))
    w = Window.partitionBy(*NODE, "block").orderBy("line", "_is_line").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.unionByName(events, allowMissingColumns=True).withColumn("opened", F.coalesce(F.last("_opened", ignorenulls=True).over(w), "open0"))
    rows = rows.withColumn("fenced", F.col("fence") | (F.col("opened") > 0)).withColumn("_head", (F.col("_is_line") & (F.col("ts") != "") & ~F.col("fenced")).cast("long"))
    return rows.withColumns({
        "pos": F.col("pos0") + F.sum(F.coalesce("_head", F.lit(0))).over(w),
        "start": F.col("start0") + F.sum(F.coalesce("_size", F.lit(0))).over(w) - F.col("_size"),
    }).filter("_is_line").select(*NODE, "line", "text", "ts", "pos", "start", "fenced", "opened", "fence", "last")


def journal_lines(journals: DataFrame, size: int = BLOCK) -> DataFrame:
    """``scan_lines`` of whole texts."""
    return scan_lines(blocks_of_text(journals, size), size)


def entry_spans(headers: DataFrame) -> DataFrame:
    """Adds ``end``: the start of the next header, else the text length ``size``. Headers come with their ``pos`` from 1."""
    following = headers.select(*NODE, (F.col("pos") - 1).alias("pos"), F.col("start").alias("_next"))
    return headers.join(following, [*NODE, "pos"], "left").withColumn("end", F.coalesce("_next", "size")).drop("_next")


def journal_split(journals: DataFrame, size: int = BLOCK) -> DataFrame:
    """Entries ``(node, pos, ts, body, start, end)`` at headers outside fences; see ``split_lines``."""
    return split_lines(journal_lines(journals, size))


def split_lines(lines: DataFrame) -> DataFrame:
    """Entries of scanned lines. Only the lines of one entry come together."""
    entries = lines.filter("pos > 0").groupBy(*NODE, "pos").agg(
        F.min_by("ts", "line").alias("ts"), F.min("start").alias("start"), F.max(F.col("start") + F.octet_length("text")).alias("_stop"),
        F.bool_or("last").alias("_last"), F.array_sort(F.collect_list(F.struct("line", "text"))).alias("_l"),
    )
    rest = F.slice("_l", F.lit(2), F.size("_l"))
    body = F.array_join(F.transform(rest, lambda e: e["text"]), "\n")
    return entries.select(
        *NODE, "pos", "ts", F.when(F.col("_last") | (F.size("_l") < 2), body).otherwise(F.concat(body, F.lit("\n"))).alias("body"), "start",
        F.when(F.col("_last"), F.col("_stop")).otherwise(F.col("_stop") + 1).cast("long").alias("end"),
    )


STRETCH = 100_000


def journal_order(entries: DataFrame) -> DataFrame:
    """Entries not strictly after the one before, or with a timestamp the journal has seen before.

    ``pos`` grows along the journal. A long journal is looked at in stretches of ``pos``; each stretch also
    gets the last entry before it, so no task sorts a whole hot journal.
    """
    stretch = F.floor(F.col("pos") / STRETCH)
    rows = entries.select(*NODE, "pos", "ts", stretch.alias("_s"))
    edge = rows.groupBy(*NODE, "_s").agg(F.max_by(F.struct("pos", "ts"), "pos").alias("e"))
    # one row per stretch: the window over them stays small
    carry = edge.withColumn("_next", F.lead("_s").over(Window.partitionBy(*NODE).orderBy("_s"))).filter("_next is not null")
    lead_in = carry.select(*NODE, "e.pos", "e.ts", F.col("_next").alias("_s"), F.lit(True).alias("_in"))
    w = Window.partitionBy(*NODE, "_s").orderBy("pos")
    seen = rows.withColumn("_in", F.lit(False)).unionByName(lead_in).withColumn("_prev", F.lag("ts").over(w))
    late = seen.filter("NOT _in AND ts <= _prev").select(*NODE, "pos", "ts", F.lit("out_of_order").alias("reason"))
    first = rows.groupBy(*NODE, "ts").agg(F.min("pos").alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    twice = salted_join(rows, first, [*NODE, "ts"]).filter("pos > _first")
    return late.unionByName(twice.select(*NODE, "pos", "ts", F.lit("duplicate_datetime").alias("reason")))


def latest_entry(journals: DataFrame, entries: DataFrame) -> DataFrame:
    """Newest entry per node and the baseline it gives: timestamp and digest of the bytes up to its end.

    The last entry ends where the text does, so the digest is taken where the text is read; the text is in no join.
    """
    last = entries.groupBy(*NODE).agg(F.max_by("ts", "pos").alias("ts"))
    return last.join(journals.select(*NODE, sha256_text("content").alias("prefix_hash")), NODE)


def recent_entries(entries: DataFrame, n: int | None = 10) -> DataFrame:
    """The last ``n`` entries per node, newest first."""
    if n is None:
        return entries.orderBy(*NODE, F.col("pos").desc())
    return top_n(entries, NODE, [F.col("pos").desc()], n)


def journal_format(journals: DataFrame, size: int = BLOCK) -> DataFrame:
    """Format faults of whole texts; see ``format_faults``."""
    return format_faults(journal_lines(journals, size))


def format_faults(lines: DataFrame) -> DataFrame:
    """Format faults of scanned lines with line numbers: bad start, header or timestamp, level-2 header in a body, out of
    order, duplicate, unclosed fence."""
    strict, readable = F.col("ts").rlike(STRICT_TS), F.try_to_timestamp("ts").isNotNull()
    header = (F.col("ts") != "") & ~F.col("fenced")
    stray = ~F.col("fenced") & (F.col("ts") == "") & F.col("text").like("## %") & (F.col("pos") > 0)
    why = F.array_compact(F.array(
        F.when((F.col("line") == 1) & (F.col("ts") == ""), F.lit("invalid_start")),
        F.when(header & ~strict & ~readable, F.lit("invalid_header")),
        F.when(header & ~strict & readable, F.lit("invalid_datetime")),
        F.when(stray, F.lit("level2_header_in_body")),
    ))
    single = lines.select(*NODE, "line", F.explode(why).alias("reason"))
    order = journal_order(lines.filter(header & strict).select(*NODE, F.col("line").alias("pos"), "ts")).select(*NODE, F.col("pos").alias("line"), "reason")
    # the fence line behind which ticks stay open to the end: the first of the last run of open ones
    fences = lines.filter("fence").groupBy(*NODE).agg(
        F.max_by("opened", "line").alias("_opened"), F.max(F.when(F.col("opened") == 0, F.col("line"))).alias("_closed")
    )
    open_ = fences.filter("_opened > 0").select(*NODE, F.coalesce("_closed", F.lit(0)).alias("_closed"))
    unclosed = lines.filter("fence").select(*NODE, "line").join(open_, NODE).filter("line > _closed").groupBy(*NODE).agg(F.min("line").alias("line"))
    return single.unionByName(order).unionByName(unclosed.select(*NODE, "line", F.lit("unclosed_code_fence").alias("reason")))


def journal_integrity(journals: DataFrame, entries: DataFrame, node_facts: DataFrame) -> DataFrame:
    """Append-only check against the stored baseline, and merge-conflict marks.

    ``node_facts`` carries ``last_ts`` and ``prefix_hash``.
    """
    stored = node_facts.filter("last_ts is not null").select(*NODE, "last_ts", "prefix_hash")
    strict = F.col("last_ts").rlike(STRICT_TS)
    at = entries.groupBy(*NODE, F.col("ts").alias("last_ts")).agg(F.min_by("end", "pos").alias("_end"))
    rows = stored.join(at, [*NODE, "last_ts"], "left").join(
        journals.select(*NODE, F.encode("content", "UTF-8").alias("_b")), NODE, "left"
    )
    now = F.sha2(F.substring("_b", F.lit(1), F.col("_end").cast("int")), 256)
    why = F.when(~strict | F.col("_end").isNull(), "boundary_missing").when(now != F.col("prefix_hash"), "prefix_modified")
    faults = rows.withColumn("reason", why).filter("reason is not null").select(*NODE, "reason")
    marks = journals.filter(F.col("content").rlike(r"(?m)^(<{7}|>{7})")).select(*NODE, F.lit("conflict").alias("reason"))
    return faults.join(marks.select(*NODE), NODE, "left_anti").unionByName(marks)


def journal_gate(
    nodes: DataFrame, types: DataFrame, fingerprints: DataFrame, latest: DataFrame, node_facts: DataFrame
) -> DataFrame:
    """Nodes that owe a fresh entry: the type asks for one, the sources changed, and the newest entry is absent
    or equal to the baseline."""
    asked = salted_join(nodes.select(*NODE, "type"), types.filter("log_required").select("graph_id", "type"), ["graph_id", "type"], "left_semi")
    rows = (
        asked.join(fingerprints.select(*NODE, "fingerprint"), NODE)
        .join(node_facts.select(*NODE, "source", "last_ts"), NODE, "left")
        .join(latest.select(*NODE, "ts"), NODE, "left")
    )
    changed = F.col("fingerprint").isNull() | ~F.col("fingerprint").eqNullSafe(F.col("source"))
    stale = F.col("fingerprint").isNull() | F.col("ts").isNull() | F.col("ts").eqNullSafe(F.col("last_ts"))
    return rows.filter(changed & stale).select(
        "graph_id", F.lit("error").alias("severity"), F.lit("log-entry-missing").alias("code"), "node_path"
    )


def merge_journals(versions: DataFrame) -> DataFrame:
    """Faults of merged journals; ``versions`` has ``base``, ``left``, ``right``, ``merged`` per node.

    No conflict marks may be left, and the merge must start with the ancestor byte for byte. Its entries past
    those of the ancestor are the union of those of both branches, none missing, none made up, in time order.
    """
    marked = versions.filter(F.col("merged").rlike(r"(?m)^(<{7}|={7}|>{7})"))
    clean = versions.join(marked.select(*NODE), NODE, "left_anti")
    kept = F.col("merged").startswith(F.col("base"))
    flag = lambda df, why: df.select(*NODE, F.lit(why).alias("reason"), F.lit("").alias("ts"))
    whole = clean.filter(kept)
    # the four texts of a node go through one scan, each as a journal of its own
    texts = F.explode(F.array(*[F.struct(F.lit(c).alias("side"), F.col(c).alias("content")) for c in ("base", "left", "right", "merged")]))
    each = whole.select(*NODE, texts.alias("_t")).select("graph_id", F.concat("_t.side", F.lit(":"), "node_path").alias("node_path"), "_t.content")
    split = cut_lineage(journal_split(each).select(
        "graph_id", F.substring_index("node_path", ":", 1).alias("_side"), F.expr("substr(node_path, instr(node_path, ':') + 1)").alias("node_path"), "pos", "ts",
        sha256_text(F.concat("ts", F.lit("\n"), "body")).alias("key"),
    ))
    old = split.filter("_side = 'base'").groupBy(*NODE).agg(F.count("*").alias("_n"))
    later = split.filter("_side <> 'base'").join(old, NODE, "left").filter(F.col("pos") > F.coalesce("_n", F.lit(0)))

    def fresh(name: str) -> DataFrame:
        return later.filter(F.col("_side") == name).select(*NODE, "pos", "ts", "key")

    merged = fresh("merged")
    both = fresh("left").unionByName(fresh("right")).select(*NODE, "ts", "key").distinct()
    lost = both.join(merged, [*NODE, "key"], "left_anti").select(*NODE, F.lit("entry_missing").alias("reason"), "ts")
    made = merged.join(both, [*NODE, "key"], "left_anti").select(*NODE, F.lit("entry_invented").alias("reason"), "ts")
    late = journal_order(merged).filter("reason = 'out_of_order'").select(*NODE, "reason", "ts")
    return (
        flag(marked, "conflict_marks").unionByName(flag(clean.filter(~kept), "prefix_broken"))
        .unionByName(lost).unionByName(made).unionByName(late)
    )
