import random

from pyspark.sql import functions as F

from attestry.operators import journals as jou
from attestry.operators import waivers as wai

MARK = "graph_id string, file string, line long, rule_id string, kind string, wildcard boolean, reason string"


def _sequences(n):
    rnd = random.Random(7)
    return {f"f{i}": [(line, rnd.choice("ab*"), rnd.choice(["disable", "enable", "single"])) for line in range(1, rnd.randint(2, 14))] for i in range(n)}


def _spans(marks, total):
    out, open_ = [], {}
    for line, rule, kind in marks:
        if kind == "single":
            out.append((rule, line + 1, line + 1))
        elif kind == "disable":
            open_.setdefault(rule, line + 1)
        elif rule in open_:
            out.append((rule, open_.pop(rule), line - 1))
    return sorted(out + [(r, s, total) for r, s in open_.items()])


def _unclosed(marks):
    stacks = {}
    for line, rule, kind in marks:
        if kind == "disable":
            stacks.setdefault(rule, []).append(line)
        elif kind == "enable" and stacks.get(rule):
            stacks[rule].pop()
    return sorted((r, n) for r, s in stacks.items() for n in s)


def test_waivers_agree_with_a_scan(spark):
    seqs = _sequences(300)
    rows = spark.createDataFrame([("g", f, n, r, k, r == "*", "why") for f, ms in seqs.items() for n, r, k in ms], MARK)
    sizes = spark.createDataFrame([("g", f, 40) for f in seqs], "graph_id string, file string, total_lines long")
    spans = {f: [] for f in seqs}
    for r in wai.waived_ranges(rows, sizes).collect():
        spans[r.file].append((r.rule_id, r.start_line, r.end_line))
    assert {f: sorted(s) for f, s in spans.items()} == {f: _spans(ms, 40) for f, ms in seqs.items()}
    left = {f: [] for f in seqs}
    for r in wai.unclosed_waivers(rows).collect():
        left[r.file].append((r.rule_id, r.line))
    assert {f: sorted(s) for f, s in left.items()} == {f: _unclosed(ms) for f, ms in seqs.items()}


def test_marker_forms(spark):
    text = "x = 1 # waive(r1, r2) known\n// waive-disable( * ) all\nwaive-enable(*)\nwaiver(r3) no\nwaive(r4)"
    files = spark.createDataFrame([("g", "a.py", text)], "graph_id string, path string, content string")
    got = sorted((r.line, r.rule_id, r.kind, r.reason) for r in wai.marker_scan(files).collect())
    assert got == [(1, "r1", "single", "known"), (1, "r2", "single", "known"), (2, "*", "disable", "all"), (3, "*", "enable", ""), (5, "r4", "single", "")]


def test_journal_faults_and_fences(spark):
    text = (
        "## [2024-01-01T00:00:00.000Z]\nok\n```\n## [not an entry]\n```\n## [2024-01-01T00:00:00.000Z]\n## stray\n"
        "## [2023-01-01]\nx\n## [soon]\n````\nopen\n```\n"
    )
    rows = spark.createDataFrame([("g", "n", text), ("g", "m", "hello\n"), ("g", "e", "")], "graph_id string, node_path string, content string")
    got = sorted((r.node_path, r.line, r.reason) for r in jou.journal_format(rows).collect())
    assert got == [
        ("m", 1, "invalid_start"), ("n", 6, "duplicate_datetime"), ("n", 6, "out_of_order"), ("n", 7, "level2_header_in_body"),
        ("n", 8, "invalid_datetime"), ("n", 10, "invalid_header"), ("n", 11, "unclosed_code_fence"),
    ]
    entries = jou.journal_split(rows).orderBy("pos").collect()
    assert [e.ts for e in entries] == ["2024-01-01T00:00:00.000Z", "2024-01-01T00:00:00.000Z", "2023-01-01", "soon"]
    raw = text.encode()
    assert all(raw[e.start:e.end].decode().endswith(e.body) for e in entries) and entries[-1].end == len(raw)


def test_no_text_of_a_journal_in_windows_or_joins(spark):
    journals = spark.createDataFrame([("g", "n", "## [a]\nx\n```\n## [b]\n```\n## [c]\ny"), ("g", "m", "no header\n"), ("g", "e", ""), ("g", "h", "## [a]\n## [b]")], "graph_id string, node_path string, content string")
    split = jou.journal_split(journals)
    got = sorted((r["node_path"], r["pos"], r["ts"], r["body"], r["start"], r["end"]) for r in split.collect())
    assert got == [("h", 1, "a", "", 0, 7), ("h", 2, "b", "", 7, 13), ("n", 1, "a", "x\n```\n## [b]\n```\n", 0, 24), ("n", 2, "c", "y", 24, 32)]
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.split("\n") if ("Window" in line or "Join" in line or "Exchange" in line) and "content" in line]


def _plain_scan(text):
    """Lines of a journal by a plain state machine: (line, pos, start, fenced, opened)."""
    import re

    ticks = pos = start = 0
    out = []
    for n, line in enumerate(text.split("\n"), 1):
        m = re.match(r"`{3,}", line)
        inside = ticks > 0
        if m:
            if not ticks:
                ticks = len(m[0])
            elif not line[len(m[0]):].strip(" ") and len(m[0]) >= ticks:
                ticks = 0
        elif not ticks and re.match(jou.HEADER, line):
            pos += 1
        out.append((n, pos, start, bool(m) or inside, ticks))
        start += len(line.encode()) + 1
    return out


def test_scan_in_blocks_equals_a_plain_scan(spark):
    rng = random.Random(8)
    kinds = ["## [2024-01-01T00:00:00.000Z]", "## [b]", "text é", "", "```", "````", "`````", "```py", "````  ", "## stray", "``` x"]
    texts = {f"n{k}": "\n".join(rng.choices(kinds, k=rng.randint(1, 60))) for k in range(60)}
    rows = spark.createDataFrame([("g", k, t) for k, t in texts.items()], "graph_id string, node_path string, content string")
    loose = rows.select("graph_id", "node_path", F.posexplode(F.split("content", "\n", -1)).alias("i", "text")).withColumn("line", F.col("i").cast("long") + 1)
    for blocks in (jou.blocks_of_text(rows, 4), jou.blocks_of_lines(loose, 4), jou.blocks_of_text(rows, 1)):
        size = 1 if blocks.filter("size(texts) > 1").isEmpty() else 4
        got = {k: [] for k in texts}
        for r in jou.scan_lines(blocks, size).collect():
            got[r.node_path].append((r.line, r.pos, r.start, r.fenced, r.opened))
        assert {k: sorted(v) for k, v in got.items()} == {k: _plain_scan(t) for k, t in texts.items() if t}
    faults = [sorted(map(tuple, jou.journal_format(rows, size).collect())) for size in (1, 5, 1000)]
    assert faults[0] == faults[1] == faults[2]
    entries = [sorted(map(tuple, jou.journal_split(rows, size).collect())) for size in (2, 1000)]
    assert entries[0] == entries[1]


def test_no_window_over_a_whole_journal(spark):
    journals = spark.createDataFrame([("g", "n", "## [a]\nx")], "graph_id string, node_path string, content string")
    for frame in (jou.journal_split(journals), jou.format_faults(jou.journal_lines(journals)).filter("reason not like '%order%'")):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        specs = [line for line in plan.split("\n") if "windowspecdefinition" in line]
        assert specs and all("block" in line or "_s#" in line for line in specs)
        assert not [line for line in specs if "_s#" in line and "lead" not in line and "lag" not in line]


def test_a_long_journal_is_scanned_in_many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    n = 400_000
    text = F.when(F.col("id") % 50 == 0, F.lit("## [2024-01-01T00:00:00.000Z]")).when(F.col("id") % 50 == 7, F.lit("```")).when(F.col("id") % 50 == 9, F.lit("```")).otherwise(F.lit("x"))
    lines = spark.range(n).select(F.lit("g").alias("graph_id"), F.lit("n").alias("node_path"), (F.col("id") + 1).alias("line"), text.alias("text"))
    scanned = jou.scan_lines(jou.blocks_of_lines(lines))
    top = scanned.withColumn("task", F.spark_partition_id()).agg(F.max("pos"), F.max("line"), F.sum(F.col("fenced").cast("int")), F.countDistinct("task")).first()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert tuple(top)[:3] == (n // 50, n, 3 * n // 50) and top[3] > 1


def test_findings_on_waived_lines_by_sweep(spark):
    rng = random.Random(12)
    spans = [("g", f"f{rng.randint(0, 2)}", rng.choice("ab*"), s := rng.randint(1, 40), s + rng.randint(-2, 9)) for _ in range(60)]
    spans.append(("g", "f9", "a", 3, None))
    ranges = spark.createDataFrame([(*x[:3], x[3], x[4], x[2] == "*") for x in spans], "graph_id string, file string, rule_id string, start_line long, end_line long, wildcard boolean")
    found = [("g", f"f{rng.randint(0, 3)}", rng.choice("abc"), rng.randint(1, 50), k) for k in range(500)] + [("g", None, "a", 3, 900), ("g", "f0", "a", None, 901), ("g", "f9", "a", 4, 902)]
    found += [("g", "f0", "a", 5, 1000)] * 300
    findings = spark.createDataFrame(found, "graph_id string, file string, rule_id string, line long, k int")

    def kept(f):
        return not any(f[1] == s[1] and f[3] is not None and s[4] is not None and s[3] <= f[3] <= s[4] and s[2] in ("*", f[2]) for s in spans)

    for stretch in (4, 4096):
        left = wai.drop_waived(findings, ranges, stretch)
        assert sorted((tuple(r[c] for c in findings.columns) for r in left.collect()), key=str) == sorted(filter(kept, found), key=str)
    plan = wai.waived_lines(findings.select("graph_id", "file", "rule_id", "line").distinct(), ranges)._jdf.queryExecution().optimizedPlan().toString()
    assert "start_line" not in "".join(line for line in plan.split("\n") if "Join" in line)
