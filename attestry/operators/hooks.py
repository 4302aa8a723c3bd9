"""Typed hooks for user code: checks, pairing, judges. The work around them stays relational."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.operators.digests import PAIR
from attestry.operators.keyed import salted_join, set_digest, shuffled_join
from attestry.operators.waivers import drop_waived, file_lines

FINDING = "graph_id string, rule_id string, unit_key string, file string, line long, message string"
FAILURE = "graph_id string, rule_id string, unit_key string, why string"
Findings = list[tuple[str | None, int | None, str]]
Check = Callable[[str, str, list[tuple[str, str]]], Findings]


def run_column_checks(pair_files: DataFrame, files: DataFrame, patterns: DataFrame) -> DataFrame:
    """Rules given as a forbidden line pattern ``(graph_id, rule_id, pattern, message)``: one finding per line hit."""
    wanted = salted_join(pair_files.select(*PAIR, "path"), patterns, ["graph_id", "rule_id"])
    # each file is split once however many rules read it
    asked = wanted.select("graph_id", F.col("path").alias("file"), "pattern").distinct()
    lines = file_lines(files.join(wanted.select("graph_id", "path").distinct(), ["graph_id", "path"], "left_semi"))
    hits = lines.join(asked, ["graph_id", "file"]).filter(F.expr("text rlike pattern")).select("graph_id", "file", "pattern", "line")
    return wanted.withColumnRenamed("path", "file").join(hits, ["graph_id", "file", "pattern"]).select(*PAIR, "file", "line", "message")


def run_python_checks(pair_files: DataFrame, files: DataFrame, check: Check) -> tuple[DataFrame, DataFrame]:
    """Per-file rules given as a function ``check(rule_id, unit_key, [(path, text)])``.

    Returns findings and failures. A crash, a bad shape or a file outside the unit makes the unit fail. Files
    stream through in batches; a unit with several subjects goes through run_unit_checks.
    """
    subjects = pair_files.join(files.select("graph_id", "path", "content"), ["graph_id", "path"]).select(*PAIR, "path", "content")
    schema = FINDING + ", why string"

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split(" ")[0] for f in schema.split(", ")]
        for pdf in parts:
            rows: list[tuple] = []
            for g, rule, unit, path, text in pdf.itertuples(index=False):
                rows += _judge(check, g, rule, unit, [(path, text)])
            yield pd.DataFrame(rows, columns=names).astype({"line": "Int64"})

    return _split(subjects.mapInPandas(batches, schema))


def run_unit_checks(pair_files: DataFrame, files: DataFrame, check: Check) -> tuple[DataFrame, DataFrame]:
    """As run_python_checks for rules that must see all subjects of a unit at once.

    The contract hands the function the whole unit, so a unit is as large as the node it belongs to; give
    rules that can work file by file a per-file scope.
    """
    subjects = pair_files.join(files.select("graph_id", "path", "content"), ["graph_id", "path"]).select(*PAIR, "path", "content")
    schema = FINDING + ", why string"
    names = [f.split(" ")[0] for f in schema.split(", ")]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf.iloc[0]
        texts = sorted(zip(pdf["path"], pdf["content"]))
        rows = _judge(check, head["graph_id"], head["rule_id"], head["unit_key"], texts)
        return pd.DataFrame(rows, columns=names).astype({"line": "Int64"})

    return _split(subjects.groupBy(*PAIR).applyInPandas(one, schema))


def _judge(check: Check, g: str, rule: str, unit: str, texts: list[tuple[str, str]]) -> list[tuple]:
    known = {p for p, _ in texts}
    try:
        found = [(f, None if n is None else int(n), str(m)) for f, n, m in check(rule, unit, texts)]
    except Exception as e:  # user code may raise anything; the unit then fails, the job does not
        return [(g, rule, unit, None, None, None, f"{type(e).__name__}: {e}")]
    strange = [f for f, _, _ in found if f is not None and f not in known]
    if strange:
        return [(g, rule, unit, None, None, None, f"finding outside the unit: {strange[0]}")]
    return [(g, rule, unit, f, n, m, None) for f, n, m in found]


def _split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return rows.filter("why is null").drop("why"), rows.filter("why is not null").select(*PAIR, "why")


def waive_findings(findings: DataFrame, ranges: DataFrame) -> DataFrame:
    """Findings less those on waived lines."""
    return drop_waived(findings, ranges)


def pairing_hook(pair_files: DataFrame, propose: Callable[[str, str, str], list[str]]) -> DataFrame:
    """Companion paths a function proposes per subject ``propose(rule_id, unit_key, path)``; feed them to companion_pairs."""
    schema = "graph_id string, rule_id string, unit_key string, path string"

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [
                (g, r, u, q) for g, r, u, p in pdf.itertuples(index=False) for q in propose(r, u, p)
            ]
            yield pd.DataFrame(rows, columns=[*PAIR, "path"])

    return pair_files.select(*PAIR, "path").mapInPandas(batches, schema).distinct()


def run_judges(texts: DataFrame, judge: Callable[[str], str], votes: DataFrame | int = 1, parallel: int | None = None) -> DataFrame:
    """Ask ``judge(text) -> reply`` for each vote of each pair: rows ``(PAIR, vote_no, reply)``.

    ``parallel`` bounds how many judges run at once. A judge that raises gives a null reply.
    """
    if isinstance(votes, int):
        rows = texts.withColumn("vote_no", F.explode(F.sequence(F.lit(0), F.lit(votes - 1))))
    else:
        rows = texts.join(votes, PAIR).withColumn("vote_no", F.explode(F.expr("sequence(0, votes - 1)")))
    rows = rows.select(*PAIR, "vote_no", "text")
    if parallel is not None:
        rows = rows.repartition(parallel)
    schema = "graph_id string, rule_id string, unit_key string, vote_no int, reply string"

    def ask(text: str) -> str | None:
        try:
            return judge(text)
        except Exception:  # an unreachable judge is a provider error of that vote
            return None

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = pdf[[*PAIR, "vote_no"]].copy()
            out["reply"] = [ask(t) for t in pdf["text"]]
            yield out

    return rows.mapInPandas(batches, schema)


def findings_to_verdicts(pairs: DataFrame, findings: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Verdict per pair: any finding refuses, and ``lines`` are its findings, one ``file:line: message`` a line.

    Lines stand in the order of file, line and text. The reason is their number and the digest of the set of lines,
    short at every size. Failed units get no verdict.
    """
    rows = finding_lines(findings)
    said = F.transform(F.array_sort(F.collect_list(F.struct("file", "line", "text"))), lambda e: e["text"])
    whole = rows.groupBy(*PAIR).agg(F.count("*").alias("_n"), F.array_join(said, "\n").alias("lines"))
    reason = shuffled_join(set_digest(rows, PAIR, F.col("text"), "_d"), whole, PAIR)
    reason = reason.select(*PAIR, F.concat(F.col("_n"), F.lit(" findings, sha256 "), "_d").alias("reason"), "lines")
    out = shuffled_join(pairs.select(*PAIR), reason, PAIR, "left")
    if failed is not None:
        out = out.join(failed.select(*PAIR).distinct(), PAIR, "left_anti")
    return out.select(*PAIR, F.when(F.col("reason").isNotNull(), "refused").otherwise("approved").alias("verdict"), "reason", "lines")


def finding_lines(findings: DataFrame) -> DataFrame:
    """Findings once each, with ``text``: ``file:line: message``, or the message alone where there is no file."""
    place = F.concat("file", F.lit(":"), F.coalesce(F.col("line").cast("string"), F.lit("?")))
    text = F.when(F.col("file").isNotNull(), F.concat(place, F.lit(": "), "message")).otherwise(F.col("message"))
    return findings.select(*PAIR, "file", "line", text.alias("text")).distinct()


# --- replies -------------------------------------------------------------------------------------------------


FENCE = r"(?s)```(?:json)?\s*(\{.*?\})\s*```"
FLAG = r'(?i)"satisfied"\s*:\s*"?(true|false)'
LOOSE_REASON = r'(?s)"reason"\s*:\s*"(.*?)(?:"\s*,\s*"\w+"\s*:|"?\s*\}?\s*$)'
OBJECT = "satisfied string, reason string"


def _answer(text: Column) -> Column:
    """The object that a text starts with, as a struct of verdict and reason; null unless it has a verdict."""
    fields = F.from_json(text, OBJECT, {"allowSingleQuotes": "false"})
    flag = F.lower(F.trim(fields["satisfied"]))
    return F.when(flag.isin("true", "false"), F.struct((flag == "true").alias("satisfied"), F.coalesce(fields["reason"], F.lit("")).alias("reason")))


def parse_judgements(replies: DataFrame, text: str = "text") -> DataFrame:
    """Read judge replies: adds ``satisfied``, ``reason``, ``error_source`` and ``how``.

    The first of these that holds a verdict counts: the whole reply as one object, an object in a fence, the last
    object that starts anywhere, and the last flag that stands like a field, with what stands after ``"reason":``
    as its reason. Quoted booleans count. A reply with none of them is an error of the provider, and the reason
    is the whole reply. Empty replies give no row.
    """
    rows = replies.filter(F.col(text).isNotNull() & F.col(text).rlike(r"\S"))
    body = F.trim(F.regexp_replace(F.col(text), r"^\s+|\s+$", ""))
    whole = F.when(body.startswith("{") & body.endswith("}"), _answer(body))
    fenced = _answer(F.regexp_extract(body, FENCE, 1))
    parts = F.split(body, r"\{")
    starts = F.when(F.size(parts) > 1, F.sequence(F.lit(2), F.size(parts)))
    found = F.filter(F.transform(starts, lambda k: _answer(F.concat(F.lit("{"), F.array_join(F.slice(parts, k, F.size(parts)), "{")))), lambda a: a.isNotNull())
    last = F.try_element_at(found, F.lit(-1))
    flag = F.try_element_at(F.regexp_extract_all(body, F.lit(FLAG), F.lit(1)), F.lit(-1))
    loose = F.trim(F.regexp_extract(body, LOOSE_REASON, 1))
    torn = F.when(
        body.contains("{") & flag.isNotNull(),
        F.struct((F.lower(flag) == "true").alias("satisfied"), F.when(loose != "", loose).otherwise("the verdict has no readable reason").alias("reason")),
    )
    nothing = F.struct(F.lit(False).alias("satisfied"), F.concat(F.lit("no verdict in the reply: "), F.col(text)).alias("reason"))
    steps = [(whole, "strict"), (fenced, "fenced"), (last, "object"), (torn, "salvage")]
    # a chain of conditions: a later step is worked out only for rows that no earlier one can read
    given = F.coalesce(*[F.when(a.isNotNull(), F.struct(a["satisfied"].alias("satisfied"), a["reason"].alias("reason"), F.lit("codeViolation").alias("error_source"), F.lit(how).alias("how"))) for a, how in steps],
                       F.struct(nothing["satisfied"].alias("satisfied"), nothing["reason"].alias("reason"), F.lit("provider").alias("error_source"), F.lit("provider-error").alias("how")))
    return rows.withColumn("_r", given).select(*replies.columns, "_r.satisfied", "_r.reason", "_r.error_source", "_r.how")
