import hashlib

from attestry.operators import hooks

KEY = "graph_id string, rule_id string, unit_key string"


def test_replies(spark):
    texts = {
        1: '{"satisfied": true, "reason": "fine"}', 2: '{"satisfied": "False", "reason": "bad"}', 3: 'Sure:\n```json\n{"satisfied": true, "reason": "x"}\n```',
        4: 'thinking {"a": 1} then {"satisfied": false, "reason": "uses {braces}"} done', 5: '{"satisfied": true, "reason": "he said "no" twice"}',
        6: '{"satisfied": false, "reason": "cut off', 7: "no idea", 8: "   ", 9: '{"reason": "first", "satisfied": TRUE}',
    }
    rows = spark.createDataFrame(list(texts.items()), "id int, text string")
    got = {r.id: (r.satisfied, r.how, r.error_source) for r in hooks.parse_judgements(rows).collect()}
    assert got == {
        1: (True, "strict", "codeViolation"), 2: (False, "strict", "codeViolation"), 3: (True, "fenced", "codeViolation"), 4: (False, "object", "codeViolation"),
        5: (True, "salvage", "codeViolation"), 6: (False, "salvage", "codeViolation"), 7: (False, "provider-error", "provider"), 9: (True, "salvage", "codeViolation"),
    }


def test_checks_that_fail_give_rows_not_errors(spark):
    pairs = spark.createDataFrame([("g", r, "file:a", "a") for r in ("ok", "crash", "foreign")], KEY + ", path string")
    files = spark.createDataFrame([("g", "a", "one\ntwo")], "graph_id string, path string, content string")

    def check(rule, unit, texts):
        if rule == "crash":
            raise ValueError("boom")
        return [("b" if rule == "foreign" else "a", 2, "two is wrong")]

    for run in (hooks.run_python_checks, hooks.run_unit_checks):
        found, failed = run(pairs, files, check)
        assert [(r.rule_id, r.file, r.line) for r in found.collect()] == [("ok", "a", 2)]
        assert {r.rule_id: r.why for r in failed.collect()} == {"crash": "ValueError: boom", "foreign": "finding outside the unit: b"}
    verdicts = {r.rule_id: (r.verdict, r.reason) for r in hooks.findings_to_verdicts(pairs, found, failed).collect()}
    block = hashlib.sha256(b"a:2: two is wrong").hexdigest()
    whole = hashlib.sha256(f"{block[:3]}:{block}".encode()).hexdigest()
    assert verdicts == {"ok": ("refused", f"1 findings, sha256 {whole}")}


def test_verdicts_carry_the_lines_of_their_findings(spark):
    pairs = spark.createDataFrame([("g", "r", "node:n"), ("g", "r", "node:m")], KEY)
    found = [("g", "r", "node:n", "b", 1, "first"), ("g", "r", "node:n", "a", 10, "late"), ("g", "r", "node:n", "a", 9, "early"), ("g", "r", "node:n", "a", 9, "early"), ("g", "r", "node:n", "c", None, "whole")]
    findings = spark.createDataFrame(found, KEY + ", file string, line bigint, message string")
    got = {r.unit_key: (r.verdict, r.lines) for r in hooks.findings_to_verdicts(pairs, findings).collect()}
    assert got == {"node:n": ("refused", "a:9: early\na:10: late\nb:1: first\nc:?: whole"), "node:m": ("approved", None)}
