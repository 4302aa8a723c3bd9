import json

from pyspark.sql import functions as F

from attestry.sources import files as src
from attestry.sources import verdict_store as store
from attestry.streaming import streams


def test_scan_and_journals(spark, tmp_path):
    for name, text in {"g1/src/a.py": "x", "g1/.git/HEAD": "no", "g1/model/n/log.md": "## [t]\nhi\n", "g2/b.txt": "y"}.items():
        path = tmp_path / "trees" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    root = str(tmp_path / "trees")
    got = {(r.graph_id, r.path, r.size) for r in src.scan_files(spark, root).collect()}
    assert got == {("g1", "src/a.py", 1), ("g1", "model/n/log.md", 10), ("g2", "b.txt", 1)}
    nodes = spark.createDataFrame([("g1", "model/n"), ("g1", "model/m")], "graph_id string, node_path string")
    assert {r.node_path: r.content for r in src.read_journals(spark, root, nodes).collect()} == {"model/n": "## [t]\nhi\n", "model/m": ""}


def test_documents_become_tables(spark):
    node = {"name": "N", "type": "svc", "mapping": ["src", "lib/*.py"], "rules": [{"rule_id": "r1", "status": "draft"}],
            "relations": [{"target": "b", "type": "uses", "consumes": ["p"]}], "ports": {"p": {"description": "d", "rules": [{"rule_id": "r2"}]}}}
    docs = [("g", "node", "a/x/c", json.dumps(node)), ("g", "node", "a", "{}"), ("g", "flow", "f", json.dumps({"nodes": ["a"], "rules": [{"rule_id": "r1"}]})),
            ("g", "rule", "r1", json.dumps({"kind": "judged", "implies": [{"rule_id": "r2", "inherit": "own-default"}]})), ("g", "type", "svc", json.dumps({"parents": ["root"], "relations": {"uses": ["*"]}}))]
    t = src.normalize_graph(spark.createDataFrame(docs, "graph_id string, kind string, path string, doc string"))
    assert {r.node_path: r.parent_path for r in t["nodes"].collect()} == {"a/x/c": "a", "a": None}
    assert [(r.ord, r.entry) for r in t["mappings"].orderBy("ord").collect()] == [(0, "src"), (1, "lib/*.py")]
    assert {(r.site_kind, r.site, r.port, r.rule_id, r.status) for r in t["attachments_raw"].collect()} == {
        ("node", "a/x/c", None, "r1", "draft"), ("flow", "f", None, "r1", None), ("port", "a/x/c", "p", "r2", None)}
    assert t["implies"].first().implied == "r2" and t["relations"].first().consumes == ["p"] and t["types"].first().parents == ["root"]


VERDICTS = store.VERDICT


def test_store_round_trip_skips_what_did_not_change(spark, tmp_path):
    rows = [("g", "judged", "r1", "node:a", "approved", "a" * 64, None, None), ("g", "judged", "r2", "node:a", "approved", "a" * 64, None, None),
            ("g", "computed", "r2", "file:b", "refused", "b" * 64, "b:1: no", [("read:c", "d")])]
    facts = spark.createDataFrame([("g", "a", "f", None, None)], store.FACTS)
    path = str(tmp_path / "store")
    v = spark.createDataFrame(rows, VERDICTS)
    assert store.write_verdicts(v, facts, path) == ["judged", "computed", "facts"]
    assert store.write_verdicts(v, facts, path) == []
    read, node_facts, invalid = store.read_verdicts(spark, path)
    # the computed r2 hides the judged one
    assert {(r.rule_id, r.kind) for r in read.collect()} == {("r1", "judged"), ("r2", "computed")} and invalid.count() == 0 and node_facts.count() == 1
    changed = v.withColumn("verdict", F.when(F.col("rule_id") == "r1", "refused").otherwise(F.col("verdict")))
    assert store.write_verdicts(changed, facts, path, "deterministic") == []
    assert store.write_verdicts(changed, facts, path) == ["judged"]


def _drain(query):
    query.awaitTermination(120)
    assert query.exception() is None


def test_journal_stream_stamps_strictly_later(spark, tmp_path):
    rows = [("g", "n", "2024-01-01 00:00:00", "one"), ("g", "n", "2024-01-01 00:00:00", "two"), ("g", "n", "2024-01-01 00:00:00", "  "), ("g", "m", "2024-01-01 00:00:05", "## no"),
            ("g", "n", None, "no time"), ("g", "n", "2024-01-01 00:00:03", None), ("g", "n", "2023-12-31 23:59:59", "zero"), ("g", "m", "2024-01-01 05:00:00", "newest")]
    schema = "graph_id string, node_path string, arrived timestamp, body string"
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, "graph_id string, node_path string, arrived string, body string").withColumn("arrived", F.to_timestamp("arrived")).coalesce(1).write.parquet(source)
    out = streams.journal_stream(spark.readStream.schema(schema).parquet(source))
    _drain(out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).option("path", str(tmp_path / "out")).outputMode("append").trigger(availableNow=True).start())
    got = spark.read.parquet(str(tmp_path / "out"))
    # in the order of arrival, not of the rows; the newest waits for the watermark
    assert sorted((r.ts, r.body) for r in got.collect()) == [
        ("2023-12-31T23:59:59.000Z", "zero\n"), ("2024-01-01T00:00:00.000Z", "one\n"), ("2024-01-01T00:00:00.001Z", "two\n")]


def test_a_change_its_way_back_and_the_change_again_are_three_events(spark, tmp_path):
    schema = "graph_id string, path string, hash string, at timestamp"
    known = spark.createDataFrame([("g", "a", "old"), ("g", "a", "old"), ("g", "c", "same")], "graph_id string, path string, hash string")
    runs = [
        [("g", "a", "new", "2024-01-01 10:00:00"), ("g", "a", "new", "2024-01-01 10:00:00"), ("g", "c", "same", "2024-01-01 10:00:00"), ("g", "b", "x", "2024-01-01 10:00:00")],
        [("g", "a", "new", "2024-01-01 10:30:00"), ("g", "a", "old", "2024-01-01 10:40:00"), ("g", "a", "new", "2024-01-01 10:50:00"), ("g", "b", "y", "2024-01-01 09:00:00"), ("g", "b", None, "2024-01-01 11:00:00")],
    ]
    for rows in runs:
        spark.createDataFrame(rows, "graph_id string, path string, hash string, at string").withColumn("at", F.to_timestamp("at")).write.mode("append").parquet(str(tmp_path / "in"))
        out = streams.digest_changes(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), known)
        _drain(out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start())
    got = sorted((r.path, r.ms, r.was, r.hash) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    # the older event of b came late
    assert [(p, w, h) for p, _, w, h in got] == [("a", "old", "new"), ("a", "new", "old"), ("a", "old", "new"), ("b", None, "x")]


def test_change_and_verdict_streams(spark, tmp_path):
    key = "graph_id string, rule_id string, unit_key string"
    changes = spark.createDataFrame([("g", "a", "new", "2024-01-01"), ("g", "a", "new", "2024-01-01"), ("g", "b", "same", "2024-01-01")], "graph_id string, path string, hash string, at string")
    changes.withColumn("at", F.to_timestamp("at")).coalesce(1).write.parquet(str(tmp_path / "changes"))
    pairs = spark.createDataFrame([("g", "r", f"file:{p}", p, "computed", "n") for p in "ab"], key + ", path string, kind string, node_path string")
    known = spark.createDataFrame([("g", "a", "old"), ("g", "b", "same")], "graph_id string, path string, hash string")
    empty = lambda s: spark.createDataFrame([], s)
    stream = spark.readStream.schema("graph_id string, path string, hash string, at timestamp").parquet(str(tmp_path / "changes"))
    writer = streams.change_stream(stream, pairs, empty("graph_id string, rule_id string, path string"), empty(key), empty(key + ", key string"), empty("graph_id string, node_path string, entry string"), known, str(tmp_path / "stale"))
    _drain(writer.option("checkpointLocation", str(tmp_path / "ck1")).trigger(availableNow=True).start())
    assert [(r.unit_key, r.reason) for r in spark.read.parquet(str(tmp_path / "stale")).collect()] == [("file:a", "own")]


def _verdict(rule, unit, verdict, digit, kind="computed"):
    return ("g", kind, rule, unit, verdict, digit * 64, None, None)


def _states(spark, path):
    return {(r.rule_id, r.unit_key): r.verdict for r in store.read_verdicts(spark, path)[0].collect()}


def test_verdict_stream_folds_each_batch_once(spark, tmp_path):
    path, facts = str(tmp_path / "store"), spark.createDataFrame([("g", "a", "f", None, None)], store.FACTS)
    old = spark.createDataFrame([_verdict("r", "file:a", "refused", "1"), _verdict("r", "file:b", "refused", "1")], VERDICTS)
    store.write_verdicts(old, facts, path)
    new = spark.createDataFrame([_verdict("r", "file:a", "approved", "2")], VERDICTS)
    new.write.parquet(str(tmp_path / "new"))
    writer = streams.verdict_stream(spark.readStream.schema(new.schema).parquet(str(tmp_path / "new")), path)
    _drain(writer.option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start())
    assert _states(spark, path) == {("r", "file:a"): "approved", ("r", "file:b"): "refused"}
    # the batch again, as after a failure: passed over; the next one counts
    again = spark.createDataFrame([_verdict("r", "file:a", "refused", "3")], VERDICTS)
    assert not store.fold_batch(again, path, "verdicts", 0) and _states(spark, path)["r", "file:a"] == "approved"
    assert store.fold_batch(again, path, "verdicts", 1) and _states(spark, path)["r", "file:a"] == "refused"
    before, seen = store.manifest(spark, path)["version"], store.read_verdicts(spark, path)[0]
    store.compact(spark, path)
    assert store.manifest(spark, path)["batches"] == [] and store.manifest(spark, path)["streams"] == {"verdicts": 1}
    # who read before goes on, and the store is the same
    assert {(r.unit_key, r.verdict) for r in seen.collect()} == {("file:a", "refused"), ("file:b", "refused")}
    assert _states(spark, path) == {("r", "file:a"): "refused", ("r", "file:b"): "refused"}
    assert store.manifest(spark, path)["version"] == before + 1 and not store.fold_batch(again, path, "verdicts", 1)
    store.vacuum(spark, path, keep=1)
    assert _states(spark, path) == {("r", "file:a"): "refused", ("r", "file:b"): "refused"} and len(store.versions(spark, path)) == 1


def test_a_write_cut_off_leaves_the_store_as_it_was(spark, tmp_path, monkeypatch):
    path, facts = str(tmp_path / "store"), spark.createDataFrame([], store.FACTS)
    store.write_verdicts(spark.createDataFrame([_verdict("r", "file:a", "refused", "1")], VERDICTS), facts, path)
    other = spark.createDataFrame([_verdict("r", "file:b", "approved", "2"), _verdict("s", "file:b", "approved", "2", "judged")], VERDICTS)
    with monkeypatch.context() as m:
        m.setattr(store, "commit", lambda *a, **k: (_ for _ in ()).throw(OSError("cut off")))
        for write in (lambda: store.write_verdicts(other, facts, path), lambda: store.fold_batch(other, path, "s", 0)):
            try:
                write()
                raise AssertionError("went through")
            except OSError:
                pass
    assert _states(spark, path) == {("r", "file:a"): "refused"}
    assert store.vacuum(spark, path) > 0 and _states(spark, path) == {("r", "file:a"): "refused"}
    # rows of the store itself may be written back
    assert store.write_verdicts(store.read_verdicts(spark, path)[0].unionByName(other), facts, path) == ["judged", "computed"]
    assert len(_states(spark, path)) == 3


def test_a_writer_that_comes_second_is_asked_again(spark, tmp_path):
    path, seen = str(tmp_path / "store"), []

    def change(m):
        seen.append(m["version"])
        if len(seen) == 1:
            store.commit(spark, path, lambda n: {**n, "streams": {"first": 1}})
        m["streams"]["second"] = 2
        return m

    assert store.commit(spark, path, change) == 2 and seen == [0, 1]
    assert store.manifest(spark, path)["streams"] == {"first": 1, "second": 2}


def test_scan_of_text_and_binary_files(spark, tmp_path):
    root = tmp_path / "a folder's src %20 src+x"
    for path, raw in {"g1/a.txt": "é\n".encode(), "g1/logo.png": b"\x89PNG\xff\x00", "g2/src/a folder's src %20 src+x/b.txt": b"b", "g1/.git/config": b"x", "g1/log.md": b"# l"}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(raw)
    want = {("g1", "a.txt", "é\n", 3, True), ("g1", "logo.png", None, 6, False), ("g2", "src/a folder's src %20 src+x/b.txt", "b", 1, True), ("g1", "log.md", "# l", 3, True)}
    for at in (str(root), f"{root}/", f"file:{root}"):
        assert {tuple(r) for r in src.scan_files(spark, at).collect()} == want
    assert [r["path"] for r in src.scan_files(spark, str(root), "log.md").collect()] == ["log.md"]
