from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from codeloom.sources.extract import extract_all
from codeloom.sources.store import SnapshotStore, delete_files, upsert
from codeloom.streaming.watch import Progress, accepted, apply_changes, debounced, events_stream, run_to_table


def test_upsert_keeps_the_last_and_null_keys(spark):
    base = spark.createDataFrame([("a", 1, 0), ("b", 1, 0), (None, 1, 0)], "k string, v int, o int")
    new = spark.createDataFrame([("a", 2, 1), ("a", 3, 2), ("c", 9, 1), (None, 7, 1)], "k string, v int, o int")
    assert sorted((r.k or "", r.v) for r in upsert(base, new, ["k"], "o").collect()) == [("", 1), ("", 7), ("a", 3), ("b", 1), ("c", 9)]


def test_cascade_and_revisions(spark, tmp_path):
    s = SnapshotStore(spark, f"file://{tmp_path}/store")
    assert s.revision == 0
    sym = spark.createDataFrame([("1", "a.rs"), ("2", "b.rs")], "id string, file_path string")
    imp = spark.createDataFrame([("a.rs", "x", None)], "file_path string, imported_path string, imported_symbol string")
    assert s.merge({"symbols": sym, "imports": imp}) == 1
    gone = spark.createDataFrame([("a.rs",), ("a.rs",)], "path string")
    assert s.merge({}, gone) == 2 and s.revision == 2
    assert [r.id for r in s.read("symbols").collect()] == ["2"] and s.read("imports").count() == 0
    assert delete_files({"other": sym}, gone)["other"].count() == 2
    assert SnapshotStore(spark, f"file://{tmp_path}/store").revision == 2 and s.merge({}) == 2
    assert s.clear() == 3 and s.read("symbols").count() == 0
    (tmp_path / "store" / "current-99.json").write_text('{"schema": 99, "revision": 1, "tables": {}}')
    with pytest.raises(ValueError, match="schema 99"):
        s.revision  # noqa: B018


def test_changes_stream_into_snapshots(spark, tmp_path):
    src, schema = f"{tmp_path}/changes", "path string, deleted boolean, body string, at long"
    store = SnapshotStore(spark, f"file://{tmp_path}/index")

    def extract(changed):
        found = extract_all(changed.select("path", "body", F.lit("python").alias("language"))).filter("what = 'symbol'")
        return {"symbols": found.select(F.concat_ws(":", "path", "name").alias("id"), F.col("path").alias("file_path"), "name")}

    def push(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        apply_changes(events_stream(spark, src), store, extract, f"{tmp_path}/ck").awaitTermination()

    push([("a.py", False, "def one(): pass", 1), ("b.py", False, "def two(): pass", 1)])
    assert {r.name for r in store.read("symbols").collect()} == {"one", "two"}
    push([("a.py", False, "def uno(): pass", 2), ("a.py", False, "def eins(): pass", 3), ("b.py", True, None, 2)])
    assert {r.name for r in store.read("symbols").collect()} == {"eins"} and store.revision == 2


def test_debounce_and_versions(spark, tmp_path):
    t = datetime(2025, 1, 1)
    e = spark.createDataFrame([(1, t, 1, 5), (1, t + timedelta(milliseconds=300), 2, 4), (1, t + timedelta(seconds=5), 3, 6), (2, t, 4, 1)], "user_id long, ts timestamp, event_id long, v long")
    e.coalesce(1).write.parquet(f"{tmp_path}/e")
    got = run_to_table(debounced(events_stream(spark, f"{tmp_path}/e"), "user_id", "ts"), "complete").collect()
    assert sorted((r.user_id, r.events, r.last_event) for r in got) == [(1, 1, 3), (1, 2, 2), (2, 1, 4)]
    s = events_stream(spark, f"{tmp_path}/e").select(F.col("user_id").alias("doc"), F.col("v").alias("version"), F.col("event_id").alias("arrival"))
    got = run_to_table(accepted(s, "doc", "version"), "append").collect()
    assert sorted((r.doc, r.version, r.accepted) for r in got) == [(1, 4, False), (1, 5, True), (1, 6, True), (2, 1, True)]


def test_progress_counts():
    p = Progress(total=10)
    event = type("E", (), {"progress": type("P", (), {"numInputRows": 4, "batchDuration": 2000})})
    p.onQueryProgress(event)
    assert p.state() == {"rows": 4, "batches": 1, "percent": 40.0, "eta_seconds": 3.0, "failed": 0}


def test_commits_are_whole_and_a_batch_counts_once(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    d = spark.createDataFrame([("a", 1)], "id string, x int")
    assert store.revision == 0 and store.commit({"symbols": d}, "b1") == 1
    assert store.commit({"symbols": d.limit(0)}, "b1") == 1 and store.read("symbols").count() == 1
    assert store.commit({"symbols": d.union(d)}, "b2") == 2
    (tmp_path / "s" / ".next-3-x").write_text("{")  # a commit that died before its rename is not seen
    assert store.revision == 2 and store.read("symbols").count() == 2
    (tmp_path / "s" / "current-3.json").write_text('{"schema": 1, "revision": 3, "tables": {}}')
    store._pointer = lambda: {"schema": 1, "revision": 2, "tables": {}}  # a writer that has not seen revision 3
    with pytest.raises(OSError, match="another writer"):
        store.commit({"symbols": d})


def test_sinks(spark):
    from codeloom.sources import sinks

    old = {"symbols": spark.createDataFrame([("a",)], "id string"), "files": spark.createDataFrame([("p",)], "path string")}
    new, v = sinks.migrate(old)
    assert v == sinks.version_of(new) == 9 and sinks.version_of(old) == 0 and new["symbols"].first().source_type == "project"
    assert sinks.version_of(sinks.migrate(old, 4)[0]) == 4 and sinks.migrate(new)[0]["symbols"].columns == new["symbols"].columns
    with pytest.raises(ValueError, match="newer"):
        sinks.migrate(old, 99)
    edges = spark.createDataFrame([("x", "a", "f2", 1, 1, None), ("b", "x", "f2", 1, 1, "a"), ("b", "y", "f2", 2, 1, None)], "caller_id string, symbol_name string, referenced_in_file string, line int, column_num int, callee_id string")
    t = {"symbols": spark.createDataFrame([("a", "f1"), ("b", "f2")], "id string, file_path string"), "refs": spark.createDataFrame([("a", "n", "f2"), (None, "n", "f1"), (None, "n", "f2")], "symbol_id string, symbol_name string, referenced_in_file string"), "call_edges": edges, "metrics": spark.createDataFrame([("a", 1), ("b", 2)], "symbol_id string, n int")}
    left = {k: v.count() for k, v in sinks.cascade(t, spark.createDataFrame([("f1",), ("f1",)], "path string")).items()}
    assert left == {"symbols": 1, "refs": 1, "call_edges": 2, "metrics": 1}
    assert {k: v.count() for k, v in sinks.cascade(t, spark.createDataFrame([], "path string")).items()} == {k: v.count() for k, v in t.items()}
