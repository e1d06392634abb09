import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeloom.functions import lang
from codeloom.functions.text import cut_bytes, decode_cursor, encode_cursor, go_receiver, redact, section
from codeloom.operators import graph, incremental, lookup, search, stats, tags
from codeloom.sources.extract import extract, manifest, manifests, visibility, workspace_kind

SYMBOL = "id string, name string, kind string, file_path string, start_line int, end_line int, parent string, visibility string, signature string, doc_comment string, language string, start_column int, end_column int"


def symbol(i, name, kind="function", file="lib.rs", start=1, end=10, parent=None, vis=None):
    return (i, name, kind, file, start, end, parent, vis, f"fn {name}()", None, "rust", 0, 0)


def test_definitions_exclude_variables_and_respect_parents(spark):
    df = spark.createDataFrame([symbol("1", "process", "method", parent="p"), symbol("2", "process", "method", parent="h"), symbol("3", "process", "variable"), symbol("p", "Processor", "struct"), symbol("h", "Handler", "struct")], SYMBOL)
    assert {r.id for r in lookup.definitions(df, "process").collect()} == {"1", "2"}
    assert [r.id for r in lookup.definitions(df, "process", "Processor").collect()] == ["1"]
    assert lookup.definitions(df, "none").count() == 0


def test_members_position_and_formats(spark):
    df = spark.createDataFrame([symbol("t", "MyStruct", "struct", start=1, end=20), symbol("f", "field", "field", start=2, end=2, parent="t"), symbol("m", "run", "method", start=5, end=9), symbol("o", "out", "method", start=30, end=31)], SYMBOL)
    assert {r.id for r in lookup.members(df, "MyStruct").collect()} == {"f", "m"}
    assert lookup.at_position(df, "lib.rs", 6).first().id == "m"
    assert lookup.minimal(df.filter("id = 'm'")).first().text == "run:met@lib.rs:5"


def edges(spark):
    return spark.createDataFrame([("A", "caller_a", "callee", "a.rs", 5, 1), ("B", "caller_b", "caller_a", "b.rs", 6, 1), ("A", "caller_a", "caller_b", "a.rs", 7, 1)], "caller_id string, caller_name string, symbol_name string, referenced_in_file string, line int, column_num int")


def test_callers_go_up_by_depth_and_end_in_circles(spark):
    e = edges(spark)
    assert {r.symbol_name for r in graph.callers(e, "callee", 1).collect()} == {"callee"}
    assert {r.symbol_name for r in graph.callers(e, "callee", 2).collect()} == {"callee", "caller_a"}
    deep = graph.callers(e, "callee", 9).collect()
    assert len(deep) == 3 and graph.callers(e, "nothing", 3).count() == 0


def test_call_graph_has_defined_names_only(spark):
    df = spark.createDataFrame([symbol("A", "caller_a", file="a.rs"), symbol("B", "caller_b", file="b.rs")], SYMBOL)
    nodes, found = graph.call_graph(edges(spark), df, "caller_a", 3)
    assert {(r.name, r.depth) for r in nodes.collect()} == {("caller_a", 0), ("caller_b", 1)}
    assert {(r.caller_name, r.callee_name) for r in found.collect()} == {("caller_a", "caller_b"), ("caller_b", "caller_a")}


def test_dead_code(spark):
    df = spark.createDataFrame([symbol("1", "orphan"), symbol("2", "used"), symbol("3", "main"), symbol("4", "test_x"), symbol("5", "open", vis="public"), symbol("6", "Lone", "struct")], SYMBOL)
    r = spark.createDataFrame([("used", "call"), ("orphan", "type_use")], "symbol_name string, reference_kind string")
    assert [x.id for x in stats.dead_functions(df, r).collect()] == ["1"]
    assert [x.id for x in stats.dead_types(df, r).collect()] == ["6"]


@pytest.mark.parametrize(("sig", "n"), [("f(a: M<K, V>, b: U)", 2), ("f(a, (b, c), d)", 3), ("f(a) -> (A, B)", 1), ("f()", 0), ("f", 0), ("f( )", 0)])
def test_parameter_count(spark, sig, n):
    assert spark.createDataFrame([(sig,)], "s string").select(stats.parameter_count(F.col("s")).alias("n")).first().n == n


def test_bm25_needs_all_tokens_and_blank_finds_nothing(spark):
    df = spark.createDataFrame([("1", "MyFunction test"), ("2", "test_helper"), ("3", "other"), ("4", None)], "id string, t string")
    assert search.bm25(df, "id", ["t"], "").count() == 0
    assert [r.id for r in search.bm25(df, "id", ["t"], "myfunction").collect()] == ["1"]
    assert {r.id for r in search.bm25(df, "id", ["t"], "te").collect()} == {"1", "2"}
    assert all(r.score > 0 for r in search.bm25(df, "id", ["t"], "test").collect())
    assert [r.id for r in search.bm25(df, "id", ["t"], "test hel*").collect()] == ["2"]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcdefgr_x", max_size=12), st.text(alphabet="abcdefgr_x", max_size=12))
def test_jaro_winkler_equals_the_oracle(a, b):
    want = duckdb.execute("SELECT jaro_winkler_similarity(?, ?)", [a, b]).fetchone()[0]
    if a and b:
        assert abs(search.jaro_winkler(a, b) - want) < 1e-9


def test_keyset_pages_cover_all_rows_once(spark):
    rows = [(f"i{k}", 1.0 if k % 3 else 0.5, "fn", "f", k % 2) for k in range(23)]
    df = spark.createDataFrame(rows, "id string, score double, kind string, file_path string, start_line int")
    seen, after = [], None
    while page := search.keyset_page(df, 5, after).collect():
        seen += [r.id for r in page]
        last = page[-1]
        after = (last.score, last.kind, last.file_path, last.start_line, last.id)
    assert sorted(seen) == sorted(r[0] for r in rows) and len(seen) == 23
    assert [r.id for r in search.offset_page(df, 5, 5).collect()] == seen[5:10]


@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.text(max_size=5), st.integers() | st.text(max_size=8), max_size=4))
def test_cursor_round_trip(fields):
    assert decode_cursor(encode_cursor(fields)) == fields


def test_globs_and_tag_rules(spark):
    p = spark.createDataFrame([("a/b/auth.rs",), ("a/x.py",)], "file_path string")
    got = tags.apply_rules(p, [("**/auth*", "domain:auth", 0.5), ("**/*.rs", "domain:auth", 0.5), ("[", "x:y", 1.0), ("**", "z:z", 0.0)]).collect()
    assert [(r.file_path, r.tag, r.pattern) for r in got] == [("a/b/auth.rs", "domain:auth", "**/auth*")]
    t = spark.createDataFrame([("f", "domain", "auth"), ("f", "x", "service"), ("g", "domain", "auth")], "file_path string, category string, tag string")
    assert [r.file_path for r in tags.with_all_tags(t, [("domain", "auth"), (None, "service")]).collect()] == ["f"]


def test_text_functions(spark):
    d = spark.createDataFrame([(1, "# A\n\nx\n## Install it\nrun\n\n### more\ny\n## B\nz")], "k int, t string")
    assert section(d, "k", "t", "install").first().body == "run\n\n### more\ny"
    one = lambda text, f: spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first().x
    assert one("äöü" * 10, lambda c: cut_bytes(c, 10)) == "äöü..." and one("abc", lambda c: cut_bytes(c, 3)) == "abc" and one("abcd", lambda c: cut_bytes(c, 2)) == "..."
    assert one("x gh" + "p_" + "7" * 36 + " y", redact) == "x [REDACTED] y"
    assert one("func (s *Tree) Walk()", go_receiver) == "Tree" and one("func Walk()", go_receiver) is None
    assert one(" C# ", lambda c: lang.language(c)) == "csharp" and one("MET ", lang.kind) == "method"


def test_precheck(spark):
    s = "path string, content_hash string, last_size long, last_mtime_ns long"
    cur = spark.createDataFrame([("same", "h", 1, 1), ("touch", "h", 1, 2), ("edit", "i", 2, 2), ("new", "h", 1, 1), ("nohash", "h", 2, 2)], s)
    old = spark.createDataFrame([("same", "h", 1, 1), ("touch", "h", 1, 1), ("edit", "h", 1, 1), ("gone", "h", 1, 1), ("nohash", None, 1, 1)], s)
    assert {r.path: r.status for r in incremental.precheck(cur, old).collect()} == {"same": "unchanged", "touch": "metadata_refresh", "edit": "changed", "new": "new", "gone": "stale", "nohash": "changed"}


RUST = """use std::io;\npub struct Repo { x: u8 }\nimpl Repo {\n    pub fn find(&self, id: u32) -> Option<User> {\n        helper(id); // call() in a comment\n        None\n    }\n}\nfn helper(id: u32) {}\n"""
PY = "import os\nfrom a import b\nclass Repo(Base):\n    def find(self, i):\n        return helper(i)\n\ndef _hidden():\n    pass\nLIMIT = 3\n"


def test_extraction(spark):
    r = extract(RUST, "rust")
    got = {(x[0], x[1], x[2]) for x in r}
    assert {("symbol", "Repo", "struct"), ("symbol", "find", "method"), ("symbol", "helper", "function"), ("reference", "helper", "call"), ("import", "std::io", "module")} <= got
    assert ("reference", "call", "call") not in got and next(x for x in r if x[1] == "find")[3:5] == (4, 7)
    p = {(x[0], x[1], x[2], x[7]) for x in extract(PY, "python")}
    assert {("symbol", "find", "method", "Repo"), ("symbol", "_hidden", "function", None), ("symbol", "LIMIT", "constant", None), ("reference", "Base", "extend", "Repo"), ("reference", "helper", "call", "find"), ("import", "a.b", "symbol", None)} <= p
    assert extract("def (", "python") == [] and extract("x", None) == [] and extract("", "rust") == []
    assert visibility("rust", "pub(crate) fn x", "x") == "internal" and visibility("go", "func X", "X") == "public"


def test_manifests(spark):
    cargo = '[package]\nname = "a"\nversion = "1"\n[dependencies]\nx = "1"\ny = { path = "z" }\n[dev-dependencies]\nt = "2"\n'
    assert manifest("Cargo.toml", cargo) == [("a", "1", "cargo", "x", "1", False), ("a", "1", "cargo", "y", "*", False), ("a", "1", "cargo", "t", "2", True)]
    assert manifest("package.json", "{bad") == [] and manifest("Cargo.toml", "[dependencies]") == []
    assert manifest("go.mod", "module m\nrequire example.com/x v1.2.0\n") == [("m", None, "go", "example.com/x", "v1.2.0", False)]
    d = spark.createDataFrame([("p/package.json", '{"name": "n", "devDependencies": {"j": "3"}}'), ("x", None)], "path string, body string")
    assert [(r.dependency, r.is_dev) for r in manifests(d).collect()] == [("j", True)]
    assert workspace_kind(["package.json"], {"package.json": '{"workspaces": []}'}) == "npm" and workspace_kind([], {}) == "single"


def test_hunks_and_status(spark):
    d = spark.createDataFrame([("a", "@@ -1,2 +3,2 @@ x"), ("b", "@@ -1 +7 @@"), ("c", "@@ -1,2 +3,0 @@"), ("d", "junk")], "k string, h string")
    assert sorted((r.k, r.line) for r in incremental.hunk_lines(d, "k", "h").collect()) == [("a", 3), ("a", 4), ("b", 7)]
