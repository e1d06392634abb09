import pytest
from pyspark.sql import functions as F

from codeloom.llm.docpairs import attach, documented, is_trivial, source_spans, symbol_pairs

TRIVIAL = ["", "///", "/** TODO: write docs */", "// FIXME later", "/**\n * @param depth\n * @return\n */", "/** {@inheritDoc} */", "See above.", "siehe oben", "同上", "# noqa: E501", "// eslint-disable-next-line no-shadow", "-----", "return total + 4;", "x = y + 1", "Copyright 2025 Harrow", "Walks the tree nodes.", "walk_tree_node()", "Function to walk the tree node.", "n/a", "Auto-generated method stub", "<summary>\nTODO\n</summary>", '"""Placeholder."""', "...", "@deprecated", "#region helpers", "/** @see A.b */"]
REAL = ["Safe to call twice.", "/** Sorted by path, newest first. */", "Walks the tree node, at most 4 rows at a time.", "最多写入13行，然后正常结束，不会报错。", "TODO\nReturns zero if nothing is left.", "/// @internal\n/// Запись завершается без ошибки.", "Panics on an odd count.", "Gibt die Zahl zurück.\r\n@return"]


@pytest.mark.parametrize(("doc", "want"), [(d, True) for d in [*TRIVIAL, None]] + [(d, False) for d in REAL])
def test_trivial(spark, doc, want):
    d = spark.createDataFrame([(doc, "walk_tree_node")], "d string, n string")
    assert d.select(is_trivial(F.col("d"), F.col("n")).alias("x")).first().x is want


def test_symbols_states_nulls_and_ties(spark):
    rows = [("a", 1, " MET ", "walk", "fn walk()", "Stops at the end."), ("a", 2, "fn", "walk", "fn walk()", None), ("b", 1, "Method", "w", "fn w()", "Stops at the end."), ("b", 1, "Method", "w", "fn w()", "Stops at the end."), ("c", 1, "class", "C", "class C", "A real text here."), ("d", 1, "fn", "d", " ", "A real text here."), ("e", None, "fn", None, "fn e()", "A real text here."), (None, 1, "fn", "x", "fn x()", "A real text."), ("f", 1, None, "x", "fn x()", "A real text.")]
    s = spark.createDataFrame(rows, "id string, indexed_at int, kind string, name string, signature string, doc_comment string").withColumn("role", F.lit(1))
    s = s.withColumn("file_path", F.lit("no/text.rs")).withColumn("start_line", F.lit(3))
    none = spark.createDataFrame([], "path string, body string"), spark.createDataFrame([], "path string, language string, project_id long, indexed_at int")
    assert sorted(r.holder for r in symbol_pairs(s, *none).collect()) == ["b", "e"]
    assert symbol_pairs(s.limit(0), *none).count() == 0


def test_symbols_are_anchored_to_the_spans_of_their_texts(spark):
    rust = "/// Stops at the end of it.\nfn near() {}\n/// Begins at the other end.\nlet x = 1;\nfn parted() {}\n\n// Keeps what is left over.\n\n#[test]\nfn far() {}\nfn bare() {}\n"
    at = {"near": 2, "parted": 5, "far": 10, "bare": 11}
    docs = {"near": "Stops at the end of it.", "parted": "/// Begins at the other end.", "far": "// Keeps  what is left over.", "bare": "Is nowhere in this text."}
    rows = [(f"{k}{i}", n, docs[n], p, at[n] + off) for i, (k, p, off) in enumerate([("ok_", ".\\a.rs", 0), ("off_", "a.rs", 40), ("cut_", "b.rs", 0), ("dep_", None, 0)]) for n in at]
    s = spark.createDataFrame([(a + "_" + n, n, d, p, line) for a, n, d, p, line in rows], "id string, name string, doc_comment string, file_path string, start_line int").withColumn("kind", F.lit("fn")).withColumn("signature", F.lit("fn x()")).withColumn("indexed_at", F.lit(1))
    sources = spark.createDataFrame([("a.rs", rust.replace("let x = 1;", "use x;")), ("b.rs", rust + "fn open( {")], "path string, body string")
    files = spark.createDataFrame([("a.rs", "rust", 1, 1)], "path string, language string, project_id long, indexed_at int")
    got = {r.holder for r in symbol_pairs(s, sources, files).collect()}
    assert {r.id for r in s.select("id").collect()} - got == {"ok_0_parted"}  # only here a statement lies between, in a text that parses


def test_as_of_join_rejects_intervening_statements(spark):
    rows = [("f", "comment", 1.0, 2.0, None, None, "far"), ("f", "statement", 3.0, 3.0, None, None, None), ("f", "function", 4.0, 4.0, "a", "function", "fn a()"), ("f", "comment", 5.0, 5.0, None, None, "first"), ("f", "comment", 7.0, 8.0, None, None, "near"), ("f", "function", 9.0, 10.0, "b", "function", "fn b()"), ("f", "inner", 11.0, 11.0, None, None, "inside"), ("g", "function", 9.0, 9.0, "c", "function", "fn c()"), ("g", "statement", 10.0, 10.0, None, None, None), ("g", "inner", 11.0, 11.0, None, None, "late")]
    d = spark.createDataFrame(rows, "holder string, role string, pos double, end double, name string, kind string, text string")
    assert {r.name: r.doc for r in attach(d).collect()} == {"a": None, "b": "inside", "c": None}
    assert {r.name for r in attach(d).filter("rejected").collect()} >= {"a"}
    assert {r.name: r.doc for r in attach(d.filter("role <> 'inner'")).collect()}["b"] == "near"


def test_pairs_from_source_texts(spark):
    rust = "/// Counts what is left over.\n#[inline]\npub fn left(a: i64) -> i64 {\n    // inside\n    a\n}\n\n/// Belongs to nothing.\nlet x = 1;\nfn bare() {}\n// Two lines\n// that go on here.\nfn two() {}\nfn three() {} // Behind the code.\nfn four() {}\n"
    py = 'def f(a,\n      b):\n    """Adds both and gives the sum."""\n    return a\n\n# Tells the time of day.\ndef g():\n    x = 1\n    """No doc string."""\n'
    s = spark.createDataFrame([("a.rs", rust), ("a.rs", rust), ("b.py", py.replace("\n", "\r\n")), ("c.py", None), ("d.rs", "")], "path string, body string")
    f = spark.createDataFrame([("b.py", "Python")], "path string, language string")
    got = {(r.holder, r.name, r.kind) for r in documented(attach(source_spans(s, f))).collect()}
    assert got == {("a.rs", "left", "function"), ("a.rs", "two", "function"), ("b.py", "f", "function"), ("b.py", "g", "function")}
