from pyspark.sql import functions as F

from codeloom.sources.files import file_meta, front_matter, ignore_pattern, sidecar_rows, walk, window

SIDE = "directory_tags: [service]\nfiles:\n  a.rs:\n    doc1: Checks users\n    tags: [auth, service]\n  b.rs: {}\n"


def test_walk_skips_hidden_ignored_and_unknown_files(spark, tmp_path):
    for name, text in {"src/a.rs": "fn a() {}", "src/b.py": "x = 1", "target/c.rs": "", ".git/d.rs": "", "src/.e.rs": "", "notes.txt": "", "src/gen_f.rs": "", "x/skip.rs": "1"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    got = {r.path: (r.language, r.body) for r in walk(spark, str(tmp_path), "# rules\ntarget/\ngen_*.rs\n/x/skip.rs\n!keep\n").collect()}
    assert got == {"src/a.rs": ("rust", "fn a() {}"), "src/b.py": ("python", "x = 1")}
    assert ignore_pattern("\n# none\n") is None


def test_sidecars_and_front_matter(spark):
    assert sidecar_rows("auth/.codeloom.yml", SIDE) == [("auth/a.rs", "Checks users", None, None, None, ["service", "auth"]), ("auth/b.rs", None, None, None, None, ["service"])]
    assert sidecar_rows(".codeloom.yml", ": :\n -") == [] and sidecar_rows("x", "") == []
    assert front_matter("// @codeloom\n// purpose: parse\n// owner: core\n\nfn a() {}", "rust") == {"purpose": "parse", "owner": "core"}
    assert front_matter("# purpose: x", "python") is None and front_matter("", None) is None
    d = spark.createDataFrame([("auth/.codeloom.yml", SIDE, None), ("auth/a.rs", "// @codeloom\n// owner: core\n", "rust"), ("c.py", "# @codeloom\n# owner: me\n", "python"), ("d.py", None, "python")], "path string, body string, language string")
    got = {r.path: (r.doc, r.owner, r.tags) for r in file_meta(d).collect()}
    assert got == {"auth/a.rs": ("Checks users", None, ["service", "auth"]), "auth/b.rs": (None, None, ["service"]), "c.py": (None, "me", [])}


def test_window(spark):
    d = spark.createDataFrame([("a\r\nb\nc",)], "t string")
    assert d.select(window(F.col("t"), 2, 9).alias("x")).first().x == "   2 | b\n   3 | c"
