import ast

import pytest
from pyspark.sql import functions as F

from codeloom.llm.parsing import parse, parsed

VALID = {
    "rust": ["use std::collections::HashMap;\n\npub struct A<T: Clone> { x: Vec<Vec<u8>>, pub(crate) y: &'static str }\nimpl<T> A<T> where T: Clone {\n  pub fn f(&self, n: i64) -> Option<Vec<u8>> {\n    let mut v: Vec<i64> = (0..n).map(|x| x * 2).collect();\n    if n > 3 && !v.is_empty() { return None; }\n    match n { 0 => {}, 1..=5 => println!(\"{}\", n), _ => (), }\n    for _ in 0..36 { v.push(1); }\n    let c = 'a'; let s = r#\"x\"y\"#;\n    Some(vec![1u8, 2])\n  }\n}\n#[test]\nfn t() { assert_eq!(1, 1); }\n"],
    "java": ["package a.b;\nimport java.util.*;\npublic class X<T extends Y> implements Z {\n  private final Map<String, List<int[]>> m = new HashMap<>();\n  @Override public long f(final long a, String... b) throws E {\n    for (String s : b) { x(s); }\n    int[] q = {1, 2};\n    long r = a > 3 ? (long) a : -1;\n    r += 1; r++;\n    do { r--; } while (r > 0);\n    Runnable k = () -> { g(); };\n    switch (1) { case 1: break; default: return 2; }\n    return r << 2;\n  }\n}\n"],
    "kotlin": ["package a.b\n\nimport c.D\n\ndata class P(val a: Int, var b: String? = null) : Q(), R {\n  override fun f(x: Long): Long {\n    var s = x - 9\n    for (i in 0 until 13) {\n      s += 5\n    }\n    val l = listOf(1, 2).map { it * 2 }\n      .filter { x -> x > 1 }\n    val y = if (s > 1) \"a\" else \"b\"\n    return l!!.size.toLong() ?: 0\n  }\n  companion object { const val Z = 1 }\n}\n"],
    "go": ["package a\n\nimport (\n\t\"fmt\"\n\tx \"y/z\"\n)\n\ntype T struct {\n\ta, b int\n\tm map[string][]int\n}\n\nfunc (t *T) F(a int64, b ...string) (int64, error) {\n\tx := a - 9\n\tfor i := 0; i < 3; i++ {\n\t\tx += 9\n\t}\n\tif err := g(); err != nil {\n\t\treturn 0, err\n\t}\n\tgo func() { ch <- 1 }()\n\tv := []int{1, 2}\n\t_ = v[1:]\n\tswitch x {\n\tcase 1:\n\tdefault:\n\t}\n\treturn x, nil\n}\n"],
    "cpp": ["#include <iostream>\nnamespace n {\ntemplate <typename T> class A : public B<T> {\npublic:\n  A() : x(1), y{2} {}\n  virtual long f(const std::string& s, int* p = nullptr) const override {\n    std::cerr << \"a\" \"b\" << std::endl;\n    for (auto& q : v) { *p = (int) q; }\n    auto l = [=](int z) -> int { return z; };\n    return x ? 1 : -2;\n  }\nprivate:\n  std::vector<std::vector<int>> v;\n};\n} // n\n"],
    "csharp": ["using System;\n\nnamespace A.B\n{\n[Serializable]\npublic class X : Y, IZ\n{\n    public string Name { get; set; } = \"a\";\n    public async Task<List<int>> F(long a, string b = null)\n    {\n        var x = new Dictionary<string, int> { { \"a\", 1 } };\n        foreach (var q in x) { Console.WriteLine($\"{q}\"); }\n        return a > 1 ? await G() : null;\n    }\n}\n}\n"],
    "typescript": ["import { a as b } from \"./x\";\nimport type T from 'y';\n\nexport class X<T extends Y> implements Z {\n  private readonly m: Map<string, number[]> = new Map();\n  async f(a: number, b?: string): Promise<number> {\n    const r = /a[/]b/g.test(b ?? \"\");\n    let { x, ...y } = a as any\n    for (let i = 0; i < 3; i++) {\n      x += `t${i}`;\n    }\n    return a!.b?.c ?? 1;\n  }\n}\nexport const g = async (x: number) => x * 2;\n", "[\n{\"id\": 1, \"k\": \"a\"},\n{\"id\": 2}\n]\n", "!function(d){if(d>43)return!1;q(d-1)}(43);(()=>{var e={1:(a,b)=>{b.m=void 0;for(;a.n<4;)a.n++}};t(1)})();"],
    "python": ["import os\nfrom a import (b,\n    c)\n\nclass X(Y, metaclass=Z):\n    \"\"\"Doc.\"\"\"\n\n    @p.q\n    async def f(self, a: int = 1, *b, **c) -> int:\n        x = [i for i in a if i not in b]\n        if x is not None and not a:\n            return lambda y: y\n        else: pass\n        print(f\"{x!r}\", end='')\n        with open(a) as g, h:\n            d[1:2, ::3] = {**c, 'k': 1}\n        return x if a else -1\n"],
    "lua": ["local M = {}\n\n--[[ block ]]\nfunction M.f(a, b, ...)\n  local x = a - 9\n  for i = 1, 3 do\n    x = x + #b\n  end\n  if x > 1 then return x elseif x == 2 then x = {1, k = 2; [3] = 4} else print \"a\" end\n  while true do break end\n  repeat x = x - 1 until x < 0\n  local t = setmetatable({}, { __index = function(s, k) return k end })\n  t:go(1)(2)\n  return x\nend\n\nreturn M\n"],
}
BROKEN = [
    ("typo quotes", lambda t, _: t.replace('"', "“")), ("conflict", lambda t, _: t.replace("\n", "\n<<<<<<< HEAD\n", 3)), ("noise", lambda t, _: t[: len(t) // 2] + "\n\x01\x7f�~K\n" + t[len(t) // 2 :]),
]


@pytest.mark.parametrize(("language", "text"), [(k, t) for k, ts in VALID.items() for t in ts])
def test_valid_texts_in_all_line_ends(language, text):
    for t in (text, "﻿" + text.replace("\n", "\r\n"), text.replace("\n", "\r") if language != "cpp" else text, text + "\n\n"):
        assert parse(t, language) is None


@pytest.mark.parametrize(("language", "text"), [(k, ts[0]) for k, ts in VALID.items()])
def test_broken_texts(language, text):
    for name, breaker in BROKEN:
        if name == "typo quotes" and '"' not in text or name == "conflict" and language == "python" and "\n" not in text:
            continue
        assert parse(breaker(text, language), language) is not None, name
    for k in range(len(text) // 3, len(text) // 3 + 40, 7):  # cut off within a block
        cut = text[:k]
        if language == "python":
            try:
                ast.parse(cut)
                ok = True
            except SyntaxError:
                ok = False
            assert (parse(cut, language) is None) == ok
        else:
            assert parse(cut, language) is not None
    for other in VALID:
        if other != language:
            assert parse(VALID[other][0], language) is not None, other


def test_conflict_marks_in_comments_are_fine():
    assert parse("fn a() {}\n/*\n<<<<<<< ours\n=======\n>>>>>>> theirs\n*/\n", "rust") is None
    assert parse('S = """\n<<<<<<< ours\n"""\n', "python") is None


def test_table(spark):
    s = spark.createDataFrame([("a.rs", "fn f( {}"), ("a.rs", "fn f( {}"), ("b.txt", "def f(:\n"), ("c.rs", None), ("d.rs", ""), ("e.rs", " \n"), ("f.xyz", "((("), (None, "x"), ("g.rs", "fn f() {}")], "path string, body string").withColumn("language", F.lit("java"))
    f = spark.createDataFrame([("b.txt", " PY ", 7, 1), ("b.txt", None, 7, 2), ("g.rs", None, None, 1), ("h.rs", "rust", 1, 1)], "path string, language string, project_id long, indexed_at int")
    got = {(r.path, r.language, r.project_id, r.error is None) for r in parsed(s, f).collect()}
    assert got == {("a.rs", "rust", None, False), ("b.txt", "python", 7, False), ("g.rs", "rust", None, True)}
    assert parsed(s.limit(0), f.limit(0)).count() == 0


def test_long_text():
    assert parse("x = 1\n" * 50_000, "python") is None and parse("(" * 50_000, "rust") is not None
