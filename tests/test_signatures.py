import os

import pytest

from codeloom.sources.extract import QUERIES, extract
from codeloom.sources.signatures import parts

DATA = os.environ.get("CODELOOM_TESTDATA", "/root/testdata/sf0.01")
P = lambda name, kind=None, mut=False, own=False, many=False, default=None: (name, kind, mut, own, many, default)
CASES = [
    ("pub fn f<'a, T: Clone + Send, const N: usize>(&mut self, mut x: Vec<(u8, T)>, y: &mut [T; N]) -> Result<T, E> where T: X", "f", "rust", [("'a", [], None), ("T", ["Clone", "Send"], None), ("N", ["usize"], None)], [P("self", None, True, True), P("x", "Vec<(u8, T)>", True), P("y", "&mut [T; N]", True)], "Result<T, E>"),
    ("async def f(self, a: dict[str, int] = {}, /, *args: int, k=1, **kw) -> list[int]", "f", "python", None, [P("self", None, False, True), P("a", "dict[str, int]", default="{}"), P("args", "int", many=True), P("k", default="1"), P("kw", many=True)], "list[int]"),
    ("export function f<T extends A & B = C>(this: X, a?: number, ...r: T[]): Promise<Map<string, T>> {", "f", "typescript", [("T", ["A & B"], "C")], [P("this", "X", own=True), P("a", "number"), P("r", "T[]", many=True)], "Promise<Map<string, T>>"),
    ("public static <T extends A & B, U> Map<String, T> f(final List<? super T> a, int[] b, String... c) throws E", "f", "java", [("T", ["A", "B"], None), ("U", [], None)], [P("a", "List<? super T>"), P("b", "int[]"), P("c", "String", many=True)], "Map<String, T>"),
    ("public async Task<List<T>> F<T>(ref int x, params object[] y, string s = \"a,b\") where T : class", "F", "csharp", [("T", [], None)], [P("x", "int"), P("y", "object[]", many=True), P("s", "string", default='"a,b"')], "Task<List<T>>"),
    ("fun <T : Any> List<T>.f(vararg x: Int, g: (Int, String) -> Unit = { a, b -> }): Map<T, Int>? where T : X", "f", "kotlin", [("T", ["Any"], None)], [P("x", "Int", many=True), P("g", "(Int, String) -> Unit", default="{ a, b -> }")], "Map<T, Int>?"),
    ("func (s *T[K]) F[K comparable, V int | string](a, b int, c ...func(int) error) (x V, err error) {", "F", "go", [("K", ["comparable"], None), ("V", ["int", "string"], None)], [P("a", "int"), P("b", "int"), P("c", "func(int) error", many=True)], "(x V, err error)"),
    ("const std::map<int, T>& N::f(const std::string& a, int* p = nullptr, std::vector<int> v) const", "f", "cpp", None, [P("a", "const std::string&"), P("p", "int*", True, default="nullptr"), P("v", "std::vector<int>")], "const std::map<int, T>&"),
    ("function M.f(a, ...)", "f", "lua", None, [P("a"), P("...", many=True)], None),
    ("fn g()", "g", "rust", None, [], None),
    ("broken", "x", "java", None, None, None),
]


@pytest.mark.parametrize(("text", "name", "language", "generics", "params", "kind"), CASES)
def test_parts(text, name, language, generics, params, kind):
    assert parts(text, name, language) == (generics, params, kind)
    assert parts(text.replace(" ", "\n  "), name, language)[1] == params or '"' in text


def test_headers_and_documentation_of_whole_texts():
    rust = "/// Counts it.\n/// Twice.\n#[inline]\npub fn long(\n    a: u8,\n    b: [u8; 3],\n) -> u8\nwhere\n    u8: X,\n{\n}\n// no doc\nfn two() {}\n"
    got = {r[1]: r for r in extract(rust, "rust") if r[0] == "symbol" and r[2] == "function"}
    assert got["long"][6] == "pub fn long( a: u8, b: [u8; 3], ) -> u8 where u8: X," and got["long"][8] == "/// Counts it.\n/// Twice." and got["two"][8] is None
    assert len(max((r[6] for r in extract("fn f(" + "a: u8, " * 400 + ") {}", "rust") if r[0] == "symbol" and r[2] == "function"), key=len)) > 2500
    py = 'def f(a,  # first\n      b: int = 1):\n    """Adds."""\n\nclass A(B): x = 1\n'
    got = {r[1]: r for r in extract(py, "python") if r[0] == "symbol"}
    assert got["f"][6] == "def f(a, b: int = 1)" and got["f"][8] == "Adds." and got["A"][6] == "class A(B)"
    java = "/**\n * Stops.\n */\n@Override\npublic void stop(int a,\n    int b) {\n}\n"
    got = [r for r in extract(java, "java") if r[0] == "symbol" and r[1] == "stop"]
    assert got[0][6] == "public void stop(int a, int b)" and got[0][8] == "/**\n* Stops.\n*/"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")
def test_extraction_agrees_with_the_index(spark):
    for r in QUERIES["extract_agreement"](spark, DATA).filter("language is not null").collect():
        assert r.found >= 0.9 * r.symbols and r.same_params >= 0.9 * r.found and r.same_kind >= 0.9 * r.found and r.same_span >= 0.9 * r.found, r
