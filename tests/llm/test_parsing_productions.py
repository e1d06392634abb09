"""Texts that break a production, and texts that use rarer ones."""

import ast
import pathlib
import sysconfig

import pytest

from codeloom.llm.glr import Parser, Tables
from codeloom.llm.parsing import parse

INVALID = {
    "python": ["try:\n    x\n", "def f(x, /\n", "class :\n    pass\n", "if x\n    y\n", "for in x:\n    pass\n", "x = = 1\n", "return return\n", "def f():\nx\n", "a b\n", "1 = x\n", "f() = 1\n", "import\n", "from x import\n", "lambda x y: 1\n", "x = (1,\n", "else:\n    pass\n", "while:\n    pass\n", "def f(a b): pass\n", "@x\ny = 1\n", "x +\n", "del\n", "raise from x\n", "async x\n", "    x = 1\n", "a = 09x\n", "print 'a'\n", "with x as: pass\n", "except: pass\n", "global\n", "x[1:2:3:4]\n", "{1: 2, 3}\n"],
    "java": ["class A { void f() { else { } } }", "fn main() { let x = 3; }", "class A { void f() { x + 1; } }", "class { }", "class A { int; }", "class A { void f( { } }", "class A { void f() { int x = ; } }", "class A { void f() { for (;) { } } }", "class A { void f() { if x { } } }", "class A { void f() { return 1 } }", "class A { void f() { try { } } }", "class A extends { }", "import ;", "package a", "class A { void f() { new ; } }", "class A { void f() { case 1: } }", "class A { f(); }", "class A { void f() { a b c; } }", "class A { void f() { x = 1 2; } }", "class A { public public }", "def f(): pass"],
    "rust": ["impl for X { }", "fn f { }", "fn f() -> { }", "struct ;", "fn f() { let = 3; }", "fn f() { let x 3; }", "fn f() { if { } }", "fn f() { match x { 1 = 2 } }", "fn f(x) { }", "use a::;", "fn f() { x + ; }", "fn f() { for x { } }", "enum { A }", "trait T { fn }", "fn f() { else { } }", "mod { }", "fn f() { a b }", "let x = 1;", "pub x;", "fn f() { x..=; ) }", "class A { }", "fn f<T { }"],
    "go": ["package a\nfunc () f {}\n", "func f() {}\n", "package a\nfunc f( {}\n", "package a\nfunc f() { if { } }\n", "package a\nfunc f() { x := }\n", "package a\nfunc f() { a b c }\n", "package a\nvar\n", "package a\nimport x\n", "package a\nx := 1\n", "package a\nfunc f() { else { } }\n", "package a\ntype T\n", "package a\nfunc f() { for i := 0; i < 3 { } }\n", "package a\nfunc f() { return 1 2 }\n", "package a\nfunc f() { switch { x } }\n", "package a\nfunc f() int string { }\n", "package a\nfunc f()\n{\n}\n"],
    "typescript": ["function f( { }", "const x = ;", "class { }; class A { f( }", "if (x { }", "for (;;", "let x: = 3;", "import from 'x';", "export { a", "a b", "x = 1 2;", "class A extends { }", "interface A { x: }", "switch (x) { foo }", "else { }", "try { }", "let x y;", "return ) ;", "type X = ;", "fn main() { let mut x = 1; }", "enum { A }", "def f():\n  pass", "package a.b;\nimport java.util.List;"],
    "kotlin": ["fun { }", "fun f( { }", "val = 3", "fun f() { val x = }", "class { }", "fun f() { if { } }", "fun f() { else { } }", "fun f() { for (x) { } }", "fun f(): { }", "fun f() { when (x) { 1 2 } }", "fun f() { a b }", "fun f(x) { }", "fun f() { try { } }", "fun f() { return return ) }", "int f() { }", "fun f() { x = 1 2 }", "def f(): pass"],
    "cpp": ["int f( { }", "int f() { else { } }", "class A { int x }", "int f() { return 1 }", "int x = ;", "int f() { if { } }", "int f() { for (;) { } }", "template <class T", "namespace { ", "int f() { case 1: x }", "int f() { a b c; }", "struct A { void f( };", "int f() { x = 1 2; }", "def f(): pass", "int f() { try { } }", "using ;", "enum { A B };"],
    "csharp": ["class { }", "class A { int }", "class A { void f( { } }", "class A { void f() { else { } } }", "class A { void f() { int x = ; } }", "class A { void f() { if { } } }", "class A { void f() { return 1 } }", "using ;", "namespace { }", "class A { void f() { try { } } }", "class A { void f() { a b c; } }", "class A { void f() { x = 1 2; } }", "def f(): pass", "class A : { }", "class A { int X { get; } } }", "fn f() -> i64 { }", "#include <string>\nclass A { public: void f(std::string& s) { s->x(); } };"],
    "lua": ["if then end", "local", "function end", "for i = 1 do end", "x", "x = ", "local x = 1 2", "if x then", "return 1\nx = 2", "while do end", "repeat x()", "function f( end", "f() = 1", "local function end", "else end", "a.b", "x + 1", "goto", "for x do end"],
}
VALID = {
    "python": ["def f(x, /, *, y=1): pass\n", "x = 1.5e-9 + 1.0j + 1_000 + .5 + 0xFF\n", "match x:\n    case [1, *r] if r: pass\n    case {'a': b, **c} | P(x=1): pass\n    case _:\n        match = 3\n", "async def f():\n    async with a as b, c: pass\n    async for x in y: await z\n", "with (open(a) as b, c as d,): pass\n", "x = [i for i in y if i for j in z]\n", "def f[T: int, *A, **P](x: T) -> T: ...\n", "type X[T] = list[T]\n", "try: x\nexcept* (A, B) as e: pass\nelse: pass\nfinally: pass\n", "print(f'{a['b']!r:>{w}}', *a, **b, c=1)\n", "if (n := f()) > 3: pass\nelif a: b; c\n", "lambda *a, k=1, **b: (yield)\n", "a = b = c, *d = e\nx: int = 3\nx @= y\n", "a = x if y else z\ndel a[1:2, ::3], b.c\n", "class A(B, metaclass=C):\n\t'doc'\n\tx = 1\n", "a = b \\\n    + c\nnot a is not b\nx[...] = ()\n", "@a.b(c)[1]\ndef f() -> 'x': return\n"],
    "java": ["sealed interface S permits A, B {} record P(int x, List<String>... y) { P { } }", "class A<T extends B & C> { <X> A(X x) { this.<X>f(x); super.g(); } static { } int[] a[] = {{1}, {}}; }", "class A { int f(Object o) { return switch (o) { case Integer i when i > 3 -> i; case P(int x, var y) -> { yield x; } default -> throw new E(); }; } }", "class A { void f() { Runnable r = () -> {}; g(A::new, int[]::new, (a, b) -> a + b, (final int x) -> x); for (int i = 0, j = 1; i < j; i++, j--) ; l: while (true) continue l; } }", "@interface X { int a() default 1; @Y({1, 2}) String[] b(); }", "enum E implements I { A(1) { void f() {} }, @D B; int x; }", "class A { void f() throws E { try (var x = y; z) { } catch (A | B e) { } finally { } synchronized (this) { } assert x : y; long q = (long) a >>> 3 & ~b; int.class.f(); } }", "void x;" and "class A { List<? super Map<String, int[]>> m = new HashMap<>() {{ put(1, 2); }}; boolean b = a instanceof String s && !s.isEmpty(); }"],
    "rust": ["impl<'a, T: ?Sized + 'a> X<'a, T> where for<'b> &'b T: Y<Item = u8> { const A: usize = 1; type B = Self; fn f(self: Box<Self>) {} }", "fn f() { let Some(x) = y else { return }; if let A { b, .. } | C(1..=3) = z && w {} let c = |a, &b: &u8| -> u8 { a as u8 }; x?.await.0.1; a[1..]; ..; v![1; 2]; }", "macro_rules! m { ($x:expr) => { $x + 1 }; }", "#[cfg(test)] mod t { use super::*; pub(in a::b) struct S(pub u8, ()); }", "pub const unsafe extern \"C\" fn f<const N: usize>(x: [u8; N], ...) -> impl Fn(u8) -> bool + 'static { move || true }", "fn f() { 'a: loop { break 'a match x { 0 | 1 if y => 2, b @ 3.. => { } _ => unsafe { *p } }; } a::<u8>::b(<T as X>::y); &mut *x; -1i32; r#\"a\"#; S { x: 1, ..y }; }", "trait A: B + Send { fn f(&self) -> Self where Self: Sized; async fn g(); }\nuse a::{self, b::*, c as _};\nextern crate x;"],
    "go": ["package a\nimport (\n\t_ \"x\"\n\t. \"y\"\n)\nconst (\n\tA = iota\n\tB\n)\ntype T[K comparable, V ~int | string] struct {\n\tX, Y int `json:\"x\"`\n\t*B\n\tC[K]\n}\n", "package a\nfunc (t *T[K]) F(a, b int, c ...func(int) error) (x int, err error) {\n\tfor i := range 10 {\n\t\tdefer func() { recover() }()\n\t}\n\tswitch v := x.(type) {\n\tcase int, *T:\n\tdefault:\n\t}\n\tselect {\n\tcase <-c:\n\tcase c <- 1:\n\t}\n\tL: for { break L }\n\treturn map[string][]T{\"a\": {{1, 2}}}[k], nil\n}\n", "package a; func f() { if x := g(); x != nil && y[1:2:3] != T{1}.X { goto E }; E: ; var ch chan<- int; ch <- <-d; x, y = y, x; z &^= 1; i++ }\n"],
    "typescript": ["abstract class A<T = {}> extends B<T>(x) implements C, D { static #p = 1; readonly [k: string]: any; declare x?: T; constructor(private y: number, ...z) { super(); } get a(): T { return 1 } set a(v) {} static { } async *g() {} abstract f(): void; [Symbol.iterator]!: X }", "type X<T> = T extends (infer U)[] ? U : { readonly [K in keyof T as `a${K}`]?: T[K] } | [a: string, b?: number, ...c: any[]] | typeof x.y | new () => void | asserts;", "const f = async <T,>(x: T): Promise<T> => { await x; }, g = x => ({ a, 'b': 1, [c]: 2, ...d, async *e() {}, get h() { return 1 } })\nlet { a: { b = 1 }, ...r } = c, [, d] = e\nfor (const [k, v] of m) {}\nfor (let i in o) ;\nx?.y?.[1]?.(z) ?? w!.v as const\nlabel: do { continue label } while (1)\n", "export default function () {}\nexport * as n from 'x'\nimport type { A, type B as C } from './y'\nimport D, * as E from 'z'\nexport = F\ndeclare module 'q' { export const r: number }\nnamespace A.B { }\nfunction isX(this: Y, x): x is Z;\n", "if (a) b\nelse c\nvar r = /[/]\\/(x)/g.test(s) ? `a${`b`}` : a < b && c > d\nx = function* () { yield* y }\nnew X\nnew a.B<C>(d)\nthrow e\n", "enum A { B = 1 << 2, 'c' }\nconst enum D {}\n@dec() class E { @inp() x = 1; f = () => 1\n g = 2 }\nswitch (x) { case 1: default: y() }\ntry { } catch { } finally { }\n"],
    "kotlin": ["@file:JvmName(\"x\")\npackage a.b\n\nimport c.*\nimport d as e\n\nsealed class A<out T : Any>(val x: Int = 1, private vararg y: String) : B<T>(x), C by z where T : D {\n  constructor() : this(1)\n  init { }\n  companion object { const val Q = 1 }\n  enum class E(val v: Int) { F(1) { override fun g() = 1 }, G(2); abstract fun g(): Int }\n  var p: String by lazy { \"a\" }\n    private set\n  val q get() = 1\n}\n", "fun <T> List<T>.f(g: (Int, s: String) -> Unit, h: suspend T.() -> T? = { null }): Map<String, *> =\n  map { (a, b) -> a + b }\n    .filter { it !in c && it is D }\n    ?.let(::x) ?: run { return@f emptyMap() }\n", "fun main() {\n  val (a, b) = c to d\n  when (val x = y()) {\n    1, 2 -> z()\n    in 3..4 -> { }\n    !is E -> throw F()\n    else -> if (g) h else i\n  }\n  loop@ for (j in 0 until 10 step 2) { if (k) continue@loop }\n  do { l++ } while (l < 3)\n  val m = try { n } catch (e: Exception) { null } finally { }\n  val o = object : P(), Q { override val r = 1 }\n  s[1] += t!!.u as? V ?: w\n  if (a) b\n  else c\n}\n", "interface I { fun f(); val x: Int }\nfun interface J { fun g(): Int }\nobject K : I\ntypealias L = (M) -> N\ndata class O(val a: Int)\nvalue class P(val s: String)\n"],
    "cpp": ["#include <a>\ntemplate <typename T, int N = 3, class... A> class X : public virtual B<T>, C { public: X(int a) : b(a), c{1} { } ~X() = default; virtual void f() const noexcept override = 0; X& operator=(const X&) = delete; operator bool() const; static constexpr int d = 1; int e : 3; friend class G; template <class U> void h(U&& u, A&&... a) { i(std::forward<A>(a)...); } };", "int main(int argc, char** argv) { auto f = [&, x = 1](auto&& y) mutable -> int { return y; }; std::vector<std::pair<int, std::map<int, int>>> v{{1, {}}}; for (const auto& [k, w] : v) { if (auto p = g(); p && *p > 3) continue; } int (*fp)(int) = nullptr; delete[] new int[3]; (void) x; static_cast<long>(a); switch (b) { case 1: break; default: ; } do { } while (0); try { throw 1; } catch (...) { } return a < b ? c : d; }", "namespace a::b { using c::d; using E = std::function<void(int)>; enum class F : int { G = 1, H }; struct I; extern \"C\" { void j(void); } typedef struct { int k; } L; union M { int n; float o; }; inline namespace p { } }", "unsigned long long x = 0xFFULL, *y, z[3] = {1, 2, 3}; const char* s = \"a\" \"b\" R\"(c)\"; template <> struct A<int*> {}; static_assert(sizeof(int) == 4, \"x\"); auto f() -> decltype(g()); template <class T> concept C = requires(T t) { t.x(); { t.y() } -> D; };"],
    "csharp": ["using System;\nusing X = A.B<int>;\nnamespace N;\n[A, B(1, C = 2)] public sealed partial class D<T> : E<T>, IF where T : class, new() { private readonly int[] a = { 1, 2 }; public int P { get; private set; } = 3; public string Q => $\"{a[0]:x}\"; public D(int x) : base(x) { } ~D() { } public static D operator +(D a, D b) => a; public int this[int i] { get => i; set { } } public event EventHandler H; async Task<int> F<U>(ref int x, out string y, params object[] z) { await foreach (var w in v) { } y = null; return 1; } }", "var x = new Dictionary<string, List<int>> { [\"a\"] = new() { 1 }, };\nforeach (var (a, b) in c) { if (d is string { Length: > 3 } s and not null || e is [1, .., var f]) continue; }\nint? g = h?.i[0] ?? throw new E();\nvar j = k switch { 1 or 2 => \"x\", > 3 when l => \"y\", _ => null };\nusing var m = n;\nFunc<int, int> o = static (p) => p * 2;\nvar q = from r in s where r > 1 orderby r descending select new { r, T = 1 };\nlong u = (long)v << 3;\nw = x is null ? (1, 2) : default;\nlock (y) { }\nint Z(int a) => a;\n", "public record struct P(int X, int Y);\npublic enum E : byte { A = 1, B }\npublic delegate void D(object s, EventArgs e);\ninterface I { void F(); int G { get; } }\nclass C { void F() { switch (x) { case 1: case int y when y > 3: break; default: goto case 1; } try { } catch (E e) when (e.X) { } finally { } for (int i = 0, j = 1; i < j; i++) ; do { } while (true); yield return 1; label: ; fixed (int* p = a) { } checked { } } }"],
    "lua": ["local a <const>, b = 1, ...\nfunction M.x:y(...) return function(z) return z end, {1; 2, [3] = 4, k = 5,} end\nfor k, v in pairs(t) do goto c ::c:: end\nfor i = 1, 10, 2 do break end\nif not a == b then elseif c then else end\nrepeat local x = f{1}:g'h'.i[j](k) until x ~= nil and #y >= 3 or ~z // 2 << 1\nt[1], t.x = 1, 2;\n(f or g)(h)\nwhile true do end\nreturn a .. [==[b]]==]\n"],
}


@pytest.mark.parametrize(("language", "text"), [(k, t) for k, ts in INVALID.items() for t in ts])
def test_invalid(language, text):
    assert parse(text, language) is not None
    if language == "python":
        with pytest.raises(SyntaxError):
            compile(text, "x", "exec", ast.PyCF_ONLY_AST)


@pytest.mark.parametrize(("language", "text"), [(k, t) for k, ts in VALID.items() for t in ts])
def test_valid(language, text):
    assert parse(text, language) is None


def test_agrees_with_the_standard_library_on_its_own_files():
    files = sorted(pathlib.Path(sysconfig.get_paths()["stdlib"]).glob("*.py"))[::4]
    for f in files:
        assert parse(f.read_text("utf-8"), "python") is None, f


def test_an_ambiguous_grammar_by_brute_force():
    """S: S S | a S b | a b, against a recogniser that tries every split."""
    p = Parser(Tables("s: s s | 'a' s 'b' | 'a' 'b' | 'a' 'b'", "s", frozenset("ab")))

    def brute(w: str, known: dict = {}) -> bool:  # noqa: B006
        if w not in known:
            known[w] = w == "ab" or (len(w) > 2 and w[0] == "a" and w[-1] == "b" and brute(w[1:-1])) or any(brute(w[:i]) and brute(w[i:]) for i in range(2, len(w) - 1))
        return known[w]

    for n in range(1, 9):
        for k in range(2**n):
            w = "".join("ab"[k >> i & 1] for i in range(n))
            heads = p.begin()
            for c in w:
                heads = p.step(heads, ("'" + c,)) if heads else heads
            assert p.ends(heads) == brute(w), w
