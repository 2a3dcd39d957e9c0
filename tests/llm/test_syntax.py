import pytest

from tracewood.llm import syntax
from tracewood.llm.grammars import LANGUAGES, grammar
from tracewood.llm.peg import Grammar

GOOD = {
    "python": [
        "", "\ufeffx = 1\n", "def f(a, /, b=1, *c, d: int = 2, **e) -> int:\n    '''d'''\n    return a if b else [x async for x in y if x]\n", "async def g():\n    async with a as b, c:\n        await d\n    else_ = 1\n",
        "try:\n    pass\nexcept* (A, B) as e:\n    raise X from e\nfinally:\n    del a[0], b.c\n", "@d.e(1)\nclass A(B, metaclass=C):\n    x: int = 1\n    y: str\n", "match x:\n    case [1, *_] | {'a': b, **c} if b:\n        pass\n    case A(x=1):\n        pass\n", "match = {1: 2}\nmatch[1] = type\n",
        "print(f'{a!r:>{b}} {{x}} {c[\"d\"]}', *e, **g)\n", "x = (yield)\nwhile (n := 1): break\nelse: continue\n", "lambda *a, b=1: {**c, 'd': 1}\n", "if a:\n\tb\nelif c: d; e\n", "type X[T: int] = list[T]\ndef f[T](x: T): ...\n", "x = 1 if a else 2,\nfor a, *b in c: pass\nassert a, b\nglobal q\n", "x = 0xFF if False else 1\n", "a = 'x' r'y' '''\n<<<<<<< a\n'''\n",
    ],
    "javascript": [
        "", "a\nb()\n", "for (const [a, b] of c) if (d) e; else f\n", "label: while (1) { continue label }\n", "const {a, b: {c = 1}, ...d} = e, f = async ({g}) => ({h: 1})\n", "x = a ? b : c => d\n", "class A extends B.c { static #p = 1; get x() { return 1 } async *[y]() {} static { z } constructor() { super() } }\n", "x = /[/({]/g.test(y) / 2 / z\n", "`a ${b + `c ${d}`} e`\n", "import a, {b as c} from 'd'; export default function () {} export * as e from 'f'; export {g as default}\n",
        "try { a } catch { b } finally { c }\n", "do a(); while (b) c\n", "switch (a) { case 1: b; break; default: c }\n", "new A.b(c).d?.[e]?.(f) ?? g ** h\n", "x = function* () { yield* a; yield }\n", "if (a) return\n", "var get = set, of = async, let_ = static_\n", "o = { if: 1, get a() { return 1 }, async *b() {}, [c]: d, 'e': f, g }\n", "#!/usr/bin/node\nlet a\n", "throw a\n;;\n",
    ],
    "typescript": [
        "interface A<T extends B = C> extends D { readonly x?: number; [k: string]: any; (a: b): c; new (d): e; m<T>(x: T): void }\n", "type P<T> = { readonly [K in keyof T]?: T[K] } & (A | B)[] | ((x: number, ...y: string[]) => void)\n", "enum E { A = 1, B, 'C' = 2 }\nconst enum F {}\n", "declare module 'x' { export function f(a?: number): asserts a is B }\ndeclare const z: unique symbol\n",
        "abstract class A<T> implements B, C<T> { private static readonly x: number = 1; constructor(public a: string, private b?: C) { super() } abstract m(): void; declare y; get z(): number { return 1 } }\n", "const f = <T,>(x: T): T => x!\nlet a = b as const, c = d satisfies E, g = h<I>(j)\n", "export type { A } from 'b'; import type C from 'd'; import { type E } from 'f'\n", "function f(this: A, b: typeof c, d: A['e'], g: `x${string}`): g is H { return 1 }\nfunction f(a: string): void\n", "namespace A.B { export const c = 1 }\n", "@D() class X { @E prop!: string }\n", "let t: [a: string, b?: number, ...c: d[]] = x\n", "type C = A extends infer B ? B : never\n",
    ],
    "java": [
        "package a.b;\nimport static c.D.*;\n@A(x = {1, 2}) public final class B<T extends C & D> extends E<F[]> implements G, H<? super I> { static { } int[] a = {1, 2}, b; @Override public <U> Map<String, List<int[]>> m(final int x, T... y) throws Z { return null; } B() { super(); } ; }\n",
        'class A { void m() { for (var x : y) { } for (int i = 0, j; i < 1; i++, j--) ; int z = (int) a + (b) c.d(e -> f, G::new, int[]::new, () -> { }); String s = """\n { "x" ( """; char c = \'\\\'\'; x = y >>> 2 >= 1 ? a : b; label: while (true) break label; } }\n', "record R(int a, String... b) implements C { R { } }\nenum E { A(1) { void m() { } }, B; int x; }\nsealed interface S permits T { default void m() { } int n(); }\n@interface N { int v() default 1; }\n",
        "class A { Object m(Object o) { if (o instanceof String s && !s.isEmpty()) { } return switch (o) { case Integer i when i > 0 -> 1; case A, B -> { yield 2; } default -> throw new X(); }; } }\n", "class A { void m() { try (var a = b(); c) { } catch (D | E e) { } finally { } new B<>() { int c; }.d(); int[][] x = new int[1][]; synchronized (this) { } do x++; while (y); } }\n",
    ],
    "c": [
        '#include <a.h>\n#define X(a) \\\n  { (\nstatic const char *const a[] = {"x" "y", [1] = "z"}, b = \'\\\'\';\nint (*f[2])(int, char *) = {0, 0};\n', "typedef struct s { int a : 3; union { float b; }; } s_t, *s_p;\nenum e { A = 1, B, };\nextern int g(void), h();\n", "static inline int m(int a, ...) { for (int i = 0; i < 1; i++) if (a) { continue; } else goto x; x: switch (a) { case 1: case 2: break; default: ; } return (int) sizeof(struct s) + a ? b : (T) c; }\n", "void v(void) { T *x = (T *) y; z(*x, &w, sizeof a); do { } while (0); a = (struct p) { .x = 1, .y = {2} }; }\n", "int main(argc, argv) int argc; char **argv; { return 0; }\n", "__attribute__((unused)) static int q;\n",
    ],
    "go": [
        'package a\n\nimport (\n\t"b"\n\tc "d"\n)\n\ntype T[P any] struct {\n\ta, b int `x`\n\t*E\n}\n\nfunc (t *T[P]) M(x ...int) (n int, err error) {\n\tif y, ok := z.(T); ok && y != (T{}) {\n\t\treturn\n\t}\n\tfor i := range x {\n\t\tdefer func() { go f(i) }()\n\t}\n\tswitch v := z.(type) {\n\tcase int, []string:\n\t\tfallthrough\n\tdefault:\n\t}\n\tselect {\n\tcase c <- 1:\n\tcase d, ok := <-e:\n\t}\n\ta[1:2], b = map[string][]int{"x": {1}, "y": nil}, struct{ q int }{1}\nL:\n\tfor {\n\t\tcontinue L\n\t}\n\treturn 1, nil\n}\n',
        "package a\n\ntype I interface {\n\t~int | string\n\tM(a int) error\n}\n\nvar x = func(a int) int { return a }(1)\n\nconst (\n\tA = iota\n\tB\n)\n\nvar c chan<- int = make(chan int, 3)\nvar r = '\\''\n",
    ],
    "rust": [
        "#![allow(x)]\nuse a::{b::{self, c as d}, e::*};\npub(crate) async unsafe fn f<'a, T: B<C = D> + 'a, const N: usize>(&'a mut self, mut x: [u8; 3], (y, _): (T, &str)) -> Result<(), Box<dyn E + Send>> where T: Fn(i32) -> i32 { let Some(z) = w else { return Err(q)?; }; if let Ok(v) = u && true { } match x { A { b, .. } | C(d @ 1..=5, ..) if e => f, &[g, ref h @ ..] => {} _ => (), } 'l: loop { break 'l 1; }; for i in 0..n.len() { } |a, b: i32| -> i32 { a }; x.0.1 = S { a, b: 1, ..c }; vec![1; 2]; y as u8 >> 2; Ok(()) }\n",
        "impl<T> A<T> for B where T: C { type D = E; const F: u8 = 1; fn g(self: Box<Self>) {} }\nenum H { I = 1, J(u8), K { l: i32 } }\ntrait M: N { fn o(&self) -> impl P; }\nmacro_rules! q { ($x:expr) => { [$x] }; }\nstatic mut R: &[&str] = &[r#\"a \" b\"#, \"c\"];\n/* a /* b */ c */\nmod s { }\nextern \"C\" { fn t(x: i32, ...); }\nstruct U(pub u8, i32);\nstruct V;\n", "fn life<'a>(x: &'a str) -> &'a str { let c = ['{', '\\'', '\"']; x }\n", "fn f() { let x = if a { 1 } else { 2 } + 3; unsafe { g() }; h!{ }; return }\n",
    ],
    "ruby": [
        "", "require 'a'\nmodule A::B\n  class C < D\n    attr_reader :e, :f\n    def self.g(h, i = 1, *j, k:, l: 2, **m, &n)\n      return o if p? && !q\n      r = s.map { |t, (u, v)| t + u }.select do |w|\n        w > 1\n      end\n    rescue E, F => e\n      retry\n    ensure\n      x&.y\n    end\n  end\nend\n",
        "x = if a then 1 else 2 end\ny = case z\n    when 1, 2 then 3\n    else 4\n    end\nunless b\n  c\nend\nwhile d do e end\n", "TEXT = <<~DOC\n  { ( [ def\nDOC\nputs \"a #{b[\"c\"]} d\", %w[e (f], %q(g (h) ' i), /[({]\"'/ =~ j\n", "=begin\nend end ( {\n=end\na = { \"b\" => 1, c: 2, 'd': 3 }\ne, *f = g, h\ni ||= j ? k : l\n", "def m = 1\ndef n(a) = a + 1\nputs [1, 2]\nraise X, \"y\" unless z\nfoo.bar 1, b: 2 do |c|\n  d\nend\n", "a = ->(x) { x + 1 }\nloop do break end\nbegin; a; end while b\n71.times do |i|\n  f(i, 1)\nend\n",
    ],
    "lua": ["local a <const>, b = 1, [[x]]\nfunction t.f.g:h(...) return ... end\nfor i = 1, 2 do goto x ::x:: end\nfor k, v in pairs(t) do end\nif a then elseif b then else end\nrepeat local c until c\nf{1, [2] = 3; x = 4}\n('x'):rep(2)\n-- c\n--[==[ d ]==]\nreturn a\n"],
    "kotlin": ['package a\nimport b.*\n@D data class A<T : B>(val x: Int = 1, private var y: String?) : C(), D by e { companion object { const val Z = 1 } init { } override fun f(): Int = x ?: 0\n  val g by lazy { 1 }\n  val h: Int get() = 1 }\nfun <T> T.i(j: (Int) -> Unit = { }, vararg k: Int): List<T>? { for ((a, b) in c) { }; when (x) { 1, in 2..3 -> 4; is Int -> { } else -> null }; return "a ${b("c")} d".e?.f!!.g { it } }\nenum class E { A, B; fun x() {} }\nobject O\n'],
}
BAD = {
    "python": ["def f(:\n", "x = = 3\n", "x = (1, [2, 3)\n", "if a\n    b\n", "  x\n", "def f():\nx\n", "x = 'a\n", "<<<<<<< HEAD\n", "f(a=1, b)\n", "f() = 1\n", "x = f'{a'\n", "try:\n    a\n", "class A:\n    def f(self):\n        a\n     b\n", "\0"],
    "javascript": ["let x = ;", "const a: number = 1", "f(1, [2)", "x = 'a\n", "function f( {", "a b", "`x", "}", "if (a {", "<<<<<<< HEAD\n", "class A { x( }", "import a from", "const"],
    "typescript": ["let x: = 1", "interface A { x: }", "function f(a: number { }", "type = 1;;x y", "class A { private }}"],
    "java": ["class A { int x }", "int f() { }", "class A { void m() { int x = ; } }", "class A { String s = \"a; }", "class A {", "import a", "const x = 1;", "class A { void m() { x = (1 + [2); } }"],
    "c": ["int f( { }", "int x = ;", "return 1;", "def f(a):\n", "int f() { \"a; }", "int f() {", "}", "int x[3 = {1};", "class A { };", "int f() { v = * ; }"],
    "go": ["func f() {}\n", "package a\nfunc f( {\n}\n", "package a\nvar x = \"a\n", "package a\nfunc f() {\n", "package a\nx := 1\n", "package a\nfunc f() { v = * ; }\n", "package a\nfunc f() { if x { } else }\n"],
    "rust": ["fn f( {}", "fn f() { let x = ; }", "fn f() { \"a }", "fn f() {", "}", "let x = 1;", "fn f() { x = (1 + [2); }", "struct A { x: }"],
    "ruby": ["def f\n", "end\n", "x = (1, [2)\n", "puts 'a\n", "def f(a, b=0):\n  c\nend\n", "class A(B)\nend\n", "total = = (3\n", "<<<<<<< HEAD\n", "x = [1\n", "if a\n  b\n"],
    "lua": ["function f(", "if a then", "x = = 1", "end", "local = 1", "f 1"],
    "kotlin": ["fun f( {", "class A {", "val x = ", "fun f() { \"a }", "}"],
}


@pytest.mark.parametrize("language", sorted(LANGUAGES))
def test_well_formed(language):
    for text in GOOD[language]:
        assert syntax.well_formed(language, text), syntax.failure(language, text) + (text,)
        crlf = text.replace("\n", "\r\n")
        assert syntax.well_formed(language, crlf), (crlf, syntax.failure(language, crlf))


@pytest.mark.parametrize("language", sorted(LANGUAGES))
def test_malformed(language):
    for text in BAD[language]:
        assert not syntax.well_formed(language, text), text
        at, cause = syntax.failure(language, text)
        assert 0 <= at <= len(text) and cause


def test_javascript_is_typescript():
    for text in GOOD["javascript"]:
        assert syntax.well_formed("typescript", text), text


def test_linear_on_deep_and_long_texts():
    import sys

    sys.setrecursionlimit(syntax.DEPTH)
    assert syntax.well_formed("javascript", "x = " + "[" * 3000 + "]" * 3000 + ";\n")
    assert syntax.well_formed("python", "x = [" + "1, " * 50_000 + "]\n")
    assert not syntax.well_formed("java", "class A { int x = " + "(" * 500 + "; }")


def test_failure_place_and_cause():
    assert syntax.failure("python", "a = 1\n<<<<<<< HEAD\nb = 2\n=======\nc\n>>>>>>> x\n") == (6, "merge conflict")
    assert syntax.failure("java", "class A { int f() { retur")[1] == "truncated"
    assert syntax.failure("go", "PK\x03\x04\ufffd\0")[1] == "binary"


def test_grammar_notation():
    g = Grammar("file <- a* EOF\na <- &'x' 'x' ('y' / !'z' 'q')? ';'\n")
    run = lambda *t: g.build()([*t, "EOF"], [False] * 9, [False] * 9)[0]
    assert run() == 1 and run("x", ";") == 3 and run("x", "y", ";", "x", "q", ";") == 7 and run("x", "z", ";") == -1
    with pytest.raises(ValueError):
        Grammar("file <- nowhere")


SCHEMA = "file_id long, repo string, relative_path string, language string, text string, n_bytes long, indexed_at timestamp"
RULES = "schema_version int, language string, revision int, extensions array<string>"


def test_states_rules_and_rates(spark):
    import datetime as dt

    old, new = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)
    rows = [(1, "r", "a/b.PY", None, "x = 1\n", 1, old), (1, "r", "a/b.PY", "go", "x = = 1\n", 1, new), (1, "r", "a/b.PY", "go", "x = = 1\n", 1, new), (2, "r", "c.js", None, None, None, new), (3, None, "d.mjs", None, "let x = ", 3, None), (4, "r", "e.txt", None, "((", 2, new), (5, "r", None, None, "((", 2, new), (None, "r", "f.py", None, "((", 2, new), (6, "r", "g.js", None, "", 0, new)]
    files = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as well_formed", "2 as cause")
    rules = spark.createDataFrame([(1, "python", 1, [".py"]), (1, "javascript", 1, [".js"]), (1, "javascript", 2, [".js", ".mjs", None]), (1, "cobol", 1, [".txt"]), (1, None, 1, None), (1, "go", None, None)], RULES)
    got = {r["file_id"]: r["well_formed"] for r in syntax.parse_files(files, rules).collect()}
    assert got == {1: False, 2: True, 3: False, 6: True}
    told = {r["file_id"]: r["cause"] for r in syntax.parse_files(files, rules, explain=True).filter("not well_formed").collect()}
    assert told == {1: "unexpected token", 3: "truncated"}
    rates = {(r["repo"], r["language"]): (r["files"], r["malformed"], r["rate"]) for r in syntax.malformed_rates(syntax.parse_files(files, rules)).collect()}
    assert rates == {("r", "python"): (1, 1, 1.0), ("r", "javascript"): (2, 0, 0.0), (None, "javascript"): (1, 1, 1.0)}
    assert syntax.parse_files(files.limit(0), rules).collect() == [] and syntax.parse_files(files, rules.limit(0)).collect() == []


def test_binary_is_told_by_the_whole_text():
    assert syntax.failure("python", "x = 1\n" * 200 + "y = \ufffd\ufffd (\n")[1] == "binary"
    assert syntax.failure("python", "x = 1\n" * 200 + "y = (\n")[1] == "truncated"
