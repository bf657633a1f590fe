import ast
from datetime import datetime

import pytest

pytest.importorskip("quern.llm")
from quern.llm.dialects import RULES, dialect
from quern.llm.gll import Grammar
from quern.llm.unparsable import parsed_files, unparsable_rates

FILES = "repo_name string, repo_path string, language string, size_bytes bigint, raw_content string, crawled_at timestamp_ntz, parses boolean"
GOOD = {
    "python": [
        "", "x = 1\n", "if a:\n  b\nelif c: d; e\nelse:\n\tf\n", "@d\nasync def f(a, /, b: int = 3, *c, d, **e) -> x[1:2, ...]:\n    async with a as b, c: await d\n    return {**a, 'b': [i for i in j if k]}\n",
        "def f():\n    '''doc <<<<<<<'''\n    try:\n        pass\n    except* (A, B) as e:\n        raise X from e\n    finally:\n        yield from y\n", "match x:\n    case [1, *_] if y: pass\n    case {'a': b, **c}: pass\n    case A(b=1) | None: pass\n",
        "x: int\na, *b = c = d\nf(*a, **b, c=1)(d)[::2].e\nlambda *a, b=1: (yield)\nfrom . import (a as b,\n  c)\nprint(f'{x!r:>{w}}', 0x1f, 1e-3j)\n", "a = b if c else d\nx = not a in b is not c\nwhile (n := f()): continue\n", "x = '''\n=======\n'''\nclass A(B, metaclass=C):\n    pass\n",
    ],
    "javascript": [
        "", "import a, {b as c} from 'd'\nexport default class extends A { static #x = 1; get y() { return this.#x } async *z(...a) {} }\n", "const f = async (a, {b = 1, ...c}) => ({a, [b]: c, d() {}})\nlet x = a ? b : c\nfoo()\n  .bar(/[)}]+/g, `t ${x}`)\n",
        "for (const [k, v] of m) if (k) { v } else continue\nfor (let i = 0, n = 3; i < n; i++) ;\ndo { x-- } while (x > 0)\nlabel: switch (x) { case 1: case 2: break label; default: y }\n", "try { a?.b?.[c]?.(d) } catch { throw new E('x') } finally {}\nvar a = {if: 1, 'b': 2}, b = [, 1, ...c]\n", "export const {a, b} = require('c'); if (a) b(); else c()\nx = y\n++z\n",
    ],
    "typescript": [
        "interface A<T extends B = C> extends D { readonly a?: string; [k: string]: unknown; m(x: number): void }\ntype X = A | { b: C[] } | ((a: string) => void)\nenum E { A = 1, B }\n", "export abstract class A<T> implements B { private readonly x: Map<string, number> = new Map<string, number>(); constructor(private a: string, public b?: C) { super() } get y(): T { return this.x as unknown as T } }\n",
        "function f<T>(a: T[], b?: (c: T) => boolean): a is B { return a!.b as any }\ndeclare const z: typeof f\n", "const x: Record<string, number> = { a: 1 };\nconst y = <T,>(a: T): T => a;\n",
    ],
    "java": [
        "package a.b;\nimport static c.D.*;\n@A(x = {1, 2})\npublic final class B<T extends C & D> extends E<F> implements G {\n  private static final int[] X = {1, 2,};\n  static { x(); }\n  public <U> B(final U u, int... v) throws E { this.u = u; }\n  @Override public List<? super T> f() { return xs.stream().map(x -> x + 1).map(B::new).collect(toList()); }\n}\n",
        'enum A { X(1) { void f() {} }, Y; int z; }\ninterface I { default void f() { for (var e : m.entrySet()) { if (e instanceof Foo<?> f && !f.a()) continue; } } }\nrecord R(int a, String b) {}\nclass C { void f() { try (var x = y()) { } catch (A | B e) { throw e; } int v = switch (k) { case 1, 2 -> 3; default -> { yield 4; } }; String t = """\n  }\n"""; char c = \'{\'; Object o = new Object() { int q; }; int[][] g = new int[3][]; } }\n',
    ],
    "go": [
        'package a\n\nimport (\n\t"b"\n\tc "d/e"\n)\n\ntype T[K comparable, V any] struct {\n\ta, b int `json:"x"`\n\t*Base\n}\n\nfunc (t *T[K, V]) F(x ...string) (n int, err error) {\n\tdefer func() { recover() }()\n\tfor i, v := range x {\n\t\tif y, ok := m[v]; ok && y == (P{1}) {\n\t\t\tcontinue\n\t\t}\n\t}\n\tswitch z := q.(type) {\n\tcase int, []string:\n\t\tgo f(z...)\n\tdefault:\n\t}\n\tselect {\n\tcase v := <-ch:\n\tcase ch <- 1:\n\t}\n\treturn map[string][]int{"a": {1, 2}}["a"][:1], nil\n}\n',
        "package a\n\nconst (\n\tA = iota\n\tB\n)\n\nvar f = func(a, b int) int { return a &^ b }\n\ntype I interface {\n\tM(int) error\n\t~int | ~string\n}\n",
    ],
    "rust": [
        "#![allow(x)]\nuse a::{b, c::*};\n#[derive(Debug)]\npub struct P<'a, T: B + 'a>(&'a T);\nimpl<'a, T> Q for P<'a, T> where T: Fn(u8) -> u8 {\n    type X = Vec<Option<T>>;\n    fn f(&mut self, (a, b): (u8, u8)) -> Result<(), Box<dyn E>> {\n        let x = if a > 1 { 2 } else { 3 };\n        match x { 1 | 2 => {} Some(y) if y < 3 => return Err(\"x\".into()), A { b, .. } => (), 0..=9 => {}, _ => unreachable!(\"{}\", x), }\n        let v: Vec<u64> = xs.iter().map(|&z| z as u64 + 1).collect::<Vec<_>>();\n        while let Some(q) = it.next() { continue 'o; }\n        for i in 0..n { s.t[i] += &v[..2]?; }\n        let c = '{'; let r = r#\"raw \" }\"#;\n        Ok(S { a: 1, ..d })\n    }\n}\n",
        "pub enum E { A, B(u8), C { x: u8 } = 3 }\nconst X: [u8; 4] = [0; 4];\nmacro_rules! m { ($x:expr) => { $x }; }\npub trait T: A { const N: usize; fn g(&self); }\nmod m { pub async unsafe fn f() {} }\n",
    ],
    "c": [
        '#include <a.h>\nextern int ext(const char *, ...);\nextern const unsigned table[];\n#define X(a) \\\n  do { } while (0)\ntypedef struct node { int a : 3; struct node *next; } node_t;\nenum e { A = 1, B };\nstatic const char *names[] = { "a" "b", [2] = "c" };\nint (*fp)(int, char **);\nint main(int argc, char *argv[]) {\n    for (int i = 0; i < 3; i++) p->x[i] = (unsigned char) sizeof(struct node) * *q;\n    switch (c) { case 1: goto out; default: break; }\n    if (x) return 1; else y = z ? a : b;\nout:\n    do { n--; } while (n);\n    return 0;\n}\n',
    ],
    "cpp": [
        '#include <a>\nnamespace a::b {\ntemplate <typename T, int N = 3>\nclass A : public B<T>, private C {\npublic:\n    explicit A(int x) : B<T>(x), y{x} {}\n    virtual ~A() = default;\n    auto f(const std::vector<std::map<int, T>>& v) const noexcept -> T override { for (const auto& [k, w] : v) { if (auto it = m.find(k); it != m.end()) return static_cast<T>(*it); } throw std::runtime_error("x"); }\n    bool operator==(const A& o) const { return y == o.y; }\nprivate:\n    int y = 0;\n};\nusing X = std::unique_ptr<A<int>>;\nenum class E : int { P, Q };\n}\nint main() { auto l = [&, x = 1](int a) mutable { return a << x; }; std::string r = R"(raw } text)"; try { delete p; auto q = new int[3]{1, 2}; } catch (const std::exception& e) { log(e.what()); } return l(2); }\n',
    ],
}
BREAK = ("x = (1\n", "<<<<<<< HEAD\n", "{\n", "}\n", ")\n", "404: Not Found\n", "version https://lfs.example/spec/v1\noid sha256:12ab\n", "<!DOCTYPE html>\n<html><head><title>x</title></head>\n", 'x = "open\n', "a b c d\n", "=======\n")


@pytest.mark.parametrize("lang", sorted(RULES))
def test_valid_and_broken(lang):
    d = dialect(lang)
    for text in GOOD[lang]:
        assert d.recognises(text), text
        if text:
            for end in BREAK:
                assert not d.recognises(text + end), (end, text)
            assert not d.recognises(text.rstrip()[: len(text.rstrip()) * 2 // 3].rstrip("}) \n;") + " ("), text


MORE = {
    # valid and broken snippets of the finer points of the languages

    "javascript":["#!/usr/bin/env node\nlet a = 1\n","const s = `a ${b ? `c ${d} }` : `e`} f`\n","import x from './a.json' with {type: 'json'}\n","with (a) { b() }\n","with (a) b.with(1)\n","const {a, b = 1} = c; [x, y] = [y, x]; a.b[c] = d ||= e\n","a.with(1, 2)\n","for (const x of y) z\n","for (const x in y) z\nfor (let i = 0, j; i < 3; i += 2) ;\n","({a} = b)\nthis.x = 1\nsuper.y = 2\nnew A().b = 3\n","x = y = z => z\nasync () => { await x }\n","let x = a ? b : c, y\nvar z\n","export const a = 1, b = 2\nexport * from 'x'\n","const f = { with(a) { return a } }\nexport { f }\n"],
    "typescript":["declare module 'x' { export const a: string; export function f(a: number): void }\n","declare module 'y'\n","namespace A.B { export const c = 1 }\n","type P = [a: string, b?: number, ...rest: boolean[]]\n","function f(x: unknown): asserts x is string { }\n","function g(x: unknown): asserts x { }\n","declare const z: number\nexport declare function h(): void\n","declare global { interface Window { a: string } }\n"],
    "c":["__attribute__((unused)) static int f(void) { return 1; }\n",'MODULE_LICENSE("GPL");\n',"#define T(x) _Generic((x), int: 1, default: 2)\nint y = _Generic(x, int: 1, char *: 2, default: 3);\n","struct s { int a; } __attribute__((packed));\nstruct __attribute__((packed)) t { int a; };\nstruct s x = { .a = 1 };\n","enum e { A, B } v;\nunion u { int a; float b; };\nstruct fwd;\n","int (*f(int a))(char) { return 0; }\n"],
    "cpp":["[[nodiscard]] int f() { return 1; }\n","template <typename... A> auto sum(A... a) { return (a + ...); }\ntemplate <typename... A> auto all(A... a) { return (... && a); }\ntemplate <typename... A> void p(A... a) { (f(a), ...); }\n","class [[nodiscard]] A final : public B { public: A(); ~A() override; };\nclass F;\nstruct { int a; } x;\n","int x{1};\nA::A() : b(1) { }\n"],
    "java":["module a.b { requires java.base; exports a.b.c; }\n","open module a { }\n","class A { void f() { x = 1; x.y++; --z; f(1).g(); new B(); new B().c(); this.d = 2; super.e(); a[1] += 2; super.f = 1; } }\n","class A { A() { this(1); } A(int a) { super(); } }\n"],
    "rust":["/* a /* b */ c */ fn f() {}\n"],
    "python":["for x in *a, b: pass\n","a, *b = c\n(a, b) = [c, d] = e\n[x] = y\n() = z\n","a.b[c]: int = 3\nx[1:2] += 3\n(a) = 1\n(a): int\n","with a as (b, c), d as e.f: pass\n","del a, (b, c[1]), d.e\n","f(a, *b, c=1, *d, **e)\nf(x for x in y)\nf(**a, b=1)\n","def f(a, b=1, /, c=2, *d, e, f=3, **g): pass\ndef g(a, /, b, *, c): pass\ndef h(*, a=1): pass\ndef k(**a): pass\ndef l(*a: int, b): pass\n","lambda: 0\nlambda a, b=1, *c, d, **e: a\nlambda *, a: a\n","x = 00\ny = 0_0\nz = 0.8 + 08.5 + 1e08\n",'f"{a!r:>{w}} {{b}} {c["d"]}"\nf"""{\n a}"""\nrf"\\d{x}"\n',"None if a else True\nx = None\nprint(None, True)\n","if (n := 1) > 2: pass\n[y := 1, y**2]\n","match x:\n    case None: pass\n    case True | False: pass\n    case {'a': None, **r}: pass\n","x = yield\n","a = b = yield c\n","class A(B, metaclass=C, **d): x: int = 1\n","print(*a, sep='')\nf(a)(b).c = 1\n'x'.y = 2\n","async def f():\n    async for a, b in c: await d\n    return [x async for x in y]\n","for a.b in c: pass\nfor (x, y) in z: pass\n","try: pass\nexcept (A, B): pass\n","f'\\N{EM DASH} {x}'\n","global a, b\n"],
}
WRONG = {
    "python":["1 = x\n","f() = 1\n","f(a=1, b)\n","def f(a=1, b): pass\n","x = 08\n","f'{a'\n","None = 1\n","del f()\n","f'}'\n","f'{}'\n","def f(*): pass\n","lambda a=1, b: 0\n","(a, b) += 1\n","for f() in x: pass\n","a + b = c\n","x = (yield) = 1\n","f(**a, *b)\n","with a as 1: pass\n","del None\n","[a, 1] = b\n","True += 1\n","f(x=1, y for y in z)\n"],
    "javascript":["const x\n","1 = 2\n","with (a) { b }\nexport const c = 1\n","import a from 'b'\nwith (c) d()\n","`a ${b\n","a + b = c\n","let 1\n"],
    "java":["class A { void f() { 1 + 2; } }\n","class A { void f() { a == b; } }\n","class A { void f() { x; } }\n"],
    "cpp":["class A { }\n","struct A { int x; }\nint main() { }\n"],
    "c":["struct a { int b; }\n","int f { }\n"],
}


@pytest.mark.parametrize("lang", sorted({*MORE, *WRONG}))
def test_finer_points(lang):
    d = dialect(lang)
    assert [t for t in MORE.get(lang, ()) if not d.recognises(t)] == []
    assert [t for t in WRONG.get(lang, ()) if d.recognises(t)] == []


def test_python_snippets_agree_with_ast():
    import warnings

    for t in [*GOOD["python"], *MORE["python"], *WRONG["python"]]:
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                compile(t, "x", "exec", ast.PyCF_ONLY_AST)
            ok = True
        except SyntaxError:
            ok = False
        assert dialect("python").recognises(t) is ok, t


def test_no_bound_on_kinds_of_line_ends():
    text = "".join("x = 1" + " " * 0 + "\n" + "\n" + " " * i + "\n" for i in range(1500)) + "if a:\n" + "".join(f"{' ' * 2}y = (1,\n{' ' * (i % 1200)}2)\n" for i in range(1300))
    assert dialect("python").recognises(text)


def test_languages_are_told_apart():
    for lang in RULES:
        for other, texts in GOOD.items():
            if {lang, other} in ({"javascript", "typescript"}, {"c", "cpp"}) or lang == other:
                continue
            for t in texts:
                if len(t) > 120:
                    assert not dialect(lang).recognises(t), (lang, other, t)


def test_python_agrees_with_its_own_parser(small):
    import duckdb

    rows = duckdb.sql(f"select distinct raw_content from '{small}/files.parquet' where raw_content is not null and repo_path like '%.py'").fetchall()
    for (t,) in rows:
        try:
            ast.parse(t)
            ok = True
        except SyntaxError:
            ok = False
        assert dialect("python").recognises(t) is ok, t[:300]


def test_ambiguous_and_left_recursive_grammar():
    g = Grammar("File = S\nS = S S | 'a' | S '+' S |", {"a": "a", "+": "+"})
    assert g.derived("a+aa+a", ["File"]) == {"File"} and g.derived("", ["File"]) == {"File"} and g.derived("+a", ["File"]) == {"File"}
    h = Grammar("File = S\nS = S S | 'a' | S '+' S", {"a": "a", "+": "+"})
    assert h.derived("a+aa+a", ["File"]) == {"File"} and h.derived("+a", ["File"]) == set() and h.derived("", ["File"]) == set()
    assert g.derived("a" * 60, ["File"]) == {"File"}


def test_operator(spark):
    t = datetime(2024, 1, 1)
    rows = [
        ("r", "a.py", None, 0, "x = (", t, True), ("r", "a.py", "PY", 0, "x = 1", datetime(2024, 2, 1), None), ("r", "b.py", None, None, "def f(:", None, None), ("r", "b.py", None, None, "def f(:", None, None), ("r", "c.md", None, None, "x = (", t, None),
        ("r", "d.go", "go", 1, None, t, None), ("q", "e.js", None, 1, "\ufefflet a = 1", t, None), (None, "f.c", None, 1, "int x", t, None), ("q", None, None, 1, "x", t, None), ("q", "g.py", None, 1, "", t, None),
    ]
    df = spark.createDataFrame(rows, FILES)
    got = {(r["repo_name"], r["repo_path"], r["parses"]) for r in parsed_files(df).collect()}
    assert got == {("r", "a.py", True), ("r", "b.py", False), ("q", "e.js", True), (None, "f.c", False), ("q", "g.py", True)}
    rates = {(r["repo_name"], r["language"]): (r["n_files"], r["n_unparsable"]) for r in unparsable_rates(parsed_files(df)).collect()}
    assert rates["r", "python"] == (2, 1) and rates[None, "c"] == (1, 1)
    assert parsed_files(df.limit(0)).count() == 0


def test_long_file():
    assert dialect("java").recognises("class A {\n" + "".join(f"  int f{i}(int a) {{ return a + {i}; }}\n" for i in range(5000)) + "}\n")
    assert dialect("javascript").recognises("module.exports = [" + "1.5, -2," * 50_000 + "];\n")
    assert not dialect("python").recognises("x = [" + "1, " * 50_000)
