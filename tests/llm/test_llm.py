"""The operators for training data: against brute force, exact round trips and small cases of every kind."""

import ast
import os
import random
import warnings

import numpy as np
import pytest

from graphloom.llm import bpe, code, docpairs, grammars, neighbours, origin, packing, quality
from graphloom.llm.common import tokenizer_path
from graphloom.llm.gll import Grammar

needs_tokenizer = pytest.mark.skipif(not os.path.exists(tokenizer_path()), reason="no tokenizer here")

GOOD = {
    "python": ["x = 1", "match = 2\nmatch x:\n  case [1, *r] if r: pass\n  case {'a': b, **c}: pass\n", "def f(a, /, b=1, *, c, **k) -> int: return (yield)\n", "print(f'{a!r:>{w}} {d[\"k\"]}')", "async def g():\n  async with a as b, c: await d\n# end", "type A[T] = list[T]\n", "﻿x = [i async for i in y if (z := i)]", "try:\n  pass\nexcept* E as e:\n  pass\n"],
    "java": ["class A { int x = 3; }", "record P(int a) implements Q { P { assert a > 0; } }", 'class A { String s = """\n a "q" \\""" b\n """; char c = \'}\'; }', "sealed interface S permits A, B {} final class A<T extends List<? super T>> implements S { <R> R f(Map<String, List<R>> m, int... n) throws E { return switch (m) { case A(var x) when x > 1 -> 1; default -> { yield 2; } }; } }"],
    "kotlin": ["fun f(x: Int): Int = if (x > 0) 1 else 2", "class A<T>(val x: Int = 3) : B(x), C by d where T : E { companion object { const val Z = 1 } init { } var y: Int\n get() = 1\n private set }", 'val s = "a ${if (x) "b" else """c "q" """} $d"\n/* a /* b */ c */', "fun g() { x?.let { it.y() } ?: return@g\n  for ((a, b) in m) when (a) { is T -> 1; in 1..2, 3 -> 2\n else -> 3 } }"],
    "javascript": ["let a = 1\nlet b = 2", "import x, { y as z } from 'm'; export default class extends A { #p = 1; static { } get q() { return /[/}]/g.test(`${ {a: `b`} }`) } }", "with (a) { b }", "for await (const x of y) { label: for (;;) { break label } }", "const { a = 1, ...b } = c ?? d?.[e], f = async ({ g }) => { await h }"],
    "typescript": ["const x: Map<string, Array<number>> = new Map<string, number[]>();", "abstract class A<T> extends B<T> implements C { @D() private readonly x?: string; constructor(private a: E) { super() } get b(): F { return <G>this } abstract h(): void; [k: string]: any }", "export type X<T> = T extends (infer U)[] ? { readonly [K in keyof U]?: U[K] } : never; declare module 'm' { export function f(a: string): asserts a is string }", "enum E { A = 1, B }\nlet y = z as unknown as number; let w = v!.u satisfies T;"],
    "rust": ["fn main() {}", "impl<'a, T: Fn(&str) -> u8 + 'a> Tr for S<'a, T> where T: Sized { fn f(&mut self, (a, b): (u8, &[u8; 2])) -> impl Iterator<Item = u8> + '_ { let Some(x) = y else { return }; 'l: loop { break 'l } match z { A::B { c, .. } | A::C(1..=3) if d => 1, _ => { 2 } } } }", "macro_rules! m { ($($x:expr),*) => { vec![$($x),*] }; }\nconst C: &str = r#\"a \"q\"\"#; const D: u8 = b'\\'';", "#![allow(x)]\n#[derive(A)] pub(crate) struct S { pub a: Vec<Option<u8>>, }\nuse a::{b::*, c as _};"],
}
BAD = {
    "python": ["def f(:", "x = 'a", "if x\n  y", "<<<<<<< HEAD\nx = 1\n=======\n>>>>>>> b", "f(a=1, 2)", "  x = 1\n y = 2", "print 'x'", "a + 1 = 2"],
    "java": ["class A {", "class A { int x = ; }", "def f(): pass", "class A { void f() { g(1 } }", 'class A { String s = "x; }'],
    "kotlin": ["fun f( {", "val x = ", 'val s = "a ${b"', "class A { fun f() { } ]"],
    "javascript": ["function f( {", "let x = ;", "a b", "const s = 'x\n'", "if (a { }", "{\"a\": 1, \"b\": 2}"],
    "typescript": ["class A { x: = 1 }", "interface {", "let x: Array<number = 1;", "f(,, 2);"],
    "rust": ["fn f( {}", "let x = 1;", "struct S { a u8 }", "fn f() { /* }", "fn f() -> { 1 }"],
}


@pytest.mark.parametrize("language", sorted(GOOD))
def test_grammars(language):
    for text in GOOD[language]:
        assert grammars.accepting(language, text), (text, grammars.explain(language, text))
    for text in BAD[language]:
        assert not grammars.accepting(language, text), text


def test_python_grammar_against_the_real_parser():
    rng = random.Random(1)
    base = "class A(B):\n    @d(1)\n    def f(self, x=1, *a, **k):\n        if x in (1, 2) and not y:\n            return [i for i in a if i] or {'k': lambda q: q}\n        x.y[1:2] = yield\n    z: int = 3\nfor i, (j, k) in w: del i\n"
    warnings.simplefilter("ignore")
    for _ in range(300):
        t = base
        i = rng.randrange(len(t))
        t = t[:i] + rng.choice(["", "(", ")", ":", " if ", "=", ",", "1 "]) + t[i + rng.randrange(2) :]
        try:
            ast.parse(t)
            ok = True
        except SyntaxError:
            ok = False
        assert bool(grammars.accepting("python", t)) == ok, (t, ok)


DIALECTS = [
    ("python", "print 'x'\nexec 'a' in d\nraise E, 'x'\ntry:\n  pass\nexcept E, e:\n  print >>f, `x`, 10L, 0777\nif a <> b: pass\ndef f((a, b), c): print\n", "python2"), ("python", "print 'a' 'b', ur'c'\n", "python2"),
    ("javascript", "const A = () => <div/>;", "javascript-jsx-module"), ("javascript", "function f() {\n  return <ul className='x' {...p}>{xs.map(x => <li key={x}>don't {x} </li>)}{/* c */}</ul>;\n}", "javascript-jsx-module"),
    ("typescript", "const A = <T,>(x: T) => <B<T> y={x}/>;", "typescript-jsx-module"), ("typescript", "const A = (x: number) => { if (x < 3) { return <><B a='1' on={() => { go(x); }}>it's</B></>; } return null; }", "typescript-jsx-module"),
    ("kotlin", "plugins {\n  id(\"x\")\n}\nval a = 1\nprintln(a)\n", "kotlin-script"),
]


@pytest.mark.parametrize("language,text,dialect", DIALECTS)
def test_dialects_besides(language, text, dialect):
    """Rejected by the current dialects of the plain extension, accepted by the other."""
    assert not grammars.accepting(language, text) and dialect in grammars.accepting(language, text, besides=True)
    if dialect.startswith(("java", "type", "kot")):
        assert grammars.accepting(dialect.replace("-module", ""), text)


def test_dialects_reject():
    for text in ("const A = () => <div>;", "const A = () => <div></p>;", "const A = () => <div a={let x}></div>;", "const A = () => <div a=></div>;", "x = <a>{</a>;", "x = `${a", "x = <a b=", "<a {", "x = `${<a>}`;", "x = <", "</a>"):
        assert not grammars.accepting("javascript-jsx", text), text
    assert grammars.accepting("javascript-jsx", "let a = b < c; let d = e > f; const g = /<div>/; const h = `<p>${<b>{x}</b>}</p>`;")
    assert grammars.accepting("typescript-jsx", "const f = <T extends X>(a: T) => a; const b = c < d && e > (f);")
    assert not grammars.accepting("python", "print 'x", besides=True) and not grammars.accepting("python", "def f(:\n", besides=True)
    assert grammars.accepting("python", "x = 1\n", besides=True) == ["python3", "python2"]


def test_gll_is_general():
    g = Grammar("file = s ; s = s s | 'a' | '(' s ')' ;")
    assert g.accepts([("a",)] * 40) and g.accepts([("(",), ("a",), (")",), ("a",)]) and not g.accepts([("(",), ("a",)]) and not g.accepts([])


def names(language, text):
    return [(f["name"], f["line"]) for f in docpairs.documented(language, text)]


D = "Returns how many nodes are still open in the graph."


def test_documented_functions():
    assert names("python", f'@dec\ndef f(x):\n    """{D}"""\n    def g():\n        """g"""\n    # {D}\n    def h(): pass\n') == [("f", 2), ("h", 7)]
    assert names("python", f"# {D}\n\ndef f(): pass\n") == []
    assert names("java", f"class A {{\n  /** {D} */\n  @X(1)\n  public List<String> f(int a) {{ }}\n  /** @param a {D} */\n  void g(int a) {{ }}\n  // {D}\n  void h();\n}}") == [("f", 4), ("h", 8)]
    assert names("kotlin", f'class A {{\n  /** {D} */\n  override fun <T> f(a: T): Int = 1\n  val s = """ /** {D} */ fun no() {{ }} """\n}}') == [("f", 3)]
    assert names("typescript", f"/** {D} */\nexport const f = async (a: number): Promise<void> => {{ }};\nclass A {{\n  /** {D} */\n  @Q() get(x: string): string[] {{ const s = `// {D}\nfunction no() {{}}`; }}\n}}") == [("f", 2), ("get", 5)]
    assert names("javascript", f"/* {D} */\nfunction f() {{\n  // {D}\n  function g() {{}}\n}}\nfoo(); // {D}\nfunction h() {{}}") == [("f", 2), ("g", 4)]
    assert names("rust", f"/// {D}\n#[inline]\npub async fn f<'a>(x: &'a str) -> u8 {{ 1 }}\n//! {D}\n\nfn g() {{}}") == [("f", 3)]


def test_code_of_functions():
    def code_of(language, text):
        return [f["code"] for f in docpairs.documented(language, text)]

    assert code_of("kotlin", f"class A {{\n  /** {D} */\n  fun f(a: T): Int =\n    when (a) {{\n      else -> 1\n    }}\n  /** {D} */\n  fun g(x: Int): Int = x +\n    1\n  /** {D} */\n  abstract fun h(x: Int): Int\n}}") == ["fun f(a: T): Int =\n  when (a) {\n    else -> 1\n  }", "fun g(x: Int): Int = x +\n  1", "abstract fun h(x: Int): Int"]
    assert code_of("typescript", f"/** {D} */\nexport const f = async (a: number) => g(a)\n  .then((x) => x);\nclass A {{\n  /** {D} */\n  get(x: string): string {{\n    return '}}';\n  }}\n}}") == ["export const f = async (a: number) => g(a)\n  .then((x) => x)", "get(x: string): string {\n  return '}';\n}"]
    assert code_of("java", f'class A {{\n  /** {D} */\n  @X(1)\n  public int f(int a) {{\n    return "}}".length();\n  }}\n  /** {D} */\n  void h();\n}}') == ['public int f(int a) {\n  return "}".length();\n}', "void h();"]
    assert code_of("rust", f"/// {D}\npub fn f(x: u8) -> u8 {{\n    x\n}}\n") == ["pub fn f(x: u8) -> u8 {\n    x\n}"]
    assert code_of("python", f'class A:\n    @d\n    async def f(self):\n        """{D}"""\n        return 1\n\n    x = 1\n') == [f'async def f(self):\n    """{D}"""\n    return 1']


@pytest.mark.parametrize("doc", ["TODO: write down what this function does and why it is here", "Documentation goes here", "x = compute(a, b);", "eslint-disable-next-line no-unused-vars because the caller needs it", "Count open nodes.", "@param x the first of the two numbers to add", "", "-----------"])
def test_trivial_documentation(doc):
    assert docpairs.words(f"// {doc}", "countOpenNodes") < docpairs.LEAST_WORDS


FILES = "file_id long, repo_name string, path string, content string, e double, salt int, lang string, scanned_at string"


def files(spark, *rows):
    return spark.createDataFrame([(i, "r", p, c, 0.0, 1, "x", None) for i, p, c in rows], FILES)


def test_source_file_operators(spark):
    f = files(spark, (1, "/a.py", "def f(:"), (1, "/a.py", "def f(:"), (2, "/b.py", f'def f():\n    """{D}"""\n'), (3, "/c.py", None), (4, "/d.py", " \n"), (5, "/e.css", "{{{"), (6, "/f.py", "﻿"), (None, "/g.py", "("), (7, None, "("), (8, "/x" * 50 + ".java", "class {"))
    assert sorted(r.file_id for r in code.unparsable(f).collect()) == [1, 8]
    assert [tuple(r) for r in code.documented_functions(f).collect()] == [(2, "f", 1)]
    assert code.documented_functions(f, full=True).first()["docstring"] == D and code.documented_functions(f, full=True).first()["code"] == f'def f():\n    """{D}"""'
    broken = files(spark, (1, "/a.js", f"// {D}\nfunction f(x) {{\n  return <p>{{x}}</p>;\n}}\nlet = ;"))
    assert code.documented_functions(broken).count() == 0 and code.documented_functions(broken, full=True).first()["code"].endswith("</p>;\n}")
    assert {(r.language, r.files, r.unparsable, r.no_grammar) for r in code.unparsable_rates(f).collect()} == {("python", 5, 1, 0), ("java", 1, 1, 0), ("css", 1, 0, 1)}
    assert {r.file_id: r.dialects for r in code.dialects(f).collect()} == {1: "", 2: "python2,python3", 8: ""}
    twice = spark.createDataFrame([(1, "r", "/a.py", "def f(:", "2025-01-01"), (1, "r", "/a.py", "x = 1", "2025-01-02"), (2, "r", "/b.tsx", "const a = <b/>;", None), (3, "r", "/c.kts", "f { }", None), (4, "r", "/d.jsx", "<a", None)], "file_id long, repo_name string, path string, content string, scanned_at string")
    assert [r.file_id for r in code.unparsable(twice).collect()] == [4]
    assert code.unparsable(f.limit(0)).count() == 0 and code.documented_functions(f.limit(0)).count() == 0


def test_origins(spark):
    lib = spark.createDataFrame([(1, "\n".join(f"function lib{i}(a, b) {{ return a.call{i}(b) + {i}; }}" for i in range(40)))], "library_file_id long, content string")
    hand = "import a\n\n" + "\n".join(f"def f{w}(x):\n    return x.{w}(other, {len(w)})\n" for w in ("one", "three", "eleven", "many"))
    copy = lib.first().content.replace("lib3(", "mine(")
    f = files(
        spark, (1, "/r/src/a.py", hand), (2, "/r/gen/b.py", "# Code generated by x. DO NOT EDIT.\n" + "\n".join(f"CODE_{i} = {i * 7}" for i in range(40))), (3, "/r/lib/c.js", copy), (3, "/r/lib/c.js", copy),
        (4, "/r/src/d.js", "var a=" + "[" + ",".join(str(i * 37) for i in range(400)) + "];"), (5, "/r/src/e.js", "!function(a,b){" + "var q=a.b(1,!0),w=function(e,t){return e?t[0]:e.q(t)};" * 60 + "}();"), (6, "/r/src/vendor/f.py", hand.replace("one", "two")), (7, "/r/gen/empty.py", None), (8, "x.py", "x = 1"), (None, "/y.py", "x"),
    )
    got = {r.file_id: r.label for r in origin.file_origins(f, lib).collect()}
    assert got == {1: "hand", 2: "generated", 3: "vendored", 4: "blob", 5: "minified", 6: "hand", 7: "hand", 8: "hand"}
    assert origin.not_handwritten(f.limit(0), lib).count() == 0


def test_mark_below_a_long_licence():
    for a, line, z in (("", "# term {}", ""), ("/*", " * term {}", " */"), ("/*", "   term {}", "*/"), ("", "// term {}", "")):
        head = "\n".join([a, *(line.format(i) for i in range(90)), z])
        mark = line.format("Code generated by wiregen. DO NOT EDIT.")
        assert origin.head_mark(f"{head}\n// {mark}\nx = 1\n" if a else f"{head}\n{mark}\nx = 1\n")
        assert not origin.head_mark(f"{head}\nx = 1\n{mark}\n")


def test_long_and_short_libraries_give_equal_shares(spark, monkeypatch):
    words = [f"w{i}" for i in range(400)]
    licence = " ".join(f"term{i}" for i in range(60)) + " "
    own = " ".join(f"own{i}" for i in range(240))
    part = " ".join(words[:164]) + " " + own  # 160 of 400 shingles are the library's
    rows = [(1, "r", "a.py", part), (1, "r", "a.py", part), (2, "r", "b.py", part), (3, "r", "c.py", " ".join(words)), (4, "r", "d.py", " ".join(words[:20])), (5, "r", "e.py", own), (6, "r", "f.py", None), (7, "r", "g.py", "x"), (8, "r", "h.py", " ".join(words[:24])), (9, "r", "i.py", licence + own)]
    files = spark.createDataFrame(rows, "file_id long, repo_name string, path string, content string")
    lib = spark.createDataFrame([(1, " ".join(words)), (1, " ".join(words)), (2, licence + " ".join(words[100:])), (3, None), (4, "y"), *((k, licence + f"other{k} x y z") for k in range(5, 40))], "library_file_id long, content string")
    small = {r.file_id: tuple(r.e) for r in origin.file_evidence(files, lib).collect()}
    monkeypatch.setattr(origin, "SMALL_LIBRARY", 0)
    assert {r.file_id: tuple(r.e) for r in origin.file_evidence(files, lib).collect()} == small
    vendored = {k: e[origin.LABELS.index("vendored")] for k, e in small.items()}
    assert min(vendored[k] for k in (3, 4, 8)) > 3 and max(vendored[k] for k in (1, 2, 5, 9)) < -3 and vendored[6] == vendored[7] == 0
    shares = {r.file_id: r.copied for r in origin._similarity_join(files, lib).collect()}
    assert abs(shares[1] - 0.4) < 1e-9 and shares[1] == shares[2] and shares[3] == shares[8] == 1.0 and shares[4] == 1.0 and shares[5] is shares[7] is shares[9] is None


def test_short_files_are_judged_too():
    top = lambda path, text: origin.LABELS[int(np.argmax(origin.evidence(path, text, 0.0, 0)))]
    assert top("/a.py", "X = [" + ", ".join(str(i * 7) for i in range(40)) + "]") == "blob"  # fewer than 300 characters
    assert top("/a.ts", "\n".join(f"export const FIELD_{i} = {i};" for i in range(9))) == "generated"  # fewer than 12 lines
    assert top("/a.py", "def f(x):\n    return g(x)\n") == "hand" and top("/a.py", None) == "hand"


def test_what_only_the_folder_decides(spark, monkeypatch):
    """Ablation: a file of two lines takes the label of its folder; without messages all of them are handwritten."""
    tiny = "import x\nimport y\n"
    body = [f"function lib{i}(a, b) {{ return a.call{i}(b) + {i}; }}" for i in range(60)]
    lib = spark.createDataFrame([(k, "\n".join(body[k * 6 : k * 6 + 12])) for k in range(8)], "library_file_id long, content string")
    gen = "// Code generated by wiregen. DO NOT EDIT.\n" + "\n".join(f"export const FIELD_{i} = {i};" for i in range(30))
    hand = "import a\n\n" + "\n".join(f"def f{w}(x):\n    return x.{w}(other, {len(w)})\n" for w in ("one", "three", "eleven", "many"))
    rows = [(k, f"/r/third/pkg{k % 2}/l{k}.js", r.content) for k, r in enumerate(lib.collect())] + [(20 + k, f"/r/api/stubs/g{k}.ts", gen) for k in range(6)] + [(40 + k, f"/r/src/core/h{k}.py", hand.replace("one", f"one{k}")) for k in range(6)]
    rows += [(100, "/r/third/pkg0/index.js", tiny), (101, "/r/third/index.js", tiny), (102, "/r/api/stubs/index.ts", tiny), (103, "/r/src/core/index.py", tiny), (104, "/r/third/pkg0/hand.py", hand), (105, "/r/third/pkg0/blank.py", " ")]
    f = files(spark, *rows)
    labels = lambda: {r.file_id: r.label for r in origin.file_origins(f, lib).where("file_id >= 100").collect()}
    want = {100: "vendored", 101: "vendored", 102: "generated", 103: "hand", 104: "hand", 105: "hand"}
    assert labels() == want
    alone = {i: origin.LABELS[int(np.argmax(origin.evidence(p, t, 0.0, 0)))] for i, p, t in rows if i >= 100}
    assert set(alone.values()) == {"hand"}
    monkeypatch.setattr(origin, "MANY", 2)  # a level at a time
    assert labels() == want


def test_belief_propagation_is_exact(spark, monkeypatch):
    rng = np.random.default_rng(2)
    paths = ["a/x", "a/y", "a/b/z", "c/w"]
    ev = rng.normal(size=(4, 5)) * 2
    rows = spark.createDataFrame([(i, "r", p, [float(v) for v in ev[i]]) for i, p in enumerate(paths)], "file_id long, repo_name string, path string, e array<double>")
    got = {r.file_id: np.array(r[1:6]) for r in origin.propagate(rows).collect()}
    monkeypatch.setattr(origin, "MANY", 1)
    for r in origin.propagate(rows).collect():
        np.testing.assert_allclose(np.array(r[1:6]), got[r.file_id], rtol=1e-9)
    edge = np.full((5, 5), origin.OTHER)
    np.fill_diagonal(edge, origin.SAME)
    prior = np.exp(np.array(origin.ROOT))
    total = np.zeros((4, 5))
    ex = np.exp(ev)
    for r in range(5):  # the root, then a, a/b and c
        for a in range(5):
            for b in range(5):
                for c in range(5):
                    w = prior[r] * edge[r, a] * edge[a, b] * edge[r, c]
                    m = [edge[a], edge[a], edge[b], edge[c]]
                    each = [m[i] * ex[i] for i in range(4)]
                    s = [x.sum() for x in each]
                    for i in range(4):
                        total[i] += w * each[i] * np.prod(s) / s[i]
    for i in range(4):
        p = np.exp(got[i] - got[i].max())
        np.testing.assert_allclose(p / p.sum(), total[i] / total[i].sum(), rtol=1e-6)


def test_small_world_graph_finds_neighbours():
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(20, 48))
    x = (centre[rng.integers(0, 20, 3000)] + 0.5 * rng.normal(size=(3000, 48))).astype(np.float32)
    x[7] = x[11]
    uuids = np.array([f"{i:06d}" for i in range(len(x))], dtype=object)
    ids, _ = neighbours.shard_neighbours(uuids, x, np.ones(len(x), bool))
    exact = neighbours.exact_neighbours(x, np.arange(len(x)))
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(ids, exact)]) > 0.9 and 11 in ids[7] and 7 in ids[11]


def test_groups_of_one_direction_are_ranked_by_uuid():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 384))
    x[:300] = x[0] * rng.uniform(0.2, 5.0, 300)[:, None]  # one direction, many lengths
    x[300:500] = x[300] + 1e-5 * rng.normal(size=(200, 384))  # copies with tiny noise
    x = x[rng.permutation(900)].astype(np.float32)
    uuids = np.array([f"{i:06d}" for i in range(len(x))], dtype=object)
    ids, _ = neighbours.shard_neighbours(uuids, x, np.ones(len(x), bool))
    exact = neighbours.exact_neighbours(x, np.arange(len(x)))
    assert len({r.tobytes() for r in x}) > 890
    share = np.array([len(set(a) & set(b)) / 10 for a, b in zip(ids, exact)])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    tied = ((unit @ unit.T) > 0.999999).sum(axis=1) > 24
    assert tied.sum() == 500 and share[tied].min() == 1.0 and share.mean() > 0.9


def test_nearest_pairs(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 8)).astype(np.float32)
    rows = [(f"u{i:02d}", [float(v) for v in x[i]], 1) for i in range(60)]
    same = [(f"c{i:02d}", [1.0] * 8, 1) for i in range(30)]  # a group of copies larger than what is asked for
    odd = [("n", None, 1), ("short", [1.0], 1), ("zero", [0.0] * 8, 1), ("nan", [float("nan")] * 8, 1), (None, [1.0] * 8, 1), ("hole", [1.0] * 7 + [None], 1)]
    df = spark.createDataFrame(rows + rows[:5] + same + odd, "uuid string, embedding array<float>, shard int")
    got = {tuple(r) for r in neighbours.nearest_pairs(df, top=10, dim=8, low=4).collect()}
    all_ = sorted(rows + same)
    full = np.array([r[1] for r in all_], dtype=np.float32)
    want = {tuple(sorted((all_[i][0], all_[j][0]))) for i, near in enumerate(neighbours.exact_neighbours(full, np.arange(len(full)))) for j in near}
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want) and all(a < b for a, b in got)
    assert {p for p in want if p[0][0] == p[1][0] == "c"} <= got
    assert neighbours.nearest_pairs(df.limit(0), dim=8, low=4).count() == 0


def _clustered(spark, n, dim, seed, clusters=60, hot=0):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(clusters, dim))
    x = (centre[rng.integers(0, clusters, n)] + 0.6 * rng.normal(size=(n, dim))).astype(np.float32)
    if hot:
        x[rng.permutation(n)[:hot]] = x[0] * rng.choice([0.5, 1.0, 2.0, 4.0], hot)[:, None]  # a third of all rows in one direction
    rows = [(f"{i:06d}", [float(v) for v in x[i]]) for i in rng.permutation(n)]
    return x, spark.createDataFrame(rows, "uuid string, embedding array<float>")


def _recall(x, pairs):
    got = {(int(r.uuid_a), int(r.uuid_b)) for r in pairs.collect()}
    exact = neighbours.exact_neighbours(x, np.arange(len(x)))
    want = {(min(i, int(j)), max(i, int(j))) for i, near in enumerate(exact) for j in near}
    return len(got & want) / len(want), len(got & want) / len(got)


@pytest.mark.parametrize("most,sample,n", [(200, 12_000, 2000), (400, 4_000, 6000)])
def test_many_shards(spark, monkeypatch, most, sample, n):
    """One level of cells (10 shards or more), then two (15 or more, on a sample that would not do for one level)."""
    monkeypatch.setattr(neighbours, "MOST", most)
    monkeypatch.setattr(neighbours, "SAMPLE", sample)
    monkeypatch.setattr(neighbours, "SPILL", 1.25)
    x, df = _clustered(spark, n, 16, 3)
    cells = neighbours._fit(df, n, 12, 16)
    placed = neighbours._assign(neighbours.usable(df, 16), cells, 16).toPandas()
    assert (len(cells.top) > 1) == (most == 400) and placed["shard"].nunique() >= 0.8 * n / most and placed.groupby(["shard", "part"])["member"].sum().max() <= 2.5 * most
    assert placed["member"].sum() == n and placed["uuid"].nunique() == n and placed["several"].any() and not placed["several"].all()
    found, right = _recall(x, neighbours.nearest_pairs(df, dim=16, low=12))
    assert found > 0.9 and right > 0.85, (found, right)


def test_copies_stay_few_as_shards_grow(spark, monkeypatch):
    """As many shards as 24 million vectors make with the real MOST: each vector still goes to two shards or fewer, and shards have one part."""
    monkeypatch.setattr(neighbours, "MOST", 20)
    x, df = _clustered(spark, 30_000, 32, 5, clusters=400)
    cells = neighbours._fit(df, 30_000, 16, 32)
    home, others = cells.place(x)
    assert len(cells.parts) > 1400 and 1 + (others >= 0).sum() / len(x) <= 2.0 and np.average(cells.parts[home]) < 1.1 and sum(map(len, cells.leaves)) <= 256 * 1000


def test_a_direction_with_a_third_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "HOT", 100)
    x, df = _clustered(spark, 1500, 16, 9, hot=500)
    left = neighbours._thinned(neighbours.usable(df, 16), 16, 10)
    assert left[1].count() >= 480 and left[0].count() + left[1].count() == 1500
    found, right = _recall(x, neighbours.nearest_pairs(df, dim=16, low=8))
    assert found > 0.97 and right > 0.95, (found, right)
    r = neighbours.recall(df, neighbours.nearest_pairs(df, dim=16, low=8), dim=16, one_in=10, chunk=400).first()
    assert r.queries > 100 and r.true_pairs == 10 * r.queries and r.recall > 0.97


@needs_tokenizer
def test_tree_encoding_is_exact():
    enc = bpe.bpe(tokenizer_path())
    rng = random.Random(3)
    pieces = ["a", " ", "  ", "\n", "\r\n", "'s", "'", "re", "'re ", "1", "١", "é", "漢", "😀", "<|endoftext|>", "_", "...", "\u00a0", "\u2003", "\x1c", "\x85", "\t", "İ", "x" * 30]
    for _ in range(300):
        t = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 120)))
        for leaf in (1, 3, 16):
            got = enc.encode(t, leaf=leaf, window=2)
            assert got == enc.leaf(t), (t, leaf)
        assert enc.decode(got) == t


@needs_tokenizer
def test_encoded_documents(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "Hello world", 0), (4, "ab " * 20_000, 0), (5, "q" * 20_000, 0)], "doc_id long, text string, n int")
    got = {r.doc_id: r.ids for r in bpe.encode_documents(df).collect()}
    assert got[1] == [] and got[2] == [] and got[3] == [15496, 995]
    back = {r.doc_id: r.text for r in bpe.decode_documents(bpe.encode_documents(df)).collect()}
    assert back[4] == "ab " * 20_000 and back[5] == "q" * 20_000
    assert {r.doc_id: r.n for r in bpe.count_tokens(df).collect()} == {k: len(v) for k, v in got.items()}


def test_bounds_and_best_fit():
    rng = np.random.default_rng(1)
    for _ in range(100):
        s = rng.integers(1, 101, rng.integers(1, 200))
        b = packing.best_fit_decreasing(s, 100)
        assert np.bincount(b, weights=s).max() <= 100 and packing.lower_bound(s, 100) <= b.max() + 1
    assert packing.lower_bound(np.array([51] * 10), 100) == 10 and packing.lower_bound(np.array([34] * 9), 100) == 5 and packing.lower_bound(np.array([], int)) == 0


@needs_tokenizer
def test_packing(spark):
    rng = random.Random(2)
    rows = [(i, " a" * rng.randrange(0, 30), 9, 9) for i in range(300)] + [(900, " a" * 205, 9, 9), (901, None, 9, 9), (902, "", 9, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int, part int")
    out = packing.pack(df, capacity=50, per_part=60)
    got = out.collect()
    size = {}
    for r in got:
        size.setdefault(r.container, []).append((r.offset, r.n_tokens))
    for v in size.values():  # items stand one after the other, within the capacity
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 50
    total = {d: len(t or "") // 2 for d, t, *_ in rows}
    per = {}
    for r in got:
        per[r.doc_id] = per.get(r.doc_id, 0) + r.n_tokens
    assert per == {d: n for d, n in total.items() if n}
    assert [r.n_tokens for r in sorted(got, key=lambda r: r.piece) if r.doc_id == 900] == [50, 50, 50, 50, 5]
    s = packing.summary(out, df, capacity=50).first()
    assert s.above <= max(1, s.lower_bound // 20)
    assert packing.pack(df.limit(0)).count() == 0


def test_quality_of_texts():
    m = quality.Model()
    prose = "We keep the graph in memory because it is small, and it has never been slow.\nThis is why there is no cache here."
    assert quality.measure(prose, m)["prose_share"] > 0.9
    for junk in ("- red fox\n- blue bird\n- old tree\n- new leaf\n- wet stone", "| a | b | c |\n|---|---|---|\n| 1 | 2 | 3 |\n| 4 | 5 | 6 |", "def f(x):\n    y = g(x)\n    return y\nclass A:\n    pass", "tree module tree module payload tree tree module tree payload " * 8, "Home | Docs | Search | Next | Top\n" * 5, "~!@#$ %^&*() <>?|{} " * 9):
        assert quality.measure(junk, m)["prose_share"] < 0.5, junk
    for short in ("looks good to me but maybe we should try it again", "我们先读取文件，然后再建立它们之间的关系。", "ok so i ran it again and it did not come back"):
        assert quality.measure(short, m)["prose_share"] > 0.5, short
    s = quality.measure(None, m)
    assert s["n_words"] == 0 and s["prose_share"] is None and quality.measure(" \n\t", m)["n_lines"] == 0


def test_repeated_blocks_are_no_prose():
    block = "We keep the graph in memory because it is small. It has never been slow for the people who read it.\nThis is why there is no cache here, and none is planned. If that should change we will write about it first.\nThe tests of the store are run at night, so that nobody has to wait for them."
    m = quality.Model()
    for text in ("\n".join([block] * 25), " ".join([block] * 25).replace("\n", " "), " ".join([block] * 25).replace("\n", " ").replace(".", ""), "\n".join([block.splitlines()[0]] * 25)):
        words = text.split()
        wrapped = "\n".join(" ".join(words[i : i + 13]) for i in range(0, len(words), 13))
        for t in (text, wrapped):
            assert quality.measure(t, m)["prose_share"] < 0.1, t[:80]
    assert quality.measure(block, m)["prose_share"] > 0.9 and quality.measure(block + "\n" + block, m)["prose_share"] > 0.9
    assert quality.repeated(list("abcdefghij") * 3).sum() == 20 and not quality.repeated(list("abcdefghij") * 2).any() and not len(quality.repeated([]))


def test_quality_operator(spark):
    df = spark.createDataFrame([(1, "It is what it was, and that is all there is to it.", 0.1), (2, "- a\n- b\n- c", 0.1), (3, None, 0.1), (4, "", 0.1), (4, "", 0.1)], "doc_id long, text string, prose_share double")
    got = {r.doc_id: r for r in quality.text_quality(df).collect()}
    assert quality.text_quality(df).count() == 5 and got[3].n_words == 0 and got[3].prose_share is None and got[1].prose_share > 0.9
    assert [r.doc_id for r in quality.not_prose(df).collect()] == [2]
    assert quality.not_prose(df.limit(0)).count() == 0


def test_stack_traces_are_no_prose():
    trace = "Traceback:\n" + "\n".join(f"  at RingIndex.detachQueue{i}(source.java:{i})" for i in range(12))
    assert quality.measure(trace, quality.Model())["prose_share"] < 0.1


def test_what_only_the_neighbours_decide():
    """Ablation: messages among the lines of a log read as prose line by line; the chain, as sticky as real corpora make it, knows better.
    A narrow column of text is prose either way, more surely so with the chain."""
    said = ["could not find the file that it was to read", "so there is no node for it in the graph", "we do not know who the caller was", "all of them will be tried again when it is up", "it was not the one that is in use", "and then there was no more room for the rest"]
    log = "\n".join(f"[ERROR] RingIndex.detachQueue{i}(source.java:{i * i});\n{x}" for i, x in enumerate(said))
    sticky = np.full((4, 4), 0.04 / 3)
    np.fill_diagonal(sticky, 0.96)
    m = quality.Model(trans=sticky)
    assert quality.measure(log, m.alone())["prose_share"] > 0.4 > 0.1 > quality.measure(log, m)["prose_share"]
    words = "It was the plan that we would read all of the files again. But the cache kept stale edges from older builds around until someone removed them.".split()
    narrow = "\n".join(" ".join(words[i : i + 4]) for i in range(0, len(words), 4))
    assert quality.measure(narrow, m)["prose_share"] > 0.95 > quality.measure(narrow, m.alone())["prose_share"]


def test_fit_follows_the_corpus():
    """Counts of neighbouring lines move transitions and emissions away from the start."""
    m = quality.Model()
    seq = [np.array(quality.encode(quality.observe("\n".join(["- red fox"] * 6 + ["| a | b | c |"] * 6))[0]))] * 40
    first = np.bincount([s[0] for s in seq], minlength=quality.N_CODES).astype(float)
    x, y = np.concatenate([s[:-1] for s in seq]), np.concatenate([s[1:] for s in seq])
    key, n = np.unique(x * quality.N_CODES + y, return_counts=True)
    got = m.fitted(first, (key // quality.N_CODES, key % quality.N_CODES, n.astype(float)))
    assert got.trans[1, 1] > 0.8 and got.start[1] > 0.6 and got.start[0] < m.start[0] and np.allclose(got.trans.sum(axis=1), 1) and all(np.allclose(e.sum(axis=0), 1) for e in got.emit)
    assert m.fitted(np.zeros(quality.N_CODES), (np.zeros(0, int), np.zeros(0, int), np.zeros(0))) is m


def test_forward_backward_against_brute_force():
    import itertools

    m = quality.Model()
    texts = [np.array(quality.encode(quality.observe(t)[0])) for t in ("- a\nWe are in it.\n| a | b | c |", "- a", "x\ny = f(z);", "")]
    for codes, got in zip(texts, m.posteriors(texts)):
        want = np.zeros((len(codes), 4))
        for path in itertools.product(range(4), repeat=len(codes)):
            if not path:
                continue
            p = m.start[path[0]] * m.like[codes[0], path[0]]
            for k in range(1, len(codes)):
                p *= m.trans[path[k - 1], path[k]] * m.like[codes[k], path[k]]
            for k, s in enumerate(path):
                want[k, s] += p
        assert got.shape == want.shape
        if len(codes):
            np.testing.assert_allclose(got, want / want.sum(axis=1, keepdims=True), rtol=1e-9)
