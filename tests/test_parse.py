"""Extraction: what each language must yield, on snippets of our own."""

import pytest

from graphloom.parse import EXTRACTORS, extract, register
from graphloom.parse.lexers import LexError, lex


def rows(language, text, path="/r/a.x"):
    return extract(language, text, path, "repo")


def by(language, text, name, kind=None):
    return next(r for r in rows(language, text) if r["name"] == name and (kind is None or r["kind"] == kind))


def intents(language, text):
    return {(i["intent_type"], i["target"], i["receiver"]) for r in rows(language, text) for i in r["intents"]}


JAVA = """
package x;
/** Keeps chats. */
@Service("a")
public class NoteShelf extends Base<String> implements Store, Closeable {
    private final Repo repo = new Repo();
    // adds one
    public void add(String text, int n) { this.repo.save(text); helper(n); a.b().run(); }
}
interface Store { void put(User u); }
enum Color { RED, GREEN }
"""


def test_java():
    c = by("java", JAVA, "NoteShelf")
    assert (c["kind"], c["docstring"], c["decorators"]) == ("class", "Keeps chats.", ['@Service("a")'])
    m = by("java", JAVA, "add")
    assert (m["fqn"], m["signature"], m["enclosing_class"], m["docstring"]) == ("NoteShelf.add", "(String text, int n)", "NoteShelf", "adds one")
    assert {r["kind"] for r in rows("java", JAVA)} >= {"class", "interface", "method", "enum"}
    got = intents("java", JAVA)
    assert {("Call", "save", "this.repo"), ("Call", "helper", None), ("Call", "run", None), ("Call", "Repo", None), ("Extends", "Base", None), ("Implements", "Store", None), ("TypeReference", "User", None), ("TypeReference", "Service", None)} <= got


KOTLIN = """
/** Data. */
data class Event(val id: Int, val name: String) : Base(id), Marker {
    val total: Int = 3
    fun load(n: Int): Int { Config.instance.getUser(1); return n }
    companion object { val X = 1 }
}
interface Marker
object Single { fun go() = run() }
fun String.shout(): String = this.uppercase()
"""


def test_kotlin():
    kinds = {r["name"]: r["kind"] for r in rows("kotlin", KOTLIN)}
    assert kinds["Event"] == "kotlin_class" and kinds["Marker"] == "kotlin_interface" and kinds["Single"] == "kotlin_object" and kinds["shout"] == "kotlin_function" and kinds["load"] == "kotlin_method" and kinds["total"] == "kotlin_property"
    assert ": Int" in by("kotlin", KOTLIN, "load")["signature"]
    got = intents("kotlin", KOTLIN)
    assert {("Extends", "Base", None), ("Implements", "Marker", None), ("Call", "getUser", "Config.instance")} <= got


TS = """
import { Component } from "x";
@Component({ imports: [ShopPanel] })
export class ShopModule extends Root implements OnInit {
  private count: number = 0;
  constructor(private s: TallyService) {}
  @Input() load(id: string): Promise<void> { return this.s.fetch<User>(id, onDone); }
}
interface Shape { area(): number; }
enum Level { Low, High }
export const twice = async (n: number): Promise<number> => { return n * 2; };
"""


def test_typescript():
    kinds = {(r["name"], r["kind"]) for r in rows("typescript", TS)}
    assert {("ShopModule", "class"), ("Shape", "interface"), ("Level", "enum"), ("load", "method"), ("twice", "function"), ("count", "constant"), ("area", "method")} <= kinds
    assert by("typescript", TS, "load")["fqn"] == "ShopModule.load"
    got = intents("typescript", TS)
    assert {("TypeReference", "ShopPanel", None), ("TypeReference", "TallyService", None), ("Extends", "Root", None), ("Implements", "OnInit", None), ("Call", "fetch", "this.s"), ("ValueReference", "onDone", None)} <= got


JS = """
class View extends Base {
  static make() { return new View(); }
  render() { return <Panel id="main" className="wide dark"><b/></Panel>; }
}
function go(cb) { document.getElementById('top').classList.add('on'); el.className = 'off'; document.querySelector('#nav'); list.map(cb); }
var x = 3;
"""


def test_javascript():
    got = intents("javascript", JS)
    assert {("DomElementReference", "top", None), ("DomElementReference", "nav", None), ("CssClassUsage", "on", None), ("CssClassUsage", "off", None), ("Extends", "Base", None), ("Call", "View", None), ("Call", "Panel", None)} <= got
    kinds = {(r["name"], r["kind"]) for r in rows("javascript", JS)}
    assert {("main", "html_id"), ("wide", "html_class"), ("dark", "html_class"), ("make", "method"), ("go", "function")} <= kinds
    assert len(rows("javascript", "function f() {}\nvar y = 1;")) == 2


RUST = """
//! crate
/// Counts.
#[derive(Debug)]
pub struct Ticker { n: Inner }
pub trait Steppable { fn inc(&mut self); }
impl Steppable for Ticker {
    /// One more.
    fn inc(&mut self) { self.n.bump(); helper(1); println!("{}", self.n); Other::make(); }
}
pub const MAX: usize = 3;
macro_rules! twice { ($x:expr) => { $x * $x } }
pub async fn run<'a>(x: &'a str) -> Result<(), E> { match y { Kind::A => 1, _ => 2 } }
"""


def test_rust():
    kinds = {(r["name"], r["kind"]) for r in rows("rust", RUST)}
    assert {("Ticker", "rust_struct"), ("Steppable", "rust_trait"), ("inc", "rust_method"), ("MAX", "rust_constant"), ("twice", "rust_macro_def"), ("run", "rust_function")} <= kinds
    c = by("rust", RUST, "Ticker")
    assert c["docstring"] == "Counts." and ("Implements", "Steppable", None) in {(i["intent_type"], i["target"], i["receiver"]) for i in c["intents"]}
    assert by("rust", RUST, "twice")["fqn"] == "twice!"
    got = intents("rust", RUST)
    assert {("RustMacroCall", "println", None), ("Call", "bump", "n"), ("Call", "make", None), ("TypeReference", "Inner", None)} <= got
    assert ("TypeReference", "Kind", None) not in got


PY = '''
import a.b
from m import n as k
LIMIT = 3
@dataclass
class Dog(Animal, metaclass=Meta):
    """A dog."""
    def bark(self, x=1):
        # loud
        self.voice.play(on_end=finish)
        return fetch(x)
twice = lambda v: v * v
try:
    main()
except ValueError, e:
    print "old"
'''


def test_python():
    c = by("python", PY, "Dog")
    assert (c["docstring"], c["decorators"]) == ("A dog.", ["@dataclass"])
    m = by("python", PY, "bark")
    assert (m["kind"], m["fqn"], m["signature"], m["inline_comments"]) == ("python_method", "Dog.bark", "(self, x=1)", ["loud"])
    got = intents("python", PY)
    assert {("Extends", "Animal", None), ("Call", "play", "self.voice"), ("ValueReference", "finish", None), ("Call", "fetch", None), ("TypeReference", "a", None), ("TypeReference", "m", None), ("TypeReference", "k", None), ("Call", "main", None)} <= got
    assert by("python", PY, "<module>")["kind"] == "python_module" and by("python", PY, "twice")["kind"] == "python_function" and by("python", PY, "LIMIT")["kind"] == "python_constant"
    assert [r["name"] for r in rows("python", "import os\nimport sys\n")] == ["<module>"]


def test_markup():
    h = '<html><link rel="stylesheet" href="app.css"><my-tag id="x" class="a b"></my-tag><script src="app.js"></script></html>'
    assert {("my-tag", "html_element"), ("x", "html_id"), ("a", "html_class"), ("b", "html_class")} <= {(r["name"], r["kind"]) for r in rows("html", h)}
    assert {("HtmlFileImport", "app.js", None), ("CssFileImport", "app.css", None)} == intents("html", h)
    s = "/* .no */ .a, #b { --c: 1; color: $d } @mixin m($x) { top: 0 } @function f() { @return 1 } $v: 3;"
    assert {(r["fqn"], r["kind"]) for r in rows("scss", s)} >= {(".a", "css_class"), ("#b", "css_id"), ("--c", "css_variable"), ("@mixin m", "scss_mixin"), ("@function f", "scss_function"), ("$v", "scss_variable")}
    assert not rows("css", "@keyframes k { .from { top: 0 } }")


def test_ids_are_stable_and_unique():
    text = "class A { void f(int x) {} void f(String y) {} }"
    a, b = rows("java", text), rows("java", text)
    assert [r["uuid"] for r in a] == [r["uuid"] for r in b] and len({r["uuid"] for r in a}) == len(a)


@pytest.mark.parametrize("language", sorted(EXTRACTORS))
def test_never_raises(language):
    for text in (None, "", "  \n", "﻿", "class {{{ ((", "def f(:\n  '''", "\x00\x01", "x" * 50_000, "(" * 3000, '"unended', "`${", "/* unended"):
        extract(language, text, "/p", "r")
    assert extract("cobol", "x", "/p", "r") == []


def test_another_extractor_can_be_registered():
    old = EXTRACTORS["css"]
    try:
        register("css", lambda s: s.add("z", "css_class", 0, 1))
        assert rows("css", "anything")[0]["name"] == "z"
    finally:
        register("css", old)


def test_lexers():
    assert [t for k, t, _ in lex("javascript", "a = b / c; d = /x[/]y/g.test(`q${ {a: `n`} }r`)") if k != "nl"][:8] == ["a", "=", "b", "/", "c", ";", "d", "="]
    assert [k for k, _, _ in lex("python", "if x:\n  f'{a!r:>{w}} {b[\"k\"]}'\n")].count("de") == 1
    assert len(lex("rust", "r#\"a \"q\" b\"# 'x' 'life /* a /* b */ c */")) == 4 - 0
    for language, bad in (("java", '"open'), ("kotlin", '"${'), ("rust", "/* /* */"), ("typescript", "`a"), ("python", "'''x")):
        with pytest.raises(LexError):
            lex(language, bad)


def test_what_follows_a_broken_place_is_read():
    """An open bracket ends with its block, a Rust string that never ends with its line; nested functions of Python are their own."""
    names = lambda lang, t: [(r["name"], r["kind"]) for r in extract(lang, t, "/f", "r")]
    assert ("b", "method") in names("java", "class A { void a() { p(q, (1; }\n static int b(T[] x) { return 1; } }")
    assert ("g", "rust_method") in names("rust", 'struct S { a: u8 }\nimpl S {\n fn f(&self) {\n  let s = "open;\n }\n pub fn g(&self) {\n  h("x");\n }\n}\n')
    assert ("g", "rust_function") not in names("rust", 'fn f() { let s = "one;\n two\n"; }\n')
    assert names("python", "class A:\n    def f(self):\n        def g(): pass\n")[1:] == [("f", "python_method"), ("g", "python_function")]
