"""Extraction from programming languages, over tokens: declarations with their spans, and references."""

from __future__ import annotations

import re

from graphloom.parse.lexers import lex
from graphloom.parse.model import Source, strip_marks

_OPEN = {"(": ")", "[": "]", "{": "}"}
#: Before an object type among type arguments.
_TYPE_BEFORE = frozenset(("extends", "=", ",", "|", "&", "<", ":"))

# Words that no call, declaration or callback is named.
WORDS = {
    "java": "if for while switch catch return new throw else do try synchronized assert case super this instanceof yield class interface enum extends implements",
    "kotlin": "if for while when catch return throw else do try super this is in as fun class interface object val var constructor init",
    "javascript": "if for while switch catch return new throw else do try typeof instanceof in of delete void yield await super this function class extends case import export default const let var async null undefined true false with static get set from",
    "rust": "if for while loop match return else in as fn impl struct enum trait mod use let mut ref move pub unsafe async await crate self super Self where const static type",
    "python": "if for while return in is not and or elif else with as assert del lambda raise yield except print None True False self cls await async from import pass",
}
WORDS["typescript"] = WORDS["javascript"] + " interface enum type public private protected readonly abstract implements declare"
_KEY = {k: frozenset(v.split()) for k, v in WORDS.items()}


class Tokens:
    """The tokens without comments and line ends, with matching brackets."""

    def __init__(self, src: Source):
        self.src = src
        self.all = lex(src.language, src.text, tolerant=True)
        self.lead: dict[int, list] = {}  # index of a token -> comments right before it
        self.toks: list[tuple[str, str, int]] = []
        pending: list[tuple[int, int]] = []
        for kind, t, at in self.all:
            if kind == "com":
                src.comments.append((at, at + len(t)))
                pending.append((at, at + len(t)))
            elif kind != "nl" or src.language == "python":
                if pending and kind not in ("nl", "in", "de"):
                    self.lead[len(self.toks)] = pending
                    pending = []
                self.toks.append((kind, t, at))
        self.pair: dict[int, int] = {}
        stack: list[int] = []
        for i, (kind, t, _) in enumerate(self.toks):
            if kind in ("op", "sh") and (t in _OPEN or kind == "sh"):
                stack.append(i)
            elif kind == "st" or (kind == "op" and t in (")", "]", "}")):
                k = len(stack) - 1
                while k >= 0:
                    head = self.toks[stack[k]]
                    if (kind == "st") == (head[0] == "sh") and (kind == "st" or _OPEN[head[1]] == t):
                        break
                    # a brace closes what is left open within it; other brackets close nothing beyond a brace
                    k = k - 1 if t == "}" or head[1] != "{" else -1
                if k >= 0:
                    for j in stack[k + 1 :]:
                        self.pair[j] = i - 1
                    self.pair[stack[k]] = i
                    del stack[k:]
        n = len(self.toks)
        for j in stack:
            self.pair.setdefault(j, n - 1)
        self.opens = {j: i for i, j in self.pair.items()}
        self.closed: dict[int, int] = {}  # `<` -> the `>` that belongs to it, however far away; none across `{` or `;` or out of a bracket
        stack = []
        for i, (kind, t, _) in enumerate(self.toks):
            if kind != "op":
                continue
            if t in ("<", "(", "["):
                stack.append(i)
            elif t == ">":
                if stack and self.toks[stack[-1]][1] == "<":
                    self.closed[stack.pop()] = i
            elif t in (")", "]"):
                while stack and self.toks[stack.pop()][1] == "<":
                    pass
            elif t == "{" and stack and self.toks[stack[-1]][1] in ("<", "{") and self.toks[i - 1][1] in _TYPE_BEFORE:
                stack.append(i)  # an object type
            elif t == "}" and any(self.toks[j][1] == "{" for j in stack):
                while self.toks[stack.pop()][1] != "{":
                    pass
            elif t == ";" and any(self.toks[j][1] == "{" for j in stack):
                while self.toks[stack[-1]][1] != "{":
                    stack.pop()
            elif t in ("{", "}", ";"):
                stack = []

    def text(self, i: int) -> str:
        return self.toks[i][1] if 0 <= i < len(self.toks) else ""

    def kind(self, i: int) -> str:
        return self.toks[i][0] if 0 <= i < len(self.toks) else ""

    def at(self, i: int) -> int:
        return self.toks[i][2] if i < len(self.toks) else len(self.src.text)

    def end(self, i: int) -> int:
        return self.toks[i][2] + len(self.toks[i][1]) if i < len(self.toks) else len(self.src.text)

    def after(self, i: int) -> int:
        """The index after the bracket that opens at i."""
        return self.pair.get(i, len(self.toks) - 1) + 1

    def span(self, i: int, j: int) -> str:
        return re.sub(r"\s+", " ", self.src.text[self.at(i) : self.end(j)]).strip()

    def angles(self, i: int) -> int:
        """The index after the angle brackets that open at i, or i."""
        return self.closed.get(i, i - 1) + 1

    def doc(self, i: int) -> str | None:
        """The comments right before token i, with no blank line between."""
        rows = self.lead.get(i, [])
        keep: list[tuple[int, int]] = []
        upper = self.at(i)
        for a, b in reversed(rows):
            if self.src.text.count("\n", b, upper) > 1:
                break
            if not (self.src.language == "rust" and self.src.text.startswith(("//!", "/*!"), a)):
                keep.insert(0, (a, b))
            upper = a
        return strip_marks("\n".join(self.src.text[a:b] for a, b in keep)) or None


def _receiver(t: Tokens, i: int) -> str | None:
    """What stands before the dot before token i, as names joined by dots; null for a call's or bracket's result."""
    parts: list[str] = []
    j = i - 1
    while t.text(j) in (".", "?.", "!!"):
        if t.text(j) == "!!":
            j -= 1
            continue
        if t.kind(j - 1) != "id":
            return None
        parts.insert(0, t.text(j - 1))
        j -= 2
    return ".".join(parts) or None


def _calls(t: Tokens, skip: set[int], language: str, types: bool) -> None:
    """Calls, object creations and references to types, callbacks, page elements and style classes."""
    src, words = t.src, _KEY[language]
    ecma = language in ("javascript", "typescript")
    for i, (kind, name, at) in enumerate(t.toks):
        if kind != "id" or i in skip or name in words:
            continue
        before, nxt = t.text(i - 1), t.text(i + 1)
        if name[:1] == "@":
            if len(name) > 1:
                src.refer("TypeReference", name[1:], at)
            continue
        if name[:1] == "#":
            name = name[1:]
        call = i + 1
        if nxt == "<":
            j = t.angles(i + 1)
            if j > i + 1 and t.text(j) == "(":
                call = j
        if before == "@":
            src.refer("TypeReference", name, at)
        elif t.text(call) == "(" or (language == "kotlin" and nxt == "{" and before == "."):
            if before in (".", "?."):
                src.refer("Call", name, at, _receiver(t, i))
            else:
                src.refer("Call", name, at)
            if ecma and t.text(call) == "(":
                close = t.pair.get(call, call)
                arg = t.text(call + 1) if t.kind(call + 1) == "str" else ""
                value = arg[1:-1]
                if name == "getElementById" and value:
                    src.refer("DomElementReference", value, at)
                elif name in ("querySelector", "querySelectorAll") and re.fullmatch(r"#[\w-]+", value):
                    src.refer("DomElementReference", value[1:], at)
                elif name in ("add", "remove", "toggle", "contains") and t.text(i - 2) == "classList" and value:
                    src.refer("CssClassUsage", value, at)
                depth_start = call + 1
                while depth_start < close:  # plain names among the arguments are callbacks
                    if t.kind(depth_start) == "id" and t.text(depth_start) not in words and t.text(depth_start - 1) in ("(", ",") and t.text(depth_start + 1) in (",", ")"):
                        src.refer("ValueReference", t.text(depth_start), t.at(depth_start))
                    depth_start = t.after(depth_start) if t.text(depth_start) in _OPEN and t.kind(depth_start) == "op" else depth_start + 1
        elif ecma and name == "className" and nxt == "=" and t.kind(i + 2) == "str" and before == ".":
            for c in t.text(i + 2)[1:-1].split():
                src.refer("CssClassUsage", c, at)
        elif ecma and before == "<" and name[:1].isupper() and (t.text(i - 2) in ("(", "return", ">", "{", ",", "=>", "?", ":", "&&", "}", "=")):
            src.refer("Call", name, at)
        elif types and name[:1].isupper() and before not in (".", "?.", "::"):
            src.refer("TypeReference", name, at)


def _jsx(t: Tokens) -> None:
    """Literal id and className attributes of JSX elements, as page elements."""
    for m in re.finditer(r"<[A-Za-z][\w.]*(?:\s+[\w-]+(?:=(?:\"[^\"]*\"|'[^']*'|\{[^{}]*\}))?)*\s*/?>", t.src.text):
        for a in re.finditer(r"\s(id|className)=(?:\"([^\"]*)\"|'([^']*)')", m.group()):
            value, at = (a[2] or a[3] or ""), m.start() + a.start() + 1
            if a[1] == "id":
                if value.strip():
                    t.src.add(value.strip(), "html_id", at, m.start() + a.end())
            else:
                for c in value.split():
                    t.src.add(c, "html_class", at, m.start() + a.end())


def _names(t: Tokens, i: int, stop: tuple[str, ...]) -> list[tuple[str, int, bool]]:
    """(name, index, called) of the types listed from i up to one of `stop`."""
    out, j = [], i
    while j < len(t.toks) and t.text(j) not in stop:
        if t.kind(j) == "id" and t.text(j) not in ("by",):
            k = j
            while t.text(k + 1) == "." and t.kind(k + 2) == "id":
                k += 2
            nxt = t.angles(k + 1)
            out.append((t.text(k), k, t.text(nxt) == "("))
            j = nxt
            if t.text(j) == "(":
                j = t.after(j)
            continue
        j = t.after(j) if t.text(j) in ("(", "[") and t.kind(j) == "op" else j + 1
    return out


def _decorated(t: Tokens, i: int, language: str) -> tuple[int, list[str]]:
    """The first token of the declaration whose name or keyword is at i, back over modifiers and annotations; the annotations."""
    j, deco = i, []
    mods = frozenset("public private protected static final abstract native synchronized default strictfp open override data sealed inner internal suspend inline operator infix lateinit const enum annotation value companion external tailrec export async readonly declare get set".split())
    while j > 0:
        p = t.text(j - 1)
        if t.kind(j - 1) == "id" and p in mods:
            j -= 1
            continue
        if t.kind(j - 1) == "id" and (t.text(j - 2) == "@" or p[:1] == "@") and language != "rust":
            k = j - 1 if p[:1] == "@" else j - 2
            deco.insert(0, t.span(k, j - 1))
            j = k
            continue
        if p == ")":
            o = t.opens.get(j - 1)
            if o is not None and t.text(o) == "(" and t.kind(o - 1) == "id" and (t.text(o - 2) == "@" or t.text(o - 1)[:1] == "@"):
                k = o - 1 if t.text(o - 1)[:1] == "@" else o - 2
                deco.insert(0, t.span(k, j - 1))
                j = k
                continue
        break
    return j, deco


def _classes(t: Tokens, language: str, heads: dict[str, str], skip: set[int]) -> list[tuple[int, int, str]]:
    """Adds classes and the like; returns (index of the opening brace, of the closing one, name) of each body."""
    src, bodies = t.src, []
    for i, (kind, word, _) in enumerate(t.toks):
        if kind != "id" or word not in heads or t.text(i - 1) in (".", "::", "?."):
            continue
        n = i + 1
        if t.kind(n) != "id" or (word == "record" and t.text(n + 1) not in ("(", "<")):
            continue
        if word in ("object", "type") and language != "kotlin":
            continue
        name = t.text(n)
        skip.add(n)
        j = t.angles(n + 1)
        if t.text(j) == "(" and language in ("java", "kotlin"):
            j = t.after(j)
        stop = ("{", ";")
        limit = j
        while limit < len(t.toks) and t.text(limit) not in stop:
            if language == "kotlin" and t.kind(limit) == "id" and t.text(limit) in ("class", "fun", "val", "var", "object", "interface", "import") or t.text(limit) == "}":
                break
            limit = t.after(limit) if t.text(limit) in ("(", "[") and t.kind(limit) == "op" else limit + 1
        mode = None
        k = j
        while k < limit:
            w = t.text(k)
            if w in ("extends", "implements", "permits") or (w == ":" and language == "kotlin" and mode is None):
                mode = w
                for ref, at, called in _names(t, k + 1, ("{", "extends", "implements", "permits", ";", "where") + (() if language != "kotlin" else ("class", "fun", "val", "var", "object"))):
                    if at >= limit:
                        break
                    as_parent = mode == "extends" or (mode == ":" and called)
                    if mode != "permits":
                        src.refer("Extends" if as_parent else "Implements", ref, t.at(at))
                    if language in ("typescript", "javascript"):
                        skip.add(at)
            k += 1
        start, deco = _decorated(t, i, language)
        body = t.text(limit) == "{"
        close = t.pair.get(limit, limit) if body else max(n, limit - 1)
        doc = t.doc(start)
        src.add(name, heads[word], t.at(start), t.end(close), t.at(i), docstring=doc, decorators=deco)
        if body:
            bodies.append((limit, close, name))
    return bodies


def _enclosing(bodies: list[tuple[int, int, str]], i: int) -> tuple[int, int, str] | None:
    """The innermost body around token i."""
    inside = [b for b in bodies if b[0] < i < b[1]]
    return max(inside) if inside else None


def java(src: Source) -> None:
    t, skip = Tokens(src), set()
    heads = {"class": "class", "interface": "interface", "enum": "enum", "record": "class"}
    bodies = _classes(t, "java", heads, skip)
    brace_of = _owners(t)
    for i, (kind, name, _) in enumerate(t.toks):
        if kind != "id" or name in _KEY["java"] or t.text(i + 1) != "(":
            continue
        b = _enclosing(bodies, i)
        if not b or brace_of[i] != b[0]:
            continue
        prev = t.text(i - 1)
        if not (t.kind(i - 1) == "id" and prev not in ("new", "return", "throw", "else", "@") or prev in (">", "]")) or t.text(i - 2) == "@":
            continue
        close = t.pair.get(i + 1, i + 1)
        j = close + 1
        while t.kind(j) == "id" or t.text(j) in (",", ".", "[", "]"):
            j += 1
        if t.text(j) not in ("{", ";"):
            continue
        skip.add(i)
        s = i - 1
        while s > b[0] and t.text(s - 1) not in (";", "{", "}"):
            s -= 1
        deco = re.findall(r"@[\w.]+(?:\([^)]*\))?", src.text[t.at(s) : t.at(i)])
        src.add(name, "method", t.at(s), t.end(t.pair.get(j, j) if t.text(j) == "{" else j), t.at(i), signature=t.span(i + 1, close), enclosing=b[2], docstring=t.doc(s), decorators=deco)
    _calls(t, skip, "java", True)


def _owners(t: Tokens) -> list[int]:
    """For each token the index of the innermost bracket around it, -1 for none."""
    out, stack = [], []
    for i, (kind, w, _) in enumerate(t.toks):
        while stack and t.pair.get(stack[-1], len(t.toks)) <= i:
            stack.pop()
        out.append(stack[-1] if stack else -1)
        if kind == "op" and w in _OPEN:
            stack.append(i)
    return out


def kotlin(src: Source) -> None:
    t, skip = Tokens(src), set()
    bodies = _classes(t, "kotlin", {"class": "kotlin_class", "interface": "kotlin_interface", "object": "kotlin_object"}, skip)
    for e in src.entities:
        if e.kind == "kotlin_object" and re.search(r"\bcompanion\s+object\b", src.text[e.start : e.end].split("{", 1)[0]):
            e.kind = "kotlin_companion_object"
    owner = _owners(t)
    for i, (kind, w, _) in enumerate(t.toks):
        if kind != "id":
            continue
        if w == "fun" and t.text(i + 1) != "interface":
            j = t.angles(i + 1)
            while t.kind(j) == "id" and (t.text(j + 1) in (".", "?") or (t.text(j + 1) == "<" and t.text(t.angles(j + 1)) == ".")):
                j = t.angles(j + 1) if t.text(j + 1) == "<" else j + 1
                while t.text(j) in ("?", "."):
                    j += 1
            if t.kind(j) != "id" or t.text(j + 1) != "(":
                continue
            skip.add(j)
            close = t.pair.get(j + 1, j + 1)
            k = close + 1
            if t.text(k) == ":":
                k += 1
                while t.kind(k) == "id" or t.text(k) in (".", "?", "<", ">", ",", "*"):
                    if t.kind(k) == "id" and t.text(k) in ("fun", "val", "var", "class", "override", "private", "public", "internal", "suspend", "open", "abstract", "object"):
                        break
                    k = t.angles(k) if t.text(k) == "<" and t.angles(k) > k else k + 1
            sig = t.span(j + 1, k - 1)
            last = t.pair.get(k, k) if t.text(k) == "{" else k - 1
            if t.text(k) == "=":
                line = src.line(t.at(k + 1))
                last = k + 1
                while last + 1 < len(t.toks) and (src.line(t.at(last + 1)) == line or t.text(last + 1) in (".", "?.", "?:")):
                    last = t.pair.get(last + 1, last + 1)
                    line = src.line(t.at(last))
            b = _enclosing(bodies, i)
            member = b is not None and owner[i] == b[0]
            s, deco = _decorated(t, i, "kotlin")
            src.add(t.text(j), "kotlin_method" if member else "kotlin_function", t.at(s), t.end(last), t.at(i), signature=sig, enclosing=b[2] if member else None, docstring=t.doc(s), decorators=deco)
        elif w in ("val", "var") and t.kind(i + 1) == "id":
            b = _enclosing(bodies, i)
            if owner[i] == -1 or (b and owner[i] == b[0]):
                s, deco = _decorated(t, i, "kotlin")
                skip.add(i + 1)
                line, last = src.line(t.at(i)), i + 1
                while last + 1 < len(t.toks) and src.line(t.at(last + 1)) == line and t.text(last + 1) != "}":
                    last = t.pair.get(last + 1, last + 1)
                    line = src.line(t.at(last))
                src.add(t.text(i + 1), "kotlin_property", t.at(s), t.end(last), t.at(i), enclosing=b[2] if b and owner[i] == b[0] else None, docstring=t.doc(s), decorators=deco)
    _calls(t, skip, "kotlin", True)


def ecma(src: Source) -> None:
    language = src.language
    ts = language == "typescript"
    t, skip = Tokens(src), set()
    heads = {"class": "class"} | ({"interface": "interface", "enum": "enum"} if ts else {})
    bodies = _classes(t, language, heads, skip)
    owner = _owners(t)
    words = _KEY[language]
    for i, (kind, w, _) in enumerate(t.toks):
        if kind != "id":
            continue
        b = _enclosing(bodies, i)
        member = b is not None and owner[i] == b[0]
        if w == "function":
            j = i + 2 if t.text(i + 1) == "*" else i + 1
            if t.kind(j) != "id":
                continue
            p = t.angles(j + 1)
            if t.text(p) != "(":
                continue
            skip.add(j)
            close = t.pair.get(p, p)
            k = _body(t, close + 1)
            s, _deco = _decorated(t, i, language)
            src.add(t.text(j), "function", t.at(s), t.end(t.pair.get(k, k) if t.text(k) == "{" else close), t.at(i), signature=t.span(p, close), docstring=t.doc(s))
        elif w in ("const", "let", "var") and t.kind(i + 1) == "id" and (owner[i] == -1 or t.text(owner[i]) == "{"):
            j = i + 2
            if ts and t.text(j) == ":":
                while j < len(t.toks) and t.text(j) not in ("=", ";"):
                    j = t.after(j) if t.text(j) in _OPEN and t.kind(j) == "op" else j + 1
            if t.text(j) != "=":
                continue
            name, s = t.text(i + 1), _decorated(t, i, language)[0]
            v = j + 2 if t.text(j + 1) == "async" else j + 1
            p = t.angles(v)
            fn = None
            if t.text(p) == "(":
                q = t.after(p)
                if ts and t.text(q) == ":":
                    while q < len(t.toks) and t.text(q) not in ("=>", ";", "{"):
                        q = t.after(q) if t.text(q) in _OPEN and t.kind(q) == "op" else q + 1
                if t.text(q) == "=>":
                    fn = (t.span(p, t.pair.get(p, p)), q + 1)
            elif t.kind(p) == "id" and t.text(p + 1) == "=>":
                fn = (t.text(p), p + 2)
            elif t.text(p) == "function":
                q = p + 1
                while t.text(q) != "(" and q < len(t.toks) and q < p + 4:
                    q += 1
                fn = (t.span(q, t.pair.get(q, q)), _body(t, t.after(q)))
            top = owner[i] == -1
            if fn:
                last = t.pair.get(fn[1], fn[1]) if t.text(fn[1]) == "{" else _statement_end(t, fn[1])
                skip.add(i + 1)
                src.add(name, "function", t.at(s), t.end(last), t.at(i), signature=fn[0], docstring=t.doc(s))
            elif top or ts or t.kind(j + 1) in ("num", "str"):
                last = _statement_end(t, j + 1)
                src.add(name, "constant", t.at(s), t.end(last), t.at(i), docstring=t.doc(s))
                skip.add(i + 1)
        elif member and w not in ("constructor",) and t.text(i - 1) not in (".", "new", "=", "(", ",", ":", "<", "|", "=>", "@", "return", "?."):
            p = i + 2 if t.text(i + 1) == "?" else i + 1
            p = t.angles(p)
            if t.text(p) == "(" and w not in words - {"get", "set", "from", "of", "static", "delete", "import", "default", "with", "catch"}:
                close = t.pair.get(p, p)
                k = _body(t, close + 1)
                s, deco = _decorated(t, i, language)
                skip.add(i)
                last = t.pair.get(k, k) if t.text(k) == "{" else close
                src.add(w.lstrip("#"), "method", t.at(s), t.end(last), t.at(i), signature=t.span(p, close), enclosing=b[2], docstring=t.doc(s), decorators=deco)
            elif ts and t.text(i + 1) in ("=", ":", ";", "?", "!") and w not in words:
                s, deco = _decorated(t, i, language)
                last = _statement_end(t, i + 1)
                skip.add(i)
                src.add(w.lstrip("#"), "constant", t.at(s), t.end(min(last, b[1])), t.at(i), enclosing=b[2], docstring=t.doc(s), decorators=deco)
    for i, (kind, w, _) in enumerate(t.toks):  # default exports that have no name
        if w == "default" and kind == "id" and t.text(i - 1) == "export":
            p = t.angles(i + 2 if t.text(i + 1) == "async" else i + 1)
            if t.text(p) == "(" and t.text(t.after(p)) == "=>":
                k = t.after(p) + 1
                src.add("default", "function", t.at(i - 1), t.end(t.pair.get(k, k) if t.text(k) == "{" else _statement_end(t, k)), t.at(i), signature=t.span(p, t.pair.get(p, p)))
    _jsx(t)
    _calls(t, skip, language, ts)


def _body(t: Tokens, i: int) -> int:
    """The index of the body's brace after a parameter list, or of what ends a declaration without one."""
    if t.text(i) == ":":
        i += 1
        while i < len(t.toks) and t.text(i) not in (";", "}", "=", ")"):
            if t.text(i) == "{" and t.text(i - 1) not in (":", "|", "&", "<", ","):
                return i
            i = t.after(i) if t.text(i) in _OPEN and t.kind(i) == "op" else t.angles(i) if t.text(i) == "<" and t.angles(i) > i else i + 1
    return i


def _statement_end(t: Tokens, i: int) -> int:
    """The last token of the statement that i is in: before a semicolon, a closing bracket or a line that begins anew."""
    src = t.src
    while i < len(t.toks):
        if t.text(i) in (";", "}", ")", "]") and t.kind(i) == "op":
            return max(0, i - (t.text(i) != ";"))
        j = t.pair.get(i, i) if (t.text(i) in _OPEN and t.kind(i) == "op") or t.kind(i) == "sh" else i
        nxt = j + 1
        if nxt < len(t.toks) and src.line(t.at(nxt)) > src.line(t.at(j)) and t.kind(nxt) in ("id", "str") and t.text(j) not in (",", "=", "=>", "+", "(", "?", ":", "&&", "||", "|"):
            return j
        i = nxt
    return len(t.toks) - 1


def rust(src: Source) -> None:
    t, skip = Tokens(src), set()
    heads = {"struct": "rust_struct", "enum": "rust_enum", "union": "rust_union", "trait": "rust_trait", "mod": "rust_module", "type": "rust_type_alias", "const": "rust_constant", "static": "rust_static", "fn": "rust_function"}
    impls: list[tuple[int, int, str]] = []
    for i, (kind, w, at) in enumerate(t.toks):
        if kind != "id" or w != "impl" or t.text(i - 1) in ("->", ":", "&", "(", ",", "<", "="):
            continue
        j = t.angles(i + 1)
        k = j
        names: list[tuple[str, int]] = []
        trait = None
        while k < len(t.toks) and t.text(k) not in ("{", ";", "where"):
            if t.text(k) == "for" and names:
                trait = names[-1]
                names = []
            elif t.kind(k) == "id":
                names.append((t.text(k), k))
                skip.add(k)
            k = t.angles(k) if t.text(k) == "<" and t.angles(k) > k else k + 1
        while k < len(t.toks) and t.text(k) not in ("{", ";"):
            k += 1
        if names and t.text(k) == "{":
            target = names[-1][0]
            impls.append((k, t.pair.get(k, k), target))
            if trait:
                src.found.append((at, _impl(src, trait[0], at)))
    traits: list[tuple[int, int, str]] = []
    for i, (kind, w, _) in enumerate(t.toks):
        if kind != "id":
            continue
        if w == "macro_rules" and t.text(i + 1) == "!" and t.kind(i + 2) == "id":
            last = t.pair.get(i + 3, i + 3)
            s = _rust_start(t, i)
            src.add(t.text(i + 2), "rust_macro_def", t.at(s), t.end(last), t.at(i), docstring=t.doc(s))
            skip.update((i, i + 2))
            continue
        if w not in heads or t.kind(i + 1) != "id" or (w == "union" and t.text(i + 2) not in ("{", "<")) or (w == "const" and t.text(i + 1) in ("fn", "unsafe", "async", "extern")) or t.text(i - 1) in ("*", "|") or t.text(i + 1) in _KEY["rust"]:
            continue
        name = t.text(i + 1)
        skip.add(i + 1)
        j = t.angles(i + 2)
        sig = None
        if w == "fn" and t.text(j) == "(":
            sig = t.span(j, t.pair.get(j, j))
            j = t.after(j)
        while j < len(t.toks) and t.text(j) not in ("{", ";") and not (w != "fn" and t.text(j) == "}"):
            j = t.after(j) if t.text(j) in ("(", "[") and t.kind(j) == "op" else j + 1
        last = t.pair.get(j, j) if t.text(j) == "{" else j
        if w in ("const", "static", "type"):
            while j < len(t.toks) and t.text(j) != ";":
                j = t.after(j) if t.text(j) in _OPEN and t.kind(j) == "op" else j + 1
            last = min(j, len(t.toks) - 1)
        s = _rust_start(t, i)
        kind_, enclosing = heads[w], None
        if w == "fn" and (b := _enclosing(impls + traits, i)):
            kind_, enclosing = "rust_method", b[2]
        if w == "trait" and t.text(j) == "{":
            traits.append((j, last, name))
        src.add(name, kind_, t.at(s), t.end(last), t.at(i), signature=sig, enclosing=enclosing, docstring=t.doc(s))
    words = _KEY["rust"]
    seen: set[tuple[int, str]] = set()
    for i, (kind, name, at) in enumerate(t.toks):
        if kind != "id" or i in skip or (name in words and name != "self"):
            continue
        before, nxt = t.text(i - 1), t.text(i + 1)
        if nxt == "!" and t.text(i + 2) in ("(", "[", "{"):
            src.refer("RustMacroCall", name, at)
            continue
        call = i + 1
        if nxt == "::" and t.text(i + 2) == "<":
            call = t.angles(i + 2)
        if t.text(call) == "(" and name != "self" and before not in ("|", "&", "#"):
            if before == ".":
                recv = t.text(i - 2) if t.kind(i - 2) == "id" else None
                src.refer("Call", name, at, recv)
            elif name[:1].islower() or before != "::":
                src.refer("Call", name, at)
        if name[:1].isupper() and before != "::" and name != "Self":
            k = i
            while t.text(k + 1) == "::" and t.kind(k + 2) == "id":
                k += 2
            e = t.after(k + 1) if t.text(k + 1) in ("(", "{") else k + 1
            if k > i and t.text(e) in ("=>", "|"):
                continue  # a pattern of a match
            key = (src.line(at), name)
            if key not in seen:
                seen.add(key)
                src.refer("TypeReference", name, at)


def _impl(src: Source, trait: str, at: int):
    from graphloom.parse.model import Intent

    return Intent("Implements", trait, src.line(at))


def _rust_start(t: Tokens, i: int) -> int:
    """The first token of an item: back over visibility, qualifiers and attributes."""
    j = i
    while j > 0:
        p = t.text(j - 1)
        if p in ("pub", "async", "unsafe", "extern", "default", "const") and t.kind(j - 1) == "id" or t.kind(j - 1) == "str" and t.text(j - 2) == "extern":
            j -= 1
        elif p in (")", "]"):
            o = next((a for a, b in t.pair.items() if b == j - 1), None)
            if o is None:
                break
            if p == ")" and t.text(o - 1) == "pub":
                j = o - 1
            elif p == "]" and t.text(o - 1) == "#":
                j = o - 1
            else:
                break
        else:
            break
    return j


def rust_attach(src: Source) -> None:
    """Gives Implements of `impl Trait for Type` to the type declared in the file."""
    types = {e.name: e for e in src.entities if e.kind in ("rust_struct", "rust_enum", "rust_union")}
    rest = []
    for at, x in src.found:
        if x.intent_type == "Implements":
            m = re.match(r"impl\b[^{]*?\bfor\s+(?:[\w:]+::)?(\w+)", src.text[at : at + 400])
            if m and m[1] in types:
                types[m[1]].intents.append(x)
                continue
        rest.append((at, x))
    src.found = rest


def python(src: Source) -> None:
    t, skip = Tokens(src), set()
    words = _KEY["python"]
    stack: list[tuple[str, int, str]] = []  # (what, depth of indentation, name)
    depth = 0
    paren = 0
    ends: list[tuple] = []
    deco_from: int | None = None
    for i, (kind, w, at) in enumerate(t.toks):
        if kind == "in":
            depth += 1
        elif kind == "de":
            depth -= 1
            while stack and stack[-1][1] >= depth:
                what, _, e = stack.pop()
                last = i - 1
                while last > 0 and t.kind(last) in ("nl", "de", "in"):
                    last -= 1
                e.end = t.end(last)
                e.end_line = src.line(max(0, e.end - 1))
        if kind == "op":
            paren += (w in _OPEN) - (w in (")", "]", "}"))
        if kind == "sh":
            paren += 1
        elif kind == "st":
            paren -= 1
        first = i == 0 or t.kind(i - 1) in ("nl", "in", "de")
        if first and w == "@" and kind == "op" and deco_from is None:
            deco_from = i
        if kind == "id" and w in ("class", "def") and (first or (t.text(i - 1) == "async")) and t.kind(i + 1) == "id":
            name = t.text(i + 1)
            skip.add(i + 1)
            p = i + 2
            if t.text(p) == "[":
                p = t.after(p)
            close = t.pair.get(p, p) if t.text(p) == "(" else p - 1
            colon = close + 1
            while colon < len(t.toks) and t.text(colon) != ":":
                colon = t.after(colon) if t.text(colon) in _OPEN and t.kind(colon) == "op" else colon + 1
            start = deco_from if deco_from is not None else (i - 1 if t.text(i - 1) == "async" else i)
            deco = []
            if deco_from is not None:
                k = deco_from
                while k < i:
                    if t.text(k) == "@" and (k == 0 or t.kind(k - 1) in ("nl", "in", "de")):
                        e = k
                        while t.kind(e + 1) not in ("nl", ""):
                            e += 1
                        deco.append(t.span(k, e))
                        k = e
                    k += 1
            in_class = next((s[2].name for s in stack if s[0] == "class"), None)
            nested = w == "def" and bool(stack) and stack[-1][0] == "def"  # a function of its own, whatever class is around it
            kind_ = "python_class" if w == "class" else "python_method" if in_class and not nested else "python_function"
            doc = None
            b = colon + 1
            while t.kind(b) in ("nl", "in"):
                b += 1
            if t.kind(b) == "str" and re.match(r"[rRuU]?['\"]", t.text(b)):
                doc = strip_marks(re.sub(r"^[rRuU]?(\"\"\"|'''|\"|')|(\"\"\"|'''|\"|')$", "", t.text(b)))
            e = src.add(name, kind_, t.at(start), t.end(colon), at, signature=t.span(p, close) if w == "def" and close >= p else None, enclosing=None if nested else in_class, docstring=doc or t.doc(start), decorators=deco)
            one_line = t.kind(colon + 1) not in ("nl", "")
            if one_line:
                k = colon
                while t.kind(k + 1) not in ("nl", ""):
                    k += 1
                e.end = t.end(k)
                e.end_line = src.line(e.end - 1)
            else:
                stack.append((w, depth, e))
            if w == "class" and close >= p:
                for k in range(p + 1, close):
                    if t.kind(k) == "id" and t.text(k + 1) != "=" and t.text(k) not in words and t.text(k + 1) != ".":
                        src.refer("Extends", t.text(k), t.at(k))
                        skip.add(k)
            deco_from = None
            continue
        if kind != "id" or i in skip:
            continue
        if first and w in ("import", "from"):
            e = i
            while t.kind(e + 1) not in ("nl", "") and t.text(e + 1) != ";":
                e += 1
            _python_import(t, i, e)
            skip.update(range(i, e + 1))
            continue
        nxt, before = t.text(i + 1), t.text(i - 1)
        if first and nxt == "=" and paren == 0:
            last = i
            while t.kind(last + 1) not in ("nl", "") and t.text(last + 1) != ";":
                last += 1
            if t.text(i + 2) == "lambda":
                src.add(w, "python_function", at, t.end(last))
                skip.add(i)
            elif re.fullmatch(r"[A-Z][A-Z0-9_]*", w):
                src.add(w, "python_constant", at, t.end(last), enclosing=None)
                skip.add(i)
            continue
        deco_line = deco_from is not None
        if w == "print" and first and t.kind(i + 1) in ("str", "id", "num", "sh"):
            src.refer("Call", "print", at)
            continue
        if w in words and w != "print":
            continue
        if nxt == "(" or (deco_line and before in ("@",) or deco_line and before == "." and nxt != "."):
            if before == ".":
                k = i - 1
                while k > 0 and (t.text(k) == "." or t.kind(k) == "id" and t.text(k + 1) == "." or t.text(k) in (")", "]")):
                    if t.text(k) in (")", "]"):
                        k = next((a for a, b in t.pair.items() if b == k), k)
                    k -= 1
                src.refer("Call", w, at, src.text[t.at(k + 1) : t.at(i - 1)].strip() or None)
            else:
                src.refer("Call", w, at)
        elif paren and nxt == "=" and t.kind(i + 2) == "id" and t.text(i + 2) not in words | {"self", "cls"} and t.text(i + 3) in (",", ")", "."):
            src.refer("ValueReference", t.text(i + 2), t.at(i + 2))
    del ends


def _python_import(t: Tokens, i: int, e: int) -> None:
    src = t.src
    if t.text(i) == "import":
        for k in range(i + 1, e + 1):
            if t.kind(k) == "id" and t.text(k) != "as" and t.text(k - 1) != "as":
                src.refer("TypeReference", t.text(k), t.at(k))
        return
    k = i + 1
    module = ""
    while k <= e and t.text(k) != "import":
        module += t.text(k)
        k += 1
    if module.strip("."):
        src.refer("TypeReference", module.strip("."), t.at(i + 1))
    for j in range(k + 1, e + 1):
        if t.kind(j) == "id" and t.text(j) != "as" and t.text(j + 1) != "as":
            src.refer("TypeReference", t.text(j), t.at(j))
