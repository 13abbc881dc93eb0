"""Dialects that differ in their tokens, rewritten to those of the language: elements of JSX, and what Python 2 writes otherwise."""

from __future__ import annotations

import re

_PY2 = re.compile(
    r"(?P<keep>\#[^\n]*|(?:[bB]?[rR]?)(?:\"\"\"(?:[^\\\"]|\\.|\"(?!\"\"))*\"\"\"|'''(?:[^\\']|\\.|'(?!''))*'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'))"
    r"|(?P<ur>\b[uU][rR](?=[\"']))|(?P<long>\b(?:0[xX][0-9a-fA-F]+|0[oO]?[0-7]*|[1-9]\d*)[lL]\b)|(?P<octal>\b0[0-7]+\b)|(?P<ne><>)|(?P<tick>`)",
    re.S,
)


def python2_tokens(text: str) -> str:
    """Long and octal numbers, `<>`, backticks and ur-strings as Python 3 writes their like; strings and comments stay."""
    inside = False

    def to(m: re.Match) -> str:
        nonlocal inside
        kind, t = m.lastgroup, m.group()
        if kind == "ur":
            return "r"
        if kind == "long":
            return to_octal(t[:-1])
        if kind == "octal":
            return to_octal(t)
        if kind == "ne":
            return "!="
        if kind == "tick":
            inside = not inside
            return "(" if inside else ")"
        return t

    def to_octal(t: str) -> str:
        return "0o" + t[1:] if re.fullmatch(r"0[0-7]+", t) else t

    return _PY2.sub(to, text)


class NotJsx(ValueError):
    """What begins like an element is none."""


_PIECE = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|[\w$]+|\s+", re.S)
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[a-z]*")
_TAG = re.compile(r"[A-Za-z_$][\w$]*(?:-[\w$-]+)?(?:[.:][A-Za-z_$][\w$-]*)*")
_NAME = re.compile(r"[A-Za-z_$][\w$-]*(?::[A-Za-z_$][\w$-]*)?")
_BLANK = re.compile(r"(?:\s+|//[^\n]*|/\*.*?\*/)*", re.S)
_PARAMS = re.compile(r"<\s*(?:const\s+)?[\w$]+\s*(?:,|\bextends\b|=)")
_TYPES = re.compile(r"<[^<>(){}=]*(?:<[^<>(){}=]*>[^<>(){}=]*)*>")
_BEFORE = frozenset("return typeof case in of new delete void throw do else yield await default".split())


def without_jsx(text: str, typed: bool) -> str:
    """The text with each element of JSX as the sequence, in brackets, of the expressions within it; `typed` leaves type parameters alone."""
    return _code(text, 0, False, typed)[0]


def _code(text: str, i: int, inner: bool, typed: bool) -> tuple[str, int]:
    """Code from i to the end, or with `inner` to the brace that closes it; the offset after."""
    out: list[str] = []
    depth, last, n = 0, "", len(text)
    while i < n:
        c = text[i]
        m = _PIECE.match(text, i)
        if m:
            out.append(m.group())
            if not m.group().isspace() and not m.group().startswith(("//", "/*")):
                last = m.group()
            i = m.end()
            continue
        begins = not last or last in _BEFORE or (not (last[-1].isalnum() or last[-1] in "_$)]\"'`}"))
        if c == "`":
            piece, i = _template(text, i, typed)
            out.append(piece)
            last = "`"
            continue
        if c == "/" and begins:
            r = _REGEX.match(text, i)
            if r:
                out.append(r.group())
                last, i = "x", r.end()
                continue
        if c == "<" and (begins or last == "}") and re.match(r"<(?:[A-Za-z_$]|>)", text[i : i + 2]) and not (typed and _PARAMS.match(text, i)):
            try:
                piece, i = _element(text, i, typed)
                out.append(piece)
                last = ")"
                continue
            except NotJsx:
                pass
        if c == "{":
            depth += 1
        elif c == "}":
            if inner and not depth:
                return "".join(out), i
            depth -= 1
        out.append(c)
        last = c
        i += 1
    if inner:
        raise NotJsx
    return "".join(out), i


def _template(text: str, i: int, typed: bool) -> tuple[str, int]:
    out, n = ["`"], len(text)
    i += 1
    while i < n:
        if text[i] == "\\":
            out.append(text[i : i + 2])
            i += 2
        elif text[i] == "`":
            return "".join(out) + "`", i + 1
        elif text.startswith("${", i):
            piece, i = _code(text, i + 2, True, typed)
            out.append("${" + piece + "}")
            i += 1
        else:
            out.append(text[i])
            i += 1
    return "".join(out), i


def _element(text: str, i: int, typed: bool) -> tuple[str, int]:
    """The element at i as a bracketed sequence of its expressions, line ends kept; the offset after it."""
    found: list[str] = []
    begin = i
    skip = lambda k: _BLANK.match(text, k).end()
    m = _TAG.match(text, i + 1)
    tag = m.group() if m else ""
    i = skip(m.end() if m else i + 1)
    given = _TYPES.match(text, i) if typed and tag else None
    if given:
        i = skip(given.end())
    while True:
        if text.startswith("/>", i) and tag:
            return _bracketed(found, text[begin : i + 2]), i + 2
        if text.startswith(">", i):
            i += 1
            break
        if text.startswith("{", i):
            piece, i = _code(text, i + 1, True, typed)
            if not piece.strip().startswith("..."):
                raise NotJsx
            found.append("[" + piece + "]")
            i = skip(i + 1)
            continue
        m = _NAME.match(text, i)
        if not m or not tag:
            raise NotJsx
        i = skip(m.end())
        if text.startswith("=", i):
            i = skip(i + 1)
            q = text[i : i + 1]
            if q and q in "\"'":
                end = text.find(q, i + 1)
                if end < 0:
                    raise NotJsx
                i = end + 1
            elif q == "{":
                piece, i = _code(text, i + 1, True, typed)
                if not piece.strip():
                    raise NotJsx
                found.append("(" + piece + ")")
                i += 1
            elif q == "<":
                piece, i = _element(text, i, typed)
                found.append(piece)
            else:
                raise NotJsx
            i = skip(i)
    while i < len(text):  # children
        c = text[i]
        if text.startswith("</", i):
            i = skip(i + 2)
            m = _TAG.match(text, i)
            if (m.group() if m else "") != tag:
                raise NotJsx
            i = skip(m.end() if m else i)
            if not text.startswith(">", i):
                raise NotJsx
            return _bracketed(found, text[begin : i + 1]), i + 1
        if c == "<":
            piece, i = _element(text, i, typed)
            found.append(piece)
        elif c == "{":
            piece, i = _code(text, i + 1, True, typed)
            bare = _BLANK.sub("", piece, count=1)
            if bare.strip():
                found.append("[" + piece + "]")
            i += 1
        elif c in "}>":
            raise NotJsx
        else:
            i += 1
    raise NotJsx


def _bracketed(found: list[str], was: str) -> str:
    return "(" + (", ".join(found) if found else "null") + ")"
