"""Lexers for the supported languages. A token is (kind, text, offset).

Kinds: id num str op com nl life, and for interpolated strings sh (head) sm (middle) st (tail).
A text that can't be cut into tokens raises LexError unless `tolerant`, when the odd character is dropped.
"""

from __future__ import annotations

import re

BOM = "\ufeff"
_ID = r"[^\W\d]\w*"
_NUM = r"(?:0[xX][0-9a-fA-F_]+(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?\d+)?|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*(?:\.(?!\.)(?:\d[\d_]*)?)?|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?)"
_DQ, _SQ = r'"(?:[^"\\\n]|\\.)*"', r"'(?:[^'\\\n]|\\.)*'"

OPENERS, CLOSERS = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


class LexError(ValueError):
    """The text is no sequence of tokens of the language."""


def _compile(*parts: tuple[str, str]) -> re.Pattern:
    return re.compile("|".join(f"(?P<{k}>{v})" for k, v in parts), re.S)


_ECMA = _compile(
    ("ws", r"[ \t\f\v\u00a0\ufeff]+"),
    ("nl", r"[\r\n\u2028\u2029]+"),
    ("com", r"//[^\r\n]*|/\*.*?\*/"),
    ("id", r"[#@]?(?:[^\W\d]|\$|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:\w|\$|[\u200c\u200d]|\\u[0-9a-fA-F]{4})*"),
    ("num", r"(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?)n?(?![\w$])"),
    ("str", r'"(?:[^"\\\r\n]|\\(?:\r\n|.))*"|' + r"'(?:[^'\\\r\n]|\\(?:\r\n|.))*'"),
    ("tick", r"`"),
    ("op", r"\.\.\.|=>|===|!==|==|!=|\*\*=|\?\?=|\|\|=|&&=|<<=|<=|<<|\+\+|--|\*\*|\?\?|\?\.(?!\d)|\|\||&&|[-+*/%&|^]=|[-{}()\[\];,<>+*/%&|^!~?:=.@]"),
)
_TICK = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*(?:`|\$\{)", re.S)
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\r\n]|\\[^\r\n]|\[(?:[^\]\\\r\n]|\\[^\r\n])*\])+/[a-zA-Z]*")
#: Words after which a slash begins a regular expression.
_BEFORE_REGEX = frozenset("return typeof instanceof in of new delete void throw case do else yield await default".split())


def _ecma(text: str, tolerant: bool) -> list:
    out, pos, n, braces = [], 0, len(text), []
    last = None
    if text.startswith("#!"):
        pos = text.find("\n") if "\n" in text else n
    match = _ECMA.match
    while pos < n:
        m = match(text, pos)
        if m is None:
            if not tolerant:
                raise LexError(f"character {pos} {text[pos - 40 : pos + 60]!r}")
            pos += 1
            continue
        kind, at = m.lastgroup, pos
        pos = m.end()
        if kind == "ws":
            continue
        if kind == "nl" or kind == "com":
            t = m.group()
            out.append((kind, t, at))
            if kind == "com" and t[1] == "*" and "\n" in t:
                out.append(("nl", "\n", pos))
            continue
        t = m.group()
        if kind == "tick" or (kind == "op" and t == "}" and braces and braces[-1] == "`"):
            head = kind == "tick"
            if not head:
                braces.pop()
            w = _TICK.match(text, pos)
            if w is None:
                if not tolerant:
                    raise LexError("unended template")
                continue
            pos = w.end()
            more = text[pos - 1] == "{"
            if more:
                braces.append("`")
            kind = ("sh" if more else "str") if head else ("sm" if more else "st")
            last = (kind, text[at:pos], at)
            out.append(last)
            continue
        if kind == "op":
            if t == "{":
                braces.append("{")
            elif t == "}" and braces:
                braces.pop()
            elif t[0] == "/" and (last is None or (last[0] == "op" and last[1] not in (")", "]")) or last[0] in ("sh", "sm") or (last[0] == "id" and last[1] in _BEFORE_REGEX)):
                w = _REGEX.match(text, at)
                if w:
                    pos, kind, t = w.end(), "str", w.group()
                elif not tolerant:
                    raise LexError("unended regular expression")
        last = (kind, t, at)
        out.append(last)
    if braces and braces[-1] == "`" and not tolerant:
        raise LexError("unended template")
    return out


_JAVA = _compile(
    ("ws", r"[ \t\f\r\n\ufeff\x1a]+"),
    ("com", r"//[^\r\n]*|/\*.*?\*/"),
    ("id", r"(?:[^\W\d]|\$)(?:\w|\$)*"),
    ("num", r"(?:0[xX][0-9a-fA-F_]*(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?\d+)?|0[bB][01_]+|(?:\d[\d_]*(?:\.(?![.\w]|\s*\w+\s*\()(?:\d[\d_]*)?|\.\d[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?)[lLfFdD]?(?![\w$])"),
    ("str", r'"""[ \t\f]*\r?\n(?:[^\\"]|\\.|"(?!""))*"""|' + r'"(?!"")(?:[^"\\\r\n]|\\.)*"|""(?!")|' + r"'(?:[^'\\\r\n]|\\u+[0-9a-fA-F]{4}|\\[0-7]{1,3}|\\.)'"),
    ("op", r"\.\.\.|->|::|==|!=|<<=|<=|<<|\+\+|--|\|\||&&|[-+*/%&|^]=|[-{}()\[\];,<>+*/%&|^!~?:=.@]"),
)
_RUST = _compile(
    ("ws", r"[ \t\f\r\n\ufeff\u200e\u200f]+"),
    ("com", r"//[^\n]*"),
    ("opencom", r"/\*"),
    ("raw", r'(?:br|cr|r)(?P<hash>#*)".*?"(?P=hash)(?!#)'),
    ("str", r'[bc]?"(?:[^"\\]|\\.)*"|' + r"b?'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]+\}|.))'"),
    ("life", r"'[^\W\d]\w*(?!')"),
    ("id", r"(?:r#)?[^\W\d]\w*"),
    ("num", r"(?:0x[0-9a-fA-F_]+|0b[01_]+|0o[0-7_]+|\d[\d_]*(?:\.(?![.\w])|\.\d[\d_]*)?(?:[eE][+-]?[\d_]+)?)(?:_*(?:[iuf](?:8|16|32|64|128|size)))?(?!\w)"),
    ("op", r"\.\.\.|\.\.=|\.\.|->|=>|::|==|!=|<<=|<=|<-|<<|[-+*/%&|^]=|[-{}()\[\];,<>+*/%&|^!~?:=.@#$]"),
)
#: The same with strings that end on their line: for files in which some string never ends.
_RUST_LINES = re.compile(_RUST.pattern.replace(r'[bc]?"(?:[^"\\]|\\.)*"', r'[bc]?"(?:[^"\\\n]|\\.)*"'), re.S)
_KOTLIN = _compile(
    ("ws", r"[ \t\f\ufeff]+"),
    ("nl", r"[\r\n]+"),
    ("com", r"//[^\r\n]*|\#![^\r\n]*"),
    ("opencom", r"/\*"),
    ("quote", r'"""|"'),
    ("str", r"'(?:[^'\\\r\n]|\\u[0-9a-fA-F]{4}|\\.)'"),
    ("id", r"[^\W\d]\w*|`[^`\r\n]+`"),
    ("num", r"(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|(?:\d[\d_]*(?:\.\d[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?)(?:[uU]?L|[uU]|[fF])?(?!\w)"),
    ("op", r"===|!==|\.\.<|\.\.|->|::|==|!=|<=|\+\+|--|\?\.|\?:|!!|\|\||&&|[-+*/%]=|[-{}()\[\];,<>+*/%&|!?:=.@]"),
)
_NEST = re.compile(r"/\*|\*/")
_KT_DQ = re.compile(r'(?:[^"\\$\r\n]|\\u[0-9a-fA-F]{4}|\\[tbrn\'"\\$]|\$(?!\{))*(?:"|\$\{)', re.S)
_KT_RAW = re.compile(r'(?:[^"$]|\$(?!\{)|"(?!""))*(?:"""(?!")|"(?="""(?!"))|\$\{)', re.S)


def _kt_string(text: str, pos: int, quote: str) -> int:
    """The offset after the string's end or after the next `${`; -1 where it never ends."""
    while True:
        w = (_KT_RAW if len(quote) == 3 else _KT_DQ).match(text, pos)
        if w is None:
            return -1
        pos = w.end()
        if len(quote) == 1 or text[pos - 1] == "{" or text.endswith('"""', 0, pos):
            return pos


def _plain(master: re.Pattern, text: str, tolerant: bool) -> list:
    out, pos, n, modes = [], 0, len(text), []
    match = master.match
    while pos < n:
        m = match(text, pos)
        if m is None:
            if not tolerant:
                raise LexError(f"character {pos} {text[pos - 40 : pos + 60]!r}")
            pos += 1
            continue
        kind, at = m.lastgroup, pos
        pos = m.end()
        if kind == "ws":
            continue
        if kind == "opencom":
            depth = 1
            while depth:
                w = _NEST.search(text, pos)
                if w is None:
                    if not tolerant:
                        raise LexError("unended comment")
                    pos = n
                    break
                pos, depth = w.end(), depth + (1 if w.group() == "/*" else -1)
            t = text[at:pos]
            out.append(("com", t, at))
            if "\n" in t:
                out.append(("nl", "\n", pos))
            continue
        t = m.group()
        if kind == "quote" or (kind == "op" and t == "}" and modes and modes[-1] != "{"):
            head = kind == "quote"
            quote = t if head else modes.pop()
            pos = _kt_string(text, pos, quote)
            if pos < 0:
                if not tolerant:
                    raise LexError("unended string")
                pos = at + len(t)
                continue
            more = text[pos - 1] == "{"
            if more:
                modes.append(quote)
            out.append((("sh" if more else "str") if head else ("sm" if more else "st"), text[at:pos], at))
            continue
        if kind == "op":
            if t == "{":
                modes.append("{")
            elif t == "}" and modes:
                modes.pop()
        elif kind in ("raw", "hash"):
            kind = "str"
        out.append((kind, t, at))
    if any(x != "{" for x in modes) and not tolerant:
        raise LexError("unended string")
    return out


_PY = _compile(
    ("ws", r"[ \t\f]+|\\\r?\n"),
    ("nl", r"\r?\n|\r"),
    ("com", r"\#[^\r\n]*"),
    ("fs", r"(?:[fF][rR]?|[rR][fF])(?:\"\"\"|'''|\"|')"),
    ("str", r"(?:[rR]|[bB][rR]?|[rR][bB]|[uU])?(?:\"\"\"(?:[^\\\"]|\\.|\"(?!\"\"))*\"\"\"|'''(?:[^\\']|\\.|'(?!''))*'''|\"(?!\"\")(?:[^\"\\\r\n]|\\(?:\r\n|.))*\"|'(?!'')(?:[^'\\\r\n]|\\(?:\r\n|.))*'|\"\"|'')"),
    ("id", _ID),
    ("num", r"(?:0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:(?:\d(?:_?\d)*)?\.\d(?:_?\d)*|\d(?:_?\d)*\.?)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)(?!\w)"),
    ("op", r"\.\.\.|:=|->|\*\*=|//=|>>=|<<=|<=|>=|==|!=|\*\*|//|>>|<<|[-+*/%&|^@]=|[-{}()\[\],:;<>+*/%&|^~=.@!]"),
)
_PY_F = {q: re.compile(r"(?:[^\\{}" + q[0] + ("" if len(q) == 3 else r"\r\n") + r"]|\\(?:N\{[^}\r\n]*\}|\r\n|[^{}]|(?=[{}]))|\{\{|\}\}" + (f"|{q[0]}(?!{q[0]}{q[0]})" if len(q) == 3 else "") + r")*(?:" + q + r"|\{)", re.S) for q in ('"', "'", '"""', "'''")}
_PY_SPEC = re.compile(r"[^{}\r\n]*(?:\}|\{)", re.S)
_BLANK = re.compile(r"[ \t\f]*(?:\#[^\r\n]*)?(?:\r?\n|\r|$)")
_INDENT = re.compile(r"[ \t\f]*")


def _python(text: str, tolerant: bool) -> list:
    """Python's tokens; `nl` only at logical ends of lines, and `in`/`de` for changes of indentation."""
    out, pos, n = [], 1 if text.startswith(BOM) else 0, len(text)
    levels: list[tuple[int, int]] = [(0, 0)]
    stack: list[tuple[str, str]] = []  # (opener, quote of the f-string for its braces)
    fresh = True
    match = _PY.match

    def piece(at: int, begin: int, quote: str, head: bool) -> int:
        w = _PY_F[quote].match(text, begin)
        if w is None:
            if not tolerant:
                raise LexError("unended f-string")
            return begin
        end = w.end()
        more = text[end - 1] == "{"
        if more:
            stack.append(("{f", quote))
        out.append((("sh" if more else "str") if head else ("sm" if more else "st"), text[at:end], at))
        return end

    while pos < n:
        if fresh and not stack:
            b = _BLANK.match(text, pos)
            if b and (b.end() > pos) and (b.end() < n or text[pos : b.end()].strip(" \t\f") == "" or text[pos : b.end()].lstrip(" \t\f")[:1] in "#\r\n"):
                w = text[pos : b.end()]
                if "#" in w:
                    k = w.index("#")
                    out.append(("com", w[k:].rstrip("\r\n"), pos + k))
                pos = b.end()
                continue
            w = _INDENT.match(text, pos).group()
            w = w[w.rfind("\f") + 1 :]
            col = alt = 0
            for c in w:
                col, alt = ((col // 8 + 1) * 8, alt + 1) if c == "\t" else (col + 1, alt + 1)
            if col > levels[-1][0]:
                if alt <= levels[-1][1] and not tolerant:
                    raise LexError("tabs and blanks")
                levels.append((col, alt))
                out.append(("in", "", pos))
            else:
                while len(levels) > 1 and col < levels[-1][0]:
                    levels.pop()
                    out.append(("de", "", pos))
                if (col, alt) != levels[-1]:
                    if not tolerant:
                        raise LexError("indentation")
                    levels[-1] = (col, alt)
            fresh = False
        m = match(text, pos)
        if m is None:
            if not tolerant:
                raise LexError(f"character {pos} {text[pos - 40 : pos + 60]!r}")
            pos += 1
            continue
        kind, at = m.lastgroup, pos
        pos = m.end()
        if kind == "ws":
            if pos >= n and m.group()[0] == "\\" and not tolerant:
                raise LexError("continued into the end")
            continue
        if kind == "nl":
            if not stack:
                out.append(("nl", "\n", at))
                fresh = True
            continue
        t = m.group()
        if kind == "com":
            out.append((kind, t, at))
            continue
        if kind == "fs":
            pos = piece(at, pos, t.lstrip("fFrR"), True)
            continue
        if kind == "op":
            if t in OPENERS:
                stack.append((t, ""))
            elif t in CLOSERS:
                if stack and stack[-1][0] == "{f" and t == "}":
                    pos = piece(at, pos, stack.pop()[1], False)
                    continue
                if not stack or OPENERS.get(stack[-1][0]) != t:
                    if not tolerant:
                        raise LexError("brackets")
                    if stack:
                        stack.pop()
                else:
                    stack.pop()
            elif stack and stack[-1][0] == "{f" and t == "!" and text[pos : pos + 1] in ("r", "s", "a"):
                pos += 1
                continue
            elif stack and stack[-1][0] == "{f" and (t == "=" or t == "==") and text[pos : pos + 1] in "}!:":
                continue
            elif stack and stack[-1][0] == "{f" and t[0] == ":":
                pos = at + 1
                depth = 0
                while True:  # the format's parts; fields in it are taken whole
                    w = _PY_SPEC.match(text, pos)
                    if w is None:
                        if not tolerant:
                            raise LexError("format")
                        break
                    pos = w.end()
                    depth += 1 if text[pos - 1] == "{" else -1
                    if depth < 0:
                        break
                pos = piece(at, pos, stack.pop()[1], False)
                continue
        out.append((kind, t, at))
    if stack and not tolerant:
        raise LexError("brackets")
    if not fresh:
        out.append(("nl", "\n", n))
    out.extend(("de", "", n) for _ in levels[1:])
    return out


#: A line of Rust that begins an item: in a plain string that spans lines it means that the string never ended.
_RUST_ITEM = re.compile(r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:(?:async|unsafe|const)\s+)*(?:fn|impl|struct|enum|trait|mod|use)\b.*[{;]\s*$", re.M)


def lex(language: str, text: str, tolerant: bool = False) -> list[tuple[str, str, int]]:
    """The tokens of `text` in language java, kotlin, typescript, javascript, python or rust.

    In a tolerant reading of Rust, whose strings may span lines, strings end on their line if one would hold a line of code.
    """
    if language in ("javascript", "typescript"):
        return _ecma(text, tolerant)
    if language == "java":
        return _plain(_JAVA, text, tolerant)
    if language == "rust":
        if text.startswith("#!") and not text.startswith("#!["):
            text = "//" + text[2:]
        found = _plain(_RUST, text, tolerant)
        if tolerant and any(k == "str" and t[0] == '"' and "\n" in t and _RUST_ITEM.search(t) for k, t, _ in found):
            found = _plain(_RUST_LINES, text, tolerant)
        return found
    if language == "kotlin":
        return _plain(_KOTLIN, text, tolerant)
    if language == "python":
        return _python(text, tolerant)
    raise ValueError(language)
