"""Extraction from HTML, CSS and SCSS."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from graphloom.parse.model import Source

_NO_ATTRIBUTES = frozenset(("script", "style"))


def html(src: Source) -> None:
    """Custom elements, ids and classes as entities; scripts and style sheets as imports."""
    starts = src.starts

    class Reader(HTMLParser):
        def handle_starttag(self, tag: str, attrs: list) -> None:
            line, col = self.getpos()
            at = starts[min(line, len(starts)) - 1] + col
            raw = self.get_starttag_text() or ""
            end = at + len(raw)
            got = {k: (v or "") for k, v in attrs}
            if "-" in tag:
                src.add(tag, "html_element", at, end)
            if tag == "script" and got.get("src"):
                src.add(f"import({got['src']})", "function", at, end)
                src.refer("HtmlFileImport", got["src"], at)
            if tag == "link" and "stylesheet" in got.get("rel", "") and got.get("href"):
                src.add(f"import({got['href']})", "constant", at, end)
                src.refer("CssFileImport", got["href"], at)
            if tag in _NO_ATTRIBUTES:
                return
            if got.get("id", "").strip():
                src.add(got["id"].strip(), "html_id", at, end)
            for c in got.get("class", "").split():
                src.add(c, "html_class", at, end)

        handle_startendtag = handle_starttag

    Reader(convert_charrefs=True).feed(src.text)
    for m in re.finditer(r"<!--.*?-->", src.text, re.S):
        src.comments.append(m.span())


_CSS_SKIP = re.compile(r"/\*.*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'", re.S)
_SELECTOR = re.compile(r"([.#])(-?[_a-zA-Z\u0080-￿][\w\u0080-￿-]*)")


def css(src: Source, scss: bool = False) -> None:
    """Classes, ids and custom properties; in SCSS also variables, mixins and functions. Key frames are left out."""
    text = src.text
    skip = re.compile(_CSS_SKIP.pattern + r"|//[^\n]*", re.S) if scss else _CSS_SKIP
    for m in skip.finditer(text):
        if m.group()[0] == "/":
            src.comments.append(m.span())
    blank = skip.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)
    at = 0
    frames: list[bool] = []
    for m in re.finditer(r"[{};]", blank):
        part = blank[at : m.start()]
        head = part.strip()
        if m.group() == "{":
            close = _close(blank, m.start())
            if scss and (d := re.match(r"\s*@(mixin|function)\s+([\w-]+)\s*(\([^{]*\))?", part)):
                src.add(d[2], f"scss_{d[1]}", at + d.start(1) - 1, close, signature=d[3])
            elif not head.startswith("@") and not any(frames):
                for s in _SELECTOR.finditer(part):
                    src.add(s[2], "css_class" if s[1] == "." else "css_id", at + s.start(), close)
            frames.append("keyframes" in head)
        elif m.group() == "}" and frames:
            frames.pop()
        if d := re.match(r"\s*(--[\w-]+)\s*:", part):
            src.add(d[1], "css_variable", at + d.start(1), m.start())
        at = m.end()
    if scss:
        for d in re.finditer(r"\$([\w-]+)", blank):
            src.add(d[1], "scss_variable", d.start(), d.end())


def _close(text: str, at: int) -> int:
    depth = 0
    for m in re.finditer(r"[{}]", text[at:]):
        depth += 1 if m.group() == "{" else -1
        if not depth:
            return at + m.end()
    return len(text)
