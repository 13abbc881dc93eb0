"""What extraction yields, and the steps that all languages share."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

from graphloom.functions.ids import entity_uuid

_MARK = re.compile(r"^/\*\*?!?|\*/$|^//[/!]?|^\*|^#(?!\[)")


@dataclass
class Intent:
    intent_type: str
    target: str
    line: int
    receiver: str | None = None


@dataclass
class Entity:
    name: str
    kind: str
    start: int  # offsets of its text
    end: int
    line: int
    end_line: int | None
    signature: str | None = None
    enclosing: str | None = None
    docstring: str | None = None
    decorators: list[str] = field(default_factory=list)
    comments: list[str] = field(default_factory=list)
    intents: list[Intent] = field(default_factory=list)


class Source:
    """A text with its line numbers, comments, and what was found in it."""

    def __init__(self, language: str, text: str):
        self.language, self.text = language, text
        self.starts = [0, *(m.end() for m in re.finditer(r"\n", text))]
        self.entities: list[Entity] = []
        self.found: list[tuple[int, Intent]] = []  # with the offset of each
        self.comments: list[tuple[int, int]] = []

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at)

    def add(self, name: str, kind: str, start: int, end: int, at: int | None = None, **more) -> Entity:
        e = Entity(name, kind, start, end, self.line(start if at is None else at), self.line(max(start, end - 1)), **more)
        self.entities.append(e)
        return e

    def refer(self, kind: str, target: str, at: int, receiver: str | None = None) -> None:
        self.found.append((at, Intent(kind, target, self.line(at), receiver)))


def strip_marks(raw: str) -> str:
    """Each line without its comment marks; empty lines are dropped."""
    out = []
    for s in raw.split("\n"):
        s = s.strip()
        for _ in range(2):
            s = _MARK.sub("", s).strip()
        if s:
            out.append(s)
    return "\n".join(out)


# Kinds whose full name begins with the class around them, and marks before or after others.
_MEMBERS = frozenset("method constant enum kotlin_method kotlin_property python_method".split())
_AROUND = {
    "css_class": (".", ""), "html_class": (".", ""), "css_id": ("#", ""), "html_id": ("#", ""), "scss_variable": ("$", ""), "scss_mixin": ("@mixin ", ""), "scss_function": ("@function ", ""),
    "rust_macro_def": ("", "!"), "css_variable": ("", ""),
}


def fqn(name: str, kind: str, enclosing: str | None) -> str:
    if kind == "rust_method" and enclosing:
        return f"{enclosing}::{name}"
    if kind in _MEMBERS and enclosing:
        return f"{enclosing}.{name}"
    before, after = _AROUND.get(kind, ("", ""))
    return name if before and name.startswith(before) else f"{before}{name}{after}"


def nearest(entities: list[Entity], line: int) -> Entity | None:
    """The smallest entity around the line; else the latest before it; else the next after it."""
    best, rank = None, None
    for i, e in enumerate(entities):
        end = e.end_line if e.end_line is not None else 1 << 30
        if e.line <= line <= end:
            r = (0, end - e.line, i)
        elif e.line <= line:
            r = (1, line - e.line, i)
        else:
            r = (2, e.line - line, i)
        if rank is None or r < rank:
            best, rank = e, r
    return best


def finish(src: Source, path: str, repo: str) -> list[dict]:
    """Rows of entities with their intents: references go to the innermost entity, others to `<module>`; ids are unique in the file."""
    order = sorted(src.entities, key=lambda e: (e.start, -e.end))
    orphans: list[Intent] = []
    stack: list[Entity] = []
    k = 0
    for at, intent in sorted(src.found, key=lambda x: x[0]):
        while k < len(order) and order[k].start <= at:
            stack.append(order[k])
            k += 1
        while stack and stack[-1].end <= at:
            stack.pop()
        owner = next((e for e in reversed(stack) if e.start <= at < e.end), None)
        (owner.intents if owner else orphans).append(intent)
    bodies = [e for e in order if e.end_line is not None]
    for a, b in src.comments:
        inside = [e for e in bodies if e.start < a < e.end]
        if inside:
            inside[-1].comments.append(strip_marks(src.text[a:b]))
    if orphans:
        kind = {"python": "python_module", "rust": "rust_module"}.get(src.language, "function")
        order.append(Entity("<module>", kind, 0, 0, 1, None, intents=orphans))
    rows, seen, once = [], {}, {}
    for e in order:
        # of equal declarations on a line, one with a signature stays
        key = (e.name, e.kind, e.line)
        if key in once:
            kept = once[key]
            if kept["signature"] is None and e.signature is not None:
                kept["signature"] = e.signature
            kept["intents"] += _intent_rows(e.intents, len(kept["intents"]))
            continue
        full = fqn(e.name, e.kind, e.enclosing)
        seen[full] = n = seen.get(full, 0) + 1
        row = {
            "uuid": entity_uuid(repo, path, full if n == 1 else f"{full}#{n}"), "name": e.name, "kind": e.kind, "fqn": full, "signature": e.signature, "docstring": e.docstring or None, "inline_comments": e.comments,
            "decorators": e.decorators, "language": src.language, "file_path": path, "start_line": e.line, "end_line": e.end_line, "enclosing_class": e.enclosing, "repo_name": repo, "intents": _intent_rows(e.intents, 0),
        }
        once[key] = row
        rows.append(row)
    return rows


def _intent_rows(intents: list[Intent], at: int) -> list[dict]:
    return [{"seq": at + i, "intent_type": x.intent_type, "target": x.target, "receiver": x.receiver, "line": x.line} for i, x in enumerate(intents)]
