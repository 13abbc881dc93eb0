"""The three questions as an API: search, callers, explore; results as tables, Markdown or JSON."""

from __future__ import annotations

import json
import os
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import graph, search, vector
from graphloom.operators.store import Store, part_of

NO_MATCH = "No matching code found for your query."
MOST_LETTERS, MOST_RESULTS = 500, 20


class CodeIndex:
    """Answers from the tables of a Store, or from DataFrames given."""

    def __init__(self, entities: DataFrame, edges: DataFrame, vectors: DataFrame | None = None, embedder: vector.Embedder | None = None):
        self.entities, self.edges, self.vectors, self.embedder = entities, edges, vectors, embedder or vector.HashingEmbedder()
        self.read = None  # reads parts of the Store's tables as of one manifest

    @classmethod
    def open(cls, spark: SparkSession, root: str, embedder: vector.Embedder | None = None) -> CodeIndex:
        s = Store(spark, root)
        manifest = s.manifest()
        index = cls(*(s.read(name, manifest=manifest) for name in ("entities", "edges", "vectors")), embedder)
        index.read = lambda name, repos=None, parts=None: s.read(name, repos, parts, manifest)
        return index

    def search(self, query: str, k: int = 5, repo: str | None = None) -> DataFrame:
        """The k entities that are most like the query, with the graph around them."""
        if not 1 <= len(query) <= MOST_LETTERS:
            raise ValueError(f"a query has 1 to {MOST_LETTERS} characters")
        if not 0 <= k <= MOST_RESULTS:
            raise ValueError(f"at most {MOST_RESULTS} results")
        if isinstance(self.embedder, vector.ZeroEmbedder):
            self.embedder.embed_query(query)
        vectors = self.read("vectors", [repo]) if self.read and repo is not None else self.vectors
        return search.hybrid(self.entities, self.edges, vectors, self.embedder.embed([query])[0], k, repo)

    def callers(self, name: str, repo: str | None = None, strict: bool = False, rel_types: tuple[str, ...] | None = None) -> DataFrame:
        """Who calls, extends, implements or references what `name` means."""
        refs = graph.find_references(self.entities, self.edges, name, repo, strict, rel_types or graph.REFERENCE_RELATIONS)
        return refs.orderBy("rel_type", "target_file", "target_line", "file_path", "start_line", "name")

    def explore(self, path: str, repo: str | None = None) -> DataFrame:
        """What a file declares. A path that exists here is made absolute first."""
        path = os.path.realpath(path) if os.path.exists(path) else path
        entities = self.entities
        if self.read:  # only the one part of each repository in which the file can be
            part = entities.sparkSession.range(1).select(part_of(F.lit(path))).first()[0]
            entities = self.read("entities", None if repo is None else [repo], [part])
        return graph.explore_file(entities, path, repo).orderBy("position")


class Answer(list):
    """A page of an answer's rows; `total` counts all rows and `groups` those of each value of the column rel_type or section, exactly."""

    total: int
    page: int
    pages: int
    groups: dict

    @classmethod
    def of(cls, found: list[dict]) -> Answer:
        """A list of rows as an answer of one page."""
        if isinstance(found, cls):
            return found
        a = cls(found)
        a.total, a.page, a.pages = len(a), 1, 1
        by = next((c for c in _GROUPED if a and c in a[0]), None)
        a.groups = dict(Counter(r[by] for r in a)) if by else {}
        return a

    def note(self) -> str:
        """What a cut answer leaves out; empty for a whole one."""
        return f"Page {self.page} of {self.pages}: {len(self)} of {self.total} rows shown" if self.pages > 1 else ""


_GROUPED = ("rel_type", "section")
PAGE = 10_000


def rows(df: DataFrame, page: int = 1, size: int = PAGE) -> Answer:
    """A page (from 1) of the rows of an answer, in its order. Of an answer longer than a page all rows are counted, never cut in silence."""
    if page < 1 or size < 1:
        raise ValueError("page and size are 1 or more")
    found = [r.asDict(recursive=True) for r in (df if page == 1 else df.offset((page - 1) * size)).limit(size + 1).collect()]
    a = Answer.of(found[:size])
    if page > 1 or len(found) > size:
        by = next((c for c in _GROUPED if c in df.columns), None)
        a.page = page
        a.groups = {r[0]: r[1] for r in df.groupBy(by).count().collect()} if by else {}
        a.total = sum(a.groups.values()) if by else df.count()
        a.pages = -(-a.total // size)
    return a


def as_json(answer: list[dict]) -> str:
    return json.dumps(answer, indent=2, ensure_ascii=False, default=str)


def as_table(head: list[str], body: list[list]) -> str:
    """Columns padded to their widest cell."""
    cells = [head, *[["" if x is None else str(x).split("\n")[0] for x in r] for r in body]]
    width = [max(len(r[i]) for r in cells) for i in range(len(head))]
    out = [" | ".join(x.ljust(w) for x, w in zip(r, width)).rstrip() for r in cells]
    return "\n".join([out[0], "-+-".join("-" * w for w in width), *out[1:]])


def _noted(text: str, answer: Answer) -> str:
    return f"{text}\n{answer.note()}" if answer.note() else text


def search_table(answer: list[dict]) -> str:
    return as_table(["Kind", "Name", "File", "Line"], [[r["kind"], r["name"], r["file_path"], r["start_line"]] for r in answer]) if answer else NO_MATCH


def callers_table(name: str, answer: list[dict]) -> str:
    if not answer:
        return f"No references found for `{name}`. This entity may be unused."
    return _noted(as_table(["Relationship", "Target", "Caller", "File", "Line"], [[r["rel_type"], r["target"], r["name"], r["file_path"], r["start_line"]] for r in answer]), Answer.of(answer))


def explore_table(path: str, answer: list[dict]) -> str:
    if not answer:
        return f"No entities found in `{path}`."
    return _noted(as_table(["Type", "Name", "Line", "Signature"], [[r["kind"], r["name"], r["start_line"], r["signature"]] for r in answer]), Answer.of(answer))


def search_markdown(answer: list[dict]) -> str:
    if not answer:
        return NO_MATCH
    out = []
    for r in answer:
        out.append(f"## {r['name']} ({r['kind']})\n\n**File:** {r['file_path']}:{r['start_line']}")
        for title, key in (("Signature", "signature"), ("Documentation", "docstring"), ("Subclasses", "subclasses"), ("Implementers", "implementers"), ("Calls", "calls")):
            if r.get(key):
                out.append(f"**{title}:** {r[key]}")
        if r.get("type_usage_count"):
            out.append(f"**Used as a type:** {r['type_usage_count']} ({r['type_usage_samples']})")
        if r.get("caller_count"):
            out.append(f"**Callers:** {r['caller_count']} ({r['caller_samples']})")
    return "\n".join(out)


def callers_markdown(name: str, answer: list[dict]) -> str:
    """By relation, then by target where a relation has several."""
    if not answer:
        return f"No references found for `{name}`. This entity may be unused."
    answer = Answer.of(answer)
    out = [f"# References to `{name}`", f"{answer.total} in all"]
    for rel in sorted({r["rel_type"] for r in answer}):
        mine = [r for r in answer if r["rel_type"] == rel]
        out.append(f"## {rel} ({answer.groups[rel]})")
        key = lambda r: f"{r['target_file']}:{r['target_line']}" if r["target_file"] else "unknown"
        targets = sorted({key(r) for r in mine})
        for t in targets:
            if len(targets) > 1:
                out.append(f"### {t}")
            out += [f"- {r['name']} ({r['kind']}) in {r['file_path']}:{r['start_line']}" for r in mine if key(r) == t]
    return _noted("\n".join(out), answer)


def explore_markdown(path: str, answer: list[dict]) -> str:
    if not answer:
        return f"No entities found in `{path}`."
    out = [f"# {path}"]
    for name, _ in graph.SECTIONS:
        mine = [r for r in answer if r["section"] == name]
        if mine:
            out.append(f"## {name}")
            out += [f"- {r['name']}{r['signature'] or ''} (line {r['start_line']})" for r in mine]
    return _noted("\n".join(out), Answer.of(answer))


def payload(df: DataFrame) -> DataFrame:
    """Rows as JSON strings; null fields are left out."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))
