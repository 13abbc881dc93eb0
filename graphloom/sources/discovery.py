"""Source trees on disk: discovery that honours ignore files, as a batch and a streaming data source."""

from __future__ import annotations

import fnmatch
import hashlib
import json
import logging
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

from graphloom.functions.text import EXTENSIONS

_FILES = "repo_name string, path string, language string, content string, sha256 string, error string"
_CHANGES = "repo_name string, path string, sha256 string, op string, snapshot long"


def extension(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[-1] if "." in name[1:] else ""


@lru_cache(maxsize=4096)
def _rule(line: str) -> tuple[bool, bool, re.Pattern] | None:
    """(negated, directories only, pattern of the path below the ignore file) of one line; null for none."""
    line = line.rstrip("\r\n")
    line = line if line.endswith("\\ ") else line.rstrip()
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[1:] if negated else line.removeprefix("\\")
    only_dir, line = line.endswith("/"), line.rstrip("/")
    anchored, line = "/" in line, line.lstrip("/")
    out = ""
    i = 0
    while i < len(line):
        if line.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif line.startswith("/**", i) and i + 3 == len(line):
            out, i = out + "/.*", i + 3
        elif line[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif line[i] == "?":
            out, i = out + "[^/]", i + 1
        elif line[i] == "[" and "]" in line[i + 1 :]:
            j = line.index("]", i + 1)
            out, i = out + fnmatch.translate(line[i : j + 1]).removeprefix("(?s:").split(")")[0], j + 1
        else:
            out, i = out + re.escape(line[i]), i + 1
    return negated, only_dir, re.compile(("" if anchored else "(?:.*/)?") + out + r"\Z", re.S)


def _rules(folder: str, name: str) -> list:
    try:
        with open(os.path.join(folder, name), encoding="utf-8", errors="replace") as f:
            return [r for r in map(_rule, f) if r]
    except OSError:
        return []


def discover(root: str) -> list[str]:
    """Sorted paths of the supported files below root that no ignore file excludes; unreadable folders are left out."""
    root = os.path.abspath(root)
    found: list[str] = []

    def ignored(path: str, is_dir: bool, sets: list) -> bool:
        verdict = False
        for base, rules in sets:
            below = os.path.relpath(path, base).replace(os.sep, "/")
            for negated, only_dir, pattern in rules:
                if (is_dir or not only_dir) and pattern.match(below):
                    verdict = not negated
        return verdict

    def walk(folder: str, sets: list) -> None:
        sets = [*sets, (folder, _rules(folder, ".gitignore") + _rules(folder, ".ignore"))]
        try:
            items = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError as e:
            logging.getLogger(__name__).warning("%s is left out: %s", folder, e)
            return
        for e in items:
            if e.is_dir(follow_symlinks=False):
                if e.name != ".git" and not ignored(e.path, True, sets):
                    walk(e.path, sets)
            elif e.is_file() and extension(e.name) in EXTENSIONS and not ignored(e.path, False, sets):
                found.append(e.path)

    walk(root, [(root, _rules(root, ".git/info/exclude"))])
    return sorted(found)


def read_file(path: str) -> tuple[str | None, str | None, str | None]:
    """(content, sha256, error): a file that is gone, unreadable or no UTF-8 has an error and no content."""
    try:
        with open(path, "rb") as f:
            raw = f.read()
    except OSError as e:
        return None, None, type(e).__name__
    try:
        return raw.decode("utf-8"), hashlib.sha256(raw).hexdigest(), None
    except UnicodeDecodeError:
        return None, hashlib.sha256(raw).hexdigest(), "not UTF-8"


class _Part(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(0)
        self.paths = paths


class _TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.repo, self.size = options["path"], options.get("repo") or "", int(options.get("filesPerPartition", "500"))
        self.whole = options.get("content", "true") == "true"

    def partitions(self) -> list[InputPartition]:
        paths = discover(self.root)
        return [_Part(paths[i : i + self.size]) for i in range(0, len(paths), self.size)] or [_Part([])]

    def read(self, partition: _Part) -> Iterator[tuple]:
        for p in partition.paths:
            content, digest, error = read_file(p)
            yield self.repo, p, EXTENSIONS.get(extension(p)), content if self.whole else None, digest, error


class _ChangeReader(SimpleDataSourceStreamReader):
    """Changes since the last look: the offset holds time, size and hash of each file, so that a restart goes on from there.

    A file is read again only if its time or size is another than at the last look.
    """

    def __init__(self, options: dict):
        self.root, self.repo = options["path"], options.get("repo") or ""
        self.limit = int(options.get("maxFilesPerTrigger", "100000"))

    def initialOffset(self) -> dict:
        return {"snapshot": 0, "hashes": "{}"}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        old = json.loads(start["hashes"])
        new, rows = dict(old), []
        snapshot = int(start["snapshot"]) + 1
        seen = set()
        for p in discover(self.root):
            seen.add(p)
            try:
                st = os.stat(p)
            except OSError:
                continue
            known = old.get(p)
            if known and known[:2] == [st.st_mtime_ns, st.st_size] or len(rows) >= self.limit:
                continue
            digest = read_file(p)[1]
            if digest and (not known or known[2] != digest):
                rows.append((self.repo, p, digest, "modified" if p in old else "added", snapshot))
            if digest:
                new[p] = [st.st_mtime_ns, st.st_size, digest]
        for p in sorted(set(old) - seen):
            rows.append((self.repo, p, None, "deleted", snapshot))
            del new[p]
        if not rows:
            return iter(()), start
        return iter(rows), {"snapshot": snapshot, "hashes": json.dumps(new, sort_keys=True)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        old, new = json.loads(start["hashes"]), json.loads(end["hashes"])
        snapshot = int(end["snapshot"])
        rows = [(self.repo, p, h, "modified" if p in old else "added", snapshot) for p, (_, _, h) in sorted(new.items()) if p not in old or old[p][2] != h]
        return iter(rows + [(self.repo, p, None, "deleted", snapshot) for p in sorted(set(old) - set(new))])

    def commit(self, end: dict) -> None:
        pass


class SourceTree(DataSource):
    """Format `source_tree`; options path, repo, filesPerPartition, content (false: hashes only), and for streams maxFilesPerTrigger."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return _CHANGES if self.options.get("changes") == "true" else _FILES

    def reader(self, schema: StructType) -> DataSourceReader:
        return _TreeReader(self.options)

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return _ChangeReader(self.options)


def contents(paths: DataFrame) -> DataFrame:
    """(repo_name, path, content, sha256, error) of the files named by `paths` (repo_name, path), read where the task runs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(repo, p, *read_file(p)) for repo, p in zip(b["repo_name"], b["path"])]
            yield pd.DataFrame(rows, columns=["repo_name", "path", "content", "sha256", "error"])

    return paths.select("repo_name", "path").mapInPandas(run, "repo_name string, path string, content string, sha256 string, error string")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SourceTree)


def load_state(spark: SparkSession, path: str, repo: str):
    """An index state from JSON {"file_hashes": {path: hash}}; a missing file is an empty state."""
    from graphloom.schema import STATE

    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    hashes = {}
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        hashes = json.loads(spark.read.text(path, wholetext=True).first()[0]).get("file_hashes", {})
    return spark.createDataFrame([(repo, p, h) for p, h in sorted(hashes.items())], STATE)
