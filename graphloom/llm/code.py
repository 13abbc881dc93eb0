"""Operators over source files: files that do not parse (problem 3) and functions with their documentation (problem 1).

Both read `files` (file_id, repo_name, path, content, ...; other columns are ignored). Null, empty and blank contents and paths
without a supported extension give no rows; a byte-order mark is skipped; repeated deliveries of a file_id count once.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.llm.common import language_of, partitions, spread

#: Contents whose results a worker keeps, at most; others are worked out again.
CACHE = 512
CACHED_CHARS = 20_000


def _cached(work: Callable[[str, str], object]) -> Callable[[str, str], object]:
    kept: OrderedDict = OrderedDict()

    def run(language: str, content: str) -> object:
        if len(content) > CACHED_CHARS:
            return work(language, content)
        k = (language, content)
        if k not in kept:
            kept[k] = work(language, content)
            if len(kept) > CACHE:
                kept.popitem(last=False)
        else:
            kept.move_to_end(k)
        return kept[k]

    return run


def source_files(files: DataFrame) -> DataFrame:
    """The delivered files with a grammar and a text, spread over tasks."""
    df = files.select("file_id", language_of(F.col("path")).alias("lang"), "content").where("file_id is not null and lang is not null and trim(content) <> ''")
    return spread(df, "content", "file_id", partitions(files))


def _reject(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from graphloom.llm.grammars import accepting

    run = _cached(lambda language, text: not accepting(language, text))
    for b in batches:
        bad = [not t.isspace() and t != "﻿" and run(lang, t) for lang, t in zip(b["lang"], b["content"])]
        yield b.loc[bad, ["file_id"]]


def unparsable(files: DataFrame) -> DataFrame:
    """file_id of every file that all current dialects of its extension reject; of a file delivered twice, as last scanned."""
    return source_files(latest(files)).mapInPandas(_reject, "file_id long").distinct()


def _ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from graphloom.llm.grammars import accepting

    run = _cached(lambda language, text: ",".join(sorted(accepting(language, text, besides=True))))
    for b in batches:
        rows = [(i, run(lang, t)) for i, lang, t in zip(b["file_id"], b["lang"], b["content"]) if not t.isspace() and t != "\ufeff"]
        yield pd.DataFrame(rows, columns=["file_id", "dialects"])


def dialects(files: DataFrame) -> DataFrame:
    """(file_id, dialects): per file with a grammar and a text the supported dialects that accept it, with commas, earlier versions included.

    A file that none accepts has an empty string. Of a file delivered twice with different texts the latest counts, as far as scanned_at tells.
    """
    return source_files(latest(files)).mapInPandas(_ask, "file_id long, dialects string")


def latest(files: DataFrame) -> DataFrame:
    """Each file_id once: as last scanned, of equally late ones the largest content."""
    when = F.col("scanned_at") if "scanned_at" in files.columns else F.lit(None).cast("timestamp")
    cols = [c for c in ("repo_name", "path", "content") if c in files.columns]
    order = F.struct(F.coalesce(when.cast("timestamp"), F.lit("0001-01-01").cast("timestamp")), F.coalesce("content", F.lit("")), F.coalesce("path", F.lit("")))
    return files.where("file_id is not null").groupBy("file_id").agg(F.max_by(F.struct(*cols), order).alias("r")).select("file_id", "r.*")


def unparsable_rates(files: DataFrame) -> DataFrame:
    """Per repo_name and language: files, those of them without a grammar (html, css, scss), those that do not parse, and their share.

    A file counts as last scanned.
    """
    one = latest(files)
    ext = language_of(F.col("path"))
    one = one.select("file_id", "repo_name", F.coalesce(F.split_part(ext, F.lit("-"), F.lit(1)), text.language(F.col("path"))).alias("language"), ext.isNull().cast("int").alias("none"), "path", "content").where("language is not null")
    bad = unparsable(one).withColumn("bad", F.lit(1))
    j = one.select("file_id", "repo_name", "language", "none").join(bad, "file_id", "left")
    n = F.count("*")
    return j.groupBy("repo_name", "language").agg(n.alias("files"), F.sum("none").alias("no_grammar"), F.count("bad").alias("unparsable"), F.round(F.count("bad") / n, 6).alias("share"))


def _pairs(full: bool) -> Callable:
    def work(language: str, content: str) -> list:
        from graphloom.llm.docpairs import documented
        from graphloom.llm.grammars import accepting

        found = documented(language.split("-")[0], content)
        return found if full or (found and accepting(language, content)) else []

    cols = ["file_id", "fn_name", "fn_line"] + (["language", "kind", "signature", "docstring", "code"] if full else [])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = _cached(work)
        for b in batches:
            rows = []
            for file_id, lang, content in zip(b["file_id"], b["lang"], b["content"]):
                if content.isspace() or content == "\ufeff":
                    continue
                for f in of(lang, content):
                    rows.append((file_id, f["name"], f["line"]) + ((lang.split("-")[0], f["kind"], f["signature"], f["docstring"], f["code"]) if full else ()))
            yield pd.DataFrame(rows, columns=cols)

    return run


def documented_functions(files: DataFrame, full: bool = False) -> DataFrame:
    """file_id, fn_name, fn_line of every function with real documentation, in files that parse.

    `full` adds language, kind, signature, docstring and code: the pairs themselves, also from files that do not parse as a whole, as far
    as their brackets close.
    """
    cols = "file_id long, fn_name string, fn_line int" + (", language string, kind string, signature string, docstring string, code string" if full else "")
    return source_files(latest(files)).mapInPandas(_pairs(full), cols).dropDuplicates(["file_id", "fn_name", "fn_line"])
