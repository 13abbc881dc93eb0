"""Extraction as a stage of a plan: files in, entities and their intents out. Files are independent, so nothing is gathered."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import ids, text
from graphloom.parse import CUSTOM

_INTENT = "struct<seq:int,intent_type:string,target:string,receiver:string,line:int>"
ROW = (
    "uuid string, name string, kind string, fqn string, signature string, docstring string, inline_comments array<string>, decorators array<string>, language string, file_path string, "
    f"start_line int, end_line int, enclosing_class string, repo_name string, intents array<{_INTENT}>"
)
_NAMES = [c.split()[0] for c in ROW.replace(f"array<{_INTENT}>", "x").split(", ")]


def _runner(custom: dict):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from graphloom.parse import extract

        for b in batches:
            rows = [r for lang, content, path, repo in zip(b["language"], b["content"], b["path"], b["repo_name"]) for r in extract(lang, content, path, repo, custom)]
            out = pd.DataFrame(rows, columns=_NAMES)
            for c in ("start_line", "end_line"):
                out[c] = out[c].astype("Int32")
            yield out

    return run


def extract_files(files: DataFrame, extractors: dict | None = None) -> DataFrame:
    """Entities with nested intents, from files (repo_name, path, content); the language is that of the path's extension.

    Null and blank contents, unsupported extensions and null paths give nothing; a broken file gives what can be read of it.
    What is registered in graphloom.parse when the stage is planned, and `extractors` before it, goes to the workers with the stage.
    """
    f = files.select(F.coalesce("repo_name", F.lit("")).alias("repo_name"), "path", "content", text.language(F.col("path")).alias("language")).where("path is not null and language is not null and trim(content) <> ''")
    return f.mapInPandas(_runner(CUSTOM | (extractors or {})), ROW)


def entities_of(extracted: DataFrame) -> DataFrame:
    e = extracted.drop("intents")
    cols = ("kind", "name", "decorators", "signature", "docstring", "inline_comments", "file_path", "start_line")
    return e.withColumn("embed_text", text.embed_text(*[F.col(c) for c in cols]))


def intents_of(extracted: DataFrame) -> DataFrame:
    i = extracted.select("repo_name", F.col("uuid").alias("src_uuid"), F.col("file_path").alias("src_file"), F.col("enclosing_class").alias("own"), "name", "kind", F.explode("intents").alias("i"))
    inside = F.when(F.col("kind").isin("class", "kotlin_class", "python_class", "interface"), F.col("name")).otherwise(F.col("own"))
    return i.select("repo_name", "src_uuid", "src_file", inside.alias("src_enclosing_class"), "i.*")


# SQL bodies of the scalar functions: expanded into the query by the planner, so no Python runs.
_UUID5 = (
    "(SELECT concat_ws('-', substring(h, 1, 8), substring(h, 9, 4), concat('5', substring(h, 14, 3)), concat(lower(hex((cast(conv(substring(h, 17, 1), 16, 10) AS int) & 3) | 8)), substring(h, 18, 3)), substring(h, 21, 12)) "
    "FROM (SELECT sha1(concat(unhex('{ns}'), encode(identity, 'UTF-8'))) AS h))"
)
_COSINE = "aggregate(zip_with(a, b, (x, y) -> cast(x AS double) * cast(y AS double)), 0D, (s, x) -> s + x) / nullif(sqrt(aggregate(a, 0D, (s, x) -> s + cast(x AS double) * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + cast(x AS double) * x)), 0)"


def register_sql(spark: SparkSession) -> None:
    """SQL names: the table function extract_entities(language, content, path, repo), and uuid5_sql(identity), cosine_sim(a, b) and strip_comment_markers(text)."""
    from pyspark.sql.functions import udtf

    custom = dict(CUSTOM)

    @udtf(returnType="uuid: string, name: string, kind: string, fqn: string, signature: string, docstring: string, start_line: int, end_line: int, enclosing_class: string")
    class ExtractEntities:
        def eval(self, language: str, content: str, path: str, repo: str):
            from graphloom.parse import extract

            for r in extract(language, content, path, repo, custom):
                yield tuple(r[c] for c in ("uuid", "name", "kind", "fqn", "signature", "docstring", "start_line", "end_line", "enclosing_class"))

    spark.udtf.register("extract_entities", ExtractEntities)
    strip = "raw"
    for pattern, to in text.MARKS:
        strip = "regexp_replace({}, r'{}', '{}')".format(strip, pattern, to)
    strip = f"array_join(filter(transform(split({strip}, '\n'), s -> trim(regexp_replace(s, r'[\t\r]', ' '))), s -> s <> ''), '\n')"
    uuid5 = "CASE WHEN identity IS NOT NULL THEN " + _UUID5.format(ns=ids.NAMESPACE.hex) + " END"
    for head, body in (("uuid5_sql(identity STRING) RETURNS STRING", uuid5), ("cosine_sim(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE", f"CASE WHEN size(a) = size(b) THEN {_COSINE} END"), ("strip_comment_markers(raw STRING) RETURNS STRING", strip)):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
