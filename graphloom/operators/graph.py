"""Lookups over the graph of entities and edges. Every function is one logical plan; nothing is collected.

Null uuids and endpoints join nothing. Tables may carry other columns; only those named are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.schema import REFERENCE_RELATIONS
from graphloom.session import cut


def current_entities(entities: DataFrame) -> DataFrame:
    """One row per uuid: the latest indexed, and of equally late ones the fullest (largest signature, then docstring, fqn, line)."""
    rank = F.struct(
        F.coalesce(F.col("indexed_at").cast("timestamp"), F.lit("0001-01-01").cast("timestamp")).alias("t"), F.coalesce("signature", F.lit("")).alias("s"), F.coalesce("docstring", F.lit("")).alias("d"),
        F.coalesce("fqn", F.lit("")).alias("f"), F.coalesce("start_line", F.lit(-1)).alias("l"),
    )
    cols = [c for c in entities.columns if c != "uuid"]
    e = entities.where("uuid is not null")
    return e.groupBy("uuid").agg(F.max_by(F.struct(*cols), rank).alias("r")).select("uuid", "r.*")


def clean_edges(edges: DataFrame) -> DataFrame:
    """(src_uuid, dst_uuid, rel_type) trimmed, in lower case, without nulls, each once."""
    k = [F.lower(F.trim(c)).alias(c) for c in ("src_uuid", "dst_uuid")]
    return edges.select(*k, "rel_type").dropna().distinct()


def matches(name: str) -> Column:
    """An entity that a search for `name` means: by name, by fqn, or by a part of name and signature."""
    return (F.col("name") == name) | (F.col("fqn") == name) | F.contains(F.concat("name", F.coalesce("signature", F.lit(""))), F.lit(name))


def find_references(entities: DataFrame, edges: DataFrame, name: str, repo: str | None = None, strict: bool = False, rel_types=REFERENCE_RELATIONS) -> DataFrame:
    """Who calls, extends, implements or references what `name` means; `repo` limits the targets, never the callers.

    The targets are filtered before any join; the planner broadcasts them when they are few.
    """
    target = entities.where(((F.col("name") == name) | (F.col("fqn") == name)) if strict else matches(name))
    if repo is not None:
        target = target.where(F.col("repo_name") == repo)
    target = target.select(F.col("uuid").alias("dst_uuid"), F.col("fqn").alias("target"), F.col("file_path").alias("target_file"), F.col("start_line").alias("target_line"))
    hits = edges.where(F.col("rel_type").isin(*rel_types)).select("src_uuid", "dst_uuid", "rel_type").join(target, "dst_uuid")
    src = entities.select(F.col("uuid").alias("src_uuid"), "name", "kind", "file_path", "start_line", "repo_name")
    return hits.join(src, "src_uuid").select("rel_type", "target", "target_file", "target_line", "src_uuid", "name", "kind", "file_path", "start_line", "repo_name")


def target_key(file: Column, line: Column) -> Column:
    """file:line, or the file, or unknown."""
    return F.when(file.isNull(), F.lit("unknown")).when(line.isNull(), file).otherwise(F.concat_ws(":", file, line.cast("string")))


def grouped_by_target(references: DataFrame) -> DataFrame:
    return references.groupBy("rel_type", target_key(F.col("target_file"), F.col("target_line")).alias("target_key")).agg(F.count("*").alias("n_references"))


def reference_counts(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Per relation: edges whose two ends exist."""
    return existing_ends(edges, entities).groupBy("rel_type").agg(F.count("*").alias("n_edges"))


def existing_ends(edges: DataFrame, entities: DataFrame) -> DataFrame:
    ids = entities.select("uuid")
    return edges.join(ids.withColumnRenamed("uuid", "src_uuid"), "src_uuid", "left_semi").join(ids.withColumnRenamed("uuid", "dst_uuid"), "dst_uuid", "left_semi").select("src_uuid", "dst_uuid", "rel_type")


def dead_entities(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Entities that no edge points to: they may be unused."""
    used = edges.select(F.col("dst_uuid").alias("uuid"))
    return entities.join(used, "uuid", "left_anti")


def dependencies_of(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(uuid, calls, n_calls) of each source of a CALLS edge: the sorted names of what it calls, as one string."""
    callee = entities.select(F.col("uuid").alias("dst_uuid"), F.col("name").alias("callee"))
    calls = edges.where("rel_type = 'CALLS'").join(callee, "dst_uuid")
    return calls.groupBy(F.col("src_uuid").alias("uuid")).agg(F.array_join(F.array_sort(F.collect_list("callee")), ",").alias("calls"), F.count("callee").alias("n_calls"))


def dependencies(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Each entity with the sorted names of what it calls, as one string; entities that call nothing keep an empty one."""
    return entities.select("uuid", "name", "fqn").join(dependencies_of(entities, edges), "uuid", "left").select("uuid", "name", "fqn", F.coalesce("calls", F.lit("")).alias("calls"), F.coalesce("n_calls", F.lit(0)).alias("n_calls"))


def enriched(entities: DataFrame, edges: DataFrame, samples: int = 3) -> DataFrame:
    """Per entity with references: its subclasses, implementers, users and callers, with counts and a few samples.

    Samples are the smallest `name in file` strings: ranked before they are gathered, so that no long list is ever built for them.
    """
    src = entities.select(F.col("uuid").alias("src_uuid"), F.concat(F.coalesce("name", F.lit("?")), F.lit(" in "), F.coalesce("file_path", F.lit("?"))).alias("sample"), F.col("name").alias("src_name"))
    e = edges.where(F.col("rel_type").isin(*REFERENCE_RELATIONS)).join(src, "src_uuid")
    w = Window.partitionBy("dst_uuid", "rel_type").orderBy("sample", "src_uuid")
    e = e.withColumn("r", F.row_number().over(w))

    def few(rel: str) -> Column:
        return F.array_join(F.array_sort(F.collect_list(F.when((F.col("rel_type") == rel) & (F.col("r") <= samples), F.col("sample")))), "; ")

    def names(rel: str) -> Column:
        return F.array_join(F.array_sort(F.collect_set(F.when(F.col("rel_type") == rel, F.col("src_name")))), ",")

    return e.groupBy(F.col("dst_uuid").alias("uuid")).agg(
        names("EXTENDS").alias("subclasses"), names("IMPLEMENTS").alias("implementers"), F.count_if(F.col("rel_type") == "REFERENCES").alias("type_usage_count"), few("REFERENCES").alias("type_usage_samples"),
        F.count_if(F.col("rel_type") == "CALLS").alias("caller_count"), few("CALLS").alias("caller_samples"),
    )


# The 24 sections of a file's anatomy, in order, and the kinds in each; then those for kinds of web pages and of plain values.
SECTIONS = (
    ("Classes", ("class", "kotlin_class")), ("Interfaces", ("interface", "kotlin_interface")), ("Objects", ("kotlin_object",)), ("Companion objects", ("kotlin_companion_object",)),
    ("Methods", ("method", "kotlin_method")), ("Functions", ("function", "kotlin_function")), ("Properties", ("kotlin_property",)),
    ("Python classes", ("python_class",)), ("Python constants", ("python_constant",)), ("Python functions", ("python_function",)), ("Python methods", ("python_method",)), ("Python modules", ("python_module",)),
    ("Rust structs", ("rust_struct",)), ("Rust enums", ("rust_enum",)), ("Rust unions", ("rust_union",)), ("Rust traits", ("rust_trait",)), ("Rust impls", ("rust_impl",)), ("Rust functions", ("rust_function",)),
    ("Rust methods", ("rust_method",)), ("Rust macros", ("rust_macro_def", "rust_macro_invoke")), ("Rust type aliases", ("rust_type_alias",)), ("Rust constants", ("rust_constant",)), ("Rust statics", ("rust_static",)), ("Rust modules", ("rust_module",)),
    ("Constants", ("constant",)), ("Enums", ("enum",)), ("Elements", ("html_element",)), ("Ids", ("html_id", "css_id")), ("CSS classes", ("html_class", "css_class")), ("Variables", ("css_variable", "scss_variable")),
    ("Mixins", ("scss_mixin",)), ("SCSS functions", ("scss_function",)),
)


def section(kind: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for name, kinds in SECTIONS for k in kinds for x in (k, name)]), kind)


def explore_file(entities: DataFrame, file_path: str, repo: str | None = None) -> DataFrame:
    """What a file declares, with sections and positions in the order of lines."""
    e = entities.where(F.col("file_path") == file_path)
    if repo is not None:
        e = e.where(F.col("repo_name") == repo)
    w = Window.partitionBy(F.lit(1)).orderBy("start_line", "name", "kind", "uuid")  # one file's entities
    return e.select(section(F.col("kind")).alias("section"), "name", "kind", "signature", "start_line", F.row_number().over(w).alias("position")).where("section is not null")


def file_sections(entities: DataFrame) -> DataFrame:
    """Per file and section: how many entities, and the first and last line."""
    e = entities.withColumn("section", section(F.col("kind"))).where("section is not null")
    return e.groupBy("repo_name", "file_path", "section").agg(F.count("*").alias("n"), F.min("start_line").alias("first_line"), F.max("start_line").alias("last_line"))


def contains_edges(entities: DataFrame) -> DataFrame:
    """CONTAINS edges, from each class to what it encloses in its file."""
    inner = entities.where("enclosing_class is not null").select("repo_name", "file_path", F.col("enclosing_class").alias("name"), F.col("uuid").alias("dst_uuid"))
    outer = entities.where(F.col("kind").isin("class", "interface", "enum", "kotlin_class", "kotlin_interface", "kotlin_object", "python_class", "rust_struct", "rust_enum", "rust_trait"))
    outer = outer.groupBy("repo_name", "file_path", "name").agg(F.min("uuid").alias("src_uuid"))
    return inner.join(outer, ["repo_name", "file_path", "name"]).select("src_uuid", "dst_uuid", F.lit("CONTAINS").alias("rel_type"))


def impact(edges: DataFrame, start: DataFrame, depth: int = 3) -> DataFrame:
    """(uuid, depth): everything that reaches `start` (a column uuid) along edges backwards within `depth` steps."""
    seen = front = cut(start.select("uuid").where("uuid is not null").distinct().withColumn("depth", F.lit(0)))
    back = edges.select("src_uuid", "dst_uuid").distinct()
    for d in range(1, depth + 1):
        step = back.join(front.select(F.col("uuid").alias("dst_uuid")), "dst_uuid").select(F.col("src_uuid").alias("uuid")).distinct()
        front = cut(step.join(seen.select("uuid"), "uuid", "left_anti").withColumn("depth", F.lit(d)))  # each step is worked out once
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen
