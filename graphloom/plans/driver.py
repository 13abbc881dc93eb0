"""The queries that the driver runs on the tables of a code index, with their SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import ids, text
from graphloom.operators import extraction, graph, incremental, lines, orphans, resolve, search, store, vector
from graphloom.plans.sql import SQL
from graphloom.streaming.batches import change_batches, distinct_changes

#: What the lookups below ask for.
REPO, PART, K, CUT = "harbor-core", "index", 5, "2025-07-01 00:00:00"


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _entities(s: SparkSession, d: str) -> DataFrame:
    return graph.current_entities(_t(s, d, "entities"))


def _edges(s: SparkSession, d: str) -> DataFrame:
    return graph.clean_edges(_t(s, d, "edges"))


def _files(s: SparkSession, d: str) -> DataFrame:
    """Each file once, as last delivered."""
    f = _t(s, d, "files")
    cols = [c for c in f.columns if c != "file_id"]
    return f.groupBy("file_id").agg(F.max_by(F.struct(*cols), F.struct(F.col("scanned_at"), F.coalesce("language", F.lit("")))).alias("r")).select("file_id", "r.*")


def _intents(s: SparkSession, d: str) -> DataFrame:
    i = _t(s, d, "intents").withColumn("target", F.trim("target"))
    cols = [c for c in i.columns if c != "intent_id"]
    return i.groupBy("intent_id").agg(F.min(F.struct(*cols)).alias("r")).select("intent_id", "r.*")  # rows of one id are alike; of others, the least


def _targets(s: SparkSession, d: str) -> DataFrame:
    """Names that the reverse lookups ask for: everything whose name contains PART."""
    return _entities(s, d).where(F.contains(F.lower("name"), F.lit(PART)))


def _usable(s: SparkSession, d: str) -> DataFrame:
    v = _t(s, d, "embeddings")
    return v.select(F.col("vec_id").alias("uuid"), F.col("label").cast("string").alias("repo_name"), "embedding")


def _query_vector(s: SparkSession, d: str) -> list[float]:
    return [float(x) for x in _usable(s, d).orderBy("uuid").first()["embedding"]]


def _index_vectors(s: SparkSession, d: str) -> DataFrame:
    """The index's own vectors that can be compared: vector.DIM finite numbers that are not all zero."""
    x = F.col("embedding")
    finite = F.forall(x, lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < F.lit(float("inf"))))
    return _t(s, d, "vectors").where(F.col("uuid").isNotNull() & (F.size(x) == vector.DIM) & finite & F.exists(x, lambda y: y != 0)).select("uuid", "repo_name", "embedding")


def _index_query(s: SparkSession, d: str) -> list[float]:
    """What the searches of the index ask for: the vector of the smallest uuid; zeros, near to nothing, where there is none."""
    few = _t(s, d, "vectors").where(F.col("uuid").isNotNull() & (F.size("embedding") == vector.DIM)).select("uuid", "embedding").orderBy("uuid").limit(64).collect()
    good = [r for r in few if None not in r.embedding and all(map(math.isfinite, r.embedding)) and any(r.embedding)]
    if good:  # the smallest uuid's vectors are all among the first, unless it has more than those
        mine = [r.embedding for r in good if r.uuid == good[0].uuid]
        if few[-1].uuid != good[0].uuid or len(few) < 64:
            return [float(x) for x in min(mine)]
    first = _index_vectors(s, d).agg(F.min(F.struct("uuid", "embedding")).alias("v")).first().v
    return [float(x) for x in first.embedding] if first else [0.0] * vector.DIM


def _index_top(s: SparkSession, d: str, repo: str | None = None) -> DataFrame:
    return vector.top_k(_t(s, d, "vectors"), _index_query(s, d), K, repo)


def _mutated(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The files as they are, and the state of an index that saw those scanned before CUT and of removed files has no hash."""
    f = _files(s, d)
    gone = _gone(s, d).withColumnRenamed("file_path", "path")
    old = f.where(F.col("scanned_at") < F.lit(CUT).cast("timestamp_ntz")).join(gone, ["repo_name", "path"], "left_anti").select("repo_name", "path", "sha256")
    return f.select("repo_name", "path", "sha256"), old.unionByName(gone.withColumn("sha256", F.lit(None).cast("string")))


def _classified(s: SparkSession, d: str) -> DataFrame:
    return incremental.classify(*_mutated(s, d))


def _gone(s: SparkSession, d: str) -> DataFrame:
    return _t(s, d, "removals").select("repo_name", "file_path").distinct()


def _vectors(s: SparkSession, d: str) -> DataFrame:
    return _t(s, d, "vectors").where("embedding is not null").select("uuid", "repo_name", F.size("embedding").alias("dims")).distinct()


def _left(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return store.without_files(_entities(s, d), _edges(s, d), _vectors(s, d), _gone(s, d))


def _new_entities(s: SparkSession, d: str) -> DataFrame:
    return _entities(s, d).where("kind = 'class'").select("uuid", F.concat("name", F.lit("V2")).alias("name"), "kind")


def _refs(s: SparkSession, d: str) -> DataFrame:
    return _intents(s, d).where("line is not null").select("repo_name", F.col("src_file").alias("file_path"), F.col("intent_id").alias("ref_id"), "line")


def _spans(s: SparkSession, d: str) -> DataFrame:
    return _entities(s, d).where("start_line is not null").select("repo_name", "file_path", "uuid", "start_line", "end_line")


def _ends(s: SparkSession, d: str) -> DataFrame:
    """The line after each entity's last: what lies in no span are the gaps between declarations."""
    return _entities(s, d).where("end_line is not null").select("repo_name", "file_path", F.col("uuid").alias("ref_id"), (F.col("end_line") + 1).alias("at"))


def _classes(s: SparkSession, d: str) -> DataFrame:
    return _entities(s, d).where("kind in ('class', 'interface', 'python_class', 'kotlin_class') and end_line is not null").select("repo_name", "file_path", "name", "start_line", "end_line")


def _batches(s: SparkSession, d: str) -> DataFrame:
    return change_batches(_t(s, d, "events"), "user_id", "ts", 120)


def _resolved(s: SparkSession, d: str) -> DataFrame:
    return resolve.resolve(_intents(s, d), _entities(s, d))


def _calls(s: SparkSession, d: str) -> DataFrame:
    return resolve.resolve_calls(_intents(s, d), _entities(s, d))


def _partial_calls(s: SparkSession, d: str) -> DataFrame:
    """Calls by parts of names: from each dotted name its class without two letters, and five letters of its last part."""
    parts = F.split("fqn", r"\.")
    e = _entities(s, d).where(F.contains("fqn", F.lit(".")))
    return e.select(F.col("uuid").alias("src_uuid"), F.lit("?").alias("src_file"), F.lit(None).cast("string").alias("src_enclosing_class"), F.lit("Call").alias("intent_type"), F.substring(F.element_at(parts, -1), 1, 5).alias("target"), F.substring(F.element_at(parts, -2), 3, 1000).alias("receiver"), F.lit(0).alias("seq"))


def _contexts(s: SparkSession, d: str) -> DataFrame:
    """Every repository depends on REPO."""
    return _entities(s, d).select("repo_name", F.lit(REPO).alias("context_repo")).where("repo_name is not null").distinct()


def _relative_imports(s: SparkSession, d: str) -> DataFrame:
    """Imports of files, their absolute paths written as seen from the importing file's folder."""
    up = F.repeat(F.lit("../"), F.greatest(F.size(F.split("src_file", "/")) - 2, F.lit(0)))
    i = _intents(s, d).where("intent_type in ('HtmlFileImport', 'CssFileImport')")
    return i.withColumn("target", F.when(F.col("target").startswith("/") & F.col("src_file").startswith("/"), F.concat(F.lit("./"), up, F.substring("target", 2, 100_000))).otherwise(F.col("target")))


def _extracted(s: SparkSession, d: str) -> DataFrame:
    return extraction.extract_files(_files(s, d))


#: Languages whose extraction is compared with the declarations that the given index holds.
LANGUAGES = ("java", "kotlin", "typescript", "javascript", "html", "css", "scss", "python", "rust")


def _declared(s: SparkSession, d: str, language: str) -> DataFrame:
    """What extraction finds, in all files of a language, of the declarations that the index holds.

    Left out are files with an odd number of double quotes: in those a string never ends, and what follows may be read as part of it.
    """
    f = _files(s, d).where(F.length(F.regexp_replace("content", '[^"]', "")) % 2 == 0)
    e = extraction.entities_of(extraction.extract_files(f.where(text.language(F.col("path")) == language)))
    return e.join(_entities(s, d).select("uuid"), "uuid", "left_semi").select("uuid", "name", "kind", "fqn", "repo_name", "file_path")


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.orphans(*(_t(spark, sf_dir, n) for n in ("intents", "edges", "entities", "files", "removals", "external_names")))


def _hybrid(s: SparkSession, d: str) -> DataFrame:
    """The search over the index's entities, edges and vectors; a hit without an entity has its rank but no row."""
    return search.hybrid(_entities(s, d), _edges(s, d), _t(s, d, "vectors"), _index_query(s, d), K).select(
        "rank", "score", "uuid", "name", "kind", "fqn", "signature", "docstring", "file_path", "start_line", "repo_name", "calls", "subclasses", "implementers", "caller_count", "caller_samples", "type_usage_count", "type_usage_samples",
    )


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search by meaning, with the graph around the hits."""
    return _hybrid(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query of the core: (spark, directory of the tables) -> DataFrame."""
    return {
        "p2_found": lambda s, d: _orphans(s, d).select("ref_table", "ref_id"),
        "p2_report": lambda s, d: orphans.orphan_report(_orphans(s, d)),
        "extract_entities": lambda s, d: extraction.entities_of(_extracted(s, d)),
        "extract_intents": lambda s, d: extraction.intents_of(_extracted(s, d)),
        **{f"extract_{x}": (lambda s, d, x=x: _declared(s, d, x)) for x in LANGUAGES},
        "current_entities": lambda s, d: _entities(s, d).select("uuid", "name", "kind", "fqn", "signature", "docstring", "file_path", "start_line", "repo_name"),
        "find_references": lambda s, d: graph.find_references(_entities(s, d), _edges(s, d), "(tree"),
        "find_references_repo": lambda s, d: graph.find_references(_entities(s, d), _edges(s, d), "Index", repo=REPO),
        "find_callers_strict": lambda s, d: graph.find_references(_entities(s, d), _edges(s, d), "trimDigest", strict=True, rel_types=("CALLS",)),
        "find_references_all_relations": lambda s, d: graph.find_references(_entities(s, d), _edges(s, d), "-", rel_types=("REFERENCES_DOM", "USES_CSS_CLASS", "MACRO_CALLS", "IMPORTS_SCRIPT", "IMPORTS_STYLESHEET")),
        "callers_grouped_by_target": lambda s, d: graph.grouped_by_target(graph.find_references(_entities(s, d), _edges(s, d), "(")),
        "reference_counts": lambda s, d: graph.reference_counts(_entities(s, d), _edges(s, d)),
        "dead_entities": lambda s, d: graph.dead_entities(_entities(s, d), _edges(s, d)).select("uuid", "name", "kind"),
        "dependencies": lambda s, d: graph.dependencies(_entities(s, d), _edges(s, d)),
        "enrich_entities": lambda s, d: graph.enriched(_entities(s, d), _edges(s, d)),
        "explore_files": lambda s, d: graph.file_sections(_entities(s, d)),
        "contains_edges": lambda s, d: graph.contains_edges(_entities(s, d)),
        "impact": lambda s, d: graph.impact(_edges(s, d), _targets(s, d).select("uuid"), 3),
        "vector_topk": _index_top,
        "vector_topk_filtered": lambda s, d: _index_top(s, d, REPO),
        "vector_topk_embeddings": lambda s, d: vector.top_k(_usable(s, d), _query_vector(s, d), K),
        "hybrid_search": _hybrid,
        "entity_uuid5": lambda s, d: _t(s, d, "entities").select("uuid", ids.uuid5(F.concat_ws(":", "repo_name", "file_path", "fqn")).alias("computed")).distinct(),
        "point_ids": lambda s, d: _entities(s, d).select("uuid", ids.point_id(F.col("uuid")).alias("point_id")),
        "embed_text": lambda s, d: _entities(s, d).select("uuid", text.embed_text(*[F.col(c) for c in ("kind", "name", "decorators", "signature", "docstring", "inline_comments", "file_path", "start_line")]).alias("embed_text")),
        "strip_comments": lambda s, d: _t(s, d, "entities").where("docstring is not null").select(F.col("docstring").alias("raw"), text.strip_comment_markers(F.col("docstring")).alias("stripped")).distinct(),
        "content_hash": lambda s, d: _files(s, d).where("content is not null").select("file_id", text.content_hash(F.col("content")).alias("computed"), "sha256"),
        "supported_files": lambda s, d: _files(s, d).select("file_id", text.is_supported(F.col("path")).alias("supported"), text.language(F.col("path")).alias("lang_of_path")),
        "file_classify": lambda s, d: incremental.counts(_classified(s, d)),
        "files_to_delete": lambda s, d: incremental.to_delete(_classified(s, d)),
        "files_to_parse": lambda s, d: incremental.to_parse(_classified(s, d)),
        "affected_intents": lambda s, d: incremental.affected_intents(_intents(s, d), incremental.to_parse(_classified(s, d)), _targets(s, d).select("name")).select("intent_id"),
        "delete_by_files": lambda s, d: _left(s, d)[0].select("uuid"),
        "delete_by_files_edges": lambda s, d: _left(s, d)[1],
        "delete_by_files_vectors": lambda s, d: _left(s, d)[2],
        "delete_repo": lambda s, d: store.without_repo(_entities(s, d), _edges(s, d), _vectors(s, d), REPO)[1],
        "delete_repo_entities": lambda s, d: store.without_repo(_entities(s, d), _edges(s, d), _vectors(s, d), REPO)[0].select("uuid"),
        "delete_repo_vectors": lambda s, d: store.without_repo(_entities(s, d), _edges(s, d), _vectors(s, d), REPO)[2],
        "upsert_entities": lambda s, d: store.upsert(_entities(s, d).select("uuid", "name", "kind"), _new_entities(s, d), ["uuid"]),
        "upsert_edges": lambda s, d: store.upsert_edges(_edges(s, d).where("rel_type <> 'CALLS'"), _edges(s, d), _entities(s, d)),
        "upsert_calls": lambda s, d: store.upsert_calls(_edges(s, d).where("rel_type = 'EXTENDS'"), _edges(s, d), _entities(s, d)),
        "entity_dedup": lambda s, d: lines.one_per_declaration(_t(s, d, "entities").select("uuid", "name", "kind", "signature", "repo_name", "file_path", "start_line").distinct()),
        "resolve_by_name": lambda s, d: resolve.resolve(_intents(s, d).where("intent_type not in ('Call', 'HtmlFileImport', 'CssFileImport')"), _entities(s, d)),
        "resolve_imports": lambda s, d: resolve.resolve(_relative_imports(s, d), _entities(s, d)),
        "resolve_calls": lambda s, d: _calls(s, d).where("step <> 6").select("src_uuid", "method", "receiver", "uuid", "step"),
        "resolve_inherited": lambda s, d: resolve.parents(_intents(s, d), _entities(s, d)),
        "fuzzy_fqn": lambda s, d: resolve.resolve_calls(_partial_calls(s, d), _entities(s, d)).where("step = 6").select("src_uuid", "method", "receiver", "uuid"),
        "resolve_by_repo": lambda s, d: resolve.resolve(_intents(s, d).where("intent_type not in ('Call', 'HtmlFileImport', 'CssFileImport')"), _entities(s, d), contexts=_contexts(s, d)),
        "name_map": lambda s, d: resolve.name_map(_entities(s, d)),
        "cross_repo_context": lambda s, d: resolve.fqn_map(resolve.context(_entities(s, d), REPO, ["ember-vault-ba0", "vale-loom-ba1"]), REPO),
        "nearest_entity": lambda s, d: lines.nearest_entity(_refs(s, d), _spans(s, d), ["repo_name", "file_path"]),
        "nearest_entity_before": lambda s, d: lines.nearest_before(_refs(s, d), _spans(s, d), ["repo_name", "file_path"]),
        "enclosing_context": lambda s, d: lines.enclosing_class(_refs(s, d).withColumnRenamed("ref_id", "row_id"), _classes(s, d), ["repo_name", "file_path"]),
        "orphan_lines": lambda s, d: lines.covered(_ends(s, d), _spans(s, d).where("end_line is not null").select("repo_name", "file_path", F.col("start_line").alias("lo"), F.col("end_line").alias("hi")), ["repo_name", "file_path"]).select("ref_id"),
        "watch_batches": _batches,
        "watch_dedup": lambda s, d: distinct_changes(_t(s, d, "events"), "user_id", "event_type"),
    }


def oracle_sql() -> dict[str, str]:
    """The same in SQL."""
    return SQL
