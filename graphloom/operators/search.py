"""Search by meaning with the graph around each hit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import graph, vector


def hybrid(entities: DataFrame, edges: DataFrame, vectors: DataFrame, query: list[float], k: int = 5, repo: str | None = None) -> DataFrame:
    """The k entities nearest to the query vector, in order, with what they call and what refers to them.

    The k hits are worked out at once, when the plan is made: their uuids, k strings, are then filters that reach the scans of the tables.
    """
    top = vector.top_k(vectors, query, k, repo)
    found = top.collect()  # k rows
    ids = [r.uuid for r in found]
    hits = F.broadcast(entities.sparkSession.createDataFrame(found, top.schema))
    e = entities.where(F.col("uuid").isin(ids)).join(hits, "uuid")
    out, into = edges.where(F.col("src_uuid").isin(ids) & (F.col("rel_type") == "CALLS")), edges.where(F.col("dst_uuid").isin(ids))
    calls = graph.dependencies_of(entities, out).select("uuid", "calls")
    around = graph.enriched(entities, into)
    cols = ["rank", "score", "uuid", "name", "kind", "fqn", "signature", "docstring", "file_path", "start_line", "repo_name"]
    j = e.select(*cols).join(calls, "uuid", "left").join(around, "uuid", "left")
    fill = {"calls": "", "subclasses": "", "implementers": "", "type_usage_samples": "", "caller_samples": "", "type_usage_count": 0, "caller_count": 0}
    return j.na.fill(fill).orderBy("rank")
