"""Indexing: a whole repository at once, what changed since, and continuously as a stream of changes."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import extraction, graph, incremental, resolve, store, vector
from graphloom.session import cut
from graphloom.sources import discovery


class Indexer:
    """Keeps the tables of a Store in step with a source tree."""

    def __init__(self, spark: SparkSession, root: str, path: str, repo: str | None = None, dependencies: tuple[str, ...] = (), embedder: vector.Embedder | None = None, extractors: dict | None = None, attempts: int = 2):
        self.spark, self.path, self.repo = spark, path, repo or store.repo_name_of(path)
        self.dependencies, self.embedder = list(dependencies), embedder or vector.HashingEmbedder()
        self.extractors, self.attempts = extractors, attempts
        self.store = store.Store(spark, root)
        self.store.ensure()
        discovery.register(spark)

    def current(self) -> DataFrame:
        """The tree's files with their hashes, without contents."""
        return self.spark.read.format("source_tree").option("path", self.path).option("repo", self.repo).option("content", "false").load().select("repo_name", "path", "sha256", "error")

    def run(self, clean: bool = False) -> dict[str, int]:
        """One indexing; files whose hash is as it was are left alone unless `clean`. Returns how many files were in each state.

        Only parts with changed files are read and written, of the vectors too; all tables change at once, with the last step. Running it
        again after a failure is safe.
        """
        s, repo = self.store, self.repo
        manifest = s.manifest()
        mine = lambda name, parts=None: s.read(name, [repo], parts, manifest)
        files = cut(self.current())
        state = mine("state")
        classified = cut(incremental.classify(files.select("repo_name", "path", "sha256"), state, clean))
        counts = {r.status: r.n for r in incremental.counts(classified).collect()}
        if not any(counts.get(k) for k in ("added", "modified", "deleted")):
            return counts
        gone = incremental.to_delete(classified).withColumnRenamed("path", "file_path")
        parts = list(range(store.PARTS)) if clean else _parts(gone, "file_path")
        read = discovery.contents(incremental.to_parse(classified).repartition(self.spark.sparkContext.defaultParallelism, "path"))
        new = cut(extraction.extract_files(read.where("error is null"), self.extractors))
        fresh = extraction.entities_of(new)
        # the parts with changed files, without what those files held, and with what they hold now
        was = mine("entities", parts)
        kept = was.limit(0) if clean else was.join(gone, ["repo_name", "file_path"], "left_anti")
        entities = cut(kept.unionByName(fresh, allowMissingColumns=True))
        left = mine("intents", parts)
        left = left.limit(0) if clean else left.join(gone.withColumnRenamed("file_path", "src_file"), ["repo_name", "src_file"], "left_anti")
        intents = cut(left.unionByName(extraction.intents_of(new)))
        vectors = mine("vectors", parts)
        vectors = vectors.limit(0) if clean else vectors.join(gone, ["repo_name", "file_path"], "left_anti")
        vectors = vectors.unionByName(vector.embed(fresh, self.embedder), allowMissingColumns=True)
        # a name that came or went may change what other files' references mean: those are resolved again
        others = [p for p in range(store.PARTS) if p not in parts]
        all_entities = entities.unionByName(mine("entities", others))
        all_intents = intents.unionByName(mine("intents", others))
        dead = was if clean else was.join(gone, ["repo_name", "file_path"], "left_semi")
        names = incremental.changed_names(dead, fresh)
        again = incremental.affected_intents(all_intents, incremental.to_parse(classified), names)
        stale = cut(again.select("src_uuid").unionByName(dead.select(F.col("uuid").alias("src_uuid"))).unionByName(fresh.select(F.col("uuid").alias("src_uuid"))).distinct())
        whole = all_intents.join(stale, "src_uuid", "left_semi")
        lineage = all_intents.where("intent_type = 'Extends'")
        context = all_entities.unionByName(s.read("entities", self.dependencies, None, manifest)) if self.dependencies else all_entities
        # both are read many times by the resolution: written once, in few columns
        context = cut(context.select("uuid", "name", "fqn", "file_path", "start_line", "repo_name"))
        whole = cut(whole.unionByName(lineage).distinct())
        found = resolve.resolve(whole, context, repo)
        found = found.unionByName(graph.contains_edges(fresh)).join(stale, "src_uuid", "left_semi")
        touched = _parts(stale, "src_uuid")
        old = mine("edges", touched).join(stale, "src_uuid", "left_anti").select("src_uuid", "dst_uuid", "rel_type")
        edges = store.upsert_edges(old, found, context).withColumn("repo_name", F.lit(repo))
        hashes = files.where("error is null").select("repo_name", "path", "sha256").withColumn("p", store.part_of(F.col("path"))).where(F.col("p").isin(parts)).drop("p")
        of = lambda which: [(repo, p) for p in which]
        s.commit({"entities": (entities, of(parts)), "intents": (intents, of(parts)), "vectors": (vectors, of(parts)), "edges": (edges, of(touched)), "state": (incremental.new_state(hashes), of(parts))})
        return counts

    def watch(self, checkpoint: str, seconds: float = 0.5, once: bool = False):
        """A streaming query that indexes after every batch of changes; a change that is delivered twice changes nothing."""
        changes = self.spark.readStream.format("source_tree").option("path", self.path).option("repo", self.repo).option("changes", "true").load()
        w = changes.writeStream.foreachBatch(self.on_batch).option("checkpointLocation", checkpoint)
        # the simple reader of a Python source has no end to stop at, so `once` is left to processAllAvailable
        return w.trigger(processingTime=f"{seconds} seconds").start()

    def on_batch(self, batch: DataFrame, batch_id: int) -> None:
        """One run for the whole batch; what the batch names is only a sign that there is something to do.

        A run that fails is tried again, and then reported without ending the stream: the state still names the files as they were, so the
        next batch makes up for it.
        """
        if batch.select("path").distinct().isEmpty():
            return
        for attempt in range(self.attempts):
            try:
                self.run()
                return
            except Exception:
                logging.getLogger(__name__).exception("indexing after batch %s failed (%s of %s)", batch_id, attempt + 1, self.attempts)


def _parts(df: DataFrame, column: str) -> list[int]:
    """The parts in which the values of a column lie: at most PARTS numbers."""
    return sorted(r.p for r in df.select(store.part_of(F.col(column)).alias("p")).distinct().collect())
