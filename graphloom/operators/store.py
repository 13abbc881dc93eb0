"""The engine's tables on disk and how they change.

A table is cut into parts by repository and, within one, by a hash of the file; a part is a folder of one version. A manifest, numbered,
names the version of every part of every table; the newest counts. A change writes new versions of the parts that it touches and then one
manifest for all tables, so a reader sees all tables as of one change, nothing is overwritten while it is read, and a lost executor or a
broken job leaves everything as it was. What no manifest of the last day names is deleted.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from graphloom import schema as S

TABLES: dict[str, StructType] = {"files": S.FILES, "entities": S.ENTITIES, "intents": S.INTENTS, "edges": S.EDGES, "vectors": S.VECTORS, "state": S.STATE}


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """`old` with the rows of `new` in place of those of the same keys; of new rows with one key the greatest stays."""
    rest = [c for c in new.columns if c not in keys]
    one = new.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("r")).select(*keys, "r.*") if rest else new.distinct()
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(one, allowMissingColumns=True)


def upsert_edges(old: DataFrame, new: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges of both, each once; new ones only if both ends exist."""
    from graphloom.operators.graph import existing_ends

    keys = ["src_uuid", "dst_uuid", "rel_type"]
    return old.select(*keys).unionByName(existing_ends(new, entities)).distinct()


def upsert_calls(old: DataFrame, new: DataFrame, entities: DataFrame) -> DataFrame:
    return upsert_edges(old, new.where("rel_type = 'CALLS'"), entities)


def without_files(entities: DataFrame, edges: DataFrame, vectors: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the entities of the files in `gone` (repo_name, file_path), their edges and their vectors."""
    dead = entities.join(gone.select("repo_name", "file_path").distinct(), ["repo_name", "file_path"], "left_semi").select("uuid").distinct()
    return without(entities, edges, vectors, dead)


def without(entities: DataFrame, edges: DataFrame, vectors: DataFrame, dead: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    left = edges.join(dead.withColumnRenamed("uuid", "src_uuid"), "src_uuid", "left_anti").join(dead.withColumnRenamed("uuid", "dst_uuid"), "dst_uuid", "left_anti")
    return entities.join(dead, "uuid", "left_anti"), left.select(*edges.columns), vectors.join(dead, "uuid", "left_anti")


def without_repo(entities: DataFrame, edges: DataFrame, vectors: DataFrame, repo: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without a repository."""
    return without(entities, edges, vectors, entities.where(F.col("repo_name") == repo).select("uuid").distinct())


#: Parts of a repository; the column by which each table's rows are dealt to them.
PARTS = 8
BY = {"files": "path", "entities": "file_path", "intents": "src_file", "edges": "src_uuid", "vectors": "file_path", "state": "path"}
#: Seconds for which versions stay that are no longer current, so that who reads them can finish.
KEEP = 86_400.0


def part_of(by: Column) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(by, F.lit(""))), F.lit(PARTS)).cast("int")


def folder_of(repo: Column) -> Column:
    """The folder of a repository: 16 digits of its hash, as names may hold anything."""
    return F.substring(F.sha1(F.encode(F.coalesce(repo, F.lit("")), "UTF-8")), 1, 16)


class Store:
    """Versioned Parquet tables under one folder, local or on any file system that Spark reads."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.root).getFileSystem(conf)

    def ensure(self) -> None:
        """Creates the folder of manifests with an empty one."""
        if not self._numbers():
            self._check()
            self._publish(1, {})

    def _list(self, folder: str) -> list:
        p = self._path(f"{self.root}/{folder}")
        return list(self._fs.listStatus(p)) if self._fs.exists(p) else []

    def _numbers(self) -> list[int]:
        return sorted(int(n[:-5]) for n in (s.getPath().getName() for s in self._list("_manifests")) if n.endswith(".json") and n[:-5].isdigit())

    def _check(self) -> None:
        """Tables without a manifest are no empty tables."""
        for name in TABLES:
            if any(s.getPath().getName().startswith("v-") for s in self._list(name)):
                raise RuntimeError(f"{self.root} holds versions of {name} but no manifest")

    def manifest(self) -> dict:
        """{table: {"repository's folder/part": version}} of the newest manifest."""
        return self._newest()[1]

    def _newest(self) -> tuple[int, dict]:
        numbers = self._numbers()
        if not numbers:
            self._check()
            return 0, {}
        stream = self._fs.open(self._path(f"{self.root}/_manifests/{numbers[-1]:012d}.json"))
        try:
            return numbers[-1], json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def _publish(self, number: int, manifest: dict) -> None:
        tmp, to = self._path(f"{self.root}/_manifests/.new-{uuid.uuid4().hex}"), self._path(f"{self.root}/_manifests/{number:012d}.json")
        stream = self._fs.create(tmp, True)
        stream.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        stream.close()
        if self._fs.exists(to) or not self._fs.rename(tmp, to):
            self._fs.delete(tmp, False)
            raise RuntimeError(f"another change of {self.root} came first")

    def folder(self, repo: str) -> str:
        return hashlib.sha1((repo or "").encode()).hexdigest()[:16]

    def read(self, name: str, repos: list[str] | None = None, parts: list[int] | None = None, manifest: dict | None = None) -> DataFrame:
        """A table, or only the rows of some repositories and of some of their parts: other folders are not even listed."""
        found = (self.manifest() if manifest is None else manifest).get(name, {})
        wanted = None if repos is None else {self.folder(r) for r in repos}
        paths = [f"{self.root}/{name}/{v}/repo={k.split('/')[0]}/part={k.split('/')[1]}" for k, v in sorted(found.items()) if (wanted is None or k.split("/")[0] in wanted) and (parts is None or int(k.split("/")[1]) in parts)]
        df = self.spark.read.schema(TABLES[name]).parquet(*paths) if paths else self.spark.createDataFrame([], TABLES[name])
        return df if repos is None else df.where(F.coalesce("repo_name", F.lit("")).isin([r or "" for r in repos]))

    def commit(self, changes: dict[str, tuple[DataFrame, list[tuple[str, int]] | None]]) -> None:
        """Puts in place of parts of tables, (repository, part), what the DataFrames hold of them; of other parts they must hold nothing.

        All tables change at once. A part that gets no rows is gone. Without a list the whole table is replaced.
        """
        number, manifest = self._newest()
        new = {t: dict(parts) for t, parts in manifest.items()}
        versions = {name: f"v-{uuid.uuid4().hex}" for name in changes}

        def put(name: str) -> None:
            df = changes[name][0]
            out = df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in TABLES[name].fields])
            out = out.withColumn("repo", folder_of(F.col("repo_name"))).withColumn("part", part_of(F.col(BY[name])))
            out.repartition("repo", "part").sortWithinPartitions("repo", "part", BY[name]).write.partitionBy("repo", "part").parquet(f"{self.root}/{name}/{versions[name]}")

        with ThreadPoolExecutor(len(changes)) as pool:  # the tables' jobs run side by side
            list(pool.map(put, changes))
        for name, (_, touched) in changes.items():
            version, here = versions[name], new.setdefault(name, {})
            if touched is None:
                here.clear()
            for repo, part in touched or ():
                here.pop(f"{self.folder(repo)}/{part}", None)
            for r in self._list(f"{name}/{version}"):
                repo = r.getPath().getName()
                if repo.startswith("repo="):
                    for q in self._list(f"{name}/{version}/{repo}"):
                        here[f"{repo[5:]}/{q.getPath().getName()[5:]}"] = version
        self._publish(number + 1, new)
        self.expire()

    def write(self, name: str, df: DataFrame) -> None:
        """Replaces a whole table."""
        self.commit({name: (df, None)})

    def expire(self, seconds: float = KEEP) -> None:
        """Deletes manifests, but for the newest, and versions that have not been current for so long."""
        old = (time.time() - seconds) * 1000
        numbers = self._numbers()
        used: set[str] = set()
        for i, n in enumerate(numbers):
            p = self._path(f"{self.root}/_manifests/{n:012d}.json")
            # a manifest was current until the next one came
            until = self._fs.getFileStatus(self._path(f"{self.root}/_manifests/{numbers[i + 1]:012d}.json")).getModificationTime() if i + 1 < len(numbers) else None
            if until is not None and until < old:
                self._fs.delete(p, False)
                continue
            stream = self._fs.open(p)
            used |= {v for parts in json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()).values() for v in parts.values()}
            stream.close()
        for name in TABLES:
            for s in self._list(name):
                v = s.getPath().getName()
                if v.startswith("v-") and v not in used and s.getModificationTime() < old:
                    self._fs.delete(s.getPath(), True)


def repo_name_of(path: str) -> str:
    """The last part of a repository's path; `unnamed-repo` if it has none."""
    return os.path.basename(os.path.normpath(path)).strip("./") or "unnamed-repo"
