"""What changed, and what has to be done again because of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def classify(current: DataFrame, state: DataFrame, clean: bool = False) -> DataFrame:
    """(repo_name, path, status): added, modified, unchanged or deleted, by comparing hashes; `clean` treats all current files as added.

    A null hash never equals another. Repeated rows count once (the largest hash).
    """
    a = current.groupBy("repo_name", "path").agg(F.max("sha256").alias("new"), F.lit(1).alias("here"))
    b = state.groupBy("repo_name", "path").agg(F.max("sha256").alias("old"), F.lit(1).alias("there"))
    j = a.join(b, ["repo_name", "path"], "full_outer")
    status = F.when(F.col("here").isNull(), "deleted").when(F.col("there").isNull() | F.lit(clean), "added").when(F.col("new") == F.col("old"), "unchanged").otherwise("modified")
    return j.select("repo_name", "path", status.alias("status"))


def counts(classified: DataFrame) -> DataFrame:
    return classified.groupBy("status").agg(F.count("*").alias("n"))


def to_delete(classified: DataFrame) -> DataFrame:
    """Files whose entities go: deleted, modified, and added ones too, in case an earlier run broke off."""
    return classified.where("status in ('deleted', 'modified', 'added')").select("repo_name", "path")


def to_parse(classified: DataFrame) -> DataFrame:
    return classified.where("status in ('added', 'modified')").select("repo_name", "path")


def affected_intents(intents: DataFrame, changed_files: DataFrame, changed_names: DataFrame) -> DataFrame:
    """Intents to resolve again: of changed files, or whose target's last part is a name that came or went.

    `changed_files` has repo_name and path, `changed_names` a column name. Resolving only these gives the edges of resolving all.
    """
    f = changed_files.select("repo_name", F.col("path").alias("src_file")).distinct()
    n = changed_names.select(F.col("name").alias("last")).where("last is not null").distinct()
    i = intents.withColumn("last", F.regexp_extract("target", r"([^.:#!]+)!?$", 1))
    mine = i.join(f, ["repo_name", "src_file"], "left_semi")
    return mine.unionByName(i.join(n, "last", "left_semi").join(f, ["repo_name", "src_file"], "left_anti")).drop("last")


def changed_names(before: DataFrame, after: DataFrame) -> DataFrame:
    """(name): names of entities that came, went or mean another than before: of which the uuids, full names or their order in a file differ."""

    def named(df: DataFrame) -> DataFrame:
        w = Window.partitionBy("file_path", "name").orderBy(F.coalesce("start_line", F.lit(0)), "uuid")
        return df.where("name is not null").select("name", F.coalesce("fqn", F.lit("")).alias("fqn"), "uuid", "file_path", F.row_number().over(w).alias("n"))

    a, b = named(before), named(after)
    keys = ["name", "fqn", "uuid", "file_path", "n"]
    return a.join(b, keys, "left_anti").select("name").unionByName(b.join(a, keys, "left_anti").select("name")).distinct()


def new_state(current: DataFrame) -> DataFrame:
    return current.groupBy("repo_name", "path").agg(F.max("sha256").alias("sha256"))
