"""References to records that do not exist (problem 2).

The integer keys are instants (microseconds): of each parent key, the instants at which some row of it is live are compressed into
contiguous runs [start, end). A reference is matched as of its own instant to the run that starts last at or before it, and reported
when it lies beyond that run's end or when no run precedes it. Compression and match are one sweep: intervals and references of a key are
put together, sorted by time and passed over once; nothing is joined by range.

Defined cases: null keys refer to nothing; a reference without a time is not judged; a parent row without a time is never live;
`this` and `self` without an enclosing class stand for no receiver; repeated rows count once. Columns beyond those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hash buckets whose rows are counted to find hot keys; the hot ones, fewer than 256, are the only thing that reaches the driver.
BUCKETS = 1 << 14
#: Slices of time into which the rows of a hot bucket are cut, as equal in rows as quantiles make them.
SLICES = 64
#: The end of what never ends.
FOREVER = (1 << 63) - 1


def _bucket(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def hot_buckets(df: DataFrame, keys: list[str], share: float = 1 / 256) -> list[int]:
    """Hash buckets of `keys` that hold more than `share` of the rows: at most 1 / share of them."""
    counts = df.groupBy(_bucket(keys).alias("b")).count()
    total = F.sum("count").over(Window.partitionBy())
    rows = counts.select("b", "count", total.alias("t")).where((F.col("count") > F.col("t") * share) & (F.col("count") > 1000)).select("b").collect()
    return sorted(r.b for r in rows)


def sweep(points: DataFrame, marks: DataFrame, keys: list[str]) -> DataFrame:
    """`points` (keys, t, ...) with run_start and run_end, of the marks (keys, t, end) with the same keys at or before t: the largest end,
    and the t at which the run began that reaches it. Both are null where no mark precedes.

    A hot key is cut into slices of time. A slice gets what the slices before it reach as one mark, with the start of the mark that reaches
    it; points of one instant that fill several slices by themselves are spread over as many tasks.
    """
    own = [c for c in points.columns if c not in (*keys, "t")]
    p = points.select(*keys, "t", F.lit(None).cast("long").alias("end"), F.struct(F.lit(1).alias("_"), *own).alias("row"))
    m = marks.groupBy(*keys, "t").agg(F.max("end").alias("end")).withColumn("row", F.lit(None).cast(p.schema["row"].dataType))
    hot = hot_buckets(points.select(*keys).unionByName(marks.select(*keys)), keys)
    by = list(keys)
    if hot:
        p, m = _sliced(p, m, keys, hot)
        by += ["slice", "salt"]
    w = Window.partitionBy(*by).orderBy("t", F.col("row").isNotNull(), "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    e = p.unionByName(m).withColumn("begins", F.when(F.col("row").isNull() & (before.isNull() | (F.col("t") > before)), F.col("t")))
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    e = e.select(*keys, "t", "row", F.last("begins", ignorenulls=True).over(so_far).alias("run_start"), F.max("end").over(so_far).alias("run_end"))
    return e.where("row is not null").select(*keys, "t", *[F.col("row")[c].alias(c) for c in own], "run_start", "run_end")


def _sliced(p: DataFrame, m: DataFrame, keys: list[str], hot: list[int]) -> tuple[DataFrame, DataFrame]:
    """Points and marks with slice and salt: 0 and 0 but in hot buckets."""
    b = F.when(_bucket(keys).isin(hot), _bucket(keys))
    p, m = p.withColumn("b", b), m.withColumn("b", b)
    cuts = p.select("b", "t").unionByName(m.select("b", "t")).where("b is not null").groupBy("b").agg(F.percentile_approx("t", [i / SLICES for i in range(1, SLICES)], 2000).alias("cuts"))
    cuts = F.broadcast(cuts.withColumn("at", F.array_distinct("cuts")))  # a row for each hot bucket, fewer than 256

    def cut(df: DataFrame) -> DataFrame:
        df = df.join(cuts, "b", "left").withColumn("slice", F.coalesce(F.size(F.filter("at", lambda x: x < F.col("t"))), F.lit(0)))
        last = F.try_element_at("at", F.col("slice") + 1)  # the slice's last instant; as often among the cuts as it fills slices
        return df.withColumn("salts", F.greatest(F.lit(1), F.coalesce(F.size(F.filter("cuts", lambda x: x == last)), F.lit(1)))).drop("cuts", "at")

    p, m = cut(p), cut(m)
    each = [*keys, "slice", "salts"]
    here = p.where("b is not null").select(*each).distinct().unionByName(m.where("b is not null").select(*each).distinct()).distinct()
    reach = m.where("b is not null").groupBy(*keys, "slice").agg(F.max(F.struct("end", "t")).alias("far"))
    w = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)  # at most SLICES rows a key
    carried = here.join(reach, [*keys, "slice"], "left").withColumn("far", F.max("far").over(w)).where("far is not null")
    carried = carried.select(*keys, F.col("far.t").alias("t"), F.col("far.end").alias("end"), F.lit(None).cast(p.schema["row"].dataType).alias("row"), "slice", "salts")
    m = m.drop("b").unionByName(carried)
    p = p.withColumn("salt", F.pmod(F.xxhash64("row"), F.col("salts")).cast("int")).drop("b", "salts")
    return p, m.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")


def ends(parents: DataFrame, removals: DataFrame) -> DataFrame:
    """`parents` (repo_name, path, start, ...) with `end`: the first removal of (repo_name, path) at or after start, else FOREVER."""
    at = F.unix_micros(F.col("removed_at").cast("timestamp"))
    stops = removals.select("repo_name", F.col("file_path").alias("path"), (-at).alias("t")).where("t is not null and repo_name is not null and path is not null")
    found = sweep(parents.withColumn("t", -F.col("start")), stops.withColumn("end", F.col("t")), ["repo_name", "path"])  # time runs backwards
    return found.select(*parents.columns, F.coalesce(-F.col("run_end"), F.lit(FOREVER)).alias("end"))


def references(intents: DataFrame, edges: DataFrame, external_names: DataFrame) -> DataFrame:
    """(space, scope, key, at, ref_table, ref_id): space u for uuids, f for fqns and p for paths; scope is the repository."""
    target = F.trim("target")
    receiver = F.when(F.col("receiver").isin("this", "self"), F.col("src_enclosing_class")).otherwise(F.col("receiver"))
    link = F.when(F.col("src_file").endswith(".rs"), "::").otherwise(".")
    is_path = F.col("intent_type").isin("HtmlFileImport", "CssFileImport")
    key = (
        F.when(is_path, target)
        .when(F.col("intent_type") == "DomElementReference", F.concat(F.lit("#"), target))
        .when(F.col("intent_type") == "CssClassUsage", F.concat(F.lit("."), target))
        .when(F.col("intent_type") == "RustMacroCall", F.concat(target, F.lit("!")))
        .otherwise(F.concat(F.coalesce(F.concat(receiver, F.coalesce(link, F.lit("."))), F.lit("")), target))
    )
    at = F.unix_micros(F.col("recorded_at").cast("timestamp"))
    a = intents.select(F.when(is_path, "p").otherwise("f").alias("space"), F.col("repo_name").alias("scope"), key.alias("key"), at.alias("at"), F.lit("intents").alias("ref_table"), F.col("intent_id").cast("long").alias("ref_id"))
    outside = external_names.select(F.lit("f").alias("space"), F.col("name").alias("key")).where("key is not null").distinct()  # broadcast by the planner while it is small
    a = a.join(outside, ["space", "key"], "left_anti").select("space", "scope", "key", "at", "ref_table", "ref_id")
    when = F.unix_micros(F.col("resolved_at").cast("timestamp"))
    b = edges.select(F.explode(F.array(*(F.lower(F.trim(c)) for c in ("src_uuid", "dst_uuid")))).alias("key"), when.alias("at"), F.col("edge_id").cast("long").alias("ref_id"))
    b = b.select(F.lit("u").alias("space"), F.lit("").alias("scope"), "key", "at", F.lit("edges").alias("ref_table"), "ref_id")
    return a.unionByName(b).where("key is not null and scope is not null and at is not null and ref_id is not null")


def live_intervals(entities: DataFrame, files: DataFrame, removals: DataFrame) -> DataFrame:
    """(space, scope, key, start, end) of every row that references may name."""
    e = entities.select("repo_name", F.col("file_path").alias("path"), F.lower(F.trim("uuid")).alias("uuid"), "fqn", F.lit(False).alias("is_file"), F.unix_micros(F.col("indexed_at").cast("timestamp")).alias("start"))
    f = files.select("repo_name", "path", F.lit(None).cast("string").alias("uuid"), F.lit(None).cast("string").alias("fqn"), F.lit(True).alias("is_file"), F.unix_micros(F.col("scanned_at").cast("timestamp")).alias("start"))
    p = ends(e.unionByName(f).where("start is not null"), removals)

    def one(space: str, scope: Column, key: Column) -> Column:
        return F.struct(F.lit(space).alias("space"), scope.alias("scope"), key.alias("key"))

    names = F.when(F.col("is_file"), F.array(one("p", F.col("repo_name"), F.col("path")))).otherwise(F.array(one("u", F.lit(""), F.col("uuid")), one("f", F.col("repo_name"), F.col("fqn"))))
    return p.select(F.explode(names).alias("k"), "start", "end").select("k.*", "start", "end").where("key is not null and scope is not null")


def orphans(intents: DataFrame, edges: DataFrame, entities: DataFrame, files: DataFrame, removals: DataFrame, external_names: DataFrame) -> DataFrame:
    """References without a live parent at their time: (ref_table, ref_id, at), one row per reference."""
    keys = ["space", "scope", "key"]
    refs = references(intents, edges, external_names).withColumnRenamed("at", "t")
    live = live_intervals(entities, files, removals).where("start < end").withColumnRenamed("start", "t")
    out = sweep(refs, live, keys).where("run_start is null or t >= run_end")
    return out.groupBy("ref_table", "ref_id").agg(F.min("t").alias("at"))


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphans per table and month (of the reference's time)."""
    month = F.date_format(F.timestamp_micros("at"), "yyyy-MM")
    return found.groupBy("ref_table", month.alias("month")).agg(F.count("*").alias("orphans"))
