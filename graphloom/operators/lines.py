"""Joins by position in a file: what encloses a line, and what is nearest to it.

No operator pairs all references of a file with all its entities. What precedes a line comes from one pass over both in the order of lines;
what encloses it from a join on the aligned blocks of lines that an interval is made of, of which only the best interval each is kept.
Null lines lie nowhere and give no rows, but for enclosing_class, which gives every row its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.orphans import sweep

#: Blocks are LEVELS long runs of 8 ** level lines, aligned: an interval is made of at most 14 a level, and a line lies in one a level.
LEVELS = 8
#: The line after the last: no file is longer.
LAST = 8**LEVELS - 1


def _blocks(lo: Column, hi: Column) -> Column:
    """The aligned blocks (level, number) that make up the lines lo to hi: at each level what is left over at both ends."""
    parts = []
    for k in range(LEVELS):
        a, b = (lo + F.lit(8**k - 1)).cast("long"), (hi + 1).cast("long")  # whole blocks of this level between the ends
        first, stop = F.floor(a / 8**k).cast("long"), F.floor(b / 8**k).cast("long")
        up, down = F.floor((lo + F.lit(8 ** (k + 1) - 1)) / 8 ** (k + 1)).cast("long") * 8, F.floor(b / 8 ** (k + 1)).cast("long") * 8
        inner = (up < down) & F.lit(k + 1 < LEVELS)  # blocks of a higher level take the middle
        whole = lambda x, y: F.when(x < y, F.sequence(x, y - 1)).otherwise(F.array().cast("array<bigint>"))
        numbers = F.when(inner, F.concat(whole(first, F.least(up, stop)), whole(F.greatest(down, first), stop))).otherwise(whole(first, stop))
        parts.append(F.transform(numbers, lambda x: F.struct(F.lit(k).alias("level"), x.alias("block"))))  # noqa: B023
    return F.concat(*parts)


def stab(points: DataFrame, intervals: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The distinct (`by`, at) of `points` that some interval (`by`, lo, hi) holds, with `best`: the least struct of the columns `order`.

    A block keeps its best interval before the join, so each line meets at most LEVELS rows; hot files spread over their blocks.
    """
    cut = intervals.where("lo <= hi").withColumn("lo", F.greatest("lo", F.lit(0))).withColumn("hi", F.least("hi", F.lit(LAST)))
    held = cut.select(*by, F.struct(*order).alias("o"), F.explode(_blocks(F.col("lo"), F.col("hi"))).alias("b")).select(*by, "b.level", "b.block", "o")
    held = held.groupBy(*by, "level", "block").agg(F.min("o").alias("o"))
    at = points.select(*by, F.col("at").cast("long").alias("at")).where("at is not null").distinct()
    at = at.select(*by, "at", F.explode(F.array(*(F.struct(F.lit(k).alias("level"), F.floor(F.col("at") / 8**k).cast("long").alias("block")) for k in range(LEVELS)))).alias("b")).select(*by, "at", "b.*")
    return at.join(held, [*by, "level", "block"]).groupBy(*by, "at").agg(F.min("o").alias("best"))


def _before(refs: DataFrame, entities: DataFrame, by: list[str]) -> DataFrame:
    """`refs` with `prev`, the (start_line, uuid) that begins last at or before the line, the smallest uuid of several, and `next`, the first after it."""
    starts = entities.where("start_line is not null").groupBy(*by, "start_line").agg(F.min("uuid").alias("uuid"))
    own = F.struct(*[c for c in refs.columns if c not in by])
    shape = refs.select(own.alias("row")).schema["row"].dataType
    e = refs.where("line is not null").select(*by, F.col("line").cast("int").alias("t"), F.lit(None).cast("string").alias("uuid"), own.alias("row"))
    e = e.unionByName(starts.select(*by, F.col("start_line").cast("int").alias("t"), F.col("uuid").cast("string").alias("uuid"), F.lit(None).cast(shape).alias("row")))
    mark = F.when(F.col("row").isNull(), F.struct(F.col("t").alias("start_line"), "uuid"))
    up = Window.partitionBy(*by).orderBy("t", F.col("row").isNotNull())
    down = Window.partitionBy(*by).orderBy(F.desc("t"), F.col("row").isNull())
    so_far = (Window.unboundedPreceding, 0)
    e = e.withColumn("prev", F.last(mark, ignorenulls=True).over(up.rowsBetween(*so_far))).withColumn("next", F.last(mark, ignorenulls=True).over(down.rowsBetween(*so_far)))
    return e.where("row is not null").select(*by, "row.*", "prev", "next")


def nearest_entity(refs: DataFrame, entities: DataFrame, by: list[str]) -> DataFrame:
    """For each reference (`by`, ref_id, line) the uuid of its nearest entity (`by`, uuid, start_line, end_line).

    The smallest that contains the line; else the latest that begins before it; else the one that begins soonest after. A null end is open.
    """
    spans = entities.where("start_line is not null").select(*by, "uuid", "start_line", F.col("start_line").cast("long").alias("lo"), F.coalesce("end_line", F.lit(1 << 30)).cast("long").alias("hi"))
    held = stab(refs.withColumn("at", F.col("line")), spans.withColumn("size", F.col("hi") - F.col("lo")), by, ["size", "start_line", "uuid"])
    near = _before(refs, entities, by).withColumn("at", F.col("line").cast("long"))
    near = near.join(held, [*by, "at"], "left").withColumn("uuid", F.coalesce("best.uuid", "prev.uuid", "next.uuid")).where("uuid is not null")
    return near.groupBy("ref_id").agg(F.min("uuid").alias("uuid"))


def nearest_before(refs: DataFrame, entities: DataFrame, by: list[str]) -> DataFrame:
    """The entity that begins last at or before the line; else the first of the file."""
    near = _before(refs, entities, by).withColumn("uuid", F.coalesce("prev.uuid", "next.uuid")).where("uuid is not null")
    return near.groupBy("ref_id").agg(F.min("uuid").alias("uuid"))


def enclosing_class(rows: DataFrame, classes: DataFrame, by: list[str]) -> DataFrame:
    """For each row (`by`, row_id, line) the outermost class (`by`, name, start_line, end_line) with start < line < end; null for none."""
    c = classes.where("start_line is not null and end_line is not null").select(*by, "start_line", F.col("name").alias("cls"), (F.col("start_line") + 1).cast("long").alias("lo"), (F.col("end_line") - 1).cast("long").alias("hi"))
    at = rows.withColumn("at", F.col("line").cast("long"))
    j = at.join(stab(at, c, by, ["start_line", "cls"]), [*by, "at"], "left")
    return j.groupBy("row_id").agg(F.min(F.col("best.cls")).alias("enclosing"))


def covered(points: DataFrame, ranges: DataFrame, by: list[str]) -> DataFrame:
    """Points (`by`, at) that lie in no range (`by`, lo, hi), ends included."""
    cols = [c for c in points.columns if c != "at"]
    marks = ranges.where("lo <= hi").select(*by, F.col("lo").cast("long").alias("t"), F.col("hi").cast("long").alias("end"))
    out = sweep(points.where("at is not null").select(*cols, F.col("at").cast("long").alias("t")), marks, by).where("run_end is null or run_end < t")
    return out.select(*[F.col("t").alias("at") if c == "at" else F.col(c) for c in points.columns])


def one_per_declaration(entities: DataFrame) -> DataFrame:
    """Entities once per (file, name, kind, line): one with a signature if there is one, else the first."""
    w = Window.partitionBy("repo_name", "file_path", "name", "kind", "start_line").orderBy(F.col("signature").isNull(), "signature", "uuid")
    return entities.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
