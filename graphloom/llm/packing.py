"""Filling containers of a fixed capacity with texts (problem 7), by bound-certified repacking.

A text's size is its number of tokens; one longer than the capacity is cut into full pieces and a rest, others are never cut. The items
are spread at random over partitions; each is packed by best-fit decreasing and its number of containers is compared with a lower bound
from dual-feasible functions. A partition that meets its bound is done. From the others the containers that are not full enough give
their items back; these are spread anew over fewer partitions, so that they meet other items, and packed again, until all partitions
are certified or a round no longer saves a container. Since the random spread makes partitions alike, what is left shrinks every round.

Null and empty texts have no tokens and no item. A null doc_id is packed like any other. Repeated rows are items of their own.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.bpe import count_tokens
from graphloom.session import cut

CAPACITY = 2048
#: Items of a partition, about; rounds, at most.
ITEMS, ROUNDS = 20_000, 6


def lower_bound(sizes: np.ndarray, capacity: int = CAPACITY) -> int:
    """Containers that any packing of `sizes` needs, by the best of a family of dual-feasible functions.

    f_k leaves out sizes below k, counts those above capacity - k as whole containers, and others as they are; g_k rounds
    size * (k + 1) / capacity down, over k. Each maps sizes so that no full container sums to more than one.
    """
    return lower_bound_of_counts(np.bincount(sizes, minlength=capacity + 1), capacity) if len(sizes) else 0


def lower_bound_of_counts(count: np.ndarray, capacity: int = CAPACITY) -> int:
    """lower_bound of sizes given as how many there are of each, from 0 to the capacity."""
    count = count.astype(np.int64)
    size = np.arange(capacity + 1)
    total = int(count @ size)
    best = -(-total // capacity)
    many = np.cumsum(count[::-1])[::-1]  # items of at least this size
    mass = np.cumsum((count * size)[::-1])[::-1]
    for k in range(1, capacity // 2 + 1):
        whole = int(many[capacity - k + 1])
        rest = int(mass[k] - mass[capacity - k + 1])
        best = max(best, whole + -(-rest // capacity))
    for k in range(1, 40):
        x = size * (k + 1)
        g = np.where(x % capacity == 0, size * k, (x // capacity) * capacity)  # in units of capacity * k
        best = max(best, -(-int(count @ g) // (capacity * k)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The container of each item: the fullest that it still fits in, items from large to small."""
    order = np.argsort(-sizes, kind="stable")
    out = np.empty(len(sizes), np.int64)
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]  # containers by the room they have left
    levels: list[int] = []  # rooms that some container has, sorted
    n = 0
    for i in order:
        s = int(sizes[i])
        k = bisect_left(levels, s)
        if k == len(levels):
            b, room = n, capacity
            n += 1
        else:
            room = levels[k]
            b = rooms[room].pop()
            if not rooms[room]:
                levels.pop(k)
        left = room - s
        if left:
            if not rooms[left]:
                insort(levels, left)
            rooms[left].append(b)
        out[i] = b
    return out


def _pack(capacity: int, closing: float):
    def run(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["n", "doc_id", "piece"], ascending=[False, True, True], ignore_index=True)
        sizes = b["n"].to_numpy(dtype=np.int64)
        place = best_fit_decreasing(sizes, capacity)
        used = int(place.max()) + 1 if len(place) else 0
        fill = np.bincount(place, weights=sizes, minlength=used)
        bound = lower_bound(sizes, capacity)
        b["bin"] = place
        b["gap"] = used - bound
        b["closed"] = (fill[place] >= closing * capacity) | (used <= bound)
        return b[["part", "doc_id", "piece", "start", "n", "bin", "gap", "closed"]]

    return run


SCHEMA = "part int, doc_id long, piece int, start long, n int, bin long, gap long, closed boolean"


def items(documents: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, n): what is to be packed."""
    c = count_tokens(documents, path).where("n > 0")
    piece = F.explode(F.sequence(F.lit(0), F.expr(f"cast((n - 1) div {capacity} as int)")))
    out = c.select("doc_id", F.col("n").alias("total"), piece.alias("piece")).withColumn("start", F.col("piece").cast("long") * capacity)
    return out.select("doc_id", "piece", "start", F.least(F.lit(capacity), F.col("total") - F.col("start")).cast("int").alias("n"))


def pack(documents: DataFrame, capacity: int = CAPACITY, path: str | None = None, per_part: int = ITEMS, rounds: int = ROUNDS) -> DataFrame:
    """container, doc_id, piece, start, n_tokens, offset: tokens start .. start + n_tokens - 1 of the document stand at offset.

    `container` is a string, the same at every run on the same data.
    """
    todo = cut(items(documents, capacity, path))
    left = todo.count()
    done: list[DataFrame] = []
    before = None
    for r in range(rounds):
        parts = max(1, -(-left // per_part))
        # items of one size are dealt round by hash: no partition depends on how many equal texts there are
        dealt = todo.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", F.lit(r)), F.lit(parts)).cast("int"))
        packed = cut(dealt.groupBy("part").applyInPandas(_pack(capacity, 0.999), SCHEMA))
        one = packed.select("part", "bin", "gap", "closed").distinct()
        open_bins, gap = one.where("not closed").count(), packed.agg(F.sum("gap")).first()[0] or 0
        last = r == rounds - 1 or open_bins == 0 or gap == 0 or parts == 1 or (before is not None and open_bins >= before)
        kept = packed if last else packed.where("closed")
        done.append(kept.withColumn("container", F.concat_ws("-", F.lit(r), "part", "bin")))
        if last:
            break
        before = open_bins
        todo = packed.where("not closed").select("doc_id", "piece", "start", "n")
        left = todo.count()
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    w = Window.partitionBy("container").orderBy(F.col("n").desc(), "doc_id", "piece").rowsBetween(Window.unboundedPreceding, -1)
    return out.select("container", "doc_id", "piece", "start", F.col("n").alias("n_tokens"), F.coalesce(F.sum("n").over(w), F.lit(0)).cast("int").alias("offset"))


def summary(packed: DataFrame, documents: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """One row: containers, items, tokens, the lower bound of all items together, containers above it, share of room unused."""
    counts = items(documents, capacity, path).groupBy("n").count()

    def bound(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = np.zeros(capacity + 1, np.int64)
        for b in batches:
            np.add.at(got, b["n"].to_numpy(), b["count"].to_numpy())
        yield pd.DataFrame({"lower_bound": [lower_bound_of_counts(got, capacity)]})

    low = counts.coalesce(1).mapInPandas(bound, "lower_bound long")  # at most `capacity` rows
    a = packed.agg(F.countDistinct("container").alias("containers"), F.count("*").alias("items"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens"))
    out = a.withColumn("one", F.lit(1)).join(low.withColumn("one", F.lit(1)), "one").drop("one")
    return out.withColumn("above", F.col("containers") - F.col("lower_bound")).withColumn("unused", F.round(1 - F.col("tokens") / (F.greatest("containers", F.lit(1)) * capacity), 6))
