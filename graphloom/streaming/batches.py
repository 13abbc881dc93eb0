"""Batches of changes: events of one file that follow each other closely are one batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def distinct_changes(events: DataFrame, path: str, op: str) -> DataFrame:
    """(path, op): what has to be done for a batch of events, each once however often it was reported; null paths are nothing to do."""
    return events.where(F.col(path).isNotNull()).select(path, op).distinct()


def change_batches(events: DataFrame, path: str, ts: str, seconds: int, tie: str = "event_id") -> DataFrame:
    """(path, batch, n_events, first_ts, last_ts): a gap of more than `seconds` after the file's last event begins a batch.

    Null times come first and begin one of their own.
    """
    w = Window.partitionBy(path).orderBy(ts, tie)
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))
    e = events.withColumn("brk", F.when(gap <= seconds * 1_000_000, 0).otherwise(1))
    e = e.withColumn("batch", F.sum("brk").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return e.groupBy(F.col(path).alias("path"), "batch").agg(F.count("*").alias("n_events"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
