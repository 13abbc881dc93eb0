"""The queries of the operators for training data, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import bpe, code, neighbours, origin, packing, quality
from graphloom.llm.common import table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    t = table
    return {
        "p1_found": lambda s, d: code.documented_functions(t(s, d, "files")),
        "p1_pairs": lambda s, d: code.documented_functions(t(s, d, "files"), full=True),
        "p3_found": lambda s, d: code.unparsable(t(s, d, "files")),
        "p3_dialects": lambda s, d: code.dialects(t(s, d, "files")),
        "p3_rates": lambda s, d: code.unparsable_rates(t(s, d, "files")),
        "p8_found": lambda s, d: quality.not_prose(t(s, d, "documents")),
        "p8_stats": lambda s, d: quality.text_quality(t(s, d, "documents")),
        "p4_found": lambda s, d: origin.not_handwritten(t(s, d, "files"), t(s, d, "library_files")),
        "p4_labels": lambda s, d: origin.file_origins(t(s, d, "files"), t(s, d, "library_files")),
        "p5_found": lambda s, d: neighbours.nearest_pairs(t(s, d, "vectors")),
        "p5_recall": lambda s, d: neighbours.recall(t(s, d, "vectors"), neighbours.nearest_pairs(t(s, d, "vectors"))),
        "p7_packing": lambda s, d: packing.pack(t(s, d, "documents")),
        "p7_summary": lambda s, d: packing.summary(packing.pack(t(s, d, "documents")), t(s, d, "documents")),
        # partitions of 250 items, so that containers with gaps are given back and packed again across partitions on small tables too
        "p7_exchange": lambda s, d: packing.summary(packing.pack(t(s, d, "documents"), per_part=250), t(s, d, "documents")),
        "p6_ids": lambda s, d: bpe.encode_documents(t(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {}
