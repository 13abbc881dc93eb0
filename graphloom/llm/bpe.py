"""Encoding by a public byte-level BPE tokenizer as a monoid over pieces of text (problem 6).

A node is a stretch of text with its ids. Neighbours are joined by encoding only a window around their border, which grows until it
ends, on both sides, between a character that is no white space and white space. The tokenizer's pattern never matches across such a
place (white space stands only at the start of a match, or fills it), whatever surrounds it, so the ids outside the window are final.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import partitions, tokenizer_path

#: The pattern by which these tokenizers cut a text before merging. A fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters that are encoded as one; the tree above costs little (sf0.1: 1.05 s at 512 against 0.65 s at 4,096) and takes in most texts.
LEAF, WINDOW = 512, 64
_BORDER = re.compile(r"(?<=[^\s\x1c-\x1f\x85])(?=[ \t\n\r])")


class Bpe:
    """One tokenizer; `path` is a file of base64 tokens and ranks."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(max(ranks.values()) + 1, dtype=np.int32)
        self.bytes = {v: k for k, v in ranks.items()}
        for k, v in ranks.items():
            self.size[v] = len(k)

    def leaf(self, text: str) -> list[int]:
        return self.enc.encode_ordinary(text)

    def encode(self, text: str, leaf: int = LEAF, window: int = WINDOW) -> list[int]:
        """The ids of `text`, by halves."""
        if len(text) <= leaf:
            return self.leaf(text)
        m = len(text) // 2
        return self.join(text[:m], self.encode(text[:m], leaf, window), text[m:], self.encode(text[m:], leaf, window), window)

    def join(self, a: str, x: list[int], b: str, y: list[int], window: int = WINDOW) -> list[int]:
        """The ids of a + b from those of a and of b."""
        w = window
        while True:  # the last place in a where every encoding has a border
            k = [m.start() for m in _BORDER.finditer(a, max(1, len(a) - w))]
            p = k[-1] if k else 0
            if k or w >= len(a):
                break
            w *= 4
        w = window
        while True:
            m = _BORDER.search(b, 1, min(len(b), w + 1))
            q = m.start() if m else len(b)
            if m or w >= len(b):
                break
            w *= 4
        return x[: len(x) - self._tokens(reversed(x), len(a[p:].encode()))] + self.leaf(a[p:] + b[:q]) + y[self._tokens(y, len(b[:q].encode())) :]

    def _tokens(self, ids, nbytes: int) -> int:
        """How many of the first ids hold just `nbytes` bytes."""
        n = got = 0
        for t in ids:
            if got >= nbytes:
                break
            got += int(self.size[t])
            n += 1
        assert got == nbytes
        return n

    def decode(self, ids: list[int]) -> str:
        """The text of `ids`: the bytes of halves, joined up the tree."""

        def tree(lo: int, hi: int) -> bytes:
            if hi - lo <= 256:
                return b"".join(self.bytes[int(t)] for t in ids[lo:hi])
            mid = (lo + hi) // 2
            return tree(lo, mid) + tree(mid, hi)

        return tree(0, len(ids)).decode()


@lru_cache(maxsize=4)
def bpe(path: str) -> Bpe:
    """One per worker and file."""
    return Bpe(path)


def _ids(path: str, counts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe(path)
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                ids = [enc.encode(t) if t else [] for t in part.column(1).to_pylist()]
                lens = np.fromiter(map(len, ids), np.int32, len(ids))
                if counts:
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lens.astype(np.int64))], names=["doc_id", "n"])
                    continue
                offsets = np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)
                flat = np.fromiter((t for x in ids for t in x), np.int32, int(offsets[-1]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["doc_id", "ids"])

    return run


def _even(documents: DataFrame) -> DataFrame:
    df = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return df.repartition(partitions(documents), F.xxhash64("doc_id"))


def encode_documents(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids of each document, without special tokens. A null or empty text gives an empty list; one row for each row given."""
    return _even(documents).mapInArrow(_ids(path or tokenizer_path(), False), "doc_id long, ids array<int>")


def count_tokens(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n: how many ids encode_documents gives."""
    return _even(documents).mapInArrow(_ids(path or tokenizer_path(), True), "doc_id long, n long")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text from doc_id, ids; null ids give null."""
    path = path or tokenizer_path()

    def run(batches):
        enc = bpe(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else enc.decode(x) for x in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
