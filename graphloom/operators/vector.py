"""Embedding and exact similarity search, both in Arrow batches."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

DIM = 384
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


class Embedder(Protocol):
    """Turns texts into vectors of one length."""

    dim: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashingEmbedder:
    """Signed hashing of words, parts of identifiers and runs of three letters: lexical, not semantic."""

    def __init__(self, dim: int = DIM):
        self.dim = dim

    def embed(self, texts: list[str]) -> list[list[float]]:
        """One weighted count over all texts of the batch; a word's features are worked out once a worker."""
        rows, at, weight = [], [], []
        for i, t in enumerate(texts):
            for w in re.findall(r"\w+", t or ""):
                spots, signs = _features(w, self.dim)
                rows += [i] * len(spots)
                at += spots
                weight += signs
        v = np.bincount(np.asarray(rows, dtype=np.int64) * self.dim + np.asarray(at, dtype=np.int64), weights=np.asarray(weight, dtype=float), minlength=len(texts) * self.dim).reshape(len(texts), self.dim)
        n = np.sqrt((v * v).sum(axis=1, keepdims=True))
        return (v / np.where(n > 0, n, 1.0)).tolist()


@lru_cache(maxsize=1 << 17)
def _features(w: str, dim: int) -> tuple[list[int], list[float]]:
    """Places and signed weights of a word, its parts and its runs of three letters."""
    parts = [p.lower() for p in _PART.findall(w)]
    grams = [f"#{w.lower()[i : i + 3]}" for i in range(len(w) - 2)]
    spots, signs = [], []
    for feature, weight in [(w.lower(), 2.0), *((p, 1.0) for p in parts), *((g, 0.3) for g in grams)]:
        h = int.from_bytes(hashlib.blake2b(feature.encode(), digest_size=8).digest(), "little")
        spots.append(h % dim)
        signs.append(weight if h >> 63 else -weight)
    return spots, signs


class ZeroEmbedder:
    """No vectors: all zero, so that no search finds anything; a query is an error."""

    def __init__(self, dim: int = DIM):
        self.dim = dim

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [[0.0] * self.dim for _ in texts]

    def embed_query(self, text: str) -> list[float]:
        raise RuntimeError("there is no model to embed a query with")


class OnnxEmbedder:
    """A sentence model in ONNX with its tokenizer's file; mean of the last layer over tokens, of length one."""

    def __init__(self, model: str, tokenizer: str, dim: int = DIM):
        self.model, self.tokenizer, self.dim, self._ready = model, tokenizer, dim, None

    def embed(self, texts: list[str]) -> list[list[float]]:
        if self._ready is None:
            import onnxruntime
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(self.tokenizer)
            tok.enable_padding()
            self._ready = (onnxruntime.InferenceSession(self.model), tok)
        session, tok = self._ready
        enc = tok.encode_batch(texts)
        feed = {"input_ids": [e.ids for e in enc], "attention_mask": [e.attention_mask for e in enc], "token_type_ids": [e.type_ids for e in enc]}
        wanted = {i.name for i in session.get_inputs()}
        out = session.run(None, {k: np.array(v, dtype=np.int64) for k, v in feed.items() if k in wanted})[0]
        mask = np.array(feed["attention_mask"], dtype=float)[:, :, None]
        v = (out * mask).sum(1) / np.maximum(mask.sum(1), 1e-9)
        return (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)).tolist()


#: What a vector's row carries besides, so that a hit can be shown without a join.
PAYLOAD = ("name", "kind", "language", "file_path", "start_line", "signature", "docstring")


def embed(entities: DataFrame, embedder: Embedder, batch: int = 64) -> DataFrame:
    """(uuid, repo_name, embedding) of each entity's embed_text, with the PAYLOAD columns that the entities have; null texts count as empty."""
    extra = [c for c in PAYLOAD if c in entities.columns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [t or "" for t in b.pop("embed_text")]
            vectors = [v for i in range(0, len(texts), batch) for v in embedder.embed(texts[i : i + batch])]
            yield b.assign(embedding=vectors)

    df = entities.select("uuid", "repo_name", "embed_text", *extra)
    kept = [f"{f.name} {f.dataType.simpleString()}" for f in df.schema if f.name != "embed_text"]
    return df.mapInPandas(run, ", ".join([*kept, "embedding array<float>"])).select("uuid", "repo_name", "embedding", *extra)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; null where a length is zero or the arrays differ in size."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n)


def top_k(vectors: DataFrame, query: list[float], k: int = 5, repo: str | None = None, key: str = "uuid") -> DataFrame:
    """(key, score, rank): the k most similar vectors, ties by key; of several rows of one key the best counts.

    Filters come before scores. A task scores whole Arrow batches with one product and hands on its k best keys, so only k rows a task are
    shuffled. Null keys and vectors, zeros, other lengths and scores that are no numbers are left out.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    v = vectors if repo is None else vectors.where(F.col("repo_name") == repo)
    x = F.col("embedding") if v.schema["embedding"].dataType.elementType in (FloatType(), DoubleType()) else F.col("embedding").cast("array<double>").alias("embedding")
    v = v.select(F.col(key), x).where(F.col(key).isNotNull() & (F.size("embedding") == len(query)))
    dim = len(query)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = np.asarray(query, dtype=float)
        length = np.sqrt(q @ q)
        keys, scores, schema = None, None, None
        for b in batches:
            schema = b.schema
            if not b.num_rows or not length or not k:
                continue
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(-1, dim)  # a null element is no number
            with np.errstate(all="ignore"):
                s = np.round((x @ q) / (np.sqrt((x * x).sum(axis=1)) * length), 6) + 0.0
            ok = np.isfinite(s)
            if len(s) > 4 * k and ok.sum() > k:  # below the k-th score nothing counts, unless copies of one key fill the places
                names = b.column(0).to_pandas()
                top = pd.DataFrame({"k": names[ok], "s": s[ok]}).groupby("k", sort=False)["s"].max().nlargest(k, keep="all")
                ok &= s >= top.min()
            new = pd.DataFrame({"k": b.column(0).to_pandas()[ok], "s": s[ok]})
            both = new if keys is None else pd.concat([pd.DataFrame({"k": keys, "s": scores}), new])
            both = both.groupby("k", as_index=False)["s"].max().sort_values(["s", "k"], ascending=[False, True]).head(k)
            keys, scores = both["k"].to_numpy(), both["s"].to_numpy()
        if keys is not None:
            yield pa.RecordBatch.from_arrays([pa.array(keys, schema.field(0).type), pa.array(scores, pa.float64())], names=[key, "score"])

    s = v.mapInArrow(best, f"{key} {v.schema[key].dataType.simpleString()}, score double")
    top = s.groupBy(key).agg(F.max("score").alias("score")).orderBy(F.desc("score"), key).limit(k)  # k rows a task
    return top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), key)))  # k rows
