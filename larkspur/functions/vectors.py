"""Vector functions: distances and scores as Column expressions; a deterministic embedder."""

from __future__ import annotations

import re
import zlib
from typing import Protocol

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import col


def l2_distance(a: Column | str, b: Column | str) -> Column:
    squares = F.zip_with(col(a), col(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def distance_score(d: Column) -> Column:
    return 1 / (1 + d)


def score_cosine(score: Column | str) -> Column:
    """Cosine of unit vectors from 1/(1+distance); null for null or non-positive scores."""
    s = col(score)
    d = 1 / s - 1
    return F.when(s > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - d * d / 2)))


def mean_unit(vectors: Column | str) -> Column:
    """Element-wise mean of an array of vectors, scaled to length 1 (left alone if it is zero)."""
    v = col(vectors)
    zero = F.transform(v[0], lambda x: F.lit(0.0))
    total = F.aggregate(v, zero, lambda a, x: F.zip_with(a, x, lambda p, q: p + q.cast("double")))
    mean = F.transform(total, lambda x: x / F.size(v))
    norm = F.sqrt(F.aggregate(mean, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(mean, lambda x: x / norm)).otherwise(mean)


def merge_embeddings(rows: DataFrame, *keys: str, vector: str = "embedding") -> DataFrame:
    """(keys, embedding): the mean of each group's vectors, of length 1. Positions are averaged with partial sums, so
    no group's vectors are gathered; use mean_unit for vectors that are in one row."""
    each = rows.select(*keys, F.posexplode(vector).alias("_k", "_x")).groupBy(*keys, "_k").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_k", "_m"))), lambda x: x["_m"])
    return each.groupBy(*keys).agg(mean_unit(F.array(listed)).alias(vector))


def token_windows(tokens: Column | str, size: int = 256, overlap: int = 32) -> Column:
    """An array of windows; one alone if the tokens fit in it."""
    t = col(tokens)
    starts = F.sequence(F.lit(0), F.greatest(F.size(t) - overlap - 1, F.lit(0)), F.lit(size - overlap))
    return F.when(F.size(t) <= size, F.array(t)).otherwise(F.transform(starts, lambda i: F.slice(t, i + 1, size)))


class Embedder(Protocol):
    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Signed feature hashing of words and identifier parts to unit vectors. It stands in for a learned model:
    deterministic, without any claim to that model's quality."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for k, t in enumerate(texts):
            for w in re.findall(r"[^\W_]+", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", t or "").lower()):
                h = zlib.crc32(w.encode())
                out[k, h % self.dim] += 1 if h >> 31 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)


def embed_column(text: Column | str, embedder: Embedder) -> Column:
    """Embeds in Arrow batches."""

    @F.pandas_udf("array<float>")
    def run(texts):
        import pandas as pd

        return pd.Series(list(embedder.embed(texts.fillna("").tolist())))

    return run(col(text))


def embed_windows(rows: DataFrame, key: str, text: str, embedder: Embedder, size: int = 256, overlap: int = 32) -> DataFrame:
    """(key, embedding): each text's vector, that of a long text being the mean of its windows' of ``size`` words."""
    words = F.filter(F.split(F.coalesce(col(text), F.lit("")), r"\s+"), lambda w: w != "")
    windows = rows.select(key, F.explode(token_windows(words, size, overlap)).alias("_w")).select(key, F.array_join("_w", " ").alias("_t"))
    return merge_embeddings(windows.select(key, embed_column("_t", embedder).alias("embedding")), key)
