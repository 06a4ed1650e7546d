"""Vectors: column expressions for small work, NumPy blocks for large, and the default embedder."""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BUCKETS = 64


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.greatest(F.sqrt(dot(a, a)), F.lit(1e-12))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


class Embedder(Protocol):
    """Texts to vectors (rows of equal length); must be picklable, since it runs on the executors."""

    def encode(self, texts: list[str]) -> np.ndarray: ...


def queries_of(embedder: Embedder, texts: list[str]) -> np.ndarray:
    """Vectors of texts that are searched for; an embedder that tells queries from passages has encode_queries()."""
    return getattr(embedder, "encode_queries", embedder.encode)(texts)


class QueryMode:
    """An embedder whose encode() is another one's query mode."""

    def __init__(self, embedder: Embedder):
        self.embedder = embedder

    def encode(self, texts: list[str]) -> np.ndarray:
        return queries_of(self.embedder, texts)


class BigramEmbedder:
    """The deterministic default: a histogram of lower-cased character pairs in 64 buckets, of unit length."""

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), BUCKETS))
        for row, t in zip(out, texts):
            points = np.array([ord(c) for c in (t or "").lower()], np.int64)
            np.add.at(row, (points[:-1] * 31 + points[1:]) % BUCKETS, 1.0)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def embed(df, text_col: str, out_col: str = "embedding", embedder: Embedder | None = None):
    """df with a vector column from an embedder, in Arrow batches."""
    embedder = embedder or BigramEmbedder()

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(list(embedder.encode(s.fillna("").tolist())), index=s.index)

    return df.withColumn(out_col, run(F.col(text_col)))
