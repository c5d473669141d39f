"""Embedding, cosine search, and the document that is embedded."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.ship import ship

Encoder = Callable[[list[str]], np.ndarray]
_WORD = re.compile(r"[A-Z]?[^\W\d_A-Z]+|[A-Z]+|\d+")


def hashing_encoder(dim: int = 384) -> Encoder:
    """The offline default: words hashed to signed features, unit length. An empty text is the zero vector."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for row, text in enumerate(texts):
            for w in _WORD.findall(text or ""):
                h = int.from_bytes(hashlib.blake2b(w.lower().encode(), digest_size=8).digest(), "little")
                out[row, h % dim] += 1.0 if h >> 63 else -1.0
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return encode


def encoded(text: Column, encoder: Encoder, batch: int = 32) -> Column:
    """array<float> of each text by ``encoder``, ``batch`` texts at a time; any model can be plugged in."""

    def run(texts: pa.Array) -> pa.Array:
        rows = texts.to_pylist()
        parts = [np.asarray(encoder([t or "" for t in rows[i : i + batch]]), np.float32) for i in range(0, len(rows), batch)]
        return pa.array([v for p in parts for v in p], pa.list_(pa.float32()))

    ship()
    return F.arrow_udf(run, T.ArrayType(T.FloatType()))(text)


#: Decimals to which scores are compared, so that equal vectors tie.
DECIMALS = 12


def dot(vector: Column, query: list[float]) -> Column:
    """Dot product of vectors of the query's length in double precision; null where it isn't finite."""
    q = np.asarray(query, np.float64)

    def run(vectors: pa.Array) -> pa.Array:
        lengths = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
        rows = np.flatnonzero(lengths == len(q))
        out = np.full(len(lengths), np.nan)
        if len(rows):
            values = vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), len(q))
            out[rows] = np.round((values.astype(np.float64) * q).sum(axis=1), DECIMALS)  # each row is summed alike, whatever its neighbours
        return pa.array(out, mask=~np.isfinite(out))

    return F.arrow_udf(run, T.DoubleType())(vector)


def top_k(vectors: DataFrame, query: list[float], k: int, key: str = "id", vector: str = "vec", mapped: DataFrame | None = None, without: list[str] | None = None) -> DataFrame:
    """(key, score): the k vectors of largest dot product with one query, ties by key.

    Unmapped and blacklisted keys are left out before the k are taken, so the
    result has k rows where there are that many.  One query against all rows:
    each task keeps its own k, and only these meet.  Vectors of another length
    and such with a null or non-finite score are left out.
    """
    rows = vectors.filter(F.col(vector).isNotNull() & (F.size(vector) == len(query)))
    if without:
        rows = rows.filter(~F.col(key).isin(without))
    if mapped is not None:
        rows = rows.join(mapped.select(F.col("id").alias(key)).distinct(), key, "left_semi")
    return rows.select(key, dot(F.col(vector), query).alias("score")).filter("score IS NOT NULL").orderBy(F.col("score").desc(), key).limit(k)


def embedding_text(nodes: DataFrame) -> DataFrame:
    """(id, document): what is embedded of a class; sections without content are left out.

    ``nodes`` has id, path, synonyms, methods, events, api_paths and snippet.
    """

    def section(name: str, text: Column) -> Column:
        return F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit(f"{name}: "), text))

    some = lambda c: F.array_join(F.col(c), ", ")
    parts = [("Class", F.col("id")), ("File", F.col("path")), ("Also", F.col("synonyms")), ("Methods", some("methods")), ("Events", some("events")), ("API paths", some("api_paths"))]
    return nodes.select("id", F.concat_ws("\n", *[section(*p) for p in parts], F.nullif("snippet", F.lit(""))).alias("document"))
