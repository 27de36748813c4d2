"""Name vectors from hashed character trigrams, sparse and dense."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIMENSIONS = 256


@lru_cache(maxsize=200_000)
def bucket(trigram: str) -> int:
    """A trigram's bucket: four bytes of BLAKE2b, big-endian, modulo the dimensions."""
    return int.from_bytes(hashlib.blake2b(trigram.encode("utf-8", "surrogatepass"), digest_size=4).digest(), "big") % DIMENSIONS


def buckets(text: str) -> list[int]:
    """The buckets of a text's trigrams, folded, without white space, two spaces on each side."""
    padded = f"  {''.join(text.casefold().split())}  "
    return [bucket(padded[i : i + 3]) for i in range(max(1, len(padded) - 2))]


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _buckets(texts: pd.Series) -> pd.Series:
    return texts.map(buckets, na_action="ignore")


def sparse_vectors(texts: DataFrame, text: str = "text") -> DataFrame:
    """Rows of (text, ...) as (..., bucket, weight), unit length; a null text has no vector."""
    keys = [c for c in texts.columns if c != text]
    parts = texts.where(F.col(text).isNotNull()).select(*keys, F.explode(_buckets(F.col(text))).alias("bucket"))
    rows = parts.groupBy(*keys, "bucket").agg(F.count("*").cast("double").alias("n"))
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(W.partitionBy(*keys)))  # as many rows as a text has buckets
    return rows.select(*keys, "bucket", (F.col("n") / norm).alias("weight"))


def dense_vectors(texts: DataFrame, text: str = "text") -> DataFrame:
    """Rows of (text, ...) as (..., embedding array<double>)."""
    sparse = sparse_vectors(texts, text)
    keys = [c for c in sparse.columns if c not in ("bucket", "weight")]
    packed = sparse.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "weight"))).alias("w"))
    places = F.sequence(F.lit(0), F.lit(DIMENSIONS - 1))
    return packed.select(*keys, F.transform(places, lambda i: F.coalesce(F.try_element_at("w", i), F.lit(0.0))).alias("embedding"))


def with_provider(texts: DataFrame, provider: Callable[[list[str]], list[list[float]]], text: str = "text", dimensions: int | None = None) -> DataFrame:
    """Adds the vectors of an outside provider, called on batches of at most 64 texts.

    Fails where the provider returns another number of vectors or another length than asked for.
    """

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def embed(values: pd.Series) -> pd.Series:
        out: list[list[float]] = []
        rows = [v or "" for v in values]
        for at in range(0, len(rows), 64):
            part = provider(rows[at : at + 64])
            if len(part) != len(rows[at : at + 64]) or (dimensions and any(len(v) != dimensions for v in part)):
                raise ValueError("the provider returned other vectors than asked for")
            out += part
        return pd.Series(out)

    return texts.withColumn("embedding", embed(F.col(text)))
