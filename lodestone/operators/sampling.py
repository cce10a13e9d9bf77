"""Samples that depend on ids and a seed only, not on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import h60, unit_hash


def bernoulli(df: DataFrame, key: str, fraction: float, seed: int) -> DataFrame:
    return df.where(h60(F.col(key), F.lit(seed)).cast("double") / F.lit(float(1 << 60)) < fraction)


def reservoir(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """k rows: planned as a top-k, no full sort."""
    return df.orderBy(h60(F.col(key), F.lit(seed)), key).limit(k)


def below_rate(x: Column, rate: float) -> Column:
    """Hash-threshold sampling: whether sha256 of x falls below the rate."""
    return unit_hash(x) < rate


def shards(spark, paths: list[str], n: int, seed: int) -> list[str]:
    """n of some files, by hash; for reading only these."""
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    return [r[0] for r in reservoir(rows, "path", n, seed).collect()]


def size_or_fraction(df: DataFrame, key: str, seed: int, size: int | None = None, fraction: float | None = None) -> DataFrame:
    if size is not None and fraction is not None:
        raise ValueError("give a size or a fraction, not both")
    if size is not None:
        return reservoir(df, key, size, seed)
    return df if fraction is None else bernoulli(df, key, fraction, seed)
