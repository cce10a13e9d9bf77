"""Reports over the members of a snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def member_groups(members: DataFrame) -> DataFrame:
    """Copies of each record in each split."""
    return members.groupBy("split", "src_id", "rec_id").agg(F.max("rec_len").alias("rec_len"), F.count("*").alias("copies"))


def _measures(chars_per_token: float) -> list[Column]:
    copies, chars = F.coalesce(F.sum("copies"), F.lit(0)), F.coalesce(F.sum(F.col("copies") * F.col("rec_len")), F.lit(0))
    return [
        copies.alias("examples"),
        F.count("*").alias("unique_examples"),
        (copies - F.count("*")).alias("extra_examples"),
        chars.alias("chars"),
        F.coalesce(F.sum((F.col("copies") - 1) * F.col("rec_len")), F.lit(0)).alias("extra_chars"),
        F.round(chars.cast("double") / F.lit(float(chars_per_token))).cast("bigint").alias("estimated_tokens"),
        (chars.cast("double") / F.nullif(copies, F.lit(0)).cast("double")).alias("avg_chars"),
    ]


def overview(groups: DataFrame, chars_per_token: float = 4.0) -> DataFrame:
    """All members and each split; one row of zeros for no members."""
    more = [F.coalesce(F.sum("rec_len"), F.lit(0)).alias("unique_chars"), F.countDistinct("src_id").alias("source_count")]
    every = groups.agg(*_measures(chars_per_token), *more).select(F.lit("ALL").alias("scope"), "*")
    return every.unionByName(groups.groupBy(F.col("split").alias("scope")).agg(*_measures(chars_per_token), *more))


def per_source(groups: DataFrame, chars_per_token: float = 4.0, top: int = -1) -> DataFrame:
    if top == 0:
        raise ValueError("top is not 0")
    out = groups.groupBy("src_id").agg(*_measures(chars_per_token))
    return out if top < 0 else out.orderBy(F.desc("chars"), F.desc("examples"), "src_id").limit(top)


def per_split_source(groups: DataFrame, top: int, chars_per_token: float = 4.0) -> DataFrame:
    out = groups.groupBy("split", "src_id").agg(*_measures(chars_per_token))
    w = Window.partitionBy("split").orderBy(F.desc("chars"), F.desc("examples"), "src_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
