"""Gzip JSON-lines shards, and typed parquet."""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PATTERN = "data_*.jsonl.gz"


def read_shards(spark: SparkSession, path: str, schema: str | None = None, skip_ratio: float = 0.0) -> DataFrame:
    """Rows of ``data_<n>.jsonl.gz``; blank lines and empty objects go.

    ``skip_ratio`` leaves out that share of the shards, the first ones by
    number.
    """
    r = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", PATTERN)
    df = (r.schema(schema) if schema else r).json(path)
    if skip_ratio > 0:
        number = F.regexp_extract(F.col("_metadata.file_name"), r"data_(\d+)\.jsonl\.gz", 1).cast("int")
        numbered = df.select("*", number.alias("__shard"))
        shards = [r[0] for r in numbered.select("__shard").distinct().orderBy("__shard").collect()]
        df = numbered.where(F.col("__shard").isin(shards[int(len(shards) * skip_ratio) :])).drop("__shard")
    return df.dropna("all")


def shard_numbers(df: DataFrame, order: str, max_bytes: int) -> DataFrame:
    """``line``, ``shard``: rows in order, cut so that a shard holds about
    ``max_bytes``. A row belongs to the shard in which its first byte lies;
    greedy cutting, which starts each shard at a row, is sequential.

    Rows are first dealt by ranges of the order; only the sizes of these
    ranges are summed up in one place. The dealt rows are settled, as a second
    run of the exchange may draw and join its ranges otherwise.
    """
    from ..session import settle

    rows = df.select(F.to_json(F.struct(*df.columns)).alias("line"), F.col(order).alias("__o"))
    rows = rows.withColumn("size", F.octet_length("line") + 1).repartitionByRange("__o")
    rows = settle(rows.withColumn("part", F.spark_partition_id()), "ranges")
    before = rows.groupBy("part").agg(F.sum("size").alias("bytes"))
    before = before.withColumn("base", F.sum("bytes").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    w = Window.partitionBy("part").orderBy("__o").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("size").over(w), F.lit(0))).join(F.broadcast(before), "part")
    return rows.select("line", F.floor((F.coalesce("base", F.lit(0)) + F.col("inner")) / max_bytes).cast("int").alias("shard"), "__o")


def write_shards(df: DataFrame, path: str, order: str, max_bytes: int = 100 << 20) -> None:
    """One gzip file of JSON lines for each shard number, in order.

    Spark names files by task; a folder ``shard=<n>`` holds each, and the
    rows of a shard are in one file.
    """
    from ..session import settle

    numbered = settle(shard_numbers(df, order, max_bytes), "numbered")
    out = numbered.repartition("shard").sortWithinPartitions("shard", "__o").select("shard", F.col("line").alias("value"))
    out.write.partitionBy("shard").option("compression", "gzip").text(path)
    _rename(df.sparkSession, path)


def _rename(spark: SparkSession, path: str) -> None:
    """``shard=<n>/part-...`` becomes ``shard=<n>/data_<n>.jsonl.gz``."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for d in fs.listStatus(root):
        name = d.getPath().getName()
        if d.isDirectory() and name.startswith("shard="):
            n = int(name.split("=")[1]) + 1
            for f in fs.listStatus(d.getPath()):
                if f.getPath().getName().startswith("part-"):
                    fs.rename(f.getPath(), jvm.org.apache.hadoop.fs.Path(d.getPath(), f"data_{n:04d}.jsonl.gz"))


def read_parquet_union(spark: SparkSession, *paths: str) -> DataFrame:
    """Files of different columns, united by name."""
    return spark.read.option("mergeSchema", "true").parquet(*paths)


def write_table(df: DataFrame, path: str, partition_by: str | None = None, order: str | None = None) -> None:
    """Parquet with zstd, in place of what was there; ordered if asked."""
    if order:
        df = df.orderBy(order)
    w = df.write.mode("overwrite").option("compression", "zstd")
    (w.partitionBy(partition_by) if partition_by else w).parquet(path)


def write_manifest(spark: SparkSession, path: str, content: Mapping[str, Any]) -> None:
    """A small JSON document beside a table."""
    spark.createDataFrame([(json.dumps(content, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_manifest(spark: SparkSession, path: str) -> dict[str, Any]:
    return json.loads("".join(r[0] for r in spark.read.text(path).collect()))


def record_text(df: DataFrame, key: str, value: Any, fields: list[str]) -> DataFrame:
    """The text of one record: a filter and a projection."""
    if len(fields) == 1:
        return df.where(F.col(key) == value).select(F.col(fields[0]).alias("text"))
    return df.where(F.col(key) == value).select(F.concat_ws("\n\n", *[F.concat(F.lit(f"[{f}]\n"), F.col(f)) for f in fields]).alias("text"))
