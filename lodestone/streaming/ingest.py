"""Resumable ingest and running histograms with Structured Streaming.

The progress of a stream is in its checkpoint folder: a query that is run
again goes on where it stopped, and the file sink commits each batch once.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import shared_dir


def _stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int, kind: str = "parquet") -> DataFrame:
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    # A single file is read as the only one of its folder that has its name.
    head, _, name = path.rstrip("/").rpartition("/")
    if name.endswith(f".{kind}"):
        return r.option("pathGlobFilter", name).format(kind).load(head) if _is_file(spark, path) else r.format(kind).load(path)
    return r.format(kind).load(path)


def _is_file(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile()


def resume(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, files_per_batch: int = 100, kind: str = "json") -> None:
    """Append new files of ``source`` to ``target``, each row once, whatever
    was interrupted before."""
    rows = _stream(spark, source, schema, files_per_batch, kind)
    rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _drain(df: DataFrame, mode: str) -> DataFrame:
    """The final state of an aggregated stream, as a written table."""
    spark = df.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out")

    df.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/out")


def drained_counts(spark: SparkSession, path: str, schema: StructType, field: str, files_per_batch: int = 1) -> DataFrame:
    """A running histogram of a field, over all files there are."""
    return _drain(_stream(spark, path, schema, files_per_batch).groupBy(field).agg(F.count("*").alias("n")), "complete")


def drained_windows(spark: SparkSession, path: str, schema: StructType, time: str, size: str, field: str, late: str = "1 hour") -> DataFrame:
    """Counts by event-time window, with a watermark that bounds the state
    where the sink takes updates."""
    rows = _stream(spark, path, schema, 1)
    rows = rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    out = rows.groupBy(F.window(time, size), field).agg(F.count("*").alias("n"))
    return _drain(out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), field, "n"), "complete")
