"""Index tables: sources, files and records with stable ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SNIPPET = 100


def records(documents: DataFrame, files: int = 4) -> DataFrame:
    """rec_id, fle_id, src_id, rec_lan, rec_len, rec_sni of documents."""
    return documents.select(
        F.concat_ws("_", "source", "doc_id").alias("rec_id"),
        F.concat_ws("_", "source", (F.col("doc_id") % files).cast("string")).alias("fle_id"),
        F.col("lang").alias("rec_lan"),
        F.col("n_chars").alias("rec_len"),
        F.substring("text", 1, SNIPPET).alias("rec_sni"),
    )


def files(documents: DataFrame, files: int = 4) -> DataFrame:
    """fle_id and src_id of the files that hold documents."""
    return documents.select(F.concat_ws("_", "source", (F.col("doc_id") % files).cast("string")).alias("fle_id"), F.col("source").alias("src_id")).distinct()


def sources(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("source").alias("src_id"), F.upper("source").alias("src_label")).distinct()


def with_record_ids(raw: DataFrame, source: str, name: str = "r_uid") -> DataFrame:
    """``{source}_{file number}_{row number}`` of rows read from files.

    A gzip file is one split, so its lines keep their order.
    """
    file = F.col("_metadata.file_path")
    number = F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)\.[^/]*$", 1)
    order = Window.partitionBy("__file").orderBy("__row")
    out = raw.select("*", file.alias("__file"), number.alias("__nr"), F.monotonically_increasing_id().alias("__row"))
    out = out.withColumn(name, F.concat_ws("_", F.lit(source), "__nr", F.row_number().over(order).cast("string")))
    return out.select(name, *raw.columns)
