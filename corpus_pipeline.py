"""A corpus pipeline of five stages over the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and read again as the next one's docs. All but the last
keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontam, jaccard, langid, linededup, packing
from lodestone.session import settle, table

#: A pooled probability is at least 1/k for k languages. Below this share of
#: the way from there to 1 no language is accepted; texts of fewer characters
#: than SHORT are pooled over few positions, and so unsure even if clean.
LEAST_SHARE, SHORT_SHARE, SHORT = 1 / 3, 0.1, 100

#: Stages 1 and 5 cannot be expressed in SQL; the tests compare them with
#: brute-force versions.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts in no learned language: without a letter, or unsure."""
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id"), F.col("text"), F.col("lang"))
    net = langid.train(rows.where(~langid.held_out()))
    least = 1 / len(net.langs) if net else 1.0
    share = F.when(F.length("text") < SHORT, SHORT_SHARE).otherwise(LEAST_SHARE)
    # Less a little for rounding: with one language every score is 1.
    least = least + share * (1 - least) - 1e-6
    return langid.predict(rows, net).where((F.col("lang_pred") != "und") & (F.col("score") >= least)).select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that an earlier line has, or one with nearly the same
    words; texts left without a word go."""
    out = linededup.dedup_lines(docs)
    out = out.where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each linked group."""
    return jaccard.keep_representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents that hold a window of a benchmark item."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into bins."""
    return packing.best_fit(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
    return docs
