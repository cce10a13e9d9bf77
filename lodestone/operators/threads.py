"""Message logs: what a thread holds after appends and replacements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip


def thread_log(events: DataFrame) -> DataFrame:
    """thread, place, role, content, at: the messages of each thread.

    events: thread, seq, op (append, replace), role, content, at. A
    replacement takes the place of the thread's last answer of an assistant,
    or is appended if there is none. Blank system messages are left out;
    a blank thread raises.
    """
    name = strip(F.col("thread"))
    e = events.withColumn("thread", F.when(F.coalesce(name, F.lit("")) == "", F.raise_error(F.lit("a thread has no name")).cast("string")).otherwise(name))
    e = e.withColumns({"role": F.when(F.col("op") == "replace", "assistant").otherwise(F.col("role")), "content": F.when(F.col("role") == "system", strip(F.col("content"))).otherwise(F.col("content"))})
    e = e.where((F.col("role") != "system") | (F.col("content") != ""))
    w = Window.partitionBy("thread").orderBy("seq")
    answer = F.col("role") == "assistant"
    earlier = F.coalesce(F.sum(answer.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    e = e.withColumn("opens", ~answer | (F.col("op") == "append") | (earlier == 0))
    # An answer and its replacements share a slot; other messages have their own.
    e = e.withColumn("slot", F.when(answer, F.sum((answer & F.col("opens")).cast("int")).over(w)).otherwise(-F.col("seq")))
    slots = e.groupBy("thread", "slot").agg(F.min("seq").alias("first"), F.max_by(F.struct("role", "content", "at"), "seq").alias("m"))
    return slots.select("thread", F.row_number().over(Window.partitionBy("thread").orderBy("first")).alias("place"), "m.*")


def upsert_threads(batch: DataFrame, path: str) -> None:
    """Appends a batch of events to a log in ``path``; for ``foreachBatch``.
    ``thread_log`` over the log gives the messages, so a batch that is written
    again after a failure changes nothing but needs ``seq`` to be kept."""
    batch.write.mode("append").parquet(path)
