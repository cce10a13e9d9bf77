"""Queries of training views. Characters stand in for tokens, so that SQL can
state the same lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics, views
from ..session import spread
from .catalog import query, reader

WINDOW_SQL = """w AS (
  SELECT doc_id, n, k * 896 AS start, least(k * 896 + 1024, n) AS stop, CASE WHEN k = 0 THEN 0 ELSE k * 896 + 128 END AS new_from, k
  FROM (SELECT doc_id, n_chars AS n, unnest(range(greatest(ceil((n_chars - 1024) / 896.0), 0)::BIGINT + 1)) AS k FROM documents WHERE n_chars > 0)
), win AS (
  SELECT doc_id, (CASE WHEN k > 0 AND stop - new_from < 256 THEN n - 1024 ELSE start END)::INT AS start, (CASE WHEN k > 0 AND stop - new_from < 256 THEN n ELSE stop END)::INT AS stop, new_from::INT AS new_from FROM w
)"""


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = reader(spark, sf_dir)("documents").select("doc_id", "source", F.explode(views.windows(F.col("n_chars"))).alias("w"))
    return d.select("doc_id", "source", "w", "w.*")


@query("token_windows", f"WITH {WINDOW_SQL} SELECT * FROM win")
def token_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir).select("doc_id", "start", "stop", "new_from")


@query("window_work_units", f"WITH {WINDOW_SQL} SELECT doc_id, count(*) AS windows, sum(greatest(0, stop - start - greatest(1, new_from - start)))::BIGINT AS units FROM win GROUP BY doc_id")
def window_work_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("windows"), F.sum(views.work_units(F.col("w")).cast("bigint")).alias("units"))


@query("window_loss_masks", f"WITH {WINDOW_SQL} SELECT doc_id, start, (stop - start - greatest(1, new_from - start))::DOUBLE AS mask_sum, stop - start AS mask_size FROM win")
def window_loss_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(_windows(spark, sf_dir)).withColumn("mask", views.loss_mask(F.col("w")))
    return rows.select("doc_id", "start", F.aggregate("mask", F.lit(0.0), lambda a, x: a + x).alias("mask_sum"), F.size("mask").alias("mask_size"))


@query("eval_prefix_by_source", "SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM (SELECT *, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS c FROM documents) WHERE c <= 50000 GROUP BY source")
def eval_prefix_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = reader(spark, sf_dir)("documents").select("source", "doc_id", "n_chars")
    return views.within_budget(d, "n_chars", 50_000, "doc_id", ["source"]).groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("training_budget_batches", "WITH b AS (SELECT source, doc_id, n_chars, ((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 8)::INT AS batch FROM documents), t AS (SELECT source, batch, sum(n_chars) AS u FROM b GROUP BY ALL), c AS (SELECT source, batch, coalesce(sum(u) OVER (PARTITION BY source ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t) SELECT b.source, b.doc_id, b.batch FROM b JOIN c ON b.source = c.source AND b.batch = c.batch WHERE before < 60000")
def training_budget_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = reader(spark, sf_dir)("documents").select("source", "doc_id", "n_chars")
    return views.whole_batches(d, "n_chars", 60_000, 8, "doc_id", ["source"]).select("source", "doc_id", "batch")


TURNS_SQL = """x AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM conversations),
per AS (SELECT conv_id, g::INT AS i, max(length(text)) FILTER (WHERE role = 'user') AS p, sum(length(text)) FILTER (WHERE role = 'assistant') AS c FROM x WHERE g > 0 AND role <> 'system' GROUP BY conv_id, g HAVING count(*) FILTER (WHERE role = 'assistant') > 0),
sys AS (SELECT conv_id, max(length(text)) AS s FROM conversations WHERE role = 'system' GROUP BY conv_id)"""


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    c = reader(spark, sf_dir)("conversations").withColumn("n", F.length("text"))
    c = c.withColumn("i", F.sum((F.col("role") == "user").cast("int")).over(Window.partitionBy("conv_id").orderBy("turn")).cast("int"))
    answer = F.col("role") == "assistant"
    per = c.where("i > 0 and role <> 'system'").groupBy("conv_id", "i").agg(F.max(F.when(F.col("role") == "user", F.col("n"))).alias("prompt_len"), F.sum(F.when(answer, F.col("n"))).cast("int").alias("completion_len")).where("completion_len is not null")
    system = c.where("role = 'system'").groupBy("conv_id").agg(F.max("n").alias("system_len"))
    return per.join(system, "conv_id", "left").withColumns({"system_len": F.coalesce("system_len", F.lit(0)), "scratchpad_len": F.lit(0)}).withColumnRenamed("conv_id", "record_id")


ENCODED_SQL = f"""{TURNS_SQL}, h AS (
  SELECT a.conv_id, a.i, b.i AS bi, sum(b.p + b.c) OVER (PARTITION BY a.conv_id, a.i ORDER BY b.i DESC) AS used, 1200 - a.p - a.c AS room
  FROM per a JOIN per b ON a.conv_id = b.conv_id AND b.i < a.i),
 k AS (SELECT conv_id, i, count(*) FILTER (WHERE used <= room) AS kept, coalesce(max(used) FILTER (WHERE used <= room), 0) AS used, count(*) AS size FROM h GROUP BY ALL),
 enc AS (SELECT per.conv_id AS record_id, per.i, p + c > 1200 AS rejected, false AS has_scratchpad, CASE WHEN p + c > 1200 THEN 0 ELSE coalesce(kept, 0) END::INT AS history_kept, coalesce(size, 0)::INT AS history_size,
   p + c <= 1200 AND coalesce(s, 0) > 0 AND coalesce(s, 0) <= 1200 - p - c - coalesce(used, 0) AS has_system, coalesce(s, 0) > 0 AS had_system
 FROM per LEFT JOIN k ON per.conv_id = k.conv_id AND per.i = k.i LEFT JOIN sys ON per.conv_id = sys.conv_id)"""


@query("encode_turns", f"WITH {ENCODED_SQL} SELECT * EXCLUDE (had_system) FROM enc")
def encode_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.encode_turns(_turns(spark, sf_dir), 1200)


@query(
    "context_losses",
    f"WITH {ENCODED_SQL} SELECT (record_id % 4)::INT AS part, count(*) AS segments, count(*) FILTER (WHERE history_size > 0) AS with_history, count(*) FILTER (WHERE history_kept < history_size) AS history_reduced, sum(history_size - history_kept)::BIGINT AS turns_dropped, 0::BIGINT AS with_scratchpad, 0::BIGINT AS scratchpad_removed, count(*) FILTER (WHERE had_system) AS with_system, count(*) FILTER (WHERE had_system AND NOT has_system) AS system_dropped FROM enc WHERE NOT rejected GROUP BY 1",
)
def context_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _turns(spark, sf_dir)
    had = turns.select("record_id", "i", (F.col("system_len") > 0).alias("had_system"), (F.col("scratchpad_len") > 0).alias("had_scratchpad"))
    encoded = views.encode_turns(turns, 1200).join(had, ["record_id", "i"])
    return metrics.context_losses(encoded.withColumn("part", (F.col("record_id") % 4).cast("int")), ["part"])


WEIGHTS = {"src1": 1.0, "src2": 2.0, "src3": 0.5}


def _streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reader(spark, sf_dir)("documents").select("source", F.col("doc_id").alias("uid"), F.col("n_chars").alias("units"), F.col("doc_id").alias("ord"))


@query("mixture_parallel", "WITH s AS (SELECT d.source, doc_id AS uid, sum(n_chars) OVER (PARTITION BY d.source ORDER BY doc_id)::DOUBLE / w AS target FROM documents d JOIN (VALUES ('src1', 1.0::DOUBLE), ('src2', 2.0::DOUBLE), ('src3', 0.5::DOUBLE)) AS v(source, w) ON d.source = v.source) SELECT source, uid, target FROM s WHERE target <= (SELECT min(e) FROM (SELECT max(target) AS e FROM s GROUP BY source))")
def mixture_parallel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.mix_parallel(_streams(spark, sf_dir), WEIGHTS)


@query("mixture_exact")
def mixture_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.mix_exact(_streams(spark, sf_dir), WEIGHTS, {"src3": 1})


@query("first_fit_packs")
def first_fit_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows of all documents; uid is the document and the start."""
    d = reader(spark, sf_dir)("documents").select("doc_id", "source", F.col("n_chars").alias("n"), F.explode(views.windows(F.col("n_chars"))).alias("w"))
    uid = F.concat_ws(":", "doc_id", "w.start")
    rows = d.select("source", "doc_id", "w.start", uid.alias("uid"), (F.col("w.stop") - F.col("w.start")).alias("length"), (F.col("w.stop") == F.col("n")).alias("ends"), (F.col("w.start") == 0).alias("starts"))
    return views.first_fit_packs(rows, order=["doc_id", "start"])


@query("feedback_prompts", f"WITH {TURNS_SQL} SELECT conv_id::VARCHAR AS record_id, (row_number() OVER (PARTITION BY conv_id ORDER BY i) - 1)::INT AS i, (row_number() OVER (PARTITION BY conv_id ORDER BY i) - 1)::INT AS history_size FROM per")
def feedback_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.transforms import chat_to_sft

    out = views.feedback_prompts(chat_to_sft(reader(spark, sf_dir)("conversations")))
    return out.select("record_id", "i", F.size("history").alias("history_size"))


@query("position_weights", "SELECT turn, list_transform(range(8), lambda i: CASE WHEN i < turn THEN 0.0 WHEN i - turn < 2 THEN 2.0 WHEN i - turn < 4 THEN 1.5 ELSE 1.0 END::DOUBLE) AS weights FROM (SELECT DISTINCT turn FROM conversations)")
def position_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = reader(spark, sf_dir)("conversations").select("turn").distinct()
    mask = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: (i >= F.col("turn")).cast("double"))
    return t.select("turn", views.position_weights(mask, [(2, 2.0), (4, 1.5)], 1.0).alias("weights"))


@query("ranked_groups", "SELECT o_custkey, n, list_transform(range(n), lambda i: (n - 1 - i)::DOUBLE) AS scores FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 2)")
def ranked_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = reader(spark, sf_dir)("orders").groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("c"))
    g = views.scored_groups(o.select("o_custkey", F.size("c").cast("bigint").alias("n"), views.ranked_scores(F.col("c")).alias("scores")))
    return g
