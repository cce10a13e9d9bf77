"""Queries of metrics, verifiers, statistics, audits and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import verifiers as vf
from ..operators import metrics as mt
from ..operators import tokenizer as tk
from .catalog import query, reader

LOSS_SQL = "t AS (SELECT user_id, event_id, value / 10.0::DOUBLE AS loss, (1 + event_id % 2)::DOUBLE AS weight, value > 50 AS hit, (1 + event_id % 5)::BIGINT AS n_bytes, ((row_number() OVER (ORDER BY event_id) - 1) * 10 // (SELECT count(*) FROM events))::INT AS shard FROM events)"


def _losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = reader(spark, sf_dir)("events")
    return e.select("user_id", "event_type", F.col("event_id").alias("ord"), (F.col("value") / 10.0).alias("loss"), (1 + F.col("event_id") % 2).cast("double").alias("weight"), (F.col("value") > 50).alias("hit"), (1 + F.col("event_id") % 5).alias("n_bytes"))


@query(
    "token_metrics_by_type",
    """WITH t AS (SELECT event_type, value / 10.0::DOUBLE AS loss, (1 + event_id % 2)::DOUBLE AS weight, value > 50 AS hit, 1 + event_id % 5 AS n_bytes,
  ((row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) * 10 // count(*) OVER (PARTITION BY event_type)) AS shard FROM events),
 p AS (SELECT event_type, shard, sum(loss * weight) AS l, sum(weight) AS w, sum(hit::INT * weight) AS h, sum(n_bytes) AS b FROM t GROUP BY ALL)
 SELECT event_type, round(sum(l) / sum(w), 6) AS loss, round(sum(l) / sum(b) / ln(2.0::DOUBLE), 6) AS bits_per_byte, round(sum(h) / sum(w), 6) AS top10, round(stddev_samp(l / w) / sqrt(count(*)::DOUBLE), 6) AS stderr FROM p GROUP BY event_type""",
)
def token_metrics_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mt.token_metrics(_losses(spark, sf_dir), ["event_type"])
    return out.select("event_type", *[F.round(c, 6).alias(c) for c in ("loss", "bits_per_byte", "top10", "stderr")])


@query("banded_metric", "WITH s AS (SELECT o_custkey, list(o_totalprice ORDER BY o_orderkey) AS v FROM orders GROUP BY o_custkey HAVING count(*) >= 8), f AS (SELECT unnest(range(len(v))) AS pos, unnest(v) AS x FROM s) SELECT CASE WHEN pos < 2 THEN 0 WHEN pos < 7 THEN 1 ELSE 2 END AS band, count(*) AS n, round(avg(x), 4) AS mean FROM f GROUP BY ALL")
def banded_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = reader(spark, sf_dir)("orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_totalprice"))), lambda s: s["o_totalprice"]).alias("v"))
    return mt.banded_metric(o, "v").withColumn("mean", F.round("mean", 4))


@query("run_matches", "WITH r AS (SELECT user_id, event_type, value > 20 AS ok, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS g FROM events), g AS (SELECT user_id, event_type, bool_and(ok) AS ok FROM r GROUP BY user_id, event_type, g) SELECT event_type, count(*) AS runs, count(*) FILTER (WHERE ok) AS right_runs FROM g GROUP BY event_type")
def run_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = reader(spark, sf_dir)("events").withColumn("ok", F.col("value") > 20)
    return mt.run_matches(e, "user_id", "event_id", "event_type", "ok")


@query("pass_at_k", "WITH s AS (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE value > 80) AS c FROM events GROUP BY user_id) SELECT user_id, round(CASE WHEN n < 3 THEN NULL WHEN n - c < 3 THEN 1.0 ELSE 1.0 - (n - c)::DOUBLE / n * (n - c - 1) / (n - 1) * (n - c - 2) / (n - 2) END, 9) AS p3 FROM s")
def pass_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = reader(spark, sf_dir)("events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 80).alias("c"))
    return s.select("user_id", F.round(mt.pass_at_k(F.col("n"), F.col("c"), 3), 9).alias("p3"))


@query("prefix_group_means", "SELECT p AS grp, round(avg(score), 6) AS mean, count(*) AS n FROM (SELECT split_part(p_brand || '/' || p_partkey, '/', 1) AS p, p_size / 50.0::DOUBLE AS score FROM part) GROUP BY p")
def prefix_group_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = reader(spark, sf_dir)("part").select(F.split_part(F.concat_ws("/", "p_brand", F.col("p_partkey").cast("string")), F.lit("/"), F.lit(1)).alias("grp"), (F.col("p_size") / 50.0).alias("score"))
    return p.groupBy("grp").agg(F.round(F.avg("score"), 6).alias("mean"), F.count("*").alias("n"))


@query("unit_weighted_loss", "SELECT event_type, round(sum(value * (1 + event_id % 3)) / sum(1 + event_id % 3), 6) AS loss, round(sum(1 + event_id % 3)::DOUBLE / sum(1 + event_id % 7), 6) AS per_second FROM events GROUP BY event_type")
def unit_weighted_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = reader(spark, sf_dir)("events").select("event_type", F.col("value").alias("loss"), (1 + F.col("event_id") % 3).alias("units"), (1 + F.col("event_id") % 7).alias("seconds"))
    return mt.mean_loss(e, ["event_type"]).select("event_type", F.round("loss", 6).alias("loss"), F.round("per_second", 6).alias("per_second"))


@query("nearest_rank", "WITH r AS (SELECT source, n_chars AS v, row_number() OVER (PARTITION BY source ORDER BY n_chars) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents) SELECT source, max(v) FILTER (WHERE i = (n - 1) * 50 // 100) AS p50, max(v) FILTER (WHERE i = (n - 1) * 95 // 100) AS p95 FROM r GROUP BY source")
def nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.nearest_rank(reader(spark, sf_dir)("documents"), "n_chars", [50, 95], ["source"])


@query("power_buckets", "SELECT CASE WHEN n_chars <= 1 THEN 1 ELSE pow(2, ceil(log2(n_chars)))::BIGINT END AS bucket, count(*) AS n FROM documents GROUP BY ALL")
def power_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.power_buckets(reader(spark, sf_dir)("documents"), "n_chars")


@query("char_classes", r"SELECT 'letters' AS class, sum(length(text) - length(regexp_replace(text, '\p{L}', '', 'g')))::BIGINT AS n FROM documents UNION ALL SELECT 'digits', sum(length(text) - length(regexp_replace(text, '\p{N}', '', 'g')))::BIGINT FROM documents UNION ALL SELECT 'spaces', sum(length(text) - length(regexp_replace(text, '[\s\x{A0}]', '', 'g')))::BIGINT FROM documents UNION ALL SELECT 'punctuation', sum(length(text) - length(regexp_replace(text, '\p{P}', '', 'g')))::BIGINT FROM documents")
def char_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.char_classes(reader(spark, sf_dir)("documents"), "text")


@query("vocabulary_coverage", "WITH v AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS t FROM benchmark), u AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS t FROM documents) SELECT count(*) AS vocabulary, count(*) FILTER (WHERE t IN (SELECT t FROM u)) AS used, count(*) FILTER (WHERE t NOT IN (SELECT t FROM u)) AS unused FROM v")
def vocabulary_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = reader(spark, sf_dir)
    words = lambda d: t(d).select(F.explode(F.split("text", " ")).alias("token"))
    return mt.coverage(words("benchmark"), words("documents"))


@query("flatten_results", "SELECT c_mktsegment AS collection, 'n' || c_nationkey AS task, 'bal' AS metric, 'none' AS filter, round(avg(c_acctbal), 4) AS value FROM customer GROUP BY ALL UNION ALL SELECT c_mktsegment, 'n' || c_nationkey, 'count', '', count(*)::DOUBLE FROM customer GROUP BY ALL")
def flatten_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = reader(spark, sf_dir)("customer").groupBy("c_mktsegment", "c_nationkey").agg(F.round(F.avg("c_acctbal"), 4).alias("bal"), F.count("*").cast("double").alias("n"))
    inner = F.create_map(F.lit("bal,none"), "bal", F.lit("count"), "n")
    tasks = F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")), inner.alias("m"))))
    rows = c.groupBy("c_mktsegment").agg(tasks.alias("t")).select(F.create_map("c_mktsegment", "t").alias("results"))
    return mt.flatten_results(rows)


@query("metric_with_stderr", "SELECT event_type AS task, 'value' AS metric, round(avg(value), 6) AS value, round(stddev_samp(value) / sqrt(count(*)::DOUBLE), 6) AS stderr FROM events GROUP BY event_type UNION ALL SELECT event_type, 'n', count(*)::DOUBLE, NULL FROM events GROUP BY event_type")
def metric_with_stderr(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = reader(spark, sf_dir)("events").groupBy(F.col("event_type").alias("task")).agg(F.round(F.avg("value"), 6).alias("value"), F.round(F.stddev_samp("value") / F.sqrt(F.count("*").cast("double")), 6).alias("value_stderr"), F.count("*").cast("double").alias("n"))
    return mt.with_stderr(e.unpivot("task", ["value", "value_stderr", "n"], "metric", "value"), ["task"])


@query("longest_prefix_lookup", "SELECT source || '_' || doc_id || '.0.transform_1' AS id, CASE WHEN doc_id % 3 = 0 THEN lang ELSE '<unclassified>' END AS lang FROM documents")
def longest_prefix_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = reader(spark, sf_dir)("documents")
    rec = F.concat_ws("_", "source", F.col("doc_id").cast("string"))
    known = d.where("doc_id % 3 = 0").select(rec.alias("known"), "lang")
    return mt.longest_prefix(d.select(F.concat(rec, F.lit(".0.transform_1")).alias("id")), known, "id", "lang")


@query("forward_fill", "SELECT event_id, last_value(CASE WHEN value > 60 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS latest FROM events")
def forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = reader(spark, sf_dir)("events").withColumn("v", F.when(F.col("value") > 60, F.col("value")))
    return mt.forward_fill(e, "user_id", "event_id", "v").select("event_id", "latest")


@query("retained_checkpoints", "SELECT user_id, event_id, b = 1 AS is_best, r <= 2 AS is_recent FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS b, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE b = 1 OR r <= 2")
def retained_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.retained(reader(spark, sf_dir)("events"), "user_id", "event_id", "value", 2).select("user_id", "event_id", "is_best", "is_recent")


@query("view_counters", "SELECT sum((role = 'user')::INT)::BIGINT AS prompts, sum((role = 'assistant')::INT)::BIGINT AS answers, sum((role = 'none')::INT)::BIGINT AS dropped, 100.0::DOUBLE * sum((role = 'assistant')::INT) / greatest(1, sum((role = 'user')::INT)) AS answered_pct, 0.0::DOUBLE AS dropped_pct FROM conversations")
def view_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = reader(spark, sf_dir)("conversations").select(*[(F.col("role") == r).cast("int").alias(n) for r, n in (("user", "prompts"), ("assistant", "answers"), ("none", "dropped"))])
    return mt.view_stats(c, ["prompts", "answers", "dropped"], {"answered_pct": ("answers", "prompts"), "dropped_pct": ("dropped", "dropped")})


@query("segment_stats", "WITH s AS (SELECT l_orderkey AS uid, l_returnflag AS grp, floor(l_quantity)::BIGINT AS tokens, floor(l_quantity / 2)::BIGINT AS loss, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, floor(l_quantity)) - 1 AS pos, count(*) OVER (PARTITION BY l_orderkey) AS k FROM lineitem) SELECT grp, count(DISTINCT uid) AS examples, count(*) AS segments, sum(tokens + CASE WHEN pos = 0 THEN k - 1 ELSE 0 END)::BIGINT AS tokens, sum(loss + CASE WHEN pos = 0 THEN k - 1 ELSE 0 END)::BIGINT AS loss_tokens, count(*) FILTER (WHERE k > 1) AS packed FROM s GROUP BY grp")
def segment_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = reader(spark, sf_dir)("lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("grp"), F.floor("l_quantity").alias("tokens"), F.floor(F.col("l_quantity") / 2).alias("loss"))
    e = li.groupBy(F.col("l_orderkey").alias("uid")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "grp", "tokens", "loss"))), lambda s: F.struct(s["grp"].alias("grp"), s["tokens"].alias("tokens"), s["loss"].alias("loss"))).alias("segments"), F.sum("tokens").alias("t"), F.sum("loss").alias("l"))
    e = e.select("uid", "segments", (F.col("t") + F.size("segments") - 1).alias("n_tokens"), (F.col("l") + F.size("segments") - 1).alias("n_loss"))
    return mt.segment_stats(e, "grp")


@query("source_shares", "SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS chars, round(100.0::DOUBLE * sum(n_chars) / (SELECT sum(n_chars) FROM documents), 6) AS share FROM documents GROUP BY source ORDER BY chars DESC, source LIMIT 8")
def source_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = reader(spark, sf_dir)("documents").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    total = d.agg(F.sum("chars").alias("t"))
    d = d.join(F.broadcast(total)).withColumn("share", F.round(100.0 * F.col("chars") / F.col("t"), 6))
    return d.orderBy(F.desc("chars"), "source").limit(8).drop("t")


@query("mixture_capacity", "WITH s AS (SELECT source, sum(n_chars) AS u, 1.0 + min(doc_id) % 3 AS w FROM documents GROUP BY source) SELECT source, round(u::DOUBLE / 1 * 2 / (w / sum(w) OVER ())::DOUBLE, 3) AS projected, CASE WHEN u::DOUBLE / 1 * 2 / (w / sum(w) OVER ())::DOUBLE < 3000000 THEN 'limiting' ELSE 'probably_valid' END AS state FROM s")
def mixture_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = reader(spark, sf_dir)("documents").groupBy("source").agg(F.sum("n_chars").alias("units"), (1.0 + F.min("doc_id") % 3).cast("double").alias("weight")).withColumns({"passes": F.lit(1), "allowed": F.lit(2)})
    return mt.capacity(s, 3_000_000).withColumn("projected", F.round("projected", 3))


@query("power_law_fit")
def power_law_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = spark.range(4).select(F.col("id").alias("run")).join(spark.range(1, 41).select((F.col("id") * 1e6).alias("tokens")))
    return mt.power_law(curve.withColumn("loss", 1.5 + (F.col("run") + 1) * F.pow("tokens", F.lit(-0.2))), "run")


@query("text_verifiers", r"SELECT event_id, (lower(trim(event_type)) = 'click')::INT::DOUBLE AS exact, (event_type IN ('click', 'view'))::INT::DOUBLE AS one_of, (event_type LIKE 'c%')::INT::DOUBLE AS starts, regexp_matches(lower(props), '(^|\W)k(\W|$)')::INT::DOUBLE AS contains FROM events")
def text_verifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.lit(" "), F.upper("event_type"), F.lit("\n"))
    return reader(spark, sf_dir)("events").select("event_id", vf.exact(t, "click").alias("exact"), vf.one_of(t, ["Click", "view"]).alias("one_of"), vf.starts_with(t, "c").alias("starts"), vf.contains_any(F.col("props"), ["K"]).alias("contains"))


@query("numeric_verifier", "SELECT p_partkey, CASE WHEN abs(p_size - 20) <= 5 THEN 1.0 ELSE 0.0 END::DOUBLE AS whole, CASE WHEN abs(p_size - 20) <= 5 THEN 0.5 ELSE 0.0 END::DOUBLE AS embedded FROM part")
def numeric_verifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size").cast("string")
    return reader(spark, sf_dir)("part").select("p_partkey", vf.numeric(F.concat(F.lit(" "), n, F.lit(",0")), 20, 5).alias("whole"), vf.numeric(F.concat(F.lit("it is "), n), 20, 5, 0.5).alias("embedded"))


@query("chrf_verifier")
def chrf_verifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reader(spark, sf_dir)("part").select("p_partkey", vf.chrf(F.col("p_name"), ["almond antique", "steel"]).alias("score"))


@query("json_verifier", "SELECT event_id, (json_extract(props, '$.k')::BIGINT = 5)::INT::DOUBLE AS score FROM events")
def json_verifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reader(spark, sf_dir)("events").select("event_id", vf.json_fields(F.col("props"), {"K": [5]}).alias("score"))


@query("python_verifier", "SELECT p_partkey, (p_size + 2 * 3 = 30)::INT::DOUBLE AS score FROM part")
def python_verifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.col("p_size").cast("string"), F.lit(" + 2 * 3"))
    return reader(spark, sf_dir)("part").select("p_partkey", vf.python_value(t, [30]).alias("score"))


@query("vocabulary_audit", r"SELECT w AS token, n, regexp_full_match(w, '[0-9]+') AS digits, regexp_matches(w, '^https?://') AS url, regexp_full_match(w, '[^@\s]+@[^@\s]+\.[^@\s]+') AS email, regexp_full_match(w, '(0x)?[0-9a-fA-F]{8,}') AS hex, length(w) > 24 AS very_long FROM (SELECT w, count(*) AS n FROM (SELECT unnest(string_split_regex(text, '\s+')) AS w FROM documents) WHERE w <> '' GROUP BY w)")
def vocabulary_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = reader(spark, sf_dir)("documents").select(F.explode(F.split("text", r"\s+")).alias("token")).where("token <> ''")
    return tk.audit(w.groupBy("token").agg(F.count("*").alias("n")))


@query("vocabulary_audit_full")
def vocabulary_audit_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tokens, however rare, by all predicates."""
    w = reader(spark, sf_dir)("documents").select(F.explode(F.split("text", r"\s+")).alias("token")).where("token <> ''")
    return tk.flags(w.groupBy("token").agg(F.count("*").alias("n")))


@query("events_stream_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def events_stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running counts of a stream of files, drained to its end."""
    from ..streaming import ingest

    return ingest.drained_counts(spark, f"{sf_dir}/events.parquet", reader(spark, sf_dir)("events").schema, "event_type")


@query("events_stream_windows", "SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def events_stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming import ingest

    return ingest.drained_windows(spark, f"{sf_dir}/events.parquet", reader(spark, sf_dir)("events").schema, "ts", "6 hours", "event_type")
