"""Queries of record transforms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import presets, threads
from ..operators import transforms as tr
from .catalog import query, reader

EXCHANGE_SQL = """x AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM conversations),
per AS (
  SELECT conv_id, g, max(text) FILTER (WHERE role = 'user') AS prompt, string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (WHERE role = 'assistant') AS completion
  FROM x WHERE g > 0 AND role <> 'system' GROUP BY conv_id, g HAVING count(*) FILTER (WHERE role = 'assistant') > 0
), turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY g) - 1 AS i, prompt, completion FROM per WHERE trim(prompt) <> '')"""


@query(
    "chat_to_sft",
    f"""WITH {EXCHANGE_SQL}
SELECT conv_id::VARCHAR AS record_id, 'prompt.' || i AS field, prompt AS value FROM turns UNION ALL SELECT conv_id::VARCHAR, 'completion.' || i, completion FROM turns
UNION ALL SELECT conv_id::VARCHAR, 'system_prompt', arg_max(text, turn) FROM conversations WHERE role = 'system' AND conv_id IN (SELECT conv_id FROM turns) GROUP BY conv_id""",
)
def chat_to_sft(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.numbered_fields(tr.chat_to_sft(reader(spark, sf_dir)("conversations")))


@query("chat_to_sft_short_turns", f"WITH {EXCHANGE_SQL} SELECT conv_id::VARCHAR AS record_id, count(*) AS n_turns, sum(length(prompt) + length(completion))::BIGINT AS chars FROM turns WHERE length(prompt) + length(completion) <= 600 GROUP BY conv_id")
def chat_to_sft_short_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tr.chat_to_sft(reader(spark, sf_dir)("conversations"), max_turn_chars=600).select("record_id", F.explode("turns").alias("t"))
    return out.groupBy("record_id").agg(F.count("*").alias("n_turns"), F.sum((F.length("t.prompt") + F.length("t.completion")).cast("bigint")).alias("chars"))


@query("message_threads", "WITH RECURSIVE up(leaf, id, depth) AS (SELECT conv_id || '-' || turn, conv_id || '-' || turn, 0 FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM conversations d WHERE d.conv_id = c.conv_id AND d.turn = c.turn + 1) UNION ALL SELECT leaf, p.conv_id || '-' || p.turn, depth + 1 FROM up JOIN conversations p ON id = p.conv_id || '-' || (p.turn + 1)) SELECT leaf AS leaf_id, count(*)::INT AS n_messages, max_by(id, depth) AS root_id FROM up GROUP BY leaf HAVING count(*) > 1")
def message_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn answers the one before it; threads of the last ones."""
    c = reader(spark, sf_dir)("conversations")
    ident = lambda t: F.concat_ws("-", F.col("conv_id").cast("string"), t.cast("string"))
    m = c.select(ident(F.col("turn")).alias("message_id"), F.when(F.col("turn") > 0, ident(F.col("turn") - 1)).alias("parent_id"), "role", "text", F.lit("en").alias("lang"))
    return tr.threads(m).select("leaf_id", F.size("messages").alias("n_messages"), F.get("messages", F.lit(0))["message_id"].alias("root_id"))


@query("field_mapping", "SELECT doc_id::VARCHAR AS record_id, concat_ws(chr(10) || chr(10), nullif(source, ''), nullif(text, '')) AS text FROM documents")
def field_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = reader(spark, sf_dir)("documents").select(F.col("doc_id").cast("string").alias("record_id"), "source", "text")
    return tr.field_mapping({"text": ["source", "text"]})(d)


@query("to_sft_and_normalize", "SELECT p_partkey::VARCHAR AS record_id, trim(p_name) || chr(10) || chr(10) || trim(p_type) AS prompt, trim(p_brand) AS completion FROM part WHERE trim(p_brand) <> ''")
def to_sft_and_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = reader(spark, sf_dir)("part").withColumn("record_id", F.col("p_partkey").cast("string"))
    out = tr.to_sft(p, [F.col("p_name"), F.col("p_type")], [F.col("p_brand")])
    return out.select("record_id", F.col("turns")[0]["prompt"].alias("prompt"), F.col("turns")[0]["completion"].alias("completion"))


@query("fan_out", "SELECT p_partkey::VARCHAR || '.transform_0.0' AS record_id, p_name AS text FROM part UNION ALL SELECT p_partkey::VARCHAR || '.transform_1.0', p_type FROM part")
def fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = reader(spark, sf_dir)("part").withColumn("record_id", F.col("p_partkey").cast("string"))
    return tr.fan_out(tr.field_mapping({"text": ["p_name"]}), tr.field_mapping({"text": ["p_type"]}))(p)


@query("context_items", "SELECT conv_id::VARCHAR AS record_id, turn::INT AS turn, trim(string_agg(p.text, chr(10) ORDER BY p.t)) AS prompt FROM (SELECT a.conv_id, a.turn, b.turn AS t, trim(b.text) AS text FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn <= a.turn AND b.role = 'user' WHERE a.role = 'user') p GROUP BY conv_id, turn")
def context_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn with all user turns so far as its context."""
    c = reader(spark, sf_dir)("conversations")
    rows = c.groupBy(F.col("conv_id").cast("string").alias("record_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("items"))
    user = lambda x: x["role"] == "user"
    out = tr.items_to_sft(rows, "items", lambda x: x["text"], lambda x: F.lit(""), lambda x: x["turn"].cast("string"), user, user)
    return out.select("record_id", F.explode("turns").alias("t")).select("record_id", F.col("t.completion").cast("int").alias("turn"), F.col("t.prompt").alias("prompt"))


@query("split_qa_pairs", "SELECT conv_id::VARCHAR || '.qa-' || (turn + 1) AS record_id, 'Passage ' || conv_id || chr(10) || chr(10) || 'Question: q' || turn AS prompt, 'a' || turn AS completion FROM conversations WHERE turn % 2 = 0 AND role <> 'system'")
def split_qa_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents built from conversations: complete pairs at even turns."""
    c = reader(spark, sf_dir)("conversations")
    answer = F.when((F.col("turn") % 2 == 0) & (F.col("role") != "system"), F.concat(F.lit(" Answer: a"), F.col("turn").cast("string"))).otherwise("")
    line = F.concat(F.lit("Question: q"), F.col("turn").cast("string"), answer)
    whole = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda s: s["line"]), "\n").alias("qa"))
    d = whole.select(F.col("conv_id").cast("string").alias("record_id"), F.concat(F.lit("Passage "), F.col("conv_id").cast("string"), F.lit("\n"), F.col("qa")).alias("text"))
    return tr.split_qa_pairs(d)


@query("arithmetic_templates")
def arithmetic_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = reader(spark, sf_dir)("part").select(F.col("p_partkey").cast("string").alias("record_id"), F.lit("Add number0 and number1.").alias("question"), F.array(F.col("p_size").cast("double"), F.lit(7.0)).alias("numbers"), F.array(F.lit("+"), F.lit("number0"), F.lit("number1")).alias("equation"))
    return tr.arithmetic_templates(p)


@query("equation_answers")
def equation_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    p = reader(spark, sf_dir)("part").where("p_size > 5").select(F.col("p_partkey").cast("string").alias("record_id"), F.concat(F.lit("Take 5 from "), size, F.lit(".")).alias("question"), F.concat(size, F.lit(" - 5 = "), (F.col("p_size") - 5).cast("string"), F.lit(" #### "), (F.col("p_size") - 5).cast("string")).alias("answer"))
    return tr.equation_answers(p)


@query("lookup_retrieval")
def lookup_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = reader(spark, sf_dir)("documents").select(F.col("doc_id").cast("string").alias("record_id"), "text")
    return tr.lookup_retrieval(d)


@query(
    "thread_messages",
    """WITH e AS (SELECT conv_id::VARCHAR AS thread, turn AS seq, role, text, role = 'assistant' AS answer, role = 'assistant' AND turn % 4 = 0 AS replaces FROM conversations),
 o AS (SELECT *, NOT answer OR NOT replaces OR coalesce(sum(answer::INT) OVER (PARTITION BY thread ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS opens FROM e),
 s AS (SELECT *, CASE WHEN answer THEN sum((answer AND opens)::INT) OVER (PARTITION BY thread ORDER BY seq) ELSE -seq - 1 END AS slot FROM o),
 m AS (SELECT thread, min(seq) AS first, arg_max(role, seq) AS role, arg_max(text, seq) AS content, max(seq)::VARCHAR AS stamp FROM s GROUP BY thread, slot)
 SELECT thread, row_number() OVER (PARTITION BY thread ORDER BY first)::INT AS place, role, content, stamp AS "at" FROM m""",
)
def thread_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other answer replaces the one before it."""
    c = reader(spark, sf_dir)("conversations")
    op = F.when((F.col("role") == "assistant") & (F.col("turn") % 4 == 0), "replace").otherwise("append")
    events = c.select(F.col("conv_id").cast("string").alias("thread"), F.col("turn").alias("seq"), op.alias("op"), "role", F.col("text").alias("content"), F.col("turn").cast("string").alias("at"))
    return threads.thread_log(events)


@query(
    "manifests_migrated",
    """SELECT p_partkey, CASE p_size % 3
  WHEN 0 THEN '{"configuration": {"task": {"params": {"assistant_format": "legacy"}, "wrapper_class": "CausalLmTaskWrapper"}}, "run_id": "r' || p_partkey || '", "version": 6}'
  WHEN 1 THEN '{"configuration": {"task_config": {"params": {"assistant_format": "normalized"}, "wrapper_class": "CausalLmTaskWrapper"}}, "version": 6}'
  ELSE '{"configuration": {"evaluation_configs": [{"task_config": {"params": {"assistant_format": "legacy", "k": ' || p_size || '}, "wrapper_class": "CausalLmTaskWrapper"}}]}, "version": 6}' END AS manifest FROM part""",
)
def manifests_migrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests of versions 1, 3 and 4."""
    kind, key, size = F.col("p_size") % 3, F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    first = F.concat(F.lit('{"run_id": "r'), key, F.lit('", "configuration": {"task": {"wrapper_class": "CausalLmTaskWrapper"}}}'))
    third = F.lit('{"version": 3, "configs": {"task_config": {"wrapper_class": "CausalLmTaskWrapper", "params": {"assistant_format": "normalized"}}}}')
    fourth = F.concat(F.lit('{"version": 4, "configuration": {"evaluation_configs": [{"task_config": {"wrapper_class": "CausalLmTaskWrapper", "params": {"k": '), size, F.lit("}}}]}}"))
    text = F.when(kind == 0, first).when(kind == 1, third).otherwise(fourth)
    return reader(spark, sf_dir)("part").select("p_partkey", presets.migrated_column(text).alias("manifest"))


@query("file_catalogue")
def file_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return presets.catalogue(spark, sf_dir).select(F.element_at(F.split("file", "/"), -1).alias("name"), "bytes")
