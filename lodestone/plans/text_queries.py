"""Queries of text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import chat
from ..functions import formats as fm
from ..functions import text as tx
from ..operators import near_duplicates as nd
from .catalog import dealt, query, reader


@query("record_features", "SELECT doc_id, length(text)::INT AS rec_len, substr(text, 1, 100) AS rec_sni, lang AS rec_lan FROM documents")
def record_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reader(spark, sf_dir)("documents").select("doc_id", F.length("text").alias("rec_len"), F.substring("text", 1, 100).alias("rec_sni"), F.col("lang").alias("rec_lan"))


@query("word_ngrams", r"SELECT doc_id, greatest(0, len(w) - 4)::INT AS n, CASE WHEN len(w) >= 5 THEN array_to_string(list_slice(w, 1, 5), ' ') END AS first FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents)")
def word_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = dealt(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", nd.words(F.col("text")).alias("w"))
    g = g.select("doc_id", nd.ngrams(F.col("w")).alias("g"))
    return g.select("doc_id", F.size("g").alias("n"), F.get("g", F.lit(0)).alias("first"))


@query("strip_white_space", r"SELECT conv_id, turn, regexp_replace(chr(160) || ' ' || text || chr(10), '^[\s\x{A0}]+|[\s\x{A0}]+$', '', 'g') AS text FROM conversations")
def strip_white_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = reader(spark, sf_dir)("conversations")
    return c.select("conv_id", "turn", tx.strip(F.concat(F.lit("\u00a0 "), "text", F.lit("\n"))).alias("text"))


@query("normalize_text", "SELECT doc_id, md5(text) AS h FROM documents")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line ends and odd characters that were put in are taken out again."""
    d = dealt(spark, sf_dir, "documents", "doc_id", "text")
    odd = F.concat(F.lit("\u200b"), F.replace(F.replace("text", F.lit("\n"), F.lit("\r\n")), F.lit(" "), F.lit("\u00a0")), F.lit("\u200e"))
    return d.select("doc_id", F.md5(tx.normalize_text(odd)).alias("h"))


@query("control_token_newlines", "SELECT conv_id, turn, '<|user|>' || ltrim(rtrim(text, chr(10)), chr(10)) || '<|end|>' AS text FROM conversations")
def control_token_newlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = reader(spark, sf_dir)("conversations")
    return c.select("conv_id", "turn", tx.strip_around_tokens(F.concat(F.lit("<|user|>\n\n"), "text", F.lit("\n<|end|>")), ["<|user|>", "<|end|>"]).alias("text"))


@query("pre_tokens", "SELECT event_id, len(regexp_extract_all(props, '[+\\-*/=<>%^|&~!?:;,.()\\[\\]{}\"''`@#$]|[0-9]|[^0-9+\\-*/=<>%^|&~!?:;,.()\\[\\]{}\"''`@#$]+'))::INT AS n FROM events")
def pre_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reader(spark, sf_dir)("events").select("event_id", F.size(tx.pre_tokens(F.col("props"))).alias("n"))


@query("math_rationale", "SELECT p_partkey, 'so ' || p_size || chr(10) || 'Final answer: ' || p_size AS text FROM part")
def math_rationale(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    t = F.concat(F.lit("so <<1+1="), size, F.lit(">>"), size, F.lit("\n#### "), size)
    return reader(spark, sf_dir)("part").select("p_partkey", tx.math_rationale(t).alias("text"))


@query("placeholders", "SELECT p_partkey, 'take ' || p_size || ' and 7, then ' || 7 || '0' AS text FROM part")
def placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = reader(spark, sf_dir)("part")
    return p.select("p_partkey", tx.placeholders(F.lit("take number0 and number1, then number10"), F.array(F.col("p_size").cast("string"), F.lit("7"))).alias("text"))


@query("choice_rendering", "SELECT p_partkey, 'A. ' || p_brand || chr(10) || 'B. ' || p_type AS lettered, '1. ' || p_brand || chr(10) || '2. ' || p_type AS numbered, CASE WHEN p_size % 2 = 0 THEN '1. ' || p_brand ELSE '2. ' || p_type END AS answer FROM part")
def choice_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = reader(spark, sf_dir)("part")
    c = F.array("p_brand", "p_type")
    place = tx.choice_by_index(c, (F.col("p_size") % 2).cast("int"))
    return p.select("p_partkey", tx.lettered(c).alias("lettered"), tx.numbered(c).alias("numbered"), tx.choice_response(c, place, "both").alias("answer"))


@query("choice_by_label", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE 'pending' END AS answer, CASE o_orderstatus WHEN 'F' THEN '1' WHEN 'O' THEN '2' ELSE '3' END AS number FROM orders")
def choice_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = reader(spark, sf_dir)("orders")
    texts = F.array(F.lit("final"), F.lit("open"), F.lit("pending"))
    place = tx.choice_by_label(F.array(F.lit("F"), F.lit("O"), F.lit("P")), F.col("o_orderstatus"))
    return o.select("o_orderkey", tx.choice_response(texts, place).alias("answer"), tx.choice_response(texts, place, "number").alias("number"))


@query("task_labels", "SELECT event_id, CASE event_type WHEN 'click' THEN 'act' END AS task, CASE WHEN value > 50 THEN 'yes' ELSE 'no' END AS yes FROM events WHERE event_type IN ('click', 'view')")
def task_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = reader(spark, sf_dir)("events").where(F.col("event_type").isin("click", "view"))
    return e.select("event_id", tx.task_label(F.col("event_type"), {"click": "act", "view": None}, ["act"]).alias("task"), tx.yes_no(F.col("value") > 50).alias("yes"))


@query("verbosity_and_format", r"SELECT conv_id, turn, CASE WHEN length(text) <= 100 THEN 'short' WHEN length(text) <= 400 THEN 'medium' ELSE 'long' END AS verbosity, CASE WHEN regexp_full_match(text, '[^\n]*') THEN 'line' WHEN regexp_full_match(text, '[^\n]*\n[^\n]*') THEN 'two' ELSE 'text' END AS format FROM conversations")
def verbosity_and_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = reader(spark, sf_dir)("conversations")
    return c.select("conv_id", "turn", tx.verbosity(F.length("text"), [(100, "short"), (400, "medium")], "long").alias("verbosity"), tx.format_label(F.col("text"), [("line", r"[^\n]*"), ("two", r"[^\n]*\n[^\n]*")], "text").alias("format"))


@query("sanitize_ids", "SELECT page_id, regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g') AS id FROM pages")
def sanitize_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reader(spark, sf_dir)("pages").select("page_id", tx.sanitize(F.col("url")).alias("id"))


@query("truncate_text", r"SELECT conv_id, turn, CASE WHEN length(text) <= 120 AND instr(text, chr(10)) = 0 THEN text ELSE regexp_replace(substr(regexp_replace(substr(string_split(text, chr(10))[1], 1, 120), '\s+$', ''), 1, 104), '\s+$', '') || ' ... [truncated]' END AS text FROM conversations")
def truncate_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reader(spark, sf_dir)("conversations").select("conv_id", "turn", tx.truncate(F.col("text"), 1, 120).alias("text"))


@query("think_split", "SELECT conv_id, turn, 'why ' || turn AS scratchpad, trim(text, ' ' || chr(10)) AS answer FROM conversations")
def think_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = reader(spark, sf_dir)("conversations")
    why, answer = tx.think_split(F.concat(F.lit(" <think> why "), F.col("turn").cast("string"), F.lit(" </think> "), "text"))
    return c.select("conv_id", "turn", why.alias("scratchpad"), answer.alias("answer"))


@query("rate_schedule", "SELECT doc_id, round(CASE WHEN doc_id < 100 THEN 0.1 + 0.9 * (doc_id / 100.0::DOUBLE) WHEN doc_id < 300 THEN 1.0 ELSE 0.2 + 0.8 * (0.5 * (1 + cos(3.141592653589793 * least(1.0, (doc_id - 300) / 500.0::DOUBLE)))) END::DOUBLE, 9) AS rate FROM documents")
def rate_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reader(spark, sf_dir)("documents").select("doc_id", F.round(tx.schedule(F.col("doc_id"), 100, 300, 500, 0.1, 1.0, 0.2), 9).alias("rate"))


@query("number_formats", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 3 THEN 'n/a' ELSE format('{:,}', l_orderkey * 1000 + l_linenumber) END AS grouped, CASE WHEN l_linenumber > 1 THEN printf('%.2f%%', 100.0 * l_linenumber / 7) ELSE 'n/a' END AS share, replace(format('{:,}', l_orderkey * 1000), ',', '_') || CASE WHEN l_orderkey > 0 THEN ' (25.00%)' ELSE ' (n/a)' END AS metric FROM lineitem")
def number_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = reader(spark, sf_dir)("lineitem")
    n = F.col("l_orderkey") * 1000
    grouped = fm.grouped_int(F.when(F.col("l_linenumber") != 3, n + F.col("l_linenumber")))
    share = fm.percent_of(F.col("l_linenumber"), F.when(F.col("l_linenumber") > 1, 7).otherwise(0))
    return d.select("l_orderkey", "l_linenumber", grouped.alias("grouped"), share.alias("share"), fm.metric(n, 4 * n).alias("metric"))


@query("epoch_times", "SELECT event_id, epoch_us(ts) // 1000 AS ms, strftime(make_timestamp(epoch_us(ts) // 1000 * 1000), '%Y-%m-%dT%H:%M:%S.%g+00:00') AS iso FROM events")
def epoch_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = reader(spark, sf_dir)("events").withColumn("ts", F.col("ts").cast("timestamp"))
    seconds = (F.unix_micros("ts") / F.lit(1_000_000).cast("decimal(20,0)")).cast("decimal(28,6)").cast("string")
    return e.select("event_id", fm.unix_ms(F.col("ts")).alias("ms"), fm.iso_utc(seconds).alias("iso"))


CHAT_SQL = """x AS (SELECT conv_id, turn, role, text, lead(text) OVER w AS answer, lead(role) OVER w AS next FROM conversations WHERE role <> 'system' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
ex AS (SELECT conv_id, turn, text AS u, answer AS a FROM x WHERE role = 'user' AND next = 'assistant'),
sy AS (SELECT conv_id, max(text) AS s FROM conversations WHERE role = 'system' GROUP BY conv_id),
h AS (SELECT b.conv_id, b.turn, coalesce(string_agg('[:user:]' || e.u || '[:eot:][:assistant:][:final:]' || e.a || '[:eot:]', '' ORDER BY e.turn), '') AS hist FROM ex b LEFT JOIN ex e ON e.conv_id = b.conv_id AND e.turn < b.turn GROUP BY ALL)"""


def _exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, user, assistant, history, system."""
    c = reader(spark, sf_dir)("conversations").select("conv_id", "turn", "role", "text")
    w = Window.partitionBy("conv_id").orderBy("turn")
    x = c.where("role <> 'system'").withColumns({"assistant": F.lead("text").over(w), "next": F.lead("role").over(w)})
    x = x.where("role = 'user' and next = 'assistant'").select("conv_id", "turn", F.col("text").alias("user"), "assistant")
    x = x.withColumn("history", F.collect_list(F.struct("user", "assistant")).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    system = c.where("role = 'system'").groupBy("conv_id").agg(F.max("text").alias("system"))
    return x.join(system, "conv_id", "left")


@query("chat_prompts", f"WITH {CHAT_SQL} SELECT ex.conv_id, ex.turn, coalesce('[:system:]' || s || '[:eot:]', '') || hist || '[:user:]' || u || '[:eot:][:assistant:][:task:]' AS prompt, '[:task:]talk[:format:]text[:scratchpad:]why[:final:]' || a || '[:eot:]' AS completion FROM ex JOIN h USING (conv_id, turn) LEFT JOIN sy ON ex.conv_id = sy.conv_id")
def chat_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _exchanges(spark, sf_dir)
    text = chat.prompt(chat.prompt_blocks(F.col("system"), F.col("history"), F.col("user"), start=chat.opening("task")))
    said = chat.completion(F.col("assistant"), task=F.lit("talk"), format=F.lit("text"), scratchpad=F.lit("why"))
    return x.select("conv_id", "turn", text.alias("prompt"), said.alias("completion"))


@query("chat_parsed", f"WITH {CHAT_SQL} SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '[:task:]talk' || trim(a, ' ' || chr(10)) ELSE trim(a, ' ' || chr(10)) END AS final, CASE WHEN turn % 3 = 0 THEN NULL ELSE 'talk' END AS task, CASE WHEN turn % 3 = 1 THEN 'why' END AS scratchpad FROM ex")
def chat_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that were rendered are parsed again; every third one lacks the
    token of the final answer, so that all of it is one."""
    x = _exchanges(spark, sf_dir).withColumn("assistant", F.regexp_replace("assistant", r"^[ \n]+|[ \n]+$", ""))
    why = F.when(F.col("turn") % 3 == 1, "why")
    whole = chat.completion(F.col("assistant"), task=F.lit("talk"), scratchpad=why)
    text = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("[:task:]talk"), "assistant", F.lit("[:eot:]rest"))).otherwise(whole)
    return x.select("conv_id", "turn", chat.parse_completion(text).alias("p")).select("conv_id", "turn", "p.final", "p.task", "p.scratchpad")


@query(
    "chat_fitted",
    f"""WITH {CHAT_SQL}, t AS (SELECT b.conv_id, b.turn, length(coalesce('[:system:]' || s || '[:eot:]', '')) + length('[:user:][:eot:][:assistant:][:final:]') AS frame, length(b.u) AS n FROM ex b LEFT JOIN sy ON b.conv_id = sy.conv_id),
 r AS (SELECT b.conv_id, b.turn, sum(length(e.u) + length(e.a) + length('[:user:][:eot:][:assistant:][:final:][:eot:]')) OVER (PARTITION BY b.conv_id, b.turn ORDER BY e.turn DESC) AS used FROM ex b JOIN ex e ON e.conv_id = b.conv_id AND e.turn < b.turn)
 SELECT t.conv_id, t.turn, 900 - frame - n < 0 AS cut, count(used) FILTER (WHERE used <= 900 - frame - n)::INT AS turns,
   (CASE WHEN 900 - frame - n < 0 THEN 900 + length('**TRUNCATED **') + 2 ELSE frame + n + coalesce(max(used) FILTER (WHERE used <= 900 - frame - n), 0) END)::INT AS n_chars
 FROM t LEFT JOIN r ON t.conv_id = r.conv_id AND t.turn = r.turn GROUP BY t.conv_id, t.turn, frame, n""",
)
def chat_fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _exchanges(spark, sf_dir).select("conv_id", "turn", chat.fit(F.col("system"), F.col("history"), F.col("user"), 900).alias("f"))
    return x.select("conv_id", "turn", "f.cut", "f.turns", F.length("f.text").alias("n_chars"))
