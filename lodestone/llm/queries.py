"""The queries of this package: whole tables in, digest columns out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread, table
from . import chat, decontam, extract, jaccard, langid, linededup, packing, quality_gam, repetition, toxicity


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select(*columns))


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages"))


def op2_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    out = quality_gam.score_quality(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return out.select("doc_id", "held_out", "score", "predicted")


def op3_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(documents(spark, sf_dir, "doc_id", "text", "source"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repetition.rate(documents(spark, sf_dir, "doc_id", "text"))
    return out.select("doc_id", *repetition.COUNTS, *repetition.EXTRA, "base_failed", "kept")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    out = decontam.contamination(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return out.drop("text_hash")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(documents(spark, sf_dir, "doc_id", "text"), counts=True)
    return out.select("doc_id", "n_lines", "n_removed", F.md5("text").alias("text_md5"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard.near_duplicates(documents(spark, sf_dir, "doc_id", "text"))
    return out.withColumnRenamed("id", "doc_id")


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chat(table(spark, sf_dir, "conversations"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = langid.identify(documents(spark, sf_dir, "doc_id", "text", "lang"))
    return out.select("doc_id", "held_out", "lang_pred", "score")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    out = toxicity.score_toxicity(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return out.select("doc_id", "held_out", "score", "predicted")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_extraction": op1_html_extraction,
        "op2_quality_gam": op2_quality_gam,
        "op3_best_fit": op3_best_fit,
        "op4_quality_rules": op4_quality_rules,
        "op5_decontamination": op5_decontamination,
        "op6_line_dedup": op6_line_dedup,
        "op7_ngram_jaccard": op7_ngram_jaccard,
        "op8_chat_formatting": op8_chat_formatting,
        "op9_language_id": op9_language_id,
        "op10_toxicity": op10_toxicity,
    }


OP5_SQL = r"""
WITH item AS (
  SELECT DISTINCT item_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, list_slice(w, s + 1, s + least(len(w), 10)) AS g
  FROM (SELECT item_id, w, unnest(range(greatest(len(w) - 10, 0) + 1)) AS s FROM item WHERE len(w) > 0)
), doc AS (
  SELECT DISTINCT doc_id, text, coalesce(list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> ''), []) AS w
  FROM documents
), gram AS (
  SELECT doc_id, text, n, s, list_slice(w, s + 1, s + n) AS g
  FROM (SELECT doc_id, text, w, n, unnest(range(len(w) - n + 1)) AS s FROM doc, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)
), occ AS (
  SELECT DISTINCT doc_id, text, item_id, s, gram.n FROM gram JOIN win USING (n, g)
), hit AS (
  SELECT doc_id, text, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, text, unnest(range(s, s + n)) AS p FROM occ) GROUP BY ALL
), ids AS (
  SELECT doc_id, text, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS s FROM (SELECT DISTINCT doc_id, text, item_id::VARCHAR AS i FROM occ) GROUP BY ALL
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (doc_id, text) LEFT JOIN ids USING (doc_id, text)
"""


OP6_SQL = r"""
WITH line AS (
  SELECT doc_id, i - 1 AS no, l[i] AS line, list_filter(string_split_regex(l[i], '[ \x09-\x0D]+'), lambda x: x <> '') AS w
  FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))
), sets AS (
  SELECT doc_id, no, list_sort(list_distinct(w)) AS s FROM line WHERE len(w) > 0
), cls AS (
  SELECT s, min((doc_id, no)) AS f, row_number() OVER () AS c FROM sets GROUP BY s
), tok AS (SELECT c, f, len(s) AS n, unnest(s) AS t FROM cls),
pair AS (
  SELECT b.c FROM tok a JOIN tok b ON a.t = b.t AND a.f < b.f AND 3 * greatest(a.n, b.n) <= 4 * least(a.n, b.n)
  GROUP BY a.c, b.c, a.n, b.n HAVING 7 * count(*) >= 3 * (a.n + b.n)
), gone AS (SELECT DISTINCT c FROM pair),
bad AS (
  SELECT doc_id, no FROM sets JOIN cls USING (s) LEFT JOIN gone USING (c) WHERE gone.c IS NOT NULL OR (doc_id, no) <> f
), per AS (
  SELECT line.doc_id, count(*) AS n_lines, count(bad.no) AS n_removed,
    coalesce(string_agg(line, chr(10) ORDER BY line.no) FILTER (WHERE bad.no IS NULL), '') AS kept
  FROM line LEFT JOIN bad ON line.doc_id = bad.doc_id AND line.no = bad.no GROUP BY line.doc_id
)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, md5(kept) AS text_md5
FROM documents LEFT JOIN per USING (doc_id)
"""


OP7_SQL = r"""
WITH RECURSIVE doc AS (
  SELECT doc_id, coalesce(list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \x09-\x0D]+'), lambda x: x <> ''), []) AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM doc
), cls AS (SELECT s, min(doc_id) AS c FROM sets WHERE len(s) > 0 GROUP BY s),
tok AS (SELECT c, len(s) AS n, unnest(s) AS t FROM cls),
edge AS (
  SELECT a.c AS x, b.c AS y FROM tok a JOIN tok b ON a.t = b.t AND a.c <> b.c
  GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach(x, y) AS (
  SELECT c, c FROM cls UNION SELECT r.x, e.y FROM reach r JOIN edge e ON r.y = e.x
), comp AS (SELECT x AS c, min(y) AS k FROM reach GROUP BY x)
SELECT doc_id, len(sets.s)::BIGINT AS n_shingles, coalesce(k, doc_id) AS component_id
FROM sets LEFT JOIN cls ON sets.s = cls.s LEFT JOIN comp USING (c)
"""


OP8_SQL = r"""
WITH ask AS (SELECT *, conv_id || '-' || turn AS call_id FROM conversations WHERE role = 'user'),
reply AS (SELECT *, conv_id || '-' || (turn - 1) AS call_id FROM conversations WHERE role = 'assistant')
SELECT a.conv_id, a.turn, 0 AS place, a.role, 'call' AS kind, a.call_id, r.call_id IS NOT NULL AS linked, 0 AS level, true AS valid, '' AS problems,
  '{"arguments":{"prompt":' || to_json(a.text)::VARCHAR || '},"id":' || to_json(a.call_id)::VARCHAR || ',"name":"respond","result":' || coalesce(to_json(r.text)::VARCHAR, 'null') || ',"role":"user"}' AS json
FROM ask a LEFT JOIN reply r ON a.conv_id = r.conv_id AND a.call_id = r.call_id
UNION ALL
SELECT r.conv_id, r.turn, 0, r.role, 'result', r.call_id, a.call_id IS NOT NULL, NULL, NULL, NULL,
  '{"content":' || to_json(r.text)::VARCHAR || ',"id":' || to_json(r.call_id)::VARCHAR || ',"role":"assistant"}'
FROM reply r LEFT JOIN ask a ON a.conv_id = r.conv_id AND a.call_id = r.call_id
UNION ALL
SELECT conv_id, turn, 0, role, 'message', NULL, false, NULL, NULL, NULL, '{"content":' || to_json(text)::VARCHAR || ',"role":' || to_json(role)::VARCHAR || '}'
FROM conversations WHERE role NOT IN ('user', 'assistant')
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_decontamination": OP5_SQL, "op6_line_dedup": OP6_SQL, "op7_ngram_jaccard": OP7_SQL, "op8_chat_formatting": OP8_SQL}
