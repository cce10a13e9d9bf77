"""Queries of signatures, candidate pairs, clusters and verdicts.

The queries use 16 hashes in bands of 4 over the portable base hash, so that
SQL can state the same signature; those named ``_128`` use the operator's 128
hashes in 16 bands of 8 over XXH3, and have no SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import index, near_duplicates as nd
from ..session import settle
from .catalog import query, reader


HASHES, BAND = 16, 4

_M = 1 << 64
SIG_SQL = f"""gram AS (
  SELECT DISTINCT rec_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM (
    SELECT rec_id, w, unnest(range(1, len(w) - 3)) AS i FROM (SELECT rec_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS w FROM {{rows}}) WHERE len(w) >= 5)
), base AS (SELECT rec_id, ('0x' || substr(md5(g), 1, 15))::UHUGEINT AS b FROM gram),
salt AS (SELECT s, (s::UHUGEINT * {nd.GOLDEN}::UHUGEINT) % {_M}::UHUGEINT AS v FROM (SELECT unnest(range(1, {HASHES} + 1)) AS s)),
m0 AS (SELECT rec_id, s, xor(b, v) AS x FROM base, salt),
m1 AS (SELECT rec_id, s, (xor(x, x >> 30::UHUGEINT) * {nd.MIX_1}::UHUGEINT) % {_M}::UHUGEINT AS x FROM m0),
m2 AS (SELECT rec_id, s, (xor(x, x >> 27::UHUGEINT) * {nd.MIX_2}::UHUGEINT) % {_M}::UHUGEINT AS x FROM m1),
m3 AS (SELECT rec_id, s, min(xor(x, x >> 31::UHUGEINT)) AS x FROM m2 GROUP BY ALL),
sig AS (
  SELECT r.rec_id, list(coalesce(x, {_M - 1}::UHUGEINT) ORDER BY salt.s) AS v
  FROM (SELECT rec_id FROM {{rows}}) r CROSS JOIN salt LEFT JOIN m3 ON m3.rec_id = r.rec_id AND m3.s = salt.s GROUP BY r.rec_id
)"""
DOC_ROWS = "doc AS (SELECT source || '_' || doc_id AS rec_id, source AS src_id, n_chars AS rec_len, text FROM documents)"
ALL_ROWS = DOC_ROWS + ", ref AS (SELECT 'bench_' || item_id AS rec_id, text FROM benchmark), every AS (SELECT rec_id, text FROM doc UNION ALL SELECT rec_id, text FROM ref)"
BAND_SQL = f"band AS (SELECT rec_id, i AS bnd_id, list_slice(v, i * {BAND} + 1, i * {BAND} + {BAND}) AS b FROM (SELECT rec_id, v, unnest(range({HASHES // BAND})) AS i FROM sig))"
BUCKET_SQL = "bucket AS (SELECT bnd_id, b FROM band GROUP BY ALL HAVING count(*) BETWEEN 2 AND 500)"
PAIR_SQL = """pair AS (
  SELECT DISTINCT x.rec_id AS uid1, y.rec_id AS uid2, y.rec_id LIKE 'bench_%' AS has_reference
  FROM band x JOIN bucket USING (bnd_id, b) JOIN band y USING (bnd_id, b)
  WHERE x.rec_id NOT LIKE 'bench_%' AND (y.rec_id LIKE 'bench_%' OR y.rec_id > x.rec_id)
), edge AS (
  SELECT uid1, uid2, has_reference, len(list_filter(range(1, 17), lambda i: a.v[i] = b.v[i]))::DOUBLE / 16.0 AS similarity
  FROM pair JOIN sig a ON a.rec_id = uid1 JOIN sig b ON b.rec_id = uid2
  WHERE len(list_filter(range(1, 17), lambda i: a.v[i] = b.v[i])) >= 12
)"""
EDGE_SQL = f"{ALL_ROWS}, {SIG_SQL.replace('{rows}', 'every')}, {BAND_SQL}, {BUCKET_SQL}, {PAIR_SQL}"
COMP_SQL = EDGE_SQL + """, both_ways AS (SELECT uid1 AS u, uid2 AS v FROM edge UNION SELECT uid2, uid1 FROM edge),
reach(u, v) AS (SELECT u, u FROM both_ways UNION SELECT r.u, e.v FROM reach r JOIN both_ways e ON r.v = e.u),
comp AS (SELECT u AS id, min(v) AS component FROM reach GROUP BY u)"""
VERDICT_SQL = COMP_SQL + """, grp AS (
  SELECT component, bool_or(id LIKE 'bench_%') AS any_ref, min(id) FILTER (WHERE id NOT LIKE 'bench_%') AS winner FROM comp GROUP BY component
), rejected AS (
  SELECT id AS rec_id, CASE WHEN any_ref THEN 'reference' ELSE 'within_snapshot' END AS reason
  FROM comp JOIN grp USING (component) WHERE id NOT LIKE 'bench_%' AND (any_ref OR id <> winner)
)"""


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reader(spark, sf_dir)("documents").select(F.concat_ws("_", "source", "doc_id").alias("rec_id"), "text")


def _signed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    bench = reader(spark, sf_dir)("benchmark").select(F.concat(F.lit("bench_"), F.col("item_id").cast("string")).alias("rec_id"), "text")
    return tuple(settle(nd.signatures(x, "text", HASHES).drop("text"), "signatures") for x in (_docs(spark, sf_dir), bench))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = _signed(spark, sf_dir)
    pairs = nd.candidate_pairs(nd.bands(docs, BAND), nd.bands(bench, BAND))
    return settle(nd.edges(pairs, docs, bench), "duplicate-edges")


def _edges_128(spark: SparkSession, sf_dir: str) -> DataFrame:
    bench = reader(spark, sf_dir)("benchmark").select(F.concat(F.lit("bench_"), F.col("item_id").cast("string")).alias("rec_id"), "text")
    docs, bench = (settle(nd.signatures(x, "text", base="xxh3").drop("text"), "signatures") for x in (_docs(spark, sf_dir), bench))
    return settle(nd.edges(nd.candidate_pairs(nd.bands(docs), nd.bands(bench)), docs, bench), "duplicate-edges")


@query("minhash_signatures", f"WITH {DOC_ROWS}, {SIG_SQL.replace('{rows}', 'doc')} SELECT rec_id, list_transform(v, lambda x: (CASE WHEN x >= 9223372036854775808::UHUGEINT THEN x::HUGEINT - {_M}::HUGEINT ELSE x::HUGEINT END)::BIGINT) AS sig_vector FROM sig")
def minhash_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nd.signatures(_docs(spark, sf_dir), "text", HASHES).drop("text")


@query("minhash_xxh3")
def minhash_xxh3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full 128-hash signature over XXH3; compared bit by bit in tests."""
    return nd.signatures(_docs(spark, sf_dir), "text", base="xxh3").drop("text")


@query("lsh_bucket_sizes", f"WITH {DOC_ROWS}, {SIG_SQL.replace('{rows}', 'doc')}, {BAND_SQL} SELECT bnd_id::INT AS bnd_id, n, count(*) AS buckets FROM (SELECT bnd_id, b, count(*) AS n FROM band GROUP BY ALL HAVING count(*) BETWEEN 2 AND 500) GROUP BY ALL")
def lsh_bucket_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = nd.signatures(_docs(spark, sf_dir), "text", HASHES).drop("text")
    n = nd.bands(docs, BAND).groupBy("bnd_id", "bnd_hash").agg(F.count("*").alias("n")).where("n between 2 and 500")
    return n.groupBy("bnd_id", "n").agg(F.count("*").alias("buckets"))


@query("duplicate_edges", f"WITH {EDGE_SQL} SELECT * FROM edge")
def duplicate_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir)


@query("duplicate_clusters", f"WITH RECURSIVE {COMP_SQL} SELECT * FROM comp")
def duplicate_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nd.components(_edges(spark, sf_dir))


@query("dedup_verdicts", f"WITH RECURSIVE {VERDICT_SQL} SELECT * FROM rejected")
def dedup_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _edges(spark, sf_dir)
    return nd.verdicts(nd.components(e), e)


@query(
    "dedup_stats",
    f"""WITH RECURSIVE {VERDICT_SQL}, c AS (SELECT doc.*, reason FROM doc LEFT JOIN rejected USING (rec_id)),
 s AS (SELECT src_id, count(*) AS candidate_records, coalesce(sum(rec_len), 0)::BIGINT AS candidate_chars, count(reason) AS rejected_records, coalesce(sum(rec_len) FILTER (WHERE reason IS NOT NULL), 0)::BIGINT AS rejected_chars,
   count(*) FILTER (WHERE reason = 'reference') AS by_reference, count(*) FILTER (WHERE reason = 'within_snapshot') AS within_snapshot FROM c GROUP BY src_id)
 SELECT 'source' AS level, * FROM s UNION ALL
 SELECT 'total', '', sum(candidate_records)::BIGINT, sum(candidate_chars)::BIGINT, sum(rejected_records)::BIGINT, sum(rejected_chars)::BIGINT, sum(by_reference)::BIGINT, sum(within_snapshot)::BIGINT FROM s""",
)
def dedup_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = reader(spark, sf_dir)("documents")
    records = index.records(docs).join(F.broadcast(index.files(docs)), "fle_id").select("rec_id", "src_id", "rec_len")
    e = _edges(spark, sf_dir)
    return nd.dedup_stats(records, nd.verdicts(nd.components(e), e))


@query("records_after_dedup", f"WITH RECURSIVE {VERDICT_SQL} SELECT src_id, count(*) AS kept, sum(rec_len)::BIGINT AS kept_chars FROM doc WHERE rec_id NOT IN (SELECT rec_id FROM rejected) GROUP BY src_id")
def records_after_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = reader(spark, sf_dir)("documents").select(F.concat_ws("_", "source", "doc_id").alias("rec_id"), F.col("source").alias("src_id"), "n_chars")
    e = _edges(spark, sf_dir)
    kept = docs.join(nd.verdicts(nd.components(e), e), "rec_id", "left_anti")
    return kept.groupBy("src_id").agg(F.count("*").alias("kept"), F.sum("n_chars").alias("kept_chars"))


@query("duplicate_edges_128")
def duplicate_edges_128(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges_128(spark, sf_dir)


@query("duplicate_clusters_128")
def duplicate_clusters_128(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nd.components(_edges_128(spark, sf_dir))


@query("dedup_verdicts_128")
def dedup_verdicts_128(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _edges_128(spark, sf_dir)
    return nd.verdicts(nd.components(e), e)
