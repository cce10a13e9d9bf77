"""Queries of budgeted snapshots and their reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import index, snapshot, stats
from .catalog import query, reader

TOTALS = {"train": 400_000, "eval": 60_000, "test": 30_000}
SOURCES = [snapshot.SourceQuota(f"src{i}", 1.0 + i % 3, 1 if i % 4 else 400, 20_000, 1 + (i % 5 == 0)) for i in range(20)]
SPEC = snapshot.SnapshotSpec("mix", SOURCES, TOTALS, seed=7)
OLDER = snapshot.SnapshotSpec("older", SOURCES[:10], {"train": 100_000}, seed=3)
NEWER = snapshot.SnapshotSpec("newer", SOURCES, TOTALS, seed=11, excluded_languages=("de",), excluded_snapshots=("older",))


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = reader(spark, sf_dir)("documents")
    return docs, index.records(docs), index.files(docs)


def _members(spark: SparkSession, sf_dir: str, spec: snapshot.SnapshotSpec, older: DataFrame | None = None) -> DataFrame:
    _, records, files = _tables(spark, sf_dir)
    return snapshot.select_members(snapshot.eligible(records, files, spec, older), snapshot.quotas(spark, spec), spec)


def _h60(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 15))::BIGINT"


RECORD_SQL = "record AS (SELECT source || '_' || doc_id AS rec_id, source || '_' || (doc_id % 4) AS fle_id, lang AS rec_lan, n_chars AS rec_len, substr(text, 1, 100) AS rec_sni FROM documents), file AS (SELECT DISTINCT source || '_' || (doc_id % 4) AS fle_id, source AS src_id FROM documents)"


def _quota_sql(spec: snapshot.SnapshotSpec, name: str = "quota") -> str:
    whole = sum(s.weight for s in spec.sources)
    rows = ", ".join(f"('{s.src_id}', {s.weight}::DOUBLE, {s.min_len}, {s.max_len}, {s.oversampling})" for s in spec.sources)
    budgets = ", ".join(f"trunc(trunc({t} * weight / {whole}) / oversampling)::BIGINT AS bud_{k}" for k, t in spec.totals.items())
    return f"{name} AS (SELECT *, {budgets} FROM (SELECT *, unnest(range(oversampling))::INT AS oversampling_index FROM (VALUES {rows}) AS v(src_id, weight, min_len, max_len, oversampling)))"


def _member_sql(spec: snapshot.SnapshotSpec, pool: str, out: str = "member", quota: str = "quota") -> str:
    bound, cases = "0", ""
    for k in spec.totals:
        bound += f" + bud_{k}"
        cases += f" WHEN cum <= {bound} THEN '{k}'"
    key, h = _h60("rec_id", "'sample'", f"'{spec.seed}'"), _h60("rec_id", "oversampling_index::VARCHAR", "'shuffle'", f"'{spec.seed}'")
    return f"""{out} AS (
  SELECT '{spec.snp_id}' AS snp_id, split, rec_id, oversampling_index AS oversampling, {h} AS h, src_id, rec_len
  FROM (SELECT *, CASE{cases} END AS split FROM (
    SELECT p.*, q.* EXCLUDE (src_id), sum(rec_len) OVER (PARTITION BY p.src_id, oversampling_index ORDER BY {key}) AS cum
    FROM {pool} p JOIN {quota} q ON p.src_id = q.src_id AND rec_len BETWEEN min_len AND max_len))
  WHERE split IS NOT NULL)"""


POOL_SQL = "pool AS (SELECT r.*, f.src_id FROM record r JOIN file f USING (fle_id) WHERE rec_len > 0)"
SNAPSHOT_SQL = f"WITH {RECORD_SQL}, {_quota_sql(SPEC)}, {POOL_SQL}, {_member_sql(SPEC, 'pool')}"
GROUP_SQL = SNAPSHOT_SQL + ", g AS (SELECT split, src_id, rec_id, max(rec_len) AS rec_len, count(*) AS copies FROM member GROUP BY ALL)"
MEASURE_SQL = """coalesce(sum(copies), 0)::BIGINT AS examples, count(*) AS unique_examples, (coalesce(sum(copies), 0) - count(*))::BIGINT AS extra_examples,
  coalesce(sum(copies * rec_len), 0)::BIGINT AS chars, coalesce(sum((copies - 1) * rec_len), 0)::BIGINT AS extra_chars,
  round(coalesce(sum(copies * rec_len), 0)::DOUBLE / 4.0)::BIGINT AS estimated_tokens,
  coalesce(sum(copies * rec_len), 0)::DOUBLE / nullif(coalesce(sum(copies), 0), 0)::DOUBLE AS avg_chars"""


@query("index_records", f"WITH {RECORD_SQL} SELECT record.*, src_id FROM record JOIN file USING (fle_id)")
def index_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, records, files = _tables(spark, sf_dir)
    return records.join(F.broadcast(files), "fle_id")


@query("snapshot_quotas", f"WITH {_quota_sql(SPEC)} SELECT src_id, oversampling_index, oversampling::INT AS oversampling, min_len::BIGINT AS min_len, max_len::BIGINT AS max_len, bud_train, bud_eval, bud_test FROM quota")
def snapshot_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.quotas(spark, SPEC)


@query("snapshot_members", SNAPSHOT_SQL + " SELECT * FROM member")
def snapshot_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _members(spark, sf_dir, SPEC)


@query(
    "snapshot_with_exclusions",
    f"""WITH {RECORD_SQL}, {_quota_sql(OLDER, 'oldq')}, {_quota_sql(NEWER)},
 oldpool AS (SELECT r.*, f.src_id FROM record r JOIN file f USING (fle_id) WHERE rec_len > 0), {_member_sql(OLDER, 'oldpool', 'old', 'oldq')},
 pool AS (SELECT r.*, f.src_id FROM record r JOIN file f USING (fle_id) WHERE rec_len > 0 AND rec_lan NOT IN ('de') AND rec_id NOT IN (SELECT rec_id FROM old)),
 {_member_sql(NEWER, 'pool')} SELECT * FROM member""",
)
def snapshot_with_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _members(spark, sf_dir, NEWER, _members(spark, sf_dir, OLDER))


@query(
    "snapshot_feasibility",
    f"""WITH {RECORD_SQL}, {_quota_sql(SPEC)}, {POOL_SQL},
 got AS (SELECT p.src_id, sum(rec_len) * max(oversampling) AS chars FROM pool p JOIN quota q ON p.src_id = q.src_id AND rec_len BETWEEN min_len AND max_len AND oversampling_index = 0 GROUP BY ALL),
 asked AS (SELECT src_id, sum(bud_train + bud_eval + bud_test) AS requested FROM quota GROUP BY ALL)
 SELECT asked.src_id, requested::BIGINT AS requested_chars, coalesce(chars, -1)::BIGINT AS available_chars, requested <= coalesce(chars, -1) AS feasible FROM asked LEFT JOIN got ON asked.src_id = got.src_id""",
)
def snapshot_feasibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, records, files = _tables(spark, sf_dir)
    return snapshot.availability(snapshot.eligible(records, files, SPEC), snapshot.quotas(spark, SPEC), SPEC)


@query("snapshot_overview", GROUP_SQL + f" SELECT 'ALL' AS scope, {MEASURE_SQL}, coalesce(sum(rec_len), 0)::BIGINT AS unique_chars, count(DISTINCT src_id) AS source_count FROM g UNION ALL SELECT split, {MEASURE_SQL}, coalesce(sum(rec_len), 0)::BIGINT, count(DISTINCT src_id) FROM g GROUP BY split")
def snapshot_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.overview(stats.member_groups(_members(spark, sf_dir, SPEC)))


@query("snapshot_per_source_top", GROUP_SQL + f" SELECT src_id, {MEASURE_SQL} FROM g GROUP BY src_id ORDER BY chars DESC, examples DESC, src_id LIMIT 10")
def snapshot_per_source_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.per_source(stats.member_groups(_members(spark, sf_dir, SPEC)), top=10)


@query("snapshot_report", GROUP_SQL + f", a AS (SELECT split, src_id, {MEASURE_SQL} FROM g GROUP BY split, src_id) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY chars DESC, examples DESC, src_id)::INT AS rank FROM a) WHERE rank <= 5")
def snapshot_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.per_split_source(stats.member_groups(_members(spark, sf_dir, SPEC)), top=5)


@query("snapshot_fill", GROUP_SQL + " SELECT split, sum(copies * rec_len)::BIGINT AS chars, CASE split WHEN 'train' THEN 400000 WHEN 'eval' THEN 60000 ELSE 30000 END::BIGINT AS target_chars, round(sum(copies * rec_len)::DOUBLE / CASE split WHEN 'train' THEN 400000 WHEN 'eval' THEN 60000 ELSE 30000 END, 9) AS fill FROM g GROUP BY split")
def snapshot_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = stats.member_groups(_members(spark, sf_dir, SPEC))
    target = F.broadcast(spark.createDataFrame([(k, v) for k, v in TOTALS.items()], "split string, target_chars bigint"))
    out = g.groupBy("split").agg(F.sum(F.col("copies") * F.col("rec_len")).alias("chars")).join(target, "split")
    return out.withColumn("fill", F.round(F.col("chars").cast("double") / F.col("target_chars"), 9))


@query("snapshot_split_invariant", "SELECT 0::BIGINT AS records_in_two_splits")
def snapshot_split_invariant(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = _members(spark, sf_dir, SPEC).groupBy("rec_id").agg(F.countDistinct("split").alias("n"))
    return per.agg(F.count_if(F.col("n") > 1).alias("records_in_two_splits"))


@query("materialized_copies", SNAPSHOT_SQL + " SELECT split, m.rec_id, oversampling, h, m.rec_id || '.' || oversampling AS copy_id, md5(text) AS text_md5 FROM member m JOIN (SELECT source || '_' || doc_id AS rec_id, text FROM documents) d USING (rec_id)")
def materialized_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, *_ = _tables(spark, sf_dir)
    raw = docs.select(F.concat_ws("_", "source", "doc_id").alias("rec_id"), F.md5("text").alias("text_md5"))
    return snapshot.materialize(_members(spark, sf_dir, SPEC), raw)


@query("missing_members", SNAPSHOT_SQL + ", gone AS (SELECT DISTINCT src_id, rec_id FROM member WHERE rec_id NOT IN (SELECT source || '_' || doc_id FROM documents WHERE lang = 'en')), r AS (SELECT *, row_number() OVER (PARTITION BY src_id ORDER BY rec_id) AS rn FROM gone) SELECT src_id, count(*) AS missing, string_agg(CASE WHEN rn <= 3 THEN rec_id END, ',' ORDER BY rec_id) AS examples FROM r GROUP BY src_id")
def missing_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, *_ = _tables(spark, sf_dir)
    raw = docs.where("lang = 'en'").select(F.concat_ws("_", "source", "doc_id").alias("rec_id"))
    return snapshot.missing_records(_members(spark, sf_dir, SPEC), raw)


@query("snapshot_star_join", SNAPSHOT_SQL + " SELECT m.split, upper(f.src_id) AS src_label, count(*) AS n, sum(r.rec_len)::BIGINT AS chars FROM member m JOIN record r USING (rec_id) JOIN file f USING (fle_id) GROUP BY ALL")
def snapshot_star_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, records, files = _tables(spark, sf_dir)
    m = _members(spark, sf_dir, SPEC).select("split", "rec_id")
    star = m.join(records, "rec_id").join(F.broadcast(files), "fle_id").join(F.broadcast(index.sources(docs)), "src_id")
    return star.groupBy("split", "src_label").agg(F.count("*").alias("n"), F.sum("rec_len").alias("chars"))


@query("budget_lineitem_suppliers", "SELECT l_suppkey, count(*) AS n, sum(l_quantity)::DOUBLE AS taken FROM (SELECT *, sum(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 10 + l_linenumber) AS cum FROM lineitem) WHERE cum <= 500 GROUP BY l_suppkey")
def budget_lineitem_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The running budget at a larger row count: lines of each supplier in
    order while their quantities sum to 500 at most."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_suppkey").orderBy(F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    li = reader(spark, sf_dir)("lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity")
    li = li.withColumn("cum", F.sum("l_quantity").over(w)).where("cum <= 500")
    return li.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("taken"))


@query("top_orders_per_customer", "SELECT o_custkey, o_orderkey, o_totalprice, rn FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INT AS rn FROM orders) WHERE rn <= 3")
def top_orders_per_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    o = reader(spark, sf_dir)("orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return o.withColumn("rn", F.row_number().over(w)).where("rn <= 3")
