"""Queries of scans, filters, projections, samples and histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import h60
from ..operators import histograms, predicates, sampling
from .catalog import query, reader

H60 = "('0x' || substr(md5({0}), 1, 15))::BIGINT"


@query("filter_numeric", "SELECT doc_id, n_chars FROM documents WHERE n_chars >= 2000")
def filter_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicates.filter_records(reader(spark, sf_dir)("documents"), "n_chars", gte=2000).select("doc_id", "n_chars")


@query("filter_in_list", "SELECT doc_id, source FROM documents WHERE source IN ('src1', 'src3')")
def filter_in_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicates.filter_records(reader(spark, sf_dir)("documents"), "source", **{"in": ["src1", "src3"]}).select("doc_id", "source")


@query("filter_nested_path", "SELECT event_id FROM events WHERE json_extract(props, '$.k')::BIGINT > 50")
def filter_nested_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = reader(spark, sf_dir)("events").select("event_id", F.from_json("props", "k bigint").alias("props"))
    return predicates.filter_records(e, "props.k", gt=50).select("event_id")


@query("filter_wrong_type", "SELECT count(*) AS n FROM documents WHERE false")
def filter_wrong_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A numeric test on a text field holds for no row."""
    return predicates.filter_records(reader(spark, sf_dir)("documents"), "text", gt=1).agg(F.count("*").alias("n"))


@query("filter_languages", "SELECT doc_id, lang FROM documents WHERE lower(lang) IN ('en', 'fr')")
def filter_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicates.filter_languages(reader(spark, sf_dir)("documents"), ["EN", "Fr"]).select("doc_id", "lang")


@query("exclude_columns", "SELECT doc_id, lang, source FROM documents")
def exclude_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicates.exclude_columns(reader(spark, sf_dir)("documents"), ["text", "n_chars"])


@query("join_text_fields", "SELECT p_partkey, concat_ws(chr(10) || chr(10), nullif(p_name, ''), nullif(p_brand, ''), nullif(p_type, '')) AS text FROM part")
def join_text_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reader(spark, sf_dir)("part").select("p_partkey", predicates.join_text(["p_name", "p_brand", "p_type"]).alias("text"))


@query("all_string_fields", "SELECT p_partkey, field, text FROM (SELECT p_partkey, p_name, p_brand, p_type FROM part) UNPIVOT (text FOR field IN (p_name, p_brand, p_type))")
def all_string_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = reader(spark, sf_dir)("part").select("p_partkey", "p_name", "p_brand", "p_type")
    return p.unpivot("p_partkey", ["p_name", "p_brand", "p_type"], "field", "text").where("text is not null")


@query("value_histogram", "SELECT 'lang' AS field, lower(lang) AS value, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY ALL UNION ALL SELECT 'source', lower(source), count(*) FROM documents WHERE source IS NOT NULL GROUP BY ALL")
def value_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histograms.value_histogram(reader(spark, sf_dir)("documents"), ["lang", "source"])


@query("list_histogram", "SELECT 'words' AS field, lower(w) AS value, count(*) AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS w FROM part) GROUP BY ALL")
def list_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histograms.value_histogram(reader(spark, sf_dir)("part").select(F.split("p_type", " ").alias("words")), ["words"])


@query("events_histogram", "SELECT 'event_type' AS field, lower(event_type) AS value, count(*) AS n FROM events GROUP BY ALL")
def events_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histograms.value_histogram(reader(spark, sf_dir)("events"), ["event_type"])


@query("hash_rate_sample", "SELECT event_id FROM events WHERE ('0x' || substr(sha256(event_id::VARCHAR), 1, 15))::BIGINT::DOUBLE / 1152921504606846976.0::DOUBLE < 0.1")
def hash_rate_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = reader(spark, sf_dir)("events")
    return e.where(sampling.below_rate(F.col("event_id").cast("string"), 0.1)).select("event_id")


@query("bernoulli_sample", f"SELECT doc_id FROM documents WHERE {H60.format(chr(39).join(['doc_id || ', '|5', '']))}::DOUBLE / 1152921504606846976.0::DOUBLE < 0.2")
def bernoulli_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.bernoulli(reader(spark, sf_dir)("documents"), "doc_id", 0.2, 5).select("doc_id")


@query("reservoir_sample", "SELECT doc_id FROM documents ORDER BY ('0x' || substr(md5(doc_id || '|9'), 1, 15))::BIGINT, doc_id LIMIT 50")
def reservoir_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.reservoir(reader(spark, sf_dir)("documents").select("doc_id"), "doc_id", 50, 9)


@query("deterministic_shuffle", "SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY ('0x' || substr(md5(doc_id || '|1'), 1, 15))::BIGINT, doc_id)::INT AS place FROM documents")
def deterministic_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("source").orderBy(h60(F.col("doc_id"), F.lit(1)), "doc_id")
    return reader(spark, sf_dir)("documents").select("doc_id", F.row_number().over(w).alias("place"))


@query("union_by_name", "SELECT doc_id AS id, text, lang FROM documents UNION ALL BY NAME SELECT item_id AS id, text FROM benchmark")
def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = reader(spark, sf_dir)
    return t("documents").select(F.col("doc_id").alias("id"), "text", "lang").unionByName(t("benchmark").select(F.col("item_id").alias("id"), "text"), allowMissingColumns=True)


@query("keyed_last_wins", "SELECT conv_id, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn = 1")
def keyed_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reader(spark, sf_dir)("conversations").groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))


@query("distinct_values", "SELECT DISTINCT source, lang FROM documents")
def distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reader(spark, sf_dir)("documents").select("source", "lang").distinct()


@query("labels_left_join", "SELECT d.doc_id, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def labels_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = reader(spark, sf_dir)
    return t("documents").select("doc_id").join(t("labels"), "doc_id", "left")


@query("unlabelled_anti_join", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unlabelled_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = reader(spark, sf_dir)
    return t("documents").select("doc_id").join(t("labels").select("doc_id"), "doc_id", "left_anti")


@query("ids_in_order", "SELECT p.doc_id, ord, n_chars FROM (VALUES (5, 0), (3, 1), (11, 2), (7, 3)) AS p(doc_id, ord) JOIN documents d ON p.doc_id = d.doc_id")
def ids_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = F.broadcast(spark.createDataFrame([(5, 0), (3, 1), (11, 2), (7, 3)], "doc_id bigint, ord int"))
    return reader(spark, sf_dir)("documents").select("doc_id", "n_chars").join(wanted, "doc_id").select("doc_id", "ord", "n_chars")


@query("json_round_trip", "SELECT doc_id, lang, n_chars FROM documents")
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written as gzip JSON lines to the shared folder and read again."""
    import uuid

    from ..session import shared_dir
    from ..sources import jsonl

    path = f"{shared_dir(spark)}/jsonl-{uuid.uuid4().hex}"
    jsonl.write_shards(reader(spark, sf_dir)("documents").select("doc_id", "lang", "n_chars"), path, "doc_id", max_bytes=20_000)
    return jsonl.read_shards(spark, path, "doc_id bigint, lang string, n_chars bigint")
