"""The pipeline: stage by stage against what each decides, on small data."""

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
            assert 0 < docs.count() <= n
            n = docs.count()
    assert docs.where("n_words > 0").select("doc_id").distinct().count() == n


def test_stages_take_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0, name


def test_no_learned_language(spark):
    """Unreadable bytes go, clean held-out texts stay."""
    import random

    from pyspark.sql import functions as F

    rng = random.Random(0)
    noise = [(10**9 + i, "".join(chr(rng.randrange(33, 0x2000)) for _ in range(600)) + "a") for i in range(20)]
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang")
    bad = spark.createDataFrame(noise, "doc_id bigint, text string").withColumn("lang", F.lit(None).cast("string"))
    out = corpus_pipeline.language_id(spark, docs.unionByName(bad), SF)
    assert out.where("doc_id >= 1000000000").count() == 0
    assert out.where("doc_id < 1000000000").count() >= 0.995 * docs.count()


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_jaccard", "decontamination", "best_fit_packing"]


def test_line_dedup_pairs_few_near_copies(spark, monkeypatch):
    """The pairs that the stage joins do not grow with the square of a group."""
    from lodestone.llm import linededup

    made, settle = {}, linededup.settle

    def counted(df, name="t"):
        out = settle(df, name)
        made[name] = out.count()
        return out

    monkeypatch.setattr(linededup, "settle", counted)
    common = " ".join(f"w{k}" for k in range(20))
    docs = spark.createDataFrame([(i, f"{common} only{i}", "en", "s", 1) for i in range(150)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    rows = corpus_pipeline.line_dedup(spark, docs, "").collect()
    assert [(r["doc_id"], r["n_chars"]) for r in rows] == [(0, len(f"{common} only0"))]
    assert made["pairs"] < 750
