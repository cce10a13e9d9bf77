"""Every query of the subpackage: against its SQL, or that it runs whole."""

import pytest
from helpers import same_rows

from lodestone.llm import queries as llm

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = llm.queries(), llm.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    same_rows(QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLES[name]).df())


CONTRACT = {
    "op1_html_extraction": ("page_id", "url", "text", "n_chars"),
    "op2_quality_gam": ("doc_id", "held_out", "score", "predicted"),
    "op4_quality_rules": ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"),
    "op9_language_id": ("doc_id", "held_out", "lang_pred", "score"),
    "op10_toxicity": ("doc_id", "held_out", "score", "predicted"),
}


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_contract(spark, name):
    table = "pages" if name.startswith("op1_") else "documents"
    out = QUERIES[name](spark, SF)
    assert set(CONTRACT[name]) <= set(out.columns)
    assert out.count() == spark.read.parquet(f"{SF}/{table}.parquet").count()
    if "score" in out.columns:
        assert out.where("score < 0 or score > 1 or score is null or isnan(score)").count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    lang = QUERIES["op9_language_id"](spark, sf).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (lang["lang"] == lang["lang_pred"]).mean() > 0.97
    quality = QUERIES["op2_quality_gam"](spark, sf).where("held_out").join(labels, "doc_id").toPandas()
    assert (quality["quality"] == quality["predicted"]).mean() > 0.95
    toxic = QUERIES["op10_toxicity"](spark, sf).where("held_out").join(labels, "doc_id").toPandas()
    assert (toxic["toxic"] == toxic["predicted"]).mean() > 0.9


def test_subpackage_stands_alone():
    """Nothing else in the library imports it."""
    import pathlib
    import re

    root = pathlib.Path(llm.__file__).parent.parent
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"import.*\bllm\b|from.*\bllm\b", p.read_text()), p
