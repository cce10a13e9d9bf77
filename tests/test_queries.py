"""Every registered query of the engine against its SQL, at the least size."""

import pytest
from helpers import SF, same_rows

from lodestone.plans import registry

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    same_rows(QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.count() >= 0 and len(df.columns) == len(set(df.columns))


def test_entry_has_all(spark):
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("partitions", ["1", "17"])
def test_partition_independence(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    want = sorted(QUERIES["snapshot_members"](spark, SF).collect())
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert sorted(QUERIES["snapshot_members"](spark, SF).collect()) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
