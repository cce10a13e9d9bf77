"""Value counts of chosen fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def value_histogram(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """field, value, n. Lists count by item, texts lower-cased; nulls skipped.

    All fields are counted in one pass over the rows.
    """

    def named(name: str, text: bool):
        return lambda x: F.struct(F.lit(name).alias("field"), (F.lower(x) if text else x.cast("string")).alias("value"))

    parts = []
    for name in fields:
        kind, c = df.schema[name].dataType, F.col(name)
        item = kind.elementType if isinstance(kind, T.ArrayType) else kind
        items = F.array(c) if item is kind else c
        parts.append(F.transform(F.coalesce(items, F.array().cast(T.ArrayType(item))), named(name, isinstance(item, T.StringType))))
    pairs = df.select(F.explode(F.concat(*parts)).alias("p")).where("p.value is not null")
    return pairs.groupBy("p.field", "p.value").agg(F.count("*").alias("n"))
