"""Column expressions and joins shared by the operators without Python code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(word: Column) -> Column:
    """A-Z to a-z and nothing else; quick where all is ASCII."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def pieces(text: Column, separators: str) -> Column:
    """The non-empty pieces between runs of a character class; null: none."""
    return F.coalesce(F.array_remove(F.split(text, f"[{separators}]+"), ""), F.array().cast("array<string>"))


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi-join in which nulls match nulls; keys come from the left."""
    a, b = left.alias("a"), right.alias("b")
    on = reduce(lambda x, y: x & y, [F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`")) for k in keys])
    out = a.join(b, on, how)
    if how in ("left_semi", "left_anti"):
        return out
    return out.select("a.*", *[F.col(f"b.`{c}`") for c in right.columns if c not in keys])


def within(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than needed."""
    return df.limit(rows + 1).count() <= rows


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if it is proven to be small enough."""
    return F.broadcast(df) if within(df, rows) else df
