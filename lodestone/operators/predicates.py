"""Filters with the semantics of record-oriented ingest."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = ("gt", "gte", "lt", "lte")
KINDS = ("equals", "in", *NUMERIC, "exists")


def field_type(schema: T.StructType, path: str) -> T.DataType | None:
    """The type at a dotted path, None if the path does not exist."""
    kind: T.DataType = schema
    for name in path.split("."):
        if not isinstance(kind, T.StructType) or name not in kind.names:
            return None
        kind = kind[name].dataType
    return kind


def predicate(schema: T.StructType, path: str, **test: Any) -> Column:
    """Exactly one of KINDS on a dotted path; never null.

    A numeric test is false for what is not a number, and a boolean is none.
    ``exists=True`` holds for a null too, as long as the field is there.
    """
    if len(test) != 1 or next(iter(test)) not in KINDS:
        raise ValueError(f"exactly one of {', '.join(KINDS)} is needed")
    (kind, value), found = next(iter(test.items())), field_type(schema, path)
    if kind == "exists":
        if not isinstance(value, bool):
            raise ValueError("exists takes true or false")
        return F.lit((found is not None) == value)
    if found is None:
        return F.lit(False)
    c = F.col(path)
    if kind == "equals":
        return F.coalesce(c == F.lit(value), F.lit(False)) if value is not None else c.isNull()
    if kind == "in":
        if isinstance(value, str) or not isinstance(value, Sequence):
            raise ValueError("in takes a list")
        return F.coalesce(c.isin(list(value)), F.lit(False))
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise ValueError(f"{kind} takes a number")
    if not isinstance(found, T.NumericType):
        return F.lit(False)
    op = {"gt": c > value, "gte": c >= value, "lt": c < value, "lte": c <= value}[kind]
    return F.coalesce(op, F.lit(False))


def filter_records(df: DataFrame, path: str, **test: Any) -> DataFrame:
    return df.where(predicate(df.schema, path, **test))


def filter_languages(df: DataFrame, languages: Sequence[str], column: str = "lang") -> DataFrame:
    """Rows in one of the languages, whatever the case; others go."""
    if not isinstance(df.schema[column].dataType, T.StringType):
        return df.where(F.lit(False))
    return df.where(F.lower(column).isin([x.lower() for x in languages]))


def exclude_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*columns)


def join_text(columns: Sequence[str], joiner: str = "\n\n") -> Column:
    """The non-empty texts of some columns, joined."""
    return F.concat_ws(joiner, *[F.when(F.col(c) != "", F.col(c)) for c in columns])
