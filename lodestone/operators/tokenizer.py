"""Tokenizers of public vocabularies, and audits of vocabularies.

Tokenizers are read, never trained here.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def token_ids(c: Column, definition: str) -> Column:
    """Token ids by a tokenizer's JSON definition, given as its text."""

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(definition)
        for s in batches:
            yield pd.Series([e.ids for e in t.encode_batch([x or "" for x in s])], index=s.index)

    return encode(c)


def token_count(c: Column, definition: str) -> Column:
    return F.size(token_ids(c, definition))


def decoded(c: Column, definition: str) -> Column:
    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(definition)
        for s in batches:
            yield s.map(lambda ids: t.decode([int(i) for i in ids]))

    return decode(c)


def vocabulary(spark, definition: str) -> DataFrame:
    """token, id, special: a vocabulary is bounded by its definition."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(definition)
    special = {v.content for v in t.get_added_tokens_decoder().values() if v.special}
    return spark.createDataFrame(pd.DataFrame([(k, i, k in special) for k, i in t.get_vocab().items()], columns=["token", "id", "special"]))


def audit(vocab: DataFrame, token: str = "token") -> DataFrame:
    """Predicates on the tokens of a vocabulary."""
    c = F.col(token)
    return vocab.withColumns({
        "digits": c.rlike(r"\A[0-9]+\z"),
        "url": c.rlike(r"\Ahttps?://"),
        "email": c.rlike(r"\A[^@\s]+@[^@\s]+\.[^@\s]+\z"),
        "hex": c.rlike(r"\A(0x)?[0-9a-fA-F]{8,}\z"),
        "very_long": F.length(c) > 24,
    })


def flags(vocab: DataFrame, token: str = "token") -> DataFrame:
    """All predicates of the reference's audit, on the token as it is or, for
    those on what it looks like, stripped and lower-cased."""
    c = F.col(token)
    space = r"[\s\x1C-\x1F]"
    low = F.lower(F.regexp_replace(c, rf"(?U)\A{space}+|{space}+\z", ""))
    operator, alnum = c.rlike(r"[-+*/=%<>!&|^~]"), c.rlike(r"[\p{L}\p{N}]")
    digit = c.rlike("[0-9]")
    parts = "http https http:// https:// www www. :// // .com .org .net .io .fr .co .ai .gov .edu".split()
    return vocab.withColumns({
        "single_digit": c.rlike(r"\A[0-9]\z"),
        "pure_digits": c.rlike(r"\A[0-9]{2,}\z"),
        "digit_run": c.rlike("[0-9]{2,}"),
        "digit_and_other": digit & c.rlike("[^0-9]"),
        "operator": operator,
        "digit_and_operator": digit & operator,
        "operator_and_alnum": operator & alnum,
        "url": low.isin(parts) | low.rlike(r"://|www\.") | low.rlike(r"(?:\A|[^a-z0-9])(?:[a-z0-9-]+\.)+(?:com|org|net|io|fr|co|ai|gov|edu)(?:/|\n?\z)"),
        "email": low.rlike(r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}"),
        "path": c.rlike(r"[/\\]") & alnum,
        "hex": low.rlike(r"0x[0-9a-f]{2,}|[0-9a-f]{12,}|\A[0-9a-f]{8,}\z"),
        "inner_whitespace": c.rlike(rf"(?U)[^\s\x1C-\x1F]{space}+[^\s\x1C-\x1F]"),
        "very_long": (F.length(c) >= 24) | (F.octet_length(c) >= 32),
        "suspicious": c.rlike(r"[\p{Cc}\p{Cf}\u00A0\u034F\u2007\u202F]"),
    })


def digit_wise(vocab: DataFrame, token: str = "token") -> DataFrame:
    """Tokens that break the rule of one digit a token."""
    return vocab.where(F.col(token).rlike(r"[0-9].*[0-9]"))
