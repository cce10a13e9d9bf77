"""Portable hashes: equal on any engine that has md5 and sha256."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def h60(*parts: Column | str) -> Column:
    """The first 60 bits of the md5 of the parts, joined by ``|``."""
    x = F.concat_ws("|", *[F.col(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(x), 1, 15), 16, 10).cast("bigint")


def unit_hash(x: Column) -> Column:
    """sha256 of a string as a number in [0, 1)."""
    return F.conv(F.substring(F.sha2(x, 256), 1, 15), 16, 10).cast("double") / F.lit(float(1 << 60))


def bound(value: Column, f) -> Column:
    """``f(value)`` with the value computed once, although ``f`` uses it in
    the function of a higher-order function."""
    return F.get(F.transform(F.array(value), f), F.lit(0))
