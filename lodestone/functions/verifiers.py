"""Scores in [0, 1] of completions against what was expected."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

NUMBER = r"[-+]?(?:\d+(?:[.,]\d+)?|[.,]\d+)"


def _plain(c: Column) -> Column:
    return F.lower(strip(c))


def _word(term: str) -> str:
    return rf"(?U)(?<!\w)\Q{term}\E(?!\w)"


def _score(hit: Column) -> Column:
    return F.when(F.coalesce(hit, F.lit(False)), 1.0).otherwise(0.0)


def exact(c: Column, expected: str, embedded: float = 0.0) -> Column:
    e = expected.strip().lower()
    inside = F.when(_plain(c).rlike(_word(e)), embedded).otherwise(0.0) if embedded > 0 and e else F.lit(0.0)
    return F.when(_plain(c) == e, 1.0).otherwise(inside)


def one_of(c: Column, expected: Sequence[str]) -> Column:
    if not expected:
        raise ValueError("an expected text is needed")
    return _score(_plain(c).isin([x.strip().lower() for x in expected]))


def contains_any(c: Column, terms: Sequence[str]) -> Column:
    if not terms or not all(t.strip() for t in terms):
        raise ValueError("terms are not empty")
    hit = F.lit(False)
    for t in terms:
        hit = hit | F.lower(c).rlike(_word(t.lower()))
    return _score(hit)


def starts_with(c: Column, expected: str) -> Column:
    if not expected.strip():
        raise ValueError("a prefix is needed")
    return _score(_plain(c).startswith(expected.strip().lower()))


def numeric(c: Column, expected: float, tolerance: float = 0.0, embedded: float = 0.0) -> Column:
    value = lambda s: F.replace(s, F.lit(","), F.lit(".")).try_cast("double")
    close = lambda s: F.coalesce(F.abs(value(s) - expected) <= tolerance, F.lit(False))
    whole = strip(c).rlike(rf"\A{NUMBER}\z")
    inside = F.when(F.exists(F.regexp_extract_all(c, F.lit(NUMBER), F.lit(0)), close), embedded).otherwise(0.0) if embedded > 0 else F.lit(0.0)
    return F.when(whole, _score(close(strip(c)))).otherwise(inside)


def any_of(*scores: Column) -> Column:
    return F.greatest(*scores) if len(scores) > 1 else scores[0]


def fenced_code(c: Column, language: str) -> Column:
    """The code of a text's only fenced block of a language."""
    block = rf"(?s)```{language}[ \t]*\n(.*?)```"
    found = F.regexp_extract_all(c, F.lit(block), F.lit(1))
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)))


def chrf(c: Column, references: Sequence[str], order: int = 6, beta: float = 2.0) -> Column:
    """Character n-gram F score, the best over the references."""
    from collections import Counter

    norm = lambda t: "".join(t.casefold().split())

    def grams(t: str, n: int) -> Counter:
        return Counter(t[i : i + n] for i in range(len(t) - n + 1))

    def one(hyp: str, ref: str) -> float:
        p, r, used = 0.0, 0.0, 0
        for n in range(1, order + 1):
            a, b = grams(hyp, n), grams(ref, n)
            if a and b:
                both = sum((a & b).values())
                p, r, used = p + both / a.total(), r + both / b.total(), used + 1
        if not used:
            return 0.0
        p, r = p / used, r / used
        down = beta * beta * p + r
        return (1 + beta * beta) * p * r / down if down else 0.0

    refs = [norm(x) for x in references]

    @F.pandas_udf("double")
    def score(s: pd.Series) -> pd.Series:
        return s.map(lambda t: max((one(norm(t), x) for x in refs), default=0.0) if t and norm(t) else 0.0)

    return score(c)


def json_fields(c: Column, expected: Mapping[str, Sequence[Any]], comments: bool = True) -> Column:
    """Share of the expected fields that a JSON object holds; keys and texts
    are compared without case. A fenced block is read if the text is none."""
    import json

    def fold(v: Any) -> Any:
        if isinstance(v, str):
            return ("s", v.casefold())
        if isinstance(v, bool) or v is None:
            return ("b", v)
        if isinstance(v, (int, float)):
            return ("n", float(v))
        if isinstance(v, list):
            return ("l", tuple(fold(x) for x in v))
        return ("o", tuple(sorted((k.casefold(), fold(x)) for k, x in v.items())))

    def refuse(name: str) -> None:
        raise ValueError(name)

    def parse(t: str) -> Any:
        return json.loads(t, parse_constant=refuse)

    def one(t: str | None) -> float:
        try:
            v = parse(t or "")
        except ValueError:
            found = re.findall(r"```json[ \t]*\n(.*?)```", t or "", re.S) if comments else []
            if len(found) != 1:
                return 0.0
            try:
                v = parse(found[0])
            except ValueError:
                return 0.0
        if not isinstance(v, dict):
            return 0.0
        have = {k.casefold(): fold(x) for k, x in v.items()}
        if len(have) != len(v):
            return 0.0
        return sum(k.casefold() in have and have[k.casefold()] in [fold(x) for x in ok] for k, ok in expected.items()) / len(expected)

    @F.pandas_udf("double")
    def score(s: pd.Series) -> pd.Series:
        return s.map(one)

    return score(c)


def python_value(c: Column, expected: Sequence[Any], max_nodes: int = 200, max_digits: int = 200) -> Column:
    """Whether an arithmetic or literal Python expression has one of the
    expected values. Only constants, containers, unary and binary operators,
    comparisons, and a few pure functions are evaluated, within limits."""
    import ast
    import operator

    binary = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.FloorDiv: operator.floordiv, ast.Mod: operator.mod}
    compare = {ast.Eq: operator.eq, ast.NotEq: operator.ne, ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge}
    pure = {"len": len, "sum": sum, "min": min, "max": max, "abs": abs, "sorted": sorted, "round": round}

    def value(n: Any) -> Any:
        if isinstance(n, ast.Expression):
            return value(n.body)
        if isinstance(n, ast.Constant):
            return n.value
        if isinstance(n, (ast.List, ast.Tuple)):
            items = [value(x) for x in n.elts]
            return items if isinstance(n, ast.List) else tuple(items)
        if isinstance(n, ast.Dict):
            return {value(k): value(v) for k, v in zip(n.keys, n.values)}
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, (ast.USub, ast.UAdd, ast.Not)):
            v = value(n.operand)
            return -v if isinstance(n.op, ast.USub) else not v if isinstance(n.op, ast.Not) else +v
        if isinstance(n, ast.BinOp) and type(n.op) in binary:
            a, b = value(n.left), value(n.right)
            sized = [x for x in (a, b) if isinstance(x, (str, list, tuple))]
            if isinstance(n.op, ast.Mult) and sized and any(isinstance(x, int) and x * len(sized[0]) > 10_000 for x in (a, b)):
                raise ValueError("too long")
            if isinstance(n.op, ast.Mod) and isinstance(a, str):
                raise ValueError("no formatting")
            v = binary[type(n.op)](a, b)
            if isinstance(v, int) and v.bit_length() > 4 * max_digits:
                raise ValueError("too large")
            return v
        if isinstance(n, ast.Compare):
            left = value(n.left)
            for op, right in zip(n.ops, n.comparators):
                r = value(right)
                if not compare[type(op)](left, r):
                    return False
                left = r
            return True
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id in pure and not n.keywords:
            return pure[n.func.id](*[value(x) for x in n.args])
        raise ValueError("not allowed")

    def one(t: str | None) -> float:
        try:
            tree = ast.parse((t or "").strip(), mode="eval")
            if sum(1 for _ in ast.walk(tree)) > max_nodes:
                return 0.0
            v = value(tree)
        except Exception:  # any failing expression scores 0
            return 0.0
        return 1.0 if any(type(v) is type(e) and v == e for e in expected) else 0.0

    @F.pandas_udf("double")
    def score(s: pd.Series) -> pd.Series:
        return s.map(one)

    return score(c)
