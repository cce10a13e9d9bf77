"""Text functions as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that normalisation drops or turns into spaces.
INVISIBLE = r"[﻿​⁠-⁤­͏]"
BIDI_CONTROLS = r"[؜‎‏‪-‮⁦-⁩]"
ODD_SPACES = r"[   ]"
OPERATORS = r"==|!=|<=|>=|->|=>|::|//|/\*|\*/|\*\*|\+=|-=|\*=|/=|%=|&&|\|\||<<|>>|:="
SINGLE = r"+\-*/=<>%^|&~!?:;,.()\[\]{}\"'`@#$"


def strip(c: Column) -> Column:
    """Without white space at either end, all of Unicode's."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize_text(c: Column) -> Column:
    """One kind of line end, no invisible or direction marks, plain spaces."""
    c = F.regexp_replace(F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\n\r"), F.lit("\n")), "\r", "\n")
    c = F.regexp_replace(F.regexp_replace(c, INVISIBLE, ""), BIDI_CONTROLS, "")
    return F.regexp_replace(c, ODD_SPACES, " ")


def strip_around_tokens(c: Column, tokens: Sequence[str]) -> Column:
    """No newlines right before or after control tokens."""
    import re

    any_of = "|".join(re.escape(t).replace(r"\-", "-") for t in tokens)
    c = F.regexp_replace(c, rf"\n+({any_of})", "$1")
    return F.regexp_replace(c, rf"({any_of})\n+", "$1")


def pre_tokens(c: Column) -> Column:
    """Pieces before subword merging: operators of several characters, single
    operators, digits one by one, and runs of the rest."""
    return F.regexp_extract_all(c, F.lit(f"{OPERATORS}|[{SINGLE}]|[0-9]|[^0-9{SINGLE}]+"), F.lit(0))


def math_rationale(c: Column) -> Column:
    """Drops calculator marks and surplus blanks; names the final answer."""
    c = F.regexp_replace(c, r"<<[^>]+>>", "")
    c = strip(F.regexp_replace(F.regexp_replace(c, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n"))
    at = F.instr(c, "####")
    why, answer = strip(F.left(c, at - 1)), strip(F.substr(c, at + 4))
    both = F.when((why != "") & (answer != ""), F.concat(why, F.lit("\nFinal answer: "), answer)).otherwise(F.when(answer != "", answer).otherwise(why))
    return F.when(at > 0, both).otherwise(c)


def placeholders(text: Column, values: Column, stem: str = "number") -> Column:
    """Replaces ``number0``, ``number1``, ... in the order of their index, so
    that ``number1`` is also found inside ``number10``."""
    pairs = F.transform(values, lambda v, i: F.struct(F.concat(F.lit(stem), i.cast("string")).alias("k"), v.cast("string").alias("v")))
    return F.aggregate(pairs, text, lambda t, p: F.replace(t, p["k"], p["v"]))


def lettered(choices: Column) -> Column:
    """``A. first``, ``B. second``, ... one per line."""
    return F.array_join(F.transform(choices, lambda c, i: F.concat(F.char(i + 65), F.lit(". "), c)), "\n")


def numbered(choices: Column) -> Column:
    return F.array_join(F.transform(choices, lambda c, i: F.concat((i + 1).cast("string"), F.lit(". "), c)), "\n")


def choice_response(choices: Column, place: Column, kind: str = "label") -> Column:
    """place: 1-based. kind: number, label or both."""
    text, number = F.get(choices, place - 1), place.cast("string")
    return {"label": text, "number": number, "both": F.concat(number, F.lit(". "), text)}[kind]


def choice_by_label(labels: Column, key: Column) -> Column:
    """The 1-based place of a label; unknown labels raise."""
    at = F.array_position(labels, key).cast("int")
    return F.when(at > 0, at).otherwise(F.raise_error(F.concat(F.lit("unknown choice "), key)).cast("int"))


def choice_by_index(choices: Column, index: Column, base: int = 0) -> Column:
    at = index - base + 1
    return F.when((at >= 1) & (at <= F.size(choices)), at).otherwise(F.raise_error(F.lit("choice out of range")).cast("int"))


def yes_no(c: Column, yes: str = "yes", no: str = "no") -> Column:
    return F.when(c, yes).otherwise(no)


def task_label(c: Column, mapping: Mapping[str, str | None], legal: Sequence[str]) -> Column:
    """A label by way of a mapping: a value mapped to null has none, an
    unknown value raises."""
    for v in mapping.values():
        if v is not None and v not in legal:
            raise ValueError(f"{v} is no task label")
    out = F.raise_error(F.concat(F.lit("no task label for "), F.coalesce(c, F.lit("null")))).cast("string")
    expr = None
    for k, v in mapping.items():
        value = F.lit(v).cast("string")
        expr = F.when(c == k, value) if expr is None else expr.when(c == k, value)
    return out if expr is None else expr.otherwise(out)


def verbosity(tokens: Column, thresholds: Sequence[tuple[int, str]], last: str) -> Column:
    """The label of the first bound that holds the token count."""
    expr = None
    for bound, name in thresholds:
        expr = F.when(tokens <= bound, name) if expr is None else expr.when(tokens <= bound, name)
    return expr.otherwise(last) if expr is not None else F.lit(last)


def format_label(c: Column, rules: Sequence[tuple[str, str]], last: str) -> Column:
    """The label of the first pattern that matches the whole text."""
    expr = None
    for name, pattern in rules:
        hit = c.rlike(f"\\A(?:{pattern})\\z")
        expr = F.when(hit, name) if expr is None else expr.when(hit, name)
    return expr.otherwise(last) if expr is not None else F.lit(last)


def sanitize(c: Column) -> Column:
    """Safe as a file name."""
    return F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "_")


def truncate(c: Column, lines: int, chars: int) -> Column:
    """At most so many lines, then characters, the mark of a cut included."""
    tail = lambda x: F.regexp_replace(x, r"(?U)\s+$", "")
    rows = F.split(c, "\n")
    short = F.when(F.size(rows) > lines, F.array_join(F.slice(rows, 1, lines), "\n")).otherwise(c)
    mark = F.when(F.instr(short, "\n") > 0, F.lit("\n... [truncated]")).otherwise(F.lit(" ... [truncated]"))
    cut = (F.size(rows) > lines) | (F.length(short) > chars)
    short = F.when(F.length(short) > chars, tail(F.left(short, F.lit(chars)))).otherwise(short)
    body = tail(F.left(short, F.greatest(F.lit(0), F.lit(chars) - F.length(mark))))
    return F.when(~cut, c).otherwise(F.when(body != "", F.concat(body, mark)).otherwise(strip(mark)))


def think_split(c: Column, pattern: str = r"(?s)^\s*<think>(.*?)</think>(.*)$") -> tuple[Column, Column]:
    """Scratchpad and answer; without a match all is the answer."""
    hit = c.rlike(pattern)
    return F.when(hit, strip(F.regexp_extract(c, pattern, 1))), F.when(hit, strip(F.regexp_extract(c, pattern, 2))).otherwise(strip(c))


def schedule(units: Column, warmup: int, decay_from: int, decay: int, start: float, peak: float, end: float) -> Column:
    """Linear warm-up, plateau, cosine decay over units seen."""
    u = units.cast("double")
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (u - decay_from) / float(max(1, decay))))
    down = F.lit(end) + (peak - end) * (0.5 * (1.0 + F.cos(F.lit(3.141592653589793) * share)))
    return F.when(units < warmup, start + (peak - start) * (u / float(max(1, warmup)))).when(units < decay_from, F.lit(peak)).otherwise(down if decay > 0 else F.lit(end))
