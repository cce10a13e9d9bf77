"""Chat protocols as column expressions: rendering, parsing, fitting.

Three styles: ``normalized`` marks the parts of an answer by control tokens,
``legacy`` has control tokens for roles only, ``plain`` has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# The control tokens of the protocol, and the notice that
# stands before a prompt that was cut.
SYSTEM = "[:system:]"
USER = "[:user:]"
ASSISTANT = "[:assistant:]"
END = "[:eot:]"
TASK = "[:task:]"
VERBOSITY = "[:verbosity:]"
FORMAT = "[:format:]"
SCRATCHPAD = "[:scratchpad:]"
FINAL = "[:final:]"
THINK_OPEN = "<think>"
THINK_CLOSE = "</think>"
CUT_NOTICE = "**TRUNCATED **\n\n"

STYLES = ("normalized", "legacy", "plain")
ROUTES = {"task": TASK, "verbosity": VERBOSITY, "format": FORMAT}
#: How far an answer's opening may be written into the prompt.
OPENINGS = ("assistant", "task", "verbosity", "format", "scratchpad", "final")


def _style(style: str) -> None:
    if style not in STYLES:
        raise ValueError(f"{style}: a style is one of {', '.join(STYLES)}")


def opening(last: str = "final", **forced: str | None) -> str:
    """What a prompt says of the answer to come: forced routes, then the
    token that the answer goes on from. A forced route has to lie within."""
    if last not in OPENINGS:
        raise ValueError(f"{last}: an opening ends with one of {', '.join(OPENINGS)}")
    reach = min(OPENINGS.index(last), 4)
    forced = {k: v for k, v in forced.items() if v is not None}
    for k, v in forced.items():
        if k not in ROUTES or not v or OPENINGS.index(k) > reach:
            raise ValueError(f"{k}: empty, unknown or beyond {last}")
    said = "".join(token + forced[k] for k, token in ROUTES.items() if k in forced)
    if last in ROUTES and last not in forced:
        said += ROUTES[last]
    return said + {"scratchpad": SCRATCHPAD, "final": FINAL}.get(last, "")


def _given(c: Column | None) -> Column:
    return F.lit("") if c is None else F.coalesce(c, F.lit(""))


def completion(final: Column, task: Column | None = None, verbosity: Column | None = None, format: Column | None = None, scratchpad: Column | None = None, end: bool = True, style: str = "normalized") -> Column:
    """An answer as text; empty and null parts are left out."""
    _style(style)
    why = _given(scratchpad)
    routes = [F.when(_given(c) != "", F.concat(F.lit(t), c)).otherwise("") for t, c in zip(ROUTES.values(), (task, verbosity, format)) if c is not None]
    if style == "normalized":
        said = F.concat(F.when(why != "", F.concat(F.lit(SCRATCHPAD), why)).otherwise(""), F.lit(FINAL), final)
    else:
        said = F.concat(F.when(why != "", F.concat(F.lit(THINK_OPEN), why, F.lit(THINK_CLOSE))).otherwise(""), final)
    if style != "plain":
        said = F.concat(*routes, said)
    return F.concat(said, F.lit(END)) if end and style != "plain" else said


def prompt_blocks(system: Column, history: Column, current: Column, style: str = "normalized", start: str | None = None) -> Column:
    """system, history (array), current: the blocks of a prompt.

    history: array of structs with user and assistant, oldest first.
    """
    _style(style)
    if style == "plain":
        head = F.concat(system, F.lit("\n\n"))
        turn = lambda t: F.concat(t["user"], F.lit("\n"), t["assistant"], F.lit("\n\n"))
        last = current
    else:
        said = lambda role, c: F.concat(F.lit(role), c, F.lit(END))
        head = said(SYSTEM, system)
        turn = lambda t: F.concat(said(USER, t["user"]), F.lit(ASSISTANT), completion(t["assistant"], style=style))
        last = F.concat(said(USER, current), F.lit(ASSISTANT + ((FINAL if start is None else start) if style == "normalized" else "")))
    head = F.when(_given(system) != "", head)
    return F.struct(head.alias("system"), F.transform(history, turn).alias("history"), last.alias("current"))


def prompt(blocks: Column) -> Column:
    """The text of ``prompt_blocks``."""
    return F.concat(F.coalesce(blocks["system"], F.lit("")), F.array_join(blocks["history"], ""), blocks["current"])


def parse_completion(c: Column, style: str = "normalized", start: str | None = None) -> Column:
    """final, task, verbosity, format, scratchpad of an answer's text. What
    does not keep to the protocol is all final answer."""
    _style(style)
    none = F.lit(None).cast("string")
    names = ("task", "verbosity", "format", "scratchpad")
    if style == "plain":
        return F.struct(strip(c).alias("final"), *[none.alias(n) for n in names])
    if style == "normalized" and start:
        c = F.concat(F.lit(start), c)
    whole = strip(F.substring_index(c, END, 1))
    if style == "legacy":
        return F.struct(whole.alias("final"), *[none.alias(n) for n in names])
    plain = lambda t: t.replace("[", r"\[").replace("]", r"\]")
    marks = [plain(t) for t in (*ROUTES.values(), SCRATCHPAD, FINAL)]
    # Each part ends where the first of the later marks stands, for good.
    parts = [f"(?>{m}(.*?)(?={'|'.join(marks[k + 1 :])}))?" for k, m in enumerate(marks[:-1])]
    pattern = f"(?s)^{''.join(parts)}{marks[-1]}(.*)$"
    ok = whole.rlike(pattern)
    found = {n: F.when(ok, F.nullif(F.regexp_extract(whole, pattern, k + 1), F.lit(""))) for k, n in enumerate(names)}
    final = F.when(ok, F.regexp_extract(whole, pattern, len(marks))).otherwise(whole)
    return F.struct(final.alias("final"), *[v.alias(n) for n, v in found.items()])


def fit(system: Column, history: Column, current: Column, budget: int, style: str = "normalized", start: str | None = None) -> Column:
    """text, turns, cut: a prompt of at most ``budget`` characters.

    The oldest exchanges go first; if the prompt alone is too long, the user's
    text loses its beginning, and a notice stands before the prompt. A system
    prompt and frame over the budget raise.
    """
    blocks = prompt_blocks(system, history, current, style, start)
    frame = F.length(prompt(prompt_blocks(system, F.slice(history, 1, 0), F.lit(""), style, start)))
    sizes = F.reverse(F.transform(blocks["history"], lambda t: F.length(t)))
    room = F.lit(budget) - frame - F.length(current)
    state = F.struct(F.lit(0).alias("used"), F.lit(0).alias("n"))
    # Sizes are not negative: once a turn does not fit, none before it does.
    newest = F.aggregate(sizes, state, lambda a, x: F.struct((a["used"] + x).cast("int").alias("used"), F.when(a["used"] + x <= room, a["n"] + 1).otherwise(a["n"]).cast("int").alias("n")))["n"]
    kept = F.when(room >= 0, newest).otherwise(0)
    recent = F.slice(history, F.size(history) - kept + 1, kept)
    short = F.right(current, F.lit(budget) - frame)
    text = F.when(room >= 0, prompt(prompt_blocks(system, recent, current, style, start)))
    text = text.when(frame > budget, F.raise_error(F.lit("system prompt and frame exceed the budget")).cast("string"))
    text = text.otherwise(F.concat(F.lit(CUT_NOTICE), prompt(prompt_blocks(system, F.slice(history, 1, 0), short, style, start))))
    return F.struct(text.alias("text"), kept.alias("turns"), (room < 0).alias("cut"))


def fit_tokens(system: Column, history: Column, current: Column, budget: int, definition: str, style: str = "normalized") -> Column:
    """As ``fit``, in tokens of a tokenizer given by its definition. Tokens
    may merge across blocks, so whole prompts are measured."""
    blocks = prompt_blocks(system, history, F.lit("\u0000"), style)

    @F.pandas_udf("struct<text string, n_tokens int, cut boolean>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(definition)
        count = lambda s: len(t.encode(s, add_special_tokens=False).ids)

        def one(head, turns, frame, user):
            head, turns = head or "", [] if turns is None else list(turns)
            for k in range(len(turns) + 1):
                text = head + "".join(turns[k:]) + frame.replace("\u0000", user)
                if (n := count(text)) <= budget:
                    return text, n, False
            ids = t.encode(user, add_special_tokens=False).ids
            best, low, high = None, 0, len(ids)
            while low <= high:
                keep = (low + high) // 2
                text = head + frame.replace("\u0000", t.decode(ids[len(ids) - keep :], skip_special_tokens=False))
                if (n := count(text)) <= budget:
                    best, low = (text, n), keep + 1
                else:
                    high = keep - 1
            if best is None:
                raise ValueError("system prompt and frame exceed the budget")
            return CUT_NOTICE + best[0], best[1], True

        for head, turns, frame, user in batches:
            yield pd.DataFrame([one(*x) for x in zip(head, turns, frame, user)], columns=["text", "n_tokens", "cut"])

    return run(blocks["system"], blocks["history"], blocks["current"], current)


def label_masks(c: Column, spans: Column, definition: str) -> Column:
    """ids and mask of a text: 1 for tokens of the character spans.

    spans: array of structs with start and stop. A span's tokens are those
    between the token counts of the text up to its start and up to its stop.
    """

    @F.pandas_udf("struct<ids array<int>, mask array<double>>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(definition)
        ids = lambda s: t.encode(s, add_special_tokens=False).ids

        def one(text, where):
            found = ids(text)
            mask = [0.0] * len(found)
            for s in () if where is None else where:
                a, b = len(ids(text[: s["start"]])), len(ids(text[: s["stop"]]))
                mask[a:b] = [1.0] * (min(b, len(found)) - min(a, len(found)))
            return found, mask

        for text, where in batches:
            yield pd.DataFrame([one(*x) for x in zip(text.fillna(""), where)], columns=["ids", "mask"])

    return run(c, spans)


def route_spans(c: Column) -> Column:
    """name, start, stop of the routes that a normalized answer opens with."""
    plain = lambda t: t.replace("[", r"\[").replace("]", r"\]")
    value = r"((?:(?!\[:)[\s\S])+)"
    place, out = F.lit(1), []
    for name, token in ROUTES.items():
        pattern = f"^{plain(token)}{value}"
        found = F.regexp_extract(F.substring(c, place, F.length(c)), pattern, 1)
        has = found != ""
        start = place - 1 + len(token)
        out.append(F.when(has, F.struct(F.lit(name).alias("name"), start.cast("int").alias("start"), (start + F.length(found)).cast("int").alias("stop"))))
        place = F.when(has, place + len(token) + F.length(found)).otherwise(place)
    return F.array_compact(F.array(*out))
