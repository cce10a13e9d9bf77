"""Record transforms: a DataFrame in, none to many rows out for each row.

The canonical training record is ``record_id, system_prompt, turns``, with
turns an array of ``prompt, completion, task, scratchpad``. Numbered keys
such as ``prompt.0`` are made at the edge only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip, think_split

Transform = Callable[[DataFrame], DataFrame]
TURN = "struct<prompt: string, completion: string, task: string, scratchpad: string>"


def sequential(*steps: Transform) -> Transform:
    return lambda df: reduce(lambda d, f: f(d), steps, df)


def fan_out(*branches: Transform, key: str = "record_id") -> Transform:
    """Every branch sees the same rows; with several branches ids get
    ``.transform_{branch}.{number}``."""

    def run(df: DataFrame) -> DataFrame:
        if len(branches) == 1:
            return branches[0](df)
        parts = []
        for i, f in enumerate(branches):
            out = f(df)
            w = Window.partitionBy(key).orderBy(F.lit(0))
            number = (F.row_number().over(w) - 1).cast("string")
            parts.append(out.withColumn("__n", number).withColumn(key, F.concat(F.col(key), F.lit(f".transform_{i}."), F.col("__n"))).drop("__n"))
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    return run


def field_mapping(mapping: dict[str, Sequence[str]], key: str = "record_id", joiner: str = "\n\n") -> Transform:
    """Each new field is the non-empty texts of its sources, joined; what is
    not mapped goes; a source that is no text raises."""

    def run(df: DataFrame) -> DataFrame:
        kinds = dict(df.dtypes)
        for sources in mapping.values():
            for s in sources:
                if kinds.get(s) != "string":
                    raise TypeError(f"{s} is not a text column")
        return df.select(key, *[F.concat_ws(joiner, *[F.when(F.col(s) != "", F.col(s)) for s in sources]).alias(name) for name, sources in mapping.items()])

    return run


def chat_to_sft(messages: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text", max_turn_chars: int | None = None, think_pattern: str | None = None) -> DataFrame:
    """Exchanges of conversations: a user message and the assistant messages
    that follow it, joined by a blank line.

    A user message closes the open exchange, so one without an answer is
    lost, and so are assistant messages before the first user message. The
    system prompt stays with records that have an exchange. Unknown roles
    raise, and so does a system message after the first complete exchange.
    """
    m = messages.select(F.col(key).alias("k"), F.col(order).alias("o"), F.col(role).alias("r"), F.col(text).alias("t"))
    known = F.col("r").isin("system", "user", "assistant")
    m = m.withColumn("r", F.when(known, F.col("r")).otherwise(F.raise_error(F.concat(F.lit("unknown role "), F.coalesce("r", F.lit("null")))).cast("string")))
    w = Window.partitionBy("k").orderBy("o")
    m = m.withColumn("x", F.sum((F.col("r") == "user").cast("int")).over(w))
    per = m.where("x > 0 and r <> 'system'").groupBy("k", "x").agg(
        F.max(F.when(F.col("r") == "user", F.col("t"))).alias("prompt"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("r") == "assistant", F.struct("o", "t")))), lambda s: s["t"]), "\n\n").alias("completion"),
        F.min(F.when(F.col("r") == "assistant", F.col("o"))).alias("first_answer"),
        F.count_if(F.col("r") == "assistant").alias("answers"),
    )
    per = per.where((strip(F.col("prompt")) != "") & (F.col("answers") > 0))
    if think_pattern:
        why, answer = think_split(F.col("completion"), think_pattern)
    else:
        why, answer = F.lit(None).cast("string"), F.col("completion")
    per = per.withColumns({"scratchpad": why, "completion": answer})
    if max_turn_chars is not None:
        per = per.where(F.length("prompt") + F.length("completion") <= max_turn_chars)
    turn = F.struct("x", F.struct("prompt", "completion", F.lit(None).cast("string").alias("task"), "scratchpad").alias("turn"))
    turns = per.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(turn)), lambda s: s["turn"]).alias("turns"), F.min("first_answer").alias("emitted"))
    system = m.where("r = 'system'").groupBy("k").agg(F.max_by("t", "o").alias("system_prompt"), F.max("o").alias("system_at"))
    out = turns.join(system, "k", "left")
    late = F.coalesce(F.col("system_at") > F.col("emitted"), F.lit(False))
    out = out.withColumn("system_prompt", F.when(late, F.raise_error(F.lit("system message after an exchange")).cast("string")).otherwise(F.col("system_prompt")))
    return out.select(F.col("k").cast("string").alias("record_id"), "system_prompt", "turns")


def numbered_fields(records: DataFrame) -> DataFrame:
    """record_id, field, value: the ``prompt.0`` form of records."""
    t = records.select("record_id", F.posexplode("turns").alias("i", "t"))
    parts = [F.struct(F.concat(F.lit(f"{n}."), F.col("i").cast("string")).alias("field"), F.col(f"t.{n}").alias("value")) for n in ("prompt", "completion", "task", "scratchpad")]
    flat = t.select("record_id", F.explode(F.array(*parts)).alias("f")).select("record_id", "f.*")
    system = records.select("record_id", F.lit("system_prompt").alias("field"), F.col("system_prompt").alias("value"))
    return flat.unionByName(system).where("value is not null")


def normalize_single_turn(df: DataFrame, key: str = "record_id") -> DataFrame:
    """``prompt`` and ``completion`` columns as one turn."""
    have = set(df.columns)
    part = lambda c: (F.col(c) if c in have else F.lit(None).cast("string")).alias(c)
    return df.select(key, part("system_prompt"), F.array(F.struct(*[part(c) for c in ("prompt", "completion", "task", "scratchpad")])).alias("turns"))


def to_sft(df: DataFrame, prompt: Sequence[Column], completion: Sequence[Column], scratchpad: Sequence[Column] = (), system_prompt: Sequence[Column] = (), task: Column | None = None, key: str = "record_id", joiner: str = "\n\n") -> DataFrame:
    """One turn from parts; parts are trimmed, empty ones left out. A blank
    prompt or completion drops the record."""
    if not prompt or not completion:
        raise ValueError("a prompt and a completion are needed")
    whole = lambda parts: strip(F.concat_ws(joiner, *[F.when(strip(p) != "", strip(p)) for p in parts])) if parts else F.lit("")
    out = df.select(key, whole(prompt).alias("p"), whole(completion).alias("c"), F.nullif(whole(scratchpad), F.lit("")).alias("s"), F.nullif(whole(system_prompt), F.lit("")).alias("system_prompt"), (task if task is not None else F.lit(None).cast("string")).alias("t"))
    turn = F.struct(F.col("p").alias("prompt"), F.col("c").alias("completion"), F.col("t").alias("task"), F.col("s").alias("scratchpad"))
    return out.where("p <> '' and c <> ''").select(key, "system_prompt", F.array(turn).alias("turns"))


def items_to_sft(df: DataFrame, items: str, context: Callable[[Column], Column], prompt: Callable[[Column], Column], completion: Callable[[Column], Column], is_context: Callable[[Column], Column], emits: Callable[[Column], Column], key: str = "record_id", joiner: str = "\n\n", context_joiner: str = "\n") -> DataFrame:
    """A turn for each item that emits. The context grows over the items, and
    an item adds to it before it is asked whether it emits."""
    w = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = df.select(key, F.posexplode(items).alias("i", "item"))
    rows = rows.withColumn("chunk", F.when(is_context(F.col("item")), F.nullif(strip(context(F.col("item"))), F.lit(""))))
    rows = rows.withColumn("so_far", strip(F.array_join(F.collect_list("chunk").over(w), context_joiner)))
    p, c = strip(prompt(F.col("item"))), strip(completion(F.col("item")))
    rows = rows.where(emits(F.col("item"))).select(key, "i", strip(F.concat_ws(joiner, F.nullif("so_far", F.lit("")), F.nullif(p, F.lit("")))).alias("prompt"), c.alias("completion"))
    rows = rows.where("prompt <> '' and completion <> ''")
    turn = F.struct("prompt", "completion", F.lit(None).cast("string").alias("task"), F.lit(None).cast("string").alias("scratchpad"))
    turns = rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", turn.alias("turn")))), lambda s: s["turn"]).alias("turns"))
    return turns.select(key, F.lit(None).cast("string").alias("system_prompt"), "turns")


def columnar_items(*columns: str) -> Column:
    """Equal-length lists as a list of structs."""
    return F.arrays_zip(*columns)


def split_qa_pairs(df: DataFrame, text: str = "text", key: str = "record_id") -> DataFrame:
    """A record for each complete question of a document; the text before
    the first question is the passage, and is needed."""
    parts = F.split(F.col(text), r"(?m)^[ \t]*Question:[ \t]*")
    rows = df.select(key, F.get(parts, F.lit(0)).alias("passage"), F.posexplode(F.slice(parts, 2, 1 << 30)).alias("n", "pair"))
    answer = r"(?s)^(.*?)\sAnswer:(.*)$"
    rows = rows.select(key, "n", strip(F.col("passage")).alias("passage"), strip(F.regexp_extract("pair", answer, 1)).alias("q"), strip(F.regexp_extract("pair", answer, 2)).alias("a"))
    rows = rows.where("passage <> '' and q <> '' and a <> ''")
    return rows.select(
        F.concat(F.col(key), F.lit(".qa-"), (F.col("n") + 1).cast("string")).alias(key),
        F.concat(F.col("passage"), F.lit("\n\nQuestion: "), F.col("q")).alias("prompt"),
        F.col("a").alias("completion"),
    )


def threads(messages: DataFrame, languages: Sequence[str] | None = None) -> DataFrame:
    """Paths from the root to each leaf of message trees, longer than one.

    messages: message_id, parent_id, role, text, lang. A missing parent ends
    the walk; the language is the leaf's. Pointers double each round, so a
    path of length n takes log n joins.
    """
    from ..session import settle

    m = messages if languages is None else messages.where(F.lower("lang").isin([x.lower() for x in languages]))
    m = settle(m.select("message_id", "parent_id", "role", "text", "lang"), "messages")
    leaf = m.join(m.select(F.col("parent_id").alias("message_id")).where("message_id is not null").distinct(), "message_id", "left_anti")
    # up: ancestors so far, nearest first, and where to go on from.
    jump = m.select(F.col("message_id").alias("id"), F.col("parent_id").alias("next"), F.array("message_id").alias("path"))
    while True:
        b = jump.select(F.col("id").alias("next"), F.col("next").alias("further"), F.col("path").alias("more"))
        step = jump.join(b, "next", "left").select("id", F.col("further").alias("next"), F.when(F.col("more").isNull(), F.col("path")).otherwise(F.concat("path", "more")).alias("path"))
        jump = settle(step, "paths")
        if not jump.where("next is not null").limit(1).count():
            break
    paths = jump.join(leaf.select(F.col("message_id").alias("id"), F.col("lang").alias("leaf_lang")), "id").where(F.size("path") > 1)
    flat = paths.select("id", "leaf_lang", F.posexplode(F.reverse("path")).alias("depth", "message_id"))
    said = flat.join(m.select("message_id", "role", "text"), "message_id")
    return said.groupBy(F.col("id").alias("leaf_id"), F.col("leaf_lang").alias("lang")).agg(F.transform(F.array_sort(F.collect_list(F.struct("depth", "message_id", "role", "text"))), lambda s: F.struct(s["message_id"].alias("message_id"), s["role"].alias("role"), s["text"].alias("text"))).alias("messages"))


def _seed(record: str, kind: str, seed: int, iteration: int) -> int:
    import hashlib

    return int(hashlib.md5(f"{record}|{kind}|{seed}|{iteration}".encode()).hexdigest()[:15], 16)


def prefix_value(equation: Sequence[Any], numbers: Sequence[int]) -> float | None:
    """A prefix equation of operators, ``numberK`` and constants."""

    def walk(at: int) -> tuple[float, int]:
        tok = str(equation[at])
        if tok in "+-*/" and len(tok) == 1:
            a, at = walk(at + 1)
            b, at = walk(at)
            return {"+": a + b, "-": a - b, "*": a * b, "/": a / b if b else float("nan")}[tok], at
        if tok.startswith("number"):
            return float(numbers[int(tok[6:])]), at + 1
        return float(tok), at + 1

    try:
        value, end = walk(0)
    except (IndexError, ValueError):
        return None
    return value if end == len(equation) and value == value else None


def arithmetic_templates(df: DataFrame, copies: int = 3, relative: float = 0.5, absolute: int = 5, least: int = 1, attempts: int = 50, seed: int = 0, iteration: int = 0, key: str = "record_id") -> DataFrame:
    """New numbers for word problems: question (with ``numberK``), numbers,
    equation (prefix). Keeps integer results of at least ``least`` and number
    sets not used before. Randomness is seeded by record."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from random import Random

        for b in batches:
            rows = []
            for rid, question, numbers, equation in zip(b[key], b["question"], b["numbers"], b["equation"]):
                rng, base = Random(_seed(str(rid), "arithmetic", seed, iteration)), [int(x) for x in numbers]
                used = {tuple(base)}
                made = 0
                for _ in range(attempts * copies):
                    if made == copies:
                        break
                    new = tuple(rng.randint(max(1, v - w), v + w) for v in base for w in [max(round(relative * v), absolute)])
                    value = prefix_value(list(equation), new)
                    if new in used or value is None or value != int(value) or value < least:
                        continue
                    used.add(new)
                    text = question
                    for i, v in enumerate(new):
                        text = text.replace(f"number{i}", str(v))
                    rows.append((f"{rid}.arithmetic-{iteration}-{made}", text, str(int(value))))
                    made += 1
            yield pd.DataFrame(rows, columns=[key, "prompt", "completion"])

    return df.select(key, "question", "numbers", "equation").mapInPandas(run, f"{key} string, prompt string, completion string")


def equation_answers(df: DataFrame, copies: int = 3, relative: float = 0.5, absolute: int = 5, least: int = 0, attempts: int = 50, seed: int = 0, iteration: int = 0, key: str = "record_id") -> DataFrame:
    """New operands for ``expression = result #### final`` answers. Operands
    are distinct and occur exactly once in the question; intermediate
    differences stay at ``least`` or above, divisions exact."""
    import ast

    def evaluate(node: Any) -> int | None:
        if isinstance(node, ast.Expression):
            return evaluate(node.body)
        if isinstance(node, ast.Constant) and isinstance(node.value, int):
            return node.value
        if isinstance(node, ast.BinOp):
            a, b = evaluate(node.left), evaluate(node.right)
            if a is None or b is None:
                return None
            if isinstance(node.op, ast.Add):
                return a + b
            if isinstance(node.op, ast.Sub):
                return a - b if a - b >= least else None
            if isinstance(node.op, ast.Mult):
                return a * b
            if isinstance(node.op, ast.Div):
                return a // b if b and a % b == 0 else None
        return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re
        from random import Random

        for b in batches:
            rows = []
            for rid, question, answer in zip(b[key], b["question"], b["answer"]):
                hit = re.fullmatch(r"\s*([0-9+\-*/ ]+?)\s*=\s*(-?\d+)\s*####\s*(-?\d+)\s*", answer or "")
                if not hit:
                    continue
                operands = re.findall(r"\d+", hit.group(1))
                once = all(len(re.findall(rf"(?<!\d){o}(?!\d)", question)) == 1 for o in operands)
                if len(set(operands)) != len(operands) or not once:
                    continue
                rng, used = Random(_seed(str(rid), "equation", seed, iteration)), {tuple(operands)}
                made = 0
                for _ in range(attempts * copies):
                    if made == copies:
                        break
                    new = tuple(str(rng.randint(max(1, int(o) - w), int(o) + w)) for o in operands for w in [max(round(relative * int(o)), absolute)])
                    if new in used or len(set(new)) != len(new):
                        continue
                    swap = dict(zip(operands, new))
                    put = lambda m: swap.get(m.group(), m.group())  # noqa: B023, E731
                    expression = re.sub(r"\d+", put, hit.group(1))
                    value = evaluate(ast.parse(expression.replace(" ", ""), mode="eval"))
                    if value is None:
                        continue
                    used.add(new)
                    rows.append((f"{rid}.arithmetic-{iteration}-{made}", re.sub(r"(?<!\d)\d+(?!\d)", put, question), f"{expression} = {value} #### {value}"))
                    made += 1
            yield pd.DataFrame(rows, columns=[key, "prompt", "completion"])

    return df.select(key, "question", "answer").mapInPandas(run, f"{key} string, prompt string, completion string")


# Words that make no good lookup key.
STOPWORDS = set("the and for that with this from are was were not but his her its they you our une des les pour dans que qui est sur avec".split())
LABELS = {"en": ("entry", "value", "What is the value of", "Which entry has the value"), "fr": ("entrée", "valeur", "Quelle est la valeur de", "Quelle entrée a la valeur")}


def lookup_retrieval(df: DataFrame, text: str = "text", language: str = "en", least: int = 4, most: int = 10, seed: int = 0, iteration: int = 0, key: str = "record_id") -> DataFrame:
    """Table look-ups made of a text's own words: 4 to 10 distinct words that
    are no stopwords become keys or values of numbered entries, and one is
    asked for, in either direction. Too few words give nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re
        from random import Random

        entry, value, ask, ask_back = LABELS[language]
        for b in batches:
            rows = []
            for rid, t in zip(b[key], b[text]):
                seen = dict.fromkeys(w.lower() for w in re.findall(r"[^\W\d_]{3,}", t or ""))
                found = [w for w in seen if w not in STOPWORDS]
                if len(found) < least:
                    continue
                rng = Random(_seed(str(rid), "lookup", seed, iteration))
                picked = rng.sample(found, min(len(found), rng.randint(least, most)))
                style = rng.randrange(4)
                names = [str(i + 1) if style == 0 else chr(65 + i) if style == 1 else f"{entry} {i + 1}" if style == 2 else f"#{i + 1}" for i in range(len(picked))]
                table = "\n".join(f"{n}: {w}" for n, w in zip(names, picked))
                i = rng.randrange(len(picked))
                rows.append((f"{rid}.lookup-forward", f"{table}\n\n{ask} {names[i]}?", picked[i]))
                rows.append((f"{rid}.lookup-backward", f"{table}\n\n{ask_back} {picked[i]}?", names[i]))
            yield pd.DataFrame(rows, columns=[key, "prompt", "completion"])

    return df.select(F.col(key).cast("string").alias(key), text).mapInPandas(run, f"{key} string, prompt string, completion string")
