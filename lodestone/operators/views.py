"""Training views: windows, masks, budgets, mixtures and packs."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Windowing:
    length: int = 1024
    overlap: int = 128
    min_new: int = 256
    align_last: bool = True

    def __post_init__(self) -> None:
        if not 0 <= self.overlap < self.length:
            raise ValueError("the overlap is at least 0 and less than the window")


def windows(n: Column, p: Windowing = Windowing()) -> Column:
    """array<struct<start, stop, new_from>> over a text of n tokens.

    A tail with too few new tokens becomes a window that ends with the text,
    or is left out. In closed form, so nothing is looped over.
    """
    stride = p.length - p.overlap
    last = F.ceil((n - p.length) / F.lit(float(stride))).cast("int")  # of windows that do not reach the end
    starts = F.sequence(F.lit(0), F.greatest(last, F.lit(0)))

    def one(k: Column) -> Column:
        start = k * stride
        stop = F.least(start + p.length, n)
        new = F.when(k == 0, 0).otherwise(start + p.overlap)
        short = (k > 0) & (stop - new < p.min_new)
        return F.struct(F.when(short, n - p.length).otherwise(start).cast("int").alias("start"), F.when(short, n).otherwise(stop).cast("int").alias("stop"), new.cast("int").alias("new_from"), short.alias("short"))

    many = F.transform(starts, one)
    if not p.align_last:
        many = F.filter(many, lambda w: ~w["short"])
    plain = F.transform(many, lambda w: F.struct(w["start"], w["stop"], w["new_from"]))
    single = F.array(F.struct(F.lit(0).alias("start"), n.cast("int").alias("stop"), F.lit(0).alias("new_from")))
    none = F.array().cast("array<struct<start: int, stop: int, new_from: int>>")
    return F.when(n <= 0, none).when(n <= p.length, single).otherwise(plain)


def loss_mask(w: Column) -> Column:
    """0 for tokens of the overlap and for the very first one, else 1."""
    size = w["stop"] - w["start"]
    skip = F.greatest(F.lit(1), w["new_from"] - w["start"])
    return F.transform(F.sequence(F.lit(0), size - 1), lambda i: (i >= skip).cast("float"))


def work_units(w: Column) -> Column:
    return F.greatest(F.lit(0), w["stop"] - w["start"] - F.greatest(F.lit(1), w["new_from"] - w["start"]))


def within_budget(df: DataFrame, units: str, budget: int, order: str, group: Sequence[str] = ()) -> DataFrame:
    """Rows in order up to the first one that would overflow the budget.

    Units are not negative, so the running sum only grows: the rows kept are
    those whose sum fits."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("__cum", F.sum(units).over(w)).where(F.col("__cum") <= budget).drop("__cum")


def whole_batches(df: DataFrame, units: str, budget: int, batch: int, order: str, group: Sequence[str] = ()) -> DataFrame:
    """Whole batches in order until the budget is reached; the last one may
    go over it. Adds ``batch``."""
    w = Window.partitionBy(*group).orderBy(order)
    rows = df.withColumn("batch", F.floor((F.row_number().over(w) - 1) / batch).cast("int"))
    w = Window.partitionBy(*group).orderBy("batch").rangeBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(units).over(w), F.lit(0))
    return rows.withColumn("__before", before).where(F.col("__before") < budget).drop("__before")


def newest_that_fit(lengths: Column, budget: Column) -> Column:
    """How many of the newest blocks fit, stopping at the first that does
    not. lengths: oldest first."""
    state = F.struct(F.lit(0).alias("used"), F.lit(0).alias("n"), F.lit(True).alias("go"))

    def step(s: Column, x: Column) -> Column:
        ok = s["go"] & (s["used"] + x <= budget)
        return F.struct(F.when(ok, s["used"] + x).otherwise(s["used"]).cast("int").alias("used"), F.when(ok, s["n"] + 1).otherwise(s["n"]).cast("int").alias("n"), ok.alias("go"))

    return F.aggregate(F.reverse(lengths), state, step)["n"]


def encode_turns(turns: DataFrame, budget: int, key: str = "record_id") -> DataFrame:
    """What of a conversation fits each of its answers.

    turns: key, i, prompt_len, completion_len, scratchpad_len, system_len.
    The current prompt and answer are needed, else the turn is rejected; then
    the scratchpad whole or not at all, then the newest whole exchanges, then
    the system prompt.
    """
    w = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    rows = turns.withColumn("history", F.collect_list((F.col("prompt_len") + F.col("completion_len")).cast("int")).over(w))
    left = F.lit(budget) - F.col("prompt_len") - F.col("completion_len")
    rows = rows.withColumns({"left": left.cast("int"), "rejected": left < 0})
    pad = ~F.col("rejected") & (F.col("scratchpad_len") > 0) & (F.col("scratchpad_len") <= F.col("left"))
    rows = rows.withColumn("has_scratchpad", pad)
    rows = rows.withColumn("left", F.when(pad, F.col("left") - F.col("scratchpad_len")).otherwise(F.col("left")).cast("int"))
    kept = F.when(F.col("rejected"), 0).otherwise(newest_that_fit(F.col("history"), F.col("left")))
    rows = rows.withColumn("history_kept", kept)
    used = F.aggregate(F.slice(F.reverse("history"), F.lit(1), F.col("history_kept")), F.lit(0), lambda a, x: a + x)
    rows = rows.withColumn("left", F.col("left") - used)
    system = ~F.col("rejected") & (F.col("system_len") > 0) & (F.col("system_len") <= F.col("left"))
    return rows.select(key, "i", "rejected", "has_scratchpad", "history_kept", F.size("history").alias("history_size"), system.alias("has_system"))


def mix_exact(streams: DataFrame, weights: Mapping[str, float], restarts: Mapping[str, int] | None = None, by: str = "units", seed: int = 0) -> DataFrame:
    """The sequence of a weighted mixture: place, source, uid, pass.

    At each step the source furthest behind its share is served; all stops
    when a source ends its last allowed pass. The choice depends on all
    before it, so it runs in one task, over (source, uid, units) alone: a few
    bytes for each example. ``mix_parallel`` scales out.
    """
    if not weights or min(weights.values()) <= 0:
        raise ValueError("weights are positive, of one source at least")
    restarts = dict(restarts or {})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from random import Random

        rng, data = Random(seed), {}
        for b in batches:
            for s, u, n in zip(b["source"], b["uid"], b["units"]):
                data.setdefault(s, []).append((u, int(n)))
        names = list(weights)
        for n in names:
            if not data.get(n):
                raise ValueError(f"source {n} is empty")
        total = sum(weights.values())
        at = {n: [0, 0] for n in names}  # position, pass
        served = dict.fromkeys(names, 0)
        out, going = [], True
        while going:
            whole = sum(served.values())
            if whole <= 0:
                target, pick = rng.random() * total, names[-1]
                for n in names:
                    target -= weights[n]
                    if target <= 0:
                        pick = n
                        break
            else:
                behind = {n: weights[n] / total - served[n] / whole for n in names}
                most = max(behind.values())
                tied = [n for n in names if behind[n] >= most - 1e-12]
                pick = tied[0] if len(tied) == 1 else tied[rng.randrange(len(tied))]
            pos, turn = at[pick]
            uid, units = data[pick][pos]
            out.append((len(out), pick, uid, turn))
            served[pick] += units if by == "units" else 1
            at[pick][0] += 1
            if at[pick][0] == len(data[pick]):
                if turn >= restarts.get(pick, 0):
                    going = False
                else:
                    at[pick] = [0, turn + 1]
        yield pd.DataFrame(out, columns=["place", "source", "uid", "pass"])

    rows = streams.where(F.col("source").isin(list(weights))).select("source", "uid", "units", "ord")
    rows = rows.repartition(1).sortWithinPartitions("source", "ord")
    return rows.select("source", F.col("uid").cast("string").alias("uid"), "units").mapInPandas(run, "place bigint, source string, uid string, pass int")


def mix_parallel(streams: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """A mixture by target positions: source, uid, target. An example stands
    where its source's running units reach, relative to its weight; all after
    the first source's end is cut off. No order is forced: sort by ``target``."""
    from itertools import chain

    w = F.create_map(*chain.from_iterable((F.lit(k), F.lit(float(v))) for k, v in weights.items()))
    rows = streams.where(F.col("source").isin(list(weights))).withColumn("weight", F.element_at(w, F.col("source")))
    run = Window.partitionBy("source").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("target", F.sum("units").over(run) / F.col("weight"))
    end = rows.groupBy("source").agg(F.max("target").alias("e")).agg(F.min("e").alias("end"))
    return rows.join(F.broadcast(end), F.col("target") <= F.col("end")).select("source", "uid", "target")


def first_fit_buffer(lengths: Sequence[int], ends: Sequence[bool], starts: Sequence[bool], limit: int, fill: float, max_docs: int) -> list[int]:
    """The pack (place of its first example) of each example of a buffer."""
    pack, taken = list(range(len(lengths))), [False] * len(lengths)
    for i in range(len(lengths)):
        if taken[i] or lengths[i] >= fill * limit or not ends[i]:
            continue
        size, docs, closed = lengths[i], 1, ends[i]
        for j in range(i + 1, len(lengths)):
            if taken[j] or not starts[j]:
                continue
            gap = 0 if closed else 1
            if lengths[j] <= limit - size - gap:
                size, docs, closed = size + gap + lengths[j], docs + 1, ends[j]
                pack[j], taken[j] = i, True
                if docs >= max_docs or size >= fill * limit:
                    break
    return pack


def first_fit_packs(examples: DataFrame, limit: int = 1024, fill: float = 0.8, max_docs: int = 3, buffer: int = 200, order: str | Sequence[str] = "ord", group: str = "source") -> DataFrame:
    """uid, pack_uid: examples packed inside buffers of consecutive ones.
    Buffers are independent, so each is packed by itself."""
    order = [order] if isinstance(order, str) else list(order)
    w = Window.partitionBy(group).orderBy(*order)
    rows = examples.withColumn("buffer", F.floor((F.row_number().over(w) - 1) / buffer).cast("int"))

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(order, kind="stable")
        pack = first_fit_buffer(b["length"].tolist(), b["ends"].tolist(), b["starts"].tolist(), limit, fill, max_docs)
        return pd.DataFrame({"uid": b["uid"].to_numpy(), "pack_uid": b["uid"].to_numpy()[pack]})

    kind = dict(examples.dtypes)["uid"]
    return rows.select(group, "buffer", *order, "uid", "length", "ends", "starts").groupBy(group, "buffer").applyInPandas(run, f"uid {kind}, pack_uid {kind}")


def position_weights(mask: Column, bands: Sequence[tuple[int, float]], last: float) -> Column:
    """Loss weights by the place among the answer's tokens, by upper bounds."""

    def weight(place: Column) -> Column:
        out = None
        for bound, value in bands:
            out = F.when(place < bound, value) if out is None else out.when(place < bound, value)
        return (out.otherwise(last) if out is not None else F.lit(last)).cast("double")

    places = F.transform(mask, lambda m, i: F.struct(m.alias("m"), (F.aggregate(F.slice(mask, F.lit(1), i + 1), F.lit(0.0), lambda a, x: a + x) - 1).alias("p")))
    return F.transform(places, lambda s: F.when(s["m"] > 0, s["m"] * weight(s["p"])).otherwise(0.0))


def feedback_prompts(records: DataFrame, key: str = "record_id") -> DataFrame:
    """A row for each turn with the turns before it; only the last turn may
    lack an answer."""
    rows = records.select(key, "turns", F.posexplode("turns").alias("i", "t"))
    lacks = F.coalesce(F.col("t.completion"), F.lit("")) == ""
    bad = lacks & (F.col("i") < F.size("turns") - 1)
    rows = rows.withColumn("i", F.when(bad, F.raise_error(F.lit("an answer is missing before the last turn")).cast("int")).otherwise(F.col("i")))
    return rows.select(key, "i", F.slice("turns", F.lit(1), F.col("i")).alias("history"), F.col("t.prompt").alias("prompt"), F.nullif(F.col("t.completion"), F.lit("")).alias("completion"))


def ranked_scores(candidates: Column) -> Column:
    """Scores of candidates listed best first: n - 1 - place."""
    return F.transform(candidates, lambda c, i: (F.size(candidates) - 1 - i).cast("double"))


def scored_groups(df: DataFrame, scores: str = "scores") -> DataFrame:
    """Groups of two finite scores or more."""
    finite = F.filter(scores, lambda s: s.isNotNull() & ~F.isnan(s) & (F.abs(s) < float("inf")))
    return df.withColumn(scores, finite).where(F.size(scores) >= 2)
