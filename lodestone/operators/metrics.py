"""Evaluation metrics, curve fits, view statistics and vocabulary audits."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def token_metrics(losses: DataFrame, group: Sequence[str] = (), shards: int = 10, order: str = "ord") -> DataFrame:
    """Weighted loss, bits per byte, top-10 accuracy, and the standard error
    of the loss over contiguous shards. losses: loss, weight, hit, n_bytes."""
    w = Window.partitionBy(*group)
    place = F.row_number().over(w.orderBy(order)) - 1
    rows = losses.withColumns({"__i": place, "__n": F.count("*").over(w)})
    rows = rows.withColumn("shard", F.floor(F.col("__i") * shards / F.col("__n")).cast("int"))
    sums = [F.sum(F.col("loss") * F.col("weight")).alias("l"), F.sum("weight").alias("w"), F.sum(F.col("hit").cast("double") * F.col("weight")).alias("h"), F.sum("n_bytes").alias("b")]
    per = rows.groupBy(*group, "shard").agg(*sums).withColumn("m", F.col("l") / F.col("w"))
    out = [
        (F.sum("l") / F.sum("w")).alias("loss"),
        (F.sum("l") / F.sum("b") / F.ln(F.lit(2.0))).alias("bits_per_byte"),
        (F.sum("h") / F.sum("w")).alias("top10"),
        (F.stddev_samp("m") / F.sqrt(F.count("m").cast("double"))).alias("stderr"),
    ]
    return per.groupBy(*group).agg(*out) if group else per.agg(*out)


def banded_metric(sequences: DataFrame, value: str, boundaries: Sequence[int] = (2, 7)) -> DataFrame:
    """Mean of an array's values by bands of position; sequences shorter than
    the last boundary + 1 are left out."""
    rows = sequences.where(F.size(value) >= boundaries[-1] + 1).select(F.posexplode(value).alias("pos", "v"))
    band = None
    for i, b in enumerate(boundaries):
        band = F.when(F.col("pos") < b, i) if band is None else band.when(F.col("pos") < b, i)
    return rows.groupBy(band.otherwise(len(boundaries)).alias("band")).agg(F.count("*").alias("n"), F.avg("v").alias("mean"))


def run_matches(tokens: DataFrame, group: str, order: str, label: str, right: str) -> DataFrame:
    """Runs of equal labels: how many there are and how many are right as a
    whole."""
    w, by_label = Window.partitionBy(group).orderBy(order), Window.partitionBy(group, label).orderBy(order)
    rows = tokens.withColumn("__run", F.row_number().over(w) - F.row_number().over(by_label))
    runs = rows.groupBy(group, label, "__run").agg(F.bool_and(right).alias("ok"))
    return runs.groupBy(label).agg(F.count("*").alias("runs"), F.count_if("ok").alias("right_runs"))


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """Chance that one of k of the n samples, c of them right, is right."""
    miss = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(1.0), lambda a, i: a * (n - c - i).cast("double") / (n - i).cast("double"))
    return F.when(n < k, F.lit(None).cast("double")).when(n - c < k, F.lit(1.0)).otherwise(1.0 - miss)


def mean_loss(losses: DataFrame, group: Sequence[str]) -> DataFrame:
    """Mean loss by units, and units a second."""
    return losses.groupBy(*group).agg((F.sum(F.col("loss") * F.col("units")) / F.sum("units")).alias("loss"), (F.sum("units") / F.sum("seconds")).alias("per_second"))


def nearest_rank(df: DataFrame, value: str, percents: Sequence[int], group: Sequence[str] = ()) -> DataFrame:
    """sorted[(n - 1) * p // 100] for each p."""
    w = Window.partitionBy(*group)
    rows = df.select(*group, F.col(value).alias("v")).withColumns({"i": F.row_number().over(w.orderBy("v")) - 1, "n": F.count("*").over(w)})
    picks = [F.max(F.when(F.col("i") == F.floor((F.col("n") - 1) * p / 100), F.col("v"))).alias(f"p{p}") for p in percents]
    return rows.groupBy(*group).agg(*picks) if group else rows.agg(*picks)


def power_buckets(df: DataFrame, value: str) -> DataFrame:
    """Counts by the least power of two that holds the value."""
    bound = F.when(F.col(value) <= 1, F.lit(1).cast("bigint")).otherwise(F.pow(F.lit(2.0), F.ceil(F.log2(F.col(value).cast("double")))).cast("bigint"))
    return df.groupBy(bound.alias("bucket")).agg(F.count("*").alias("n"))


def char_classes(df: DataFrame, text: str) -> DataFrame:
    """Characters by class, as counts."""
    names = {"letters": r"\p{L}", "digits": r"\p{N}", "spaces": r"[\s ]", "punctuation": r"\p{P}"}
    counts = [F.sum(F.length(text) - F.length(F.regexp_replace(text, p, ""))).cast("bigint").alias(k) for k, p in names.items()]
    one = df.agg(*counts)
    return one.unpivot([], list(names), "class", "n")


def coverage(vocabulary: DataFrame, used: DataFrame, token: str = "token") -> DataFrame:
    """How much of a vocabulary a sample uses."""
    u = used.select(token).distinct().withColumn("used", F.lit(True))
    return vocabulary.select(token).distinct().join(u, token, "left").agg(F.count("*").alias("vocabulary"), F.count("used").alias("used"), F.count_if(F.col("used").isNull()).alias("unused"))


def flatten_results(df: DataFrame, results: str = "results") -> DataFrame:
    """map<collection, map<task, map<metric, double>>> as rows; a metric
    ``name,filter`` gives two columns."""
    a = df.select(F.explode(results).alias("collection", "tasks"))
    b = a.select("collection", F.explode("tasks").alias("task", "metrics"))
    c = b.select("collection", "task", F.explode("metrics").alias("m", "value")).where("value is not null")
    return c.select("collection", "task", F.split_part("m", F.lit(","), F.lit(1)).alias("metric"), F.split_part("m", F.lit(","), F.lit(2)).alias("filter"), "value")


def with_stderr(metrics: DataFrame, key: Sequence[str], metric: str = "metric", value: str = "value") -> DataFrame:
    """Each metric with its ``<name>_stderr`` sibling."""
    e = metrics.where(F.col(metric).endswith("_stderr"))
    e = e.select(*key, F.regexp_replace(metric, "_stderr$", "").alias(metric), F.col(value).alias("stderr"))
    return metrics.where(~F.col(metric).endswith("_stderr")).join(e, [*key, metric], "left")


def longest_prefix(ids: DataFrame, known: DataFrame, key: str, value: str, sep: str = ".") -> DataFrame:
    """The value of the longest known prefix of dotted ids; others are
    ``<unclassified>``."""
    parts = F.split(key, r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), sep))
    rows = ids.select(key, F.explode(prefixes).alias("__p"))
    k = known.select(F.col(known.columns[0]).alias("__p"), F.col(value))
    hit = rows.join(k, "__p").groupBy(key).agg(F.max_by(value, F.length("__p")).alias(value))
    return ids.join(hit, key, "left").withColumn(value, F.coalesce(value, F.lit("<unclassified>")))


def forward_fill(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The latest known value of each series at each step."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("latest", F.last(value, ignorenulls=True).over(w))


def retained(df: DataFrame, group: str, order: str, loss: str, newest: int) -> DataFrame:
    """Checkpoints to keep: the one of least loss, and the newest few."""
    best = F.row_number().over(Window.partitionBy(group).orderBy(loss, order))
    recent = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(order)))
    rows = df.withColumns({"is_best": best == 1, "is_recent": recent <= newest})
    return rows.where("is_best or is_recent")


def view_stats(df: DataFrame, counters: Sequence[str], shares: dict[str, tuple[str, str]]) -> DataFrame:
    """Summed counters, and percentages with denominators of at least 1."""
    one = df.agg(*[F.sum(c).cast("bigint").alias(c) for c in counters])
    return one.select("*", *[(F.lit(100.0) * F.col(a) / F.greatest(F.lit(1), F.col(b))).alias(k) for k, (a, b) in shares.items()])


def segment_stats(examples: DataFrame, group: str) -> DataFrame:
    """Tokens and loss tokens by segment; what the segments leave of an
    example (separators) goes to its first segment.

    examples: uid, n_tokens, n_loss, segments array<struct<..., tokens, loss>>.
    """
    s = examples.select("uid", "n_tokens", "n_loss", F.size("segments").alias("k"), F.posexplode("segments").alias("pos", "s"))
    w = Window.partitionBy("uid")
    rest = {"t": F.col("n_tokens") - F.sum("s.tokens").over(w), "l": F.col("n_loss") - F.sum("s.loss").over(w)}
    s = s.withColumns({k: F.when(F.col("pos") == 0, v).otherwise(0) for k, v in rest.items()})
    return s.groupBy(F.col(f"s.{group}").alias(group)).agg(
        F.countDistinct("uid").alias("examples"), F.count("*").alias("segments"), F.sum(F.col("s.tokens") + F.col("t")).cast("bigint").alias("tokens"),
        F.sum(F.col("s.loss") + F.col("l")).cast("bigint").alias("loss_tokens"), F.count_if(F.col("k") > 1).alias("packed"),
    )


def context_losses(encoded: DataFrame, group: Sequence[str]) -> DataFrame:
    """What the budget of a view cost its exchanges, by group.

    encoded: the rows of ``encode_turns`` with had_scratchpad and
    had_system; rejected exchanges are not part of a view.
    """
    dropped = F.col("history_size") - F.col("history_kept")
    return encoded.where(~F.col("rejected")).groupBy(*group).agg(
        F.count("*").alias("segments"),
        F.count_if(F.col("history_size") > 0).alias("with_history"),
        F.count_if(dropped > 0).alias("history_reduced"),
        F.sum(dropped).cast("bigint").alias("turns_dropped"),
        F.count_if("had_scratchpad").alias("with_scratchpad"),
        F.count_if(F.col("had_scratchpad") & ~F.col("has_scratchpad")).alias("scratchpad_removed"),
        F.count_if("had_system").alias("with_system"),
        F.count_if(F.col("had_system") & ~F.col("has_system")).alias("system_dropped"),
    )


def capacity(sources: DataFrame, budget: int) -> DataFrame:
    """Whether each mixture source lasts for the budget. sources: source,
    units, passes, allowed, weight."""
    share = F.col("weight") / F.sum("weight").over(Window.partitionBy())
    projected = F.col("units").cast("double") / F.col("passes") * F.col("allowed") / share
    return sources.select("source", projected.alias("projected"), F.when(projected < budget, "limiting").otherwise("probably_valid").alias("state"))


def power_law(df: DataFrame, group: str, least: int = 20, ratio: float = 2.0, grid: int = 64, steps: int = 60, local: int = 15) -> DataFrame:
    """loss = l + a * tokens^-alpha for each curve: a grid over l with least
    squares in logarithms, refined by golden sections. One small curve is one
    group."""

    def run(b: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        b = b.sort_values("tokens", kind="stable")
        t, y = b["tokens"].to_numpy(float), b["loss"].to_numpy(float)
        name = b[group].iloc[0]
        none = pd.DataFrame({group: pd.Series([], dtype=object), **{c: pd.Series([], dtype=float) for c in ("l", "a", "alpha", "r2", "alpha_local")}})
        good = np.isfinite(t).all() and np.isfinite(y).all() and (t > 0).all() and (y > 0).all()
        if len(t) < least or not good or t.max() / t.min() < ratio:
            return none

        def fit(l, t=t, y=y):
            with np.errstate(all="ignore"):
                u, v = np.log(t), np.log(y - l)
            if not np.isfinite(v).all() or ((u - u.mean()) ** 2).sum() <= 0:
                return None
            slope = ((u - u.mean()) * (v - v.mean())).sum() / ((u - u.mean()) ** 2).sum()
            whole = ((v - v.mean()) ** 2).sum()
            if slope >= 0 or whole <= 0:
                return None
            c = v.mean() - slope * u.mean()
            sse = ((v - c - slope * u) ** 2).sum()
            return sse, l, c, -slope, 1 - sse / whole

        lo, hi = y.min() * 1e-12, np.nextafter(y.min(), 0)
        at = [lo + (hi - lo) * i / grid for i in range(grid + 1)]
        tried = [(f[0], i, f) for i, l in enumerate(at) if (f := fit(l)) is not None]
        if not tried:
            return none
        _, i, best = min(tried)
        left, right, golden = at[max(0, i - 1)], at[min(grid, i + 1)], (5**0.5 - 1) / 2
        for _ in range(steps):
            x1, x2 = right - golden * (right - left), left + golden * (right - left)
            f1, f2 = fit(x1), fit(x2)
            s1, s2 = (f[0] if f else float("inf") for f in (f1, f2))
            if s1 <= s2:
                right = x2
            else:
                left = x1
            best = min([best, *(f for f in (f1, f2) if f)])
        near = fit(best[1], t[-local:], y[-local:])
        return pd.DataFrame({group: [name], "l": [best[1]], "a": [float(np.exp(best[2]))], "alpha": [best[3]], "r2": [best[4]], "alpha_local": [near[3] if near else None]})

    kind = dict(df.dtypes)[group]
    return df.select(group, "tokens", "loss").groupBy(group).applyInPandas(run, f"{group} {kind}, l double, a double, alpha double, r2 double, alpha_local double")
