"""Conflict-constrained best-fit packing of texts into fixed-size bins.

Lengths are counted in words. A text longer than a bin fills whole bins of
its own; its rest is packed like a short text. Items are dealt at random, by
a hash of their id, to shards of bounded size, and each shard is packed by
itself: longest item first, into the fullest bin that has room and no
conflict, else into a new one. A bin never holds two items of one duplicate
cluster, nor more than ``per_source`` items of one source.

Bins are ordered by what is left in them. A tree over the residuals carries,
for each range, the sources that are full in *all* of its bins; so the
successor search passes over ranges where every bin is in conflict, and goes
on to the next tightest bin until it finds a compatible one.

Defined results: null and empty texts have no words and take no room; they
come with bin -1. Ties go to the lower id, then the older bin. Repeated rows
are items of their own (in conflict with each other, as copies). Other
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .native import pieces

CAPACITY = 2048  # words
SHARD_ITEMS = 4096  # expected items of a shard
PER_SOURCE = 2


class BinTree:
    """Open bins by residual, with conflict bitmaps."""

    def __init__(self, capacity: int):
        self.size = 1
        while self.size < capacity + 1:
            self.size *= 2
        self.full = [-1] * (2 * self.size)  # -1: all bits, for no bin at all
        self.bins: dict[int, list[int]] = {}  # residual -> bins, oldest first
        self.sources: list[int] = []  # sources that are full in a bin
        self.clusters: list[int] = []

    def _refresh(self, residual: int) -> None:
        v = -1
        for b in self.bins.get(residual, ()):
            v &= self.sources[b]
        i = residual + self.size
        self.full[i] = v
        i //= 2
        while i:
            self.full[i] = self.full[2 * i] & self.full[2 * i + 1]
            i //= 2

    def add(self, b: int, residual: int) -> None:
        at = self.bins.setdefault(residual, [])
        at.append(b)
        at.sort()
        self._refresh(residual)

    def remove(self, b: int, residual: int) -> None:
        self.bins[residual].remove(b)
        self._refresh(residual)

    def _next(self, low: int, source: int) -> int:
        """The least residual from ``low`` on with a bin open to source."""
        i = low + self.size
        if not self.full[i] & source and self.full[i] != -1:
            return low
        while i > 1:
            if i % 2 == 0 and self._open(i + 1, source):
                i += 1
                while i < self.size:
                    i = 2 * i if self._open(2 * i, source) else 2 * i + 1
                return i - self.size
            i //= 2
        return -1

    def _open(self, i: int, source: int) -> bool:
        return self.full[i] != -1 and not self.full[i] & source

    def find(self, need: int, source: int, cluster: int) -> tuple[int, int]:
        """The tightest compatible bin and its residual, or (-1, -1)."""
        r = self._next(need, source)
        while r >= 0:
            for b in self.bins[r]:
                if not self.sources[b] & source and not self.clusters[b] & cluster:
                    return b, r
            r = self._next(r + 1, source) if r + 1 < self.size else -1
        return -1, -1


def pack(sizes: list[int], sources: list, clusters: list, capacity: int = CAPACITY, per_source: int = PER_SOURCE) -> list[int]:
    """The bin of each item; items come in packing order."""
    s_bit = {s: 1 << i for i, s in enumerate(dict.fromkeys(sources))}
    seen: dict = {}
    for c in clusters:
        seen[c] = seen.get(c, 0) + 1
    c_bit = {c: 1 << i for i, c in enumerate(c for c, n in seen.items() if n > 1)}
    tree, counts, out = BinTree(capacity), [], []
    for size, source, cluster in zip(sizes, sources, clusters):
        s, c = s_bit[source], c_bit.get(cluster, 0)
        b, r = tree.find(size, s, c)
        if b < 0:
            b, r = len(counts), capacity
            counts.append({})
            tree.sources.append(0)
            tree.clusters.append(0)
        else:
            tree.remove(b, r)
        counts[b][s] = counts[b].get(s, 0) + 1
        if counts[b][s] >= per_source:
            tree.sources[b] |= s
        tree.clusters[b] |= c
        if r > size:
            tree.add(b, r - size)
        out.append(b)
    return out


def best_fit(documents: DataFrame, text: str = "text", id_column: str = "doc_id", source: str = "source", cluster: str | None = None, capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """A row for each piece of a text: id, piece, start (first word), n_words,
    bin, used (words in the bin before it).

    ``cluster`` names a column of duplicate clusters; without it texts that
    are equal form one.
    """
    kind = dict(documents.dtypes)[id_column]
    items = documents.select(
        F.col(id_column).alias("id"),
        F.col(source).cast("string").alias("source"),
        (F.col(cluster).cast("string") if cluster else F.md5(text)).alias("cluster"),
        F.size(pieces(F.col(text), r" \x09-\x0D")).alias("n"),
    )
    shards = max(1, -(-documents.count() // shard_items))
    shard = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(9)), F.lit(shards)).cast("int")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        g = group.assign(rest=group["n"] % capacity, key=group["id"].astype("string").fillna(""))
        g = g.sort_values(["rest", "id", "cluster"], ascending=[False, True, True], kind="stable", na_position="first")
        packed = g[g["rest"] > 0]
        bins = pack(packed["rest"].tolist(), packed["source"].fillna("").tolist(), packed["cluster"].fillna("").tolist(), capacity, per_source)
        base = int(group["shard"].iloc[0]) << 32
        rows = [pd.DataFrame({"id": packed["id"], "piece": packed["n"] // capacity, "start": packed["n"] - packed["rest"], "n_words": packed["rest"], "bin": np.array(bins, dtype=np.int64) + base})]
        rows[0]["used"] = rows[0].groupby("bin")["n_words"].cumsum() - rows[0]["n_words"]
        long = g[g["n"] >= capacity]
        many = (long["n"] // capacity).to_numpy()
        k = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        first = base + (max(bins) + 1 if bins else 0)
        rows.append(pd.DataFrame({"id": long["id"].repeat(many), "piece": k, "start": k * capacity, "n_words": capacity, "bin": first + np.arange(len(k)), "used": 0}))
        none = g[g["n"] == 0]
        rows.append(pd.DataFrame({"id": none["id"], "piece": 0, "start": 0, "n_words": 0, "bin": -1, "used": 0}))
        return pd.concat([r for r in rows if len(r)] or rows[:1], ignore_index=True)[["id", "piece", "start", "n_words", "bin", "used"]]

    schema = f"id {kind}, piece int, start int, n_words int, bin bigint, used int"
    return items.withColumn("shard", shard).groupBy("shard").applyInPandas(run, schema).withColumnRenamed("id", id_column)
