"""MinHash signatures, LSH bands, duplicate edges, clusters and verdicts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import h60
from ..session import settle, spread

NGRAM, NUM_HASH, BANDS, ROWS = 5, 128, 16, 8
MIN_BUCKET, MAX_BUCKET = 2, 500
THRESHOLD = 0.75

# The constants of the splitmix64 generator.
GOLDEN, MIX_1, MIX_2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def words(text: Column) -> Column:
    """Unicode words of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), F.lit(0))


def ngrams(w: Column, n: int = NGRAM) -> Column:
    """n-grams of a column of words, joined by a space; none for fewer than
    n words. The words are a column, so they are not computed for each."""
    return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))


def splitmix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(MIX_1)
    x ^= x >> np.uint64(27)
    x *= np.uint64(MIX_2)
    x ^= x >> np.uint64(31)
    return x


def minhash(base: np.ndarray, num_hash: int, block: int = 4096) -> np.ndarray:
    """The least mixed value for each salt, as signed bits; all ones if there
    is no base hash. Done in blocks, so long texts need no large matrix."""
    salts = np.arange(1, num_hash + 1, dtype=np.uint64) * np.uint64(GOLDEN)
    out = np.full(num_hash, np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(base), block):
        out = np.minimum(out, splitmix(base[i : i + block, None] ^ salts).min(axis=0))
    return out.view(np.int64)


def signatures(records: DataFrame, text: str, num_hash: int = NUM_HASH, ngram: int = NGRAM, base: str = "h60") -> DataFrame:
    """``records`` with ``sig_vector``. base: ``h60`` (portable), or ``xxh3``
    (the XXH3-64 of each n-gram of the NFKC-normalised text)."""
    records = spread(records)
    if base == "h60":
        hashed = records.withColumn("__words", words(F.col(text)))
        hashed = hashed.withColumn("__base", F.transform(F.array_distinct(ngrams(F.col("__words"), ngram)), lambda g: h60(g))).drop("__words")

        @F.pandas_udf("array<bigint>")
        def sign(b: pd.Series) -> pd.Series:
            return b.map(lambda x: minhash(np.asarray(x, dtype=np.int64).view(np.uint64), num_hash))

        return hashed.withColumn("sig_vector", sign("__base")).drop("__base")

    @F.pandas_udf("array<bigint>")
    def sign_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import re
        import unicodedata

        import xxhash

        def one(t: str | None) -> np.ndarray:
            w = re.findall(r"\w+", unicodedata.normalize("NFKC", t or "").lower())
            grams = {" ".join(w[i : i + ngram]) for i in range(len(w) - ngram + 1)}
            return minhash(np.array([xxhash.xxh3_64_intdigest(g) for g in grams], dtype=np.uint64), num_hash)

        for s in batches:
            yield s.map(one)

    return records.withColumn("sig_vector", sign_text(text))


def bands(signed: DataFrame, band_size: int = ROWS) -> DataFrame:
    """rec_id, bnd_id, bnd_hash."""
    n = F.size("sig_vector")
    starts = F.sequence(F.lit(0), F.floor(n / band_size).cast("int") - 1)
    each = F.transform(starts, lambda i: F.xxhash64(F.slice("sig_vector", i * band_size + 1, F.lit(band_size))))
    return signed.select("rec_id", F.posexplode(each).alias("bnd_id", "bnd_hash"))


def check_bands(num_hash: int, band_size: int) -> None:
    if num_hash % band_size:
        raise ValueError("the number of hashes is not a multiple of the band size")


def candidate_pairs(band: DataFrame, reference: DataFrame | None = None, lowest: int = MIN_BUCKET, highest: int = MAX_BUCKET) -> DataFrame:
    """uid1, uid2, has_reference: distinct pairs that share a bucket.

    Buckets outside the size bounds are dropped whole; the size counts
    candidates and references. Candidates pair with larger ids, and with
    every reference in the bucket.
    """
    key = ["bnd_id", "bnd_hash"]
    every = band if reference is None else band.unionByName(reference)
    sizes = every.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n").between(lowest, highest)).select(*key)
    a = band.join(sizes, key, "left_semi")
    left, right = a.withColumnRenamed("rec_id", "uid1"), a.withColumnRenamed("rec_id", "uid2")
    pairs = left.join(right, key).where("uid2 > uid1").select("uid1", "uid2", F.lit(False).alias("has_reference"))
    if reference is not None:
        r = reference.join(sizes, key, "left_semi").withColumnRenamed("rec_id", "uid2")
        pairs = pairs.unionByName(left.join(r, key).select("uid1", "uid2", F.lit(True).alias("has_reference")))
    return pairs.distinct()


def similarity(a: Column, b: Column) -> Column:
    """Share of equal positions of two signatures."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return same.cast("double") / F.size(a).cast("double")


def edges(pairs: DataFrame, signed: DataFrame, reference: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    sig = signed.select("rec_id", "sig_vector")
    every = sig if reference is None else sig.unionByName(reference.select("rec_id", "sig_vector"))
    one, two = sig.toDF("uid1", "s1"), every.toDF("uid2", "s2")
    scored = pairs.join(one, "uid1").join(two, "uid2").withColumn("similarity", similarity(F.col("s1"), F.col("s2")))
    return scored.where(F.col("similarity") >= threshold).select("uid1", "uid2", "has_reference", "similarity")


def components(edge: DataFrame, rounds: int = 50) -> DataFrame:
    """id, component (smallest id), by label propagation with pointer jumps:
    each round takes the least label around, then the label of that label."""
    both = edge.select(F.col("uid1").alias("u"), F.col("uid2").alias("v"))
    both = settle(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    label = settle(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("c")), "labels")
    for _ in range(rounds):
        near = both.join(label.toDF("v", "c"), "v").groupBy("u").agg(F.min("c").alias("m"))
        step = label.join(near, "u").select("u", F.least("c", "m").alias("c"))
        step = settle(step, "labels")
        jump = step.join(step.toDF("p", "pc"), F.col("c") == F.col("p"), "left").select("u", F.least("c", F.coalesce("pc", "c")).alias("c"))
        jump = settle(jump, "labels")
        changed = jump.join(label.toDF("u", "old"), "u").where("c <> old").limit(1).count()
        label = jump
        if not changed:
            return label.select(F.col("u").alias("id"), F.col("c").alias("component"))
    raise RuntimeError("components did not settle")


def verdicts(component: DataFrame, edge: DataFrame, reference_ids: DataFrame | None = None) -> DataFrame:
    """rec_id, reason: what each cluster rejects.

    With a reference in the cluster every candidate goes; without one the
    smallest id, as a string, stays.
    """
    ref = edge.where("has_reference").select(F.col("uid2").alias("id")).distinct().withColumn("ref", F.lit(True))
    cand = edge.select(F.col("uid1").alias("id")).unionByName(edge.where("not has_reference").select(F.col("uid2").alias("id"))).distinct().withColumn("cand", F.lit(True))
    c = component.join(ref, "id", "left").join(cand, "id", "left")
    group = c.groupBy("component").agg(F.max(F.coalesce("ref", F.lit(False))).alias("any_ref"), F.min(F.when(F.col("cand"), F.col("id"))).alias("winner"))
    out = c.where("cand").join(group, "component").where(F.col("any_ref") | (F.col("id") != F.col("winner")))
    return out.select(F.col("id").alias("rec_id"), F.when(F.col("any_ref"), "reference").otherwise("within_snapshot").alias("reason"))


def dedup_stats(candidates: DataFrame, rejected: DataFrame) -> DataFrame:
    """Candidates and rejections by source and in all: level is ``source`` or
    ``total``."""
    c = candidates.join(rejected, "rec_id", "left")
    no = F.col("reason").isNotNull()
    measures = [
        F.count("*").alias("candidate_records"),
        F.coalesce(F.sum("rec_len"), F.lit(0)).alias("candidate_chars"),
        F.count_if(no).alias("rejected_records"),
        F.coalesce(F.sum(F.when(no, F.col("rec_len"))), F.lit(0)).alias("rejected_chars"),
        F.count_if(F.col("reason") == "reference").alias("by_reference"),
        F.count_if(F.col("reason") == "within_snapshot").alias("within_snapshot"),
    ]
    total = c.agg(*measures).select(F.lit("total").alias("level"), F.lit("").alias("src_id"), "*")
    return total.unionByName(c.groupBy("src_id").agg(*measures).select(F.lit("source").alias("level"), "*"))
