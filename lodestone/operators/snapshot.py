"""Budgeted snapshots: weighted, stratified, oversampled, with splits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashing import h60


@dataclass(frozen=True)
class SourceQuota:
    src_id: str
    weight: float = 1.0
    min_len: int = 1
    max_len: int = 1 << 40
    oversampling: int = 1

    def __post_init__(self) -> None:
        if self.oversampling < 1 or self.weight < 0:
            raise ValueError("oversampling is at least 1, weight at least 0")


@dataclass(frozen=True)
class SnapshotSpec:
    snp_id: str
    sources: Sequence[SourceQuota]
    totals: Mapping[str, int]  # characters of each split, in order
    seed: int = 0
    excluded_languages: Sequence[str] = ()
    excluded_snapshots: Sequence[str] = field(default=())

    def __post_init__(self) -> None:
        if self.snp_id in self.excluded_snapshots:
            raise ValueError("a snapshot cannot exclude itself")


def quotas(spark: SparkSession, spec: SnapshotSpec) -> DataFrame:
    """A row for each source and pass: bounds, and the pass's budget of each
    split. Weights are of the order of sources; the table is tiny."""
    whole = sum(s.weight for s in spec.sources)
    rows = []
    for s in spec.sources:
        for k in range(s.oversampling):
            rows.append((s.src_id, k, s.oversampling, s.min_len, s.max_len, *(int(int(t * s.weight / whole) / s.oversampling) for t in spec.totals.values())))
    names = ", ".join(f"bud_{k} bigint" for k in spec.totals)
    return spark.createDataFrame(rows, f"src_id string, oversampling_index int, oversampling int, min_len bigint, max_len bigint, {names}")


def eligible(records: DataFrame, files: DataFrame, spec: SnapshotSpec, members: DataFrame | None = None) -> DataFrame:
    """Records in scope: with a length, of a wanted source, not in an
    excluded language (an unknown one goes once any is excluded), and not in
    an excluded snapshot."""
    r = records.where(F.col("rec_len") > 0).join(F.broadcast(files), "fle_id")
    r = r.where(F.col("src_id").isin([s.src_id for s in spec.sources]))
    if spec.excluded_languages:
        r = r.where(~F.col("rec_lan").isin(list(spec.excluded_languages)))
    if spec.excluded_snapshots:
        if members is None:
            raise ValueError("the members of excluded snapshots are missing")
        gone = members.where(F.col("snp_id").isin(list(spec.excluded_snapshots))).select("rec_id").distinct()
        r = r.join(gone, "rec_id", "left_anti")
    return r


def in_bounds(pool: DataFrame, quota: DataFrame) -> DataFrame:
    """Eligible records by pass, of a length within their source's bounds."""
    q = F.broadcast(quota.alias("q"))
    return pool.alias("p").join(q, (F.col("p.src_id") == F.col("q.src_id")) & F.col("p.rec_len").between(F.col("q.min_len"), F.col("q.max_len"))).select("p.*", *[F.col(f"q.{c}") for c in quota.columns if c != "src_id"])


def availability(pool: DataFrame, quota: DataFrame, spec: SnapshotSpec) -> DataFrame:
    """Requested and available characters of each source. The available ones
    count once for each pass; -1 stands for a source without a record."""
    first = quota.where("oversampling_index = 0")
    got = in_bounds(pool, first).groupBy("src_id").agg(F.sum("rec_len").alias("chars"), F.max("oversampling").alias("o"))
    whole = sum((F.col(f"bud_{k}") for k in list(spec.totals)[1:]), F.col(f"bud_{list(spec.totals)[0]}"))
    asked = quota.groupBy("src_id").agg(F.sum(whole).alias("requested_chars"))
    out = asked.join(F.broadcast(got), "src_id", "left")
    available = F.coalesce(F.col("chars") * F.col("o"), F.lit(-1))
    return out.select("src_id", "requested_chars", available.alias("available_chars"), (F.col("requested_chars") <= available).alias("feasible"))


def check_feasible(report: DataFrame) -> None:
    bad = report.where(~F.col("feasible")).orderBy("src_id").limit(20).collect()
    if bad:
        raise ValueError("not enough characters: " + ", ".join(f"{r['src_id']} wants {r['requested_chars']}, has {r['available_chars']}" for r in bad))


def select_members(pool: DataFrame, quota: DataFrame, spec: SnapshotSpec) -> DataFrame:
    """snp_id, split, rec_id, oversampling, h, src_id, rec_len.

    Within a source and pass, records are taken in the order of a seeded
    hash. A record goes to the first split whose cumulative bound still holds
    it; one that crosses the last bound is left out.
    """
    w = Window.partitionBy("src_id", "oversampling_index").orderBy("k")
    rows = in_bounds(pool, quota).withColumn("k", h60(F.col("rec_id"), F.lit("sample"), F.lit(spec.seed)))
    rows = rows.withColumn("cum", F.sum("rec_len").over(w))
    split, bound = None, F.lit(0)
    for name in spec.totals:
        bound = bound + F.col(f"bud_{name}")
        split = F.when(F.col("cum") <= bound, name) if split is None else split.when(F.col("cum") <= bound, name)
    rows = rows.withColumn("split", split).where(F.col("split").isNotNull())
    h = h60(F.col("rec_id"), F.col("oversampling_index"), F.lit("shuffle"), F.lit(spec.seed))
    return rows.select(F.lit(spec.snp_id).alias("snp_id"), "split", "rec_id", F.col("oversampling_index").alias("oversampling"), h.alias("h"), "src_id", "rec_len")


def missing_records(members: DataFrame, raw: DataFrame, examples: int = 3) -> DataFrame:
    """Members without a raw row, by source, with the first few ids."""
    gone = members.select("src_id", "rec_id").distinct().join(raw.select("rec_id"), "rec_id", "left_anti")
    w = Window.partitionBy("src_id").orderBy("rec_id")
    gone = gone.withColumn("rn", F.row_number().over(w))
    few = F.array_sort(F.collect_list(F.when(F.col("rn") <= examples, F.col("rec_id"))))
    return gone.groupBy("src_id").agg(F.count("*").alias("missing"), F.array_join(few, ",").alias("examples"))


def materialize(members: DataFrame, raw: DataFrame) -> DataFrame:
    """Raw rows of the members, by copy: one shuffled join instead of
    batches, and an order column in place of a sorted stream."""
    return members.select("split", "rec_id", "oversampling", "h").join(raw, "rec_id").withColumn("copy_id", F.concat_ws(".", "rec_id", F.col("oversampling").cast("string")))
