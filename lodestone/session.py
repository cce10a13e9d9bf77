"""Session helpers: configuration, shared checkpoint folder, parquet tables."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_OWN: dict[str, str | None] = {}


def build_session(app: str = "lodestone", master: str | None = None, shuffle_partitions: int = 8) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow on."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    return (
        b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables below ``sf_dir`` (any path Spark can read)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, share: int = 4) -> DataFrame:
    """``df`` dealt to all cores if it has fewer than a ``share``-th as many
    partitions, as a small table in one row group has; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * share <= cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset
    (a local test) a temporary folder of this machine is taken.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = _OWN.setdefault("dir", None) or tempfile.mkdtemp(prefix="lodestone-")
        _OWN["dir"] = d
    return d.rstrip("/")


def settle(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage; a lost executor costs no recomputation. The
    shuffle files behind the written rows are no longer of use then: a
    collection of garbage on the driver lets Spark remove them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._settled = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the folder of a settled table that nothing reads any more."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._settled)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
