"""Named presets, their expansion, catalogues of tables, and manifests of
older versions. All of it is small and runs on the driver."""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Callable, Iterable, Mapping
from typing import Any, TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")
MANIFEST_VERSION = 6


def find(presets: Iterable[T], names: str, aliases: Callable[[T], Iterable[str]]) -> list[T]:
    """The presets of a comma-separated list of names, in any case."""
    known = {a.lower(): p for p in reversed(list(presets)) for a in aliases(p)}
    wanted = [n.strip().lower() for n in names.split(",")]
    if missing := [n for n in wanted if n not in known]:
        raise ValueError(f"unknown: {', '.join(missing)}")
    return [known[n] for n in wanted]


def by_split(preset: T, splits: Mapping[str, str], uid: str = "uid", name: str = "name", split: str = "split") -> list[T]:
    """A preset for each split; ``splits`` maps names to aliases."""
    pairs = [(str(k).strip(), str(v).strip()) for k, v in splits.items()]
    if not pairs or not all(k and v for k, v in pairs):
        raise ValueError("splits have a name and an alias, and there is one at least")
    for side in zip(*pairs):
        if len(set(side)) < len(side):
            raise ValueError(f"given twice: {sorted(x for x in set(side) if side.count(x) > 1)}")
    return [dataclasses.replace(preset, **{uid: f"{getattr(preset, uid)}-{v}", name: f"{getattr(preset, name)}-{k}", split: k}) for k, v in pairs]


def catalogue(spark: SparkSession, root: str) -> DataFrame:
    """config, split, file, bytes of parquet files ``root/config/split/*``, in
    any store that Spark reads; only names and sizes are read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(root)
    part = F.reverse(F.split("path", "/"))
    return found.select(F.get(part, F.lit(2)).alias("config"), F.get(part, F.lit(1)).alias("split"), F.col("path").alias("file"), F.col("length").alias("bytes"))


def resolve(files: DataFrame, split: str, config: str | None = None) -> list[str]:
    """Files of a split. Without a config: ``default``, or else the only one."""
    if config is None:
        configs = sorted(r[0] for r in files.select("config").distinct().collect())
        if "default" not in configs and len(configs) != 1:
            raise ValueError(f"choose a config: {', '.join(configs)}")
        config = "default" if "default" in configs else configs[0]
    rows = files.where((F.col("config") == config) & (F.col("split") == split)).orderBy("file").select("file").collect()
    if not rows:
        raise ValueError(f"{config}/{split}: no file")
    return [r[0] for r in rows]


def _mark_format(task: Any, wrapper: str) -> None:
    """Tasks from before answers had a format keep the one they had."""
    if isinstance(task, dict) and str(task.get("wrapper_class", "")).strip() == wrapper:
        if task.get("params") is None:
            task["params"] = {}
        if isinstance(task["params"], dict):
            task["params"].setdefault("assistant_format", "legacy")


def migrated(manifest: Mapping[str, Any], wrapper: str = "CausalLmTaskWrapper") -> dict[str, Any]:
    """A manifest in the form of the present version.

    2 marks the task's answer format, 3 and 4 rename the configuration there
    and back, 5 marks the format of all task configurations, 6 changes no row.
    """
    out = json.loads(json.dumps(manifest))
    version = int(out.get("version", 1))
    if version < 1:
        raise ValueError(f"unknown version: {version}")

    def config() -> dict[str, Any]:
        c = out.get("configuration")
        return c if isinstance(c, dict) else {}

    def renamed(old: str, new: str) -> None:
        if new not in out:
            c = out.pop(old, None)
            if isinstance(c, dict):
                out[new] = c

    def tasks() -> None:
        some = config().get("evaluation_configs")
        for c in [config(), *(some if isinstance(some, list) else [])]:
            _mark_format(c.get("task_config") if isinstance(c, dict) else None, wrapper)

    steps = {1: lambda: _mark_format(config().get("task"), wrapper), 2: lambda: renamed("configuration", "configs"), 3: lambda: renamed("configs", "configuration"), 4: tasks, 5: lambda: None}
    while version < MANIFEST_VERSION:
        steps[version]()
        version += 1
    out["version"] = version
    return out


def migrated_column(c):
    """Manifests as JSON text, each in the form of the present version."""

    @F.pandas_udf("string")
    def run(s):
        return s.map(lambda x: None if x is None else json.dumps(migrated(json.loads(x)), sort_keys=True))

    return run(c)
