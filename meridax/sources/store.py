"""Result tables that are kept and found again by what they were made from, and plain sinks."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, path: str) -> bool:
    system, path = _path(spark, path)
    return system.exists(path)


def sources(spark: SparkSession, pattern: str) -> list[str]:
    """Files that match a pattern, in order of name; FileNotFoundError if there are none."""
    system, path = _path(spark, pattern)
    found = sorted(str(x.getPath()) for x in system.globStatus(path) or [])
    if not found:
        raise FileNotFoundError(f"no source matches {pattern}")
    return found


def key_of(**made_from) -> str:
    """A name for what a table was made from: dates, parameters, the signature of its sources."""
    return hashlib.sha256(json.dumps(made_from, sort_keys=True, default=str).encode()).hexdigest()[:16]


def signature(spark: SparkSession, pattern: str) -> str:
    """A name for the present state of the sources: paths, sizes and times of change."""
    system, _ = _path(spark, pattern)
    files = [system.getFileStatus(spark._jvm.org.apache.hadoop.fs.Path(p)) for p in sources(spark, pattern)]
    return key_of(files=[(str(f.getPath()), f.getLen(), f.getModificationTime()) for f in files])


def cached(spark: SparkSession, folder: str, name: str, make: Callable[[], DataFrame], **made_from) -> DataFrame:
    """The table of this name and origin: read if it was written whole before, else made, written and read back."""
    path = f"{folder.rstrip('/')}/{name}-{key_of(**made_from)}"
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_csv(frame: DataFrame, path: str, order: list[str] | None = None) -> None:
    """CSV with a header; ordered tables are ranged by their keys, so that the files in order of name are the order."""
    (frame.repartitionByRange(*order).sortWithinPartitions(*order) if order else frame).write.mode("overwrite").option("header", True).csv(path)


def write_json(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").json(path)


def append_metrics(frame: DataFrame, path: str, run_id: str) -> None:
    """One row per metric, (run_id, metric, value), appended."""
    numbers = [c for c, t in frame.dtypes if t in ("double", "float", "int", "bigint")]
    frame.select(*[F.col(c).cast("double") for c in numbers]).unpivot([], numbers, "metric", "value").select(F.lit(run_id).alias("run_id"), "metric", "value").write.mode("append").parquet(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
