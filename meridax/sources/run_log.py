"""The run log: one row per run with a map of flattened settings, metrics and notes, so that runs may differ in their keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "run_id string, entries map<string,string>"


def flattened(config, prefix: str = "") -> dict[str, str]:
    """Dotted keys of a nested mapping; members of lists get their place as key, missing values an empty string."""
    if isinstance(config, dict):
        items = config.items()
    elif isinstance(config, (list, tuple)):
        items = enumerate(config)
    else:
        return {prefix: "" if config is None else str(config)}
    out: dict[str, str] = {}
    for key, value in items:
        out |= flattened(value, f"{prefix}.{key}" if prefix else str(key))
    return out


def append_run(spark: SparkSession, path: str, run_id: str, config: dict, metrics: dict, notes: dict) -> None:
    entries = flattened(config) | flattened({"metric": metrics, "meta": notes})
    spark.createDataFrame([(run_id, entries)], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)
