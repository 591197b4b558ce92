"""Seconds for the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from meridax.registry import QUERIES

# each query runs twice: the first time cold, then warm; "value" and "queries" are the cold runs, as in the first round
HEADLINE = "panel_daily grid_dense returns_padded momentum_top5 quality_6 mix_tanh rolling_cov_pairs universe_hysteresis kpis_basic walkforward_kpis trade_costs hrp_weights".split()


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took, warm = {}, {}
    for seconds in (took, warm):
        for name in HEADLINE:
            began = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "warm_value": round(sum(warm.values()), 3), "warm": warm, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
