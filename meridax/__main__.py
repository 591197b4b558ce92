"""python -m meridax list | query NAME DATA OUT | backtest SETTINGS: run a registered query, or a backtest over a CSV panel."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession


def write(frame, path: str, kind: str) -> None:
    from meridax.sources import store

    {"csv": store.write_csv, "json": store.write_json, "parquet": lambda f, p: f.write.mode("overwrite").parquet(p)}[kind](frame, path)


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="meridax", description=__doc__)
    parser.add_argument("--master", help="Spark master; by default the one that spark-submit names, else all local cores")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list")
    query = commands.add_parser("query")
    query.add_argument("name")
    query.add_argument("data")
    query.add_argument("out")
    query.add_argument("--kind", choices=["parquet", "csv", "json"], default="parquet")
    commands.add_parser("backtest").add_argument("settings")
    given = parser.parse_args(arguments)

    from meridax import config
    from meridax.operators import backtest
    from meridax.registry import QUERIES
    from meridax.sources import panel

    if given.command == "list":
        print("\n".join(sorted(QUERIES)))
        return
    if given.command == "query" and given.name not in QUERIES:
        raise SystemExit(f"no such query: {given.name}")
    builder = SparkSession.builder.appName("meridax").config("spark.sql.session.timeZone", "UTC")
    spark = (builder.master(given.master) if given.master else builder).getOrCreate()
    if given.command == "query":
        write(QUERIES[given.name](spark, given.data), given.out, given.kind)
        return
    settings = config.load(given.settings)
    data, out = settings["data"], settings["output"]
    frame = panel.grid(panel.read_csv(spark, data["path"], data["start"], data["end"]))
    days = backtest.daily(frame, [config.rules_of(settings)])
    write(days, f"{out['path']}/days", out["kind"])
    write(backtest.summary(days), f"{out['path']}/summary", out["kind"])


if __name__ == "__main__":
    main()
