"""Panels: long tables of (date, asset, close, volume), from CSV files or from the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridax.sources.store import sources

PANEL = {"date": "date", "asset": "string", "close": "double", "volume": "double"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def check_panel(panel: DataFrame) -> DataFrame:
    missing = [c for c in PANEL if c not in panel.columns]
    if missing:
        raise ValueError(f"not a panel: no {', '.join(missing)}")
    return panel


def clean(panel: DataFrame) -> DataFrame:
    """Prices that aren't positive, volumes below 0 and NaN become null."""
    close, volume = (F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in ("close", "volume"))
    return check_panel(panel).withColumns({"date": F.to_date("date"), "close": F.when(close > 0, close), "volume": F.when(volume >= 0, volume)})


def read_csv(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """All CSV files of a folder; column names in any case; ``asset`` defaults to the file's stem. No file is an error."""
    sources(spark, path if "*" in path or path.endswith(".csv") else f"{path.rstrip('/')}/*.csv")
    raw = spark.read.option("header", True).csv(path)
    raw = raw.toDF(*[c.strip().lower() for c in raw.columns])
    for c in ("date", "close", "volume"):
        if c not in raw.columns:
            raise ValueError(f"no column {c}")
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv$", 1)
    asset = F.coalesce(F.col("asset"), stem) if "asset" in raw.columns else stem
    panel = clean(raw.select(F.expr("try_cast(date as date)").alias("date"), asset.alias("asset"), F.expr("try_cast(close as double)").alias("close"), F.expr("try_cast(volume as double)").alias("volume")))
    if start:
        panel = panel.where(F.col("date") >= F.lit(start).cast("date"))
    return panel.where(F.col("date") <= F.lit(end).cast("date")) if end else panel


def read_rates(spark: SparkSession, path: str) -> DataFrame:
    """(date, rate) from a semicolon file with lines before the header, dd/mm/yyyy dates and decimal commas: the first
    column that begins with a date, and the last with a number. The factor less 1 is the daily rate."""
    lines = spark.read.option("encoding", "ISO-8859-1").text(path)
    cells = F.split("value", ";")
    day = F.expr("try_to_timestamp(trim(cells[0]), 'dd/MM/yyyy')").cast("date")
    number = F.element_at(F.filter("cells", lambda x: F.trim(x).rlike(r"^[\d.]*\d(,\d+)?$")), -1)
    value = F.regexp_replace(F.regexp_replace(number, r"\.", ""), ",", ".").try_cast("double")
    return lines.select(cells.alias("cells")).where("size(cells) > 1").select(day.alias("date"), (value - 1).alias("rate")).where("date is not null and rate is not null")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(date, close, rebased) of a benchmark file with columns date and close, in any case and order; rebased to 1 at its first close."""
    from pyspark.sql import Window

    sources(spark, path)
    raw = spark.read.option("header", True).csv(path)
    raw = raw.toDF(*[c.strip().lower() for c in raw.columns])
    if missing := {"date", "close"} - set(raw.columns):
        raise ValueError(f"no column {', '.join(sorted(missing))}")
    known = raw.select(F.expr("try_cast(date as date)").alias("date"), F.expr("try_cast(close as double)").alias("close")).where("date is not null and close > 0").dropDuplicates(["date"])
    return known.withColumn("rebased", F.col("close") / F.first("close").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)))  # a row per date


def daily(spark: SparkSession, sf_dir: str, bucket: str = "day") -> DataFrame:
    """Line items as a panel: brands are assets, the unit price is the close. Sums of exact decimals, so that order doesn't matter."""
    date = F.to_date("l_shipdate") if bucket == "day" else F.to_date(F.trunc("l_shipdate", bucket))
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", date.alias("date"), "l_extendedprice", "l_quantity")
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("asset"))
    money, units = F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double")
    return lines.join(parts, lines["l_partkey"] == parts["p_partkey"]).groupBy("date", "asset").agg((money / units).alias("close"), units.alias("volume"))


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily(spark, sf_dir, "month")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    joined = orders.join(customers, orders["o_custkey"] == customers["c_custkey"])
    return joined.groupBy(F.to_date("o_orderdate").alias("date"), F.col("c_mktsegment").alias("asset")).agg((F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double") / F.count("*")).alias("close"), F.count("*").cast("double").alias("volume"))


def grid(panel: DataFrame) -> DataFrame:
    """The dense grid of dates and assets: rows that the panel lacks have nulls. Dates and assets, not rows, are crossed.

    Dates and assets are taken from the same columns and rows of the panel as its values, so that its last shuffle is made
    once and read thrice. Rows without a date or an asset have no place in it.
    """
    panel = panel.where("date is not null and asset is not null")
    used = F.sum(F.hash(*[c for c in panel.columns if c not in ("date", "asset")]).cast("long"))
    keys = lambda k: panel.groupBy(k).agg(used.alias("used")).where("used is not null").select(k)
    return keys("date").crossJoin(F.broadcast(keys("asset"))).join(panel, ["date", "asset"], "left")
