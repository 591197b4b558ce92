"""Event-time windows over the stream of events, beyond what the panels need: one pass over what has arrived, with a watermark."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = 86_400_000_000


def daily_counts(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """(date, event_type, n, total) per day; on a stream a day is emitted once the watermark (latest event minus ``delay``) passes its end.

    Local timestamps are read as UTC, so that the session's time zone doesn't move the days.
    """
    at = F.expr("cast(concat(cast(cast(ts as timestamp_ntz) as string), 'Z') as timestamp)")
    dated = events.select(at.alias("at"), "event_type", F.col("value").cast("decimal(18,6)").alias("value")).withWatermark("at", delay)
    agg = dated.groupBy(F.window("at", "1 day"), "event_type").agg(F.count("*").alias("n"), F.sum("value").cast("double").alias("total"))
    return agg.select(F.date_add(F.lit("1970-01-01").cast("date"), F.expr(f"cast(unix_micros(window.start) div {DAY} as int)")).alias("date"), "event_type", "n", "total")


def user_sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """(user_id, started, n): spells of a user's events less than ``gap`` apart; on a stream a spell is emitted once the watermark passes its end. ``started`` counts microseconds."""
    at = F.expr("cast(concat(cast(cast(ts as timestamp_ntz) as string), 'Z') as timestamp)")
    spells = events.select(at.alias("at"), "user_id").withWatermark("at", delay).groupBy("user_id", F.session_window("at", gap).alias("spell")).agg(F.count("*").alias("n"))
    return spells.select("user_id", F.unix_micros("spell.start").alias("started"), "n")


def first_sightings(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each event once: repeated event_ids within the watermark go, and the state of older ones is dropped."""
    at = F.expr("cast(concat(cast(cast(ts as timestamp_ntz) as string), 'Z') as timestamp)")
    return events.withColumn("at", at).withWatermark("at", delay).dropDuplicatesWithinWatermark(["event_id"]).drop("at")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a session on one machine may leave it unset and uses the warehouse."""
    key, context = "spark.checkpoint.dir", spark.sparkContext
    path = spark.conf.get(key, None) or context.getConf().get(key, None)
    if not path and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
        raise ValueError(f"{key} must name a folder that the driver and all executors share")
    return (path or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def drained(spark: SparkSession, path: str, transform, folder: str | None = None) -> DataFrame:
    """Run ``transform`` over all files at ``path`` as a stream until none is left, into Parquet with a checkpoint; rerun on one ``folder`` to resume."""
    folder = folder or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).schema
    # as a pattern, since a stream takes a single file by pattern only
    made = transform(spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]"))
    made.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{folder}/out")
