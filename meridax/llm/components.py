"""Connected components of an edge table: alternating large-star and small-star rounds, each written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridax.llm._scratch import discard, staged


def _least(pairs: DataFrame) -> DataFrame:
    """For each u the smallest of its v and u, joined back to the pairs. Sums before the shuffle; a join that can be split serves hot nodes."""
    return pairs.join(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "u")


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, component) for all nodes of ``edges`` (u, v: long); the component is its smallest node. An empty table gives an empty result.

    A round's table goes once the next one is written; the last stays, since the result reads it.
    """
    now = staged(spark, edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        small = _least(large)
        before, now = now, staged(spark, small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u != v").distinct(), "edges")
        discard(spark, before)
        was, mark = mark, now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if was == mark:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
