"""Operator 8: mixing sources to target weights by capped water-filling, in DataFrame operations only.

Sources by code point, null last, weigh 1, 2, 3, repeating. The mix is as large as the corpus. A source's target is
``weight * level``, at most ``max_epochs`` times its size; the level is set so that targets sum to the whole: what sources
at their cap can't take is shared by the weight of the others until none is above. With sources ordered by cap / weight,
the level follows from two running sums, so no loop is needed.

A source repeats each document floor(target / size) times. The rest of the target is drawn by a seeded order: hash
buckets in ascending order as far as they fit, then documents one by one in the bucket that crosses, so that the taken
words differ from the target by less than one document. Sums per bucket go through the shuffle, not documents.

Words are ``[^\\x20\\x09-\\x0D]+``; null or empty text has size 0 and is taken 0 times in words. Null sources form one
source. Rows with equal ids and texts are drawn together. Extra columns pass through, but for those named like what ``mixed`` makes,
which it replaces. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meridax.llm._columns import apart
from meridax.llm._scratch import staged


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, *, cycle: int = 3, max_epochs: int = 3) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row for each source. Windows run over sources only."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("weight", ((F.row_number().over(by_name) - 1) % cycle + 1).cast("double")).withColumn("cap", (max_epochs * F.col("source_size")).cast("double"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    # if exactly the sources before this one are at their cap, the level is what is left over the weight of the others
    levels = weighed.withColumn("level", (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    fits = F.col("level") * F.col("weight") <= F.col("cap")
    out = levels.withColumn("fit", F.when(fits, F.struct(F.row_number().over(by_cap).alias("i"), F.col("level").alias("x"))))
    out = out.withColumn("level", F.min("fit").over(Window.partitionBy())["x"])
    return out.select("source", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def mixed(docs: DataFrame, *, cycle: int = 3, max_epochs: int = 3, seed: int = 17, broadcast_sources: int = 10_000) -> DataFrame:
    """``docs`` with size, source_size, target and times (whole repetitions plus 0 or 1), the number of copies the mix takes.

    ``broadcast_sources``: the plan, a row for each source, is broadcast up to so many; a larger one is joined.
    """
    docs, back = apart(docs, ["size", "source_size", "target", "times"], ["doc_id", "text", "source"])
    spot = F.xxhash64(F.lit(seed), "doc_id", "text")
    bucket = F.shiftrightunsigned(spot, 52).cast("int")
    sized = docs.withColumn("mix_size", word_count(F.col("text"))).withColumn("mix_spot", spot).withColumn("mix_bucket", bucket)
    by_bucket = staged(docs.sparkSession, sized.groupBy("source", "mix_bucket").agg(F.sum("mix_size").alias("words")), "mix-buckets")
    few = by_bucket.select("source").distinct().count() <= broadcast_sources
    sent = F.broadcast if few else (lambda frame: frame)
    targets = source_targets(by_bucket.groupBy("source").agg(F.sum("words").alias("source_size")), cycle=cycle, max_epochs=max_epochs)
    targets = targets.withColumn("whole", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("int"))
    targets = targets.withColumn("part", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    t, b = targets.alias("t"), by_bucket.alias("b")
    upto = Window.partitionBy("source").orderBy("mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    edges = (
        b.join(t, F.col("b.source").eqNullSafe(F.col("t.source")))
        .select("t.*", "b.mix_bucket", "b.words")
        .withColumn("below", F.coalesce(F.sum("words").over(upto), F.lit(0)))
        .groupBy("source", "source_size", "target", "whole", "part")
        # the first bucket that doesn't fit, and what is left for it
        .agg(F.min(F.when(F.col("below") + F.col("words") > F.col("part"), F.struct("mix_bucket", (F.col("part") - F.col("below")).alias("left")))).alias("edge"))
    )
    crossing = sized.alias("d").join(sent(edges).alias("e"), F.col("d.source").eqNullSafe(F.col("e.source")) & (F.col("d.mix_bucket") == F.col("e.edge.mix_bucket")))
    drawn = (
        crossing.select("d.source", "d.mix_spot", "d.mix_size", "e.edge.left")
        .groupBy("source", "mix_spot", "left")
        .agg(F.sum("mix_size").alias("words"))
        .withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy("mix_spot")))
        .where("upto - words / 2 <= left")
        .groupBy("source")
        .agg(F.max("mix_spot").alias("last"))
    )
    plan = edges.alias("e").join(drawn.alias("l"), F.col("e.source").eqNullSafe(F.col("l.source")), "left").select("e.*", F.col("l.last"))
    joined = sized.alias("d").join(sent(plan).alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")))
    place, edge = F.col("d.mix_bucket"), F.col("p.edge.mix_bucket")
    more = F.when(edge.isNull() | (place < edge) | ((place == edge) & (F.col("d.mix_spot") <= F.col("p.last"))), 1).otherwise(0)
    more = F.when(F.col("p.part") > 0, more).otherwise(0)
    return joined.select(*back, F.col("d.mix_size").alias("size"), F.col("p.source_size").alias("source_size"), F.col("p.target").alias("target"), (F.col("p.whole") + more).alias("times"))


def mix_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as many times as the mix takes it, with its columns."""
    own = [f"c{i}" for i in range(len(docs.columns))]
    named = docs.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(docs.columns, own)], *[F.col(c) for c in ("doc_id", "text", "source")])
    taken = mixed(named, **options).where("times > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), "times"))).select(*[F.col(o).alias(c) for c, o in zip(docs.columns, own)])


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mixed(docs).select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).cast("long").alias("taken"))
