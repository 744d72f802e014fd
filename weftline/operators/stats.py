"""Dataset statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dataset_summary(seqs: DataFrame) -> DataFrame:
    """Requests, and min, mean, population deviation and max of length and of duration."""
    size, ms = F.size("call"), F.col("duration_ms")
    stats = [f(x).alias(f"{n}_{k}") for k, x in (("length", size), ("ms", ms)) for n, f in (("min", F.min), ("mean", F.avg), ("std", F.stddev_pop), ("max", F.max))]
    return seqs.groupBy("dataset").agg(F.count(F.lit(1)).alias("requests"), *stats)


def token_histogram(seqs: DataFrame, vocab: DataFrame, col: str, top: int = 9) -> DataFrame:
    """(rank, word, share): the top most frequent tokens (ties: the greater name first), then ``other``."""
    special = vocab.sparkSession.createDataFrame([(0, "[MASK]"), (1, "[UNKNOWN]"), (2, "[START]"), (3, "[END]"), (4, "[TRUNCATE]")], "idx int, word string")
    names = special.unionByName(vocab.select("idx", "word"))
    counts = seqs.select(F.explode(col).alias("idx")).groupBy("idx").agg(F.count(F.lit(1)).alias("c")).join(F.broadcast(names), "idx")
    shares = counts.crossJoin(F.broadcast(counts.agg(F.sum("c").alias("total")))).select("word", (F.col("c") / F.col("total")).alias("share"))
    ranked = shares.withColumn("rank", F.row_number().over(Window.orderBy(F.col("share").desc(), F.col("word").desc())))  # one row per word
    best = ranked.where(F.col("rank") <= top).select("rank", "word", "share")
    other = best.agg((1 - F.coalesce(F.sum("share"), F.lit(0.0))).alias("share")).select(F.lit(top + 1).alias("rank"), F.lit("other").alias("word"), "share")
    return best.unionByName(other)


def _histogram(values: DataFrame, lo, hi, bins: int) -> DataFrame:
    """values: (v, lo, hi); equal bins, the last one closed, empty ones included."""
    width = (F.col("hi") - F.col("lo")) / bins
    inside = values.where(F.col("v").between(F.col("lo"), F.col("hi")))
    place = F.when(width == 0, 0).otherwise(F.least(F.floor(F.try_divide(F.col("v") - F.col("lo"), width)), F.lit(bins - 1))).cast("int")
    counts = inside.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    return values.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(F.broadcast(counts), "bin", "left").select("bin", F.coalesce("c", F.lit(0)).alias("n"))


def duration_histogram(seqs: DataFrame, bins: int = 50, lo: float = 0.0, hi: float = 10.0) -> DataFrame:
    """D3: (bin, n) of the duration in ms; outside is ignored."""
    return _histogram(seqs.select(F.col("duration_ms").alias("v"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")), lo, hi, bins)


def length_histogram(seqs: DataFrame, bins: int = 50) -> DataFrame:
    """(bin, n) of the length, between the least and the greatest."""
    sizes = seqs.select(F.size("call").cast("double").alias("v"))
    ends = sizes.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    return _histogram(sizes.crossJoin(F.broadcast(ends)), None, None, bins)
