"""Functions on the parallel arrays of a request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ARRAYS = ("call", "proc", "entry", "duration", "pid", "tid", "ret")
TRUNCATE = 4


def tag_select(tags: Column, n_categories: int) -> Column:
    """One granularity of each a-b-c-d tag."""
    place = {4: 0, 6: 1, 8: 2}.get(n_categories, 3)
    return F.transform(tags, lambda t: F.get(F.split(t, "-"), F.lit(place)).cast("int"))


def truncate(seqs: DataFrame, max_token: int, columns: tuple[str, ...] = ARRAYS) -> DataFrame:
    """The first max_token items, then one item that says so (4 for call and proc, 0 for the rest)."""
    fill = lambda c: F.array(F.lit(TRUNCATE if c in ("call", "proc") else 0).cast(seqs.schema[c].dataType.elementType))
    return seqs.withColumns({c: F.when(F.size(c) > max_token, F.concat(F.slice(c, 1, max_token), fill(c))).otherwise(F.col(c)) for c in columns})


def shift_target(seqs: DataFrame, columns: tuple[str, ...] = ARRAYS) -> DataFrame:
    """Inputs without the last item; target is the next call."""
    shifted = {c: F.slice(F.col(c), F.lit(1), F.greatest(F.size(c) - 1, F.lit(0))) for c in columns}
    return seqs.withColumns(shifted | {"target": F.slice(F.col("call"), F.lit(2), F.greatest(F.size("call") - 1, F.lit(0)))})


def pad_batch(seqs: DataFrame, batch: int, column: str = "call") -> DataFrame:
    """Batches of consecutive ordinals (rn), zero-padded to the longest; mask marks the zeros."""
    numbered = seqs.withColumn("batch_id", F.floor((F.col("rn") - 1) / batch).cast("bigint"))
    longest = numbered.groupBy("dataset", "batch_id").agg(F.max(F.size(column)).alias("longest"))
    padded = F.concat(F.col(column), F.array_repeat(F.lit(0).cast(seqs.schema[column].dataType.elementType), F.col("longest") - F.size(column)))
    out = numbered.join(longest, ["dataset", "batch_id"]).withColumn(column, padded).drop("longest")
    return out.withColumn("mask", F.transform(column, lambda v: v == 0))


def limit_shard(seqs: DataFrame, max_sample: int | None = None, shard: int = 0, n_shards: int = 1) -> DataFrame:
    """The first max_sample ordinals; of these shard r of s takes every s-th."""
    kept = seqs if max_sample is None else seqs.where(F.col("rn") <= max_sample)
    return kept.where(F.pmod(F.col("rn") - 1, F.lit(n_shards)) == shard)


def ordinal_encode(tag: Column, n_category: int) -> Column:
    """Bit j says tag >= j, j = 2 .. n_category - 1."""
    return F.transform(F.sequence(F.lit(2), F.lit(n_category - 1)), lambda j: F.when(tag >= j, 1).otherwise(0))


def ordinal_decode(bits: Column) -> Column:
    return F.aggregate(bits, F.lit(1), lambda a, b: a + b)


def log_extremes(df: DataFrame, event: str, value: str, eps: float = 1e-6) -> DataFrame:
    """(event, low, high): the extremes of the logarithms, to scale other rows by those of the train requests."""
    logs = F.log(F.col(value) + eps)
    return df.groupBy(event).agg(F.min(logs).alias("low"), F.max(logs).alias("high"))


def log_minmax_by_event(df: DataFrame, event: str, value: str, eps: float = 1e-6, extremes: DataFrame | None = None) -> DataFrame:
    """``scaled``: logarithm scaled to 0 .. 1 by event; 0 where an event has one value only.

    extremes: those of ``log_extremes`` over other rows, by which values may lie outside 0 .. 1 and events without any are
    null; else those of df.
    """
    ends = (log_extremes(df, event, value, eps) if extremes is None else extremes).select(F.col(event).alias("__event"), "low", "high")
    scaled = F.when(F.col("high") == F.col("low"), 0.0).otherwise((F.log(F.col(value) + eps) - F.col("low")) / (F.col("high") - F.col("low")))
    return df.join(ends, F.col(event).eqNullSafe(F.col("__event")), "left").withColumn("scaled", scaled).drop("__event", "low", "high")
