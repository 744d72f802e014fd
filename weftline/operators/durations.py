"""Duration spans and latency tags (C11-C14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators import util

LEVELS = (4, 6, 8, 10)


def shares(n_categories: int) -> list[float]:
    """Boundaries as shares of the rows: classes get K, K-1, ... parts of K(K+1)/2."""
    k = n_categories - 1
    return [sum(k - j + 1 for j in range(1, i + 1)) / (k * (k + 1) / 2) for i in range(1, k)]


def level_spans(paired: DataFrame, levels: tuple[int, ...] = LEVELS, by: tuple[str, ...] = ("sysname",)) -> DataFrame:
    """C11: (n_categories, by, boundaries, n) of all levels in one pass: exact interpolated percentiles of the counted latencies, by selection of ranks (``util.quantiles``)."""
    counted = paired.where("paired").groupBy(*by, "latency").agg(F.count(F.lit(1)).alias("c"))
    both = util.quantiles(counted, list(by), "latency", "c", [s for level in levels for s in shares(level)], "b")
    starts = [1 + sum(level - 2 for level in levels[:i]) for i in range(len(levels))]
    parts = F.array(*[F.struct(F.lit(level).alias("n_categories"), F.slice("b", at, level - 2).alias("boundaries")) for level, at in zip(levels, starts)])
    return both.select(*by, "n", F.inline(parts)).select(*by, "boundaries", "n", "n_categories")


def duration_spans(paired: DataFrame, n_categories: int, by: tuple[str, ...] = ("sysname",)) -> DataFrame:
    """C11 for one level."""
    return level_spans(paired, (n_categories,), by)


def chunk_pools(paired: DataFrame, numbered: DataFrame, chunk: int, carry: int = 20, bucket: int = 4096, first: int | None = None) -> DataFrame:
    """Paired rows by chunk of completed requests, each chunk with the last ``carry`` rows of its call from before.

    The chunk 0 has ``first`` requests (default: ``chunk``), the others ``chunk``. The last one also takes the rows after the last
    request. Of the driver's values only the number of requests is used.
    """
    first = chunk if first is None else first
    last = numbered.agg(F.max("rn")).first()[0] or 0
    number = F.when(F.col("rn") <= first, 0).otherwise(F.floor((F.col("rn") - first - 1) / chunk) + 1).cast("bigint")
    chunks = (1 if last else 0) + -(-max(0, last - first) // chunk)
    ends = numbered.groupBy(number.alias("chunk")).agg(F.max("request_id").alias("chunk_end"))
    rows = util.next_point(paired.where("paired").select("sysname", "seq", "latency"), ends.select("chunk_end"), "seq", "chunk_end", bucket)
    ends = util.cut(ends)
    rows = rows.join(util.bounded(ends.withColumnRenamed("chunk_end", "__e")), F.col("chunk_end") == F.col("__e"), "left").withColumn("chunk", F.coalesce("chunk", F.lit(chunks - 1))).drop("__e", "chunk_end")
    rows = util.cut(util.ordinal(rows, ["sysname"], ["seq"], "i"))
    per = rows.groupBy("sysname", "chunk").agg(F.count(F.lit(1)).alias("m"))
    grid = per.groupBy("sysname").agg(F.min("chunk").alias("c0")).select("sysname", F.explode(F.sequence(F.col("c0"), F.lit(max(chunks - 1, 0)).cast("bigint"))).alias("chunk"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy("sysname").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    grid = grid.join(per, ["sysname", "chunk"], "left").select("sysname", "chunk", before.alias("b"))
    wanted = grid.where("b > 0").select("sysname", "chunk", F.explode(F.sequence(F.greatest(F.lit(1), F.col("b") - carry + 1), F.col("b"))).alias("i"))
    carried = wanted.join(rows.select("sysname", "i", "latency"), ["sysname", "i"]).select("sysname", "chunk", "latency")
    return rows.select("sysname", "chunk", "latency").unionByName(carried).withColumn("paired", F.lit(True))


def spans_merge(chunk_spans: DataFrame) -> DataFrame:
    """Boundaries of chunks 0 .. k averaged by their counts: (chunk, n_categories, sysname, pos, boundary, n)."""
    rows = chunk_spans.select("chunk", "n_categories", "sysname", "n", F.posexplode("boundaries").alias("pos", "b"))
    w = Window.partitionBy("n_categories", "sysname", "pos").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)  # one row a chunk
    return rows.select("chunk", "n_categories", "sysname", "pos", (F.sum(F.col("b") * F.col("n")).over(w) / F.sum("n").over(w)).alias("boundary"), F.sum("n").over(w).alias("n"))


def tag(name: Column, value: Column, boundaries: Column) -> Column:
    above = F.size(F.filter(boundaries, lambda b: b < value)) + 1
    return F.when(name.contains("exit") & boundaries.isNotNull(), above).otherwise(0)


def categorize_latency(df: DataFrame, spans: DataFrame, value: str = "latency", into: str = "tag") -> DataFrame:
    """The class of value among the boundaries of the call (one row per call, so broadcast); 0 if it isn't an exit or has no spans."""
    known = spans.select(F.col("sysname").alias("__s"), F.col("boundaries").alias("__b"))
    return df.join(util.bounded(known), F.col("sysname") == F.col("__s"), "left").withColumn(into, tag(F.col("name"), F.coalesce(F.col(value), F.lit(0)), F.col("__b"))).drop("__s", "__b")


def wide_spans(spans: DataFrame, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """(sysname, n, b<level> for each level) from the rows of level_spans."""
    return spans.groupBy("sysname", "n").agg(*[F.max(F.when(F.col("n_categories") == level, F.col("boundaries"))).alias(f"b{level}") for level in levels])


def all_spans(paired: DataFrame, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """(sysname, n, b<level> for each level) in one pass over the counted latencies."""
    return wide_spans(level_spans(paired, levels), levels)


def multi_tags(df: DataFrame, spans: DataFrame, value: str = "latency", levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """C14: ``tag``: the classes of all levels as a-b-c-d; spans as from all_spans."""
    known = spans.select(F.col("sysname").alias("__s"), *[f"b{level}" for level in levels])
    v = F.coalesce(F.col(value), F.lit(0))
    packed = F.concat_ws("-", *[tag(F.col("name"), v, F.col(f"b{level}")).cast("string") for level in levels])
    return df.join(util.bounded(known), F.col("sysname") == F.col("__s"), "left").withColumn("tag", packed).drop("__s", *[f"b{level}" for level in levels])
