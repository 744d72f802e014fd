"""Helpers: lineage cuts, global ordinals (X1), interval join by buckets (X2), next point in order."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one the cluster names in spark.checkpoint.dir (a temporary one where that is unset, on one machine alone)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return f"{context.getCheckpointDir()}/{os.urandom(8).hex()}"


def cut(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder, and read again: compressed, and of what is read later only the columns and rows that are wanted."""
    folder = shared_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


@contextmanager
def small_batches(spark: SparkSession, size: str = "8m") -> Iterator[None]:
    """What runs within gets Arrow batches of about this size, so that a Python worker needs little memory however long the rows and large the tasks are."""
    conf, key = spark.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    before = conf.get(key, None)
    conf.set(key, size)
    try:
        yield
    finally:
        conf.unset(key) if before is None else conf.set(key, before)


def ordinal(df: DataFrame, by: list[str], order: list[str], name: str = "rn") -> DataFrame:
    """1, 2, ... in order within each value of by, without one task that sees all rows.

    Rows are dealt out by ranges of (by, order) and sorted; a place is the place in its partition plus the rows of the
    partitions before. Ranges are sampled anew in each run, so the sorted rows are written once before they are counted.
    """
    keys = [*by, *order]
    placed = stored(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()))
    part, local = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    key = [f"__b{i}" for i in range(len(by))]
    sizes = placed.groupBy(part.alias("__p"), *[F.col(c).alias(k) for c, k in zip(by, key)]).agg(F.count(F.lit(1)).alias("__n"))  # one row per partition, and one more for each value of by
    sum_of = lambda w: F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = sum_of(Window.partitionBy(*key).orderBy("__p"))
    if by:  # rows of lesser values stand before in the partition
        before = before - sum_of(Window.partitionBy("__p").orderBy(*key))
    sizes = cut(sizes.select("__p", *key, before.alias("__before")))
    on = [F.col("__q") == F.col("__p"), *[F.col(c).eqNullSafe(F.col(k)) for c, k in zip(by, key)]]
    out = placed.withColumn("__q", part).join(bounded(sizes) if by else F.broadcast(sizes), on)
    return out.withColumn("__g", F.col("__before") + local + 1).drop("__at", "__p", "__q", "__before", *key).withColumnRenamed("__g", name)


#: Rows that are counted before they are broadcast.
BROADCAST_ROWS = 1_000_000
#: How much wider the buckets of a level are than those of the level below.
WIDER = 16


def bounded(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if it has at most so many rows; it is counted, so it should be small or written."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def running(df: DataFrame, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """``name``: the sum of value over the rows before, in order within by, without one task that sees all rows of a by.

    As ``ordinal``: rows are dealt out by ranges; sums of partitions (one row for each of them and by) give the start of each.
    """
    keys = [*by, *order]
    placed = cut(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()))
    placed = placed.withColumn("__p", F.shiftright("__at", 33))
    before = Window.partitionBy(*by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(*by, "__p").agg(F.sum(value).alias("__s"))
    sums = sums.select(*[F.col(c).alias(f"__b{i}") for i, c in enumerate(by)], F.col("__p").alias("__q"), F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__before"))
    on = (F.col("__p") == F.col("__q")) & F.expr(" and ".join(f"{c} <=> __b{i}" for i, c in enumerate(by)) or "true")
    here = Window.partitionBy("__p", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = placed.withColumn("__here", F.coalesce(F.sum(value).over(here), F.lit(0))).join(bounded(sums), on)
    return out.withColumn(name, F.col("__before") + F.col("__here")).drop("__at", "__p", "__q", "__before", "__here", *[f"__b{i}" for i in range(len(by))])


#: Sequence numbers of one slab of a scan, so the most rows of a key that one task orders.
SLAB = 1 << 20


def open_before(rows: DataFrame, by: list[str], at: str, value: str, closes: str, name: str, keep: str = "first", slab: int = SLAB) -> DataFrame:
    """``name``: the value that is open just before each row, in the order of ``at`` within ``by``; null if none is.

    A row with a value opens; of several the ``first`` stays or the ``last`` replaces it. A row that ``closes`` (and has no value) ends it.

    A scan of composable states. What a run of rows does to what is open is a small function: does a row close, and what is open after
    it. A key is cut in slabs of numbers (``at`` is unique, so a slab has no more rows than numbers), and a window of one slab of a key says what its own rows leave open
    before each. The rows are written with that, once; the functions of slabs, a row each, are composed in order, and what a slab finds open is joined to
    its rows: it holds until the first row that closes (for the ``last`` value: that closes or opens).
    """
    first = keep == "first"
    pick = F.first if first else F.last
    w = Window.partitionBy(*by, "__slab").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    opens = F.col(value).isNotNull()
    if first:  # only a row that finds nothing open
        opens = opens & F.coalesce(F.last(F.when(F.col(closes), True).when(opens, False), True).over(w), F.lit(True))
    local = rows.withColumn("__slab", F.floor(F.col(at) / slab).cast("bigint")).withColumn("__opens", opens)
    mark = F.when(F.col(closes), F.struct(F.lit(None).cast(rows.schema[value].dataType).alias("v"))).when(F.col("__opens"), F.struct(F.col(value).alias("v")))
    settled = F.coalesce(F.max(F.col(closes)).over(w), F.lit(False)) if first else F.last(mark, True).over(w).isNotNull()
    local = stored(local.withColumns({name: F.last(mark, True).over(w)["v"], "__settled": settled}))
    after = F.when(F.col(closes), F.lit(None)).when(F.col("__opens"), F.col(value)).otherwise(F.col(name))
    sums = local.groupBy(*by, "__slab").agg(F.max(closes).alias("__closed"), F.max_by(after, at).alias("__o"))
    order = Window.partitionBy(*by).orderBy("__slab")  # one row a slab
    sums = sums.withColumn("__run", F.sum(F.col("__closed").cast("bigint")).over(order))
    after = Window.partitionBy(*by, "__run").orderBy("__slab").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("__after", pick("__o", True).over(after)).withColumn("__found", F.lag("__after").over(order)).where(F.col("__found").isNotNull())
    key = [*by, "__slab"]
    found = cut(sums.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(key)], "__found"))
    on = [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(key)]
    whole = local.join(bounded(found), on, "left")
    out = F.when(F.col("__settled"), F.col(name)).otherwise(F.coalesce("__found", name))
    return whole.withColumn(name, out).drop("__opens", "__settled", "__found", "__slab", *[f"__k{i}" for i in range(len(key))])


def running_max(rows: DataFrame, by: list[str], at: str, value: str, name: str, slab: int = SLAB) -> DataFrame:
    """``name``: the greatest value of the rows before, in the order of ``at`` within ``by``; null if there is none. By slabs, as ``open_before``."""
    rows = rows.withColumn("__slab", F.floor(F.col(at) / slab).cast("bigint"))
    before = Window.partitionBy(*by).orderBy("__slab").rowsBetween(Window.unboundedPreceding, -1)  # one row a slab
    sums = rows.groupBy(*by, "__slab").agg(F.max(value).alias("__m"))
    sums = sums.withColumn(value, F.max("__m").over(before)).where(F.col(value).isNotNull())
    found = sums.select(*by, "__slab", (F.col("__slab") * slab - 1).alias(at), value, F.lit(True).alias("__found"))
    here = Window.partitionBy(*by, "__slab").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    whole = rows.unionByName(found, allowMissingColumns=True).withColumn(name, F.max(value).over(here))
    return whole.where("__found is null").drop("__slab", "__found")


def quantiles(counted: DataFrame, by: list[str], column: str, count: str, shares: list[float], name: str) -> DataFrame:
    """(by, n, name): n values, and their exact interpolated quantiles at all shares in one pass; counted: (by, column, count), a row for each value.

    Values are dealt out by ranges and their counts summed (``running``), so a row knows which ranks it holds; of each key only the rows that hold a wanted
    rank, two for each share at most, come together.
    """
    ranked = running(counted, by, [column], count, "__r")
    sizes = cut(ranked.groupBy(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(by)]).agg(F.sum(count).alias("n")))
    on = F.expr(" and ".join(f"{c} <=> __k{i}" for i, c in enumerate(by)) or "true")
    at = [F.lit(s) * (F.col("n") - 1) for s in shares]
    ranks = F.array(*[F.struct(F.lit(i).alias("i"), F.floor(x).alias("low"), F.ceil(x).alias("high"), x.alias("at")) for i, x in enumerate(at)])
    holds = lambda rank: (F.col("__r") <= rank) & (rank < F.col("__r") + F.col(count))
    rows = ranked.join(bounded(sizes), on).withColumn("__w", F.explode(F.filter(ranks, lambda w: holds(w["low"]) | holds(w["high"]))))
    low, high, share = (F.col(f"__w.{c}") for c in ("low", "high", "at"))
    ends = rows.groupBy(*by, "n", "__w").agg(F.max(F.when(holds(low), F.col(column))).alias("__a"), F.max(F.when(holds(high), F.col(column))).alias("__b"))
    value = F.when(low == high, F.col("__a").cast("double")).otherwise((high - share) * F.col("__a") + (share - low) * F.col("__b"))
    out = ends.groupBy(*by, "n").agg(F.sort_array(F.collect_list(F.struct(F.col("__w.i").alias("i"), value.alias("v")))).alias("__q"))  # a row for each share
    return out.select(*by, "n", F.col("__q.v").alias(name))


def medians(df: DataFrame, by: str, column: str, name: str) -> DataFrame:
    """(by, name): the exact median (the mean of the middle two) of the values of each by; nulls don't count."""
    counted = df.where(F.col(column).isNotNull()).groupBy(by, F.col(column).alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    return quantiles(counted, [by], "__v", "__c", [0.5], "__q").select(by, F.col("__q")[0].alias(name))


def interval_join(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, bucket: int) -> DataFrame:
    """Pairs with start < at < end, by a join on buckets.

    An interval belongs to the level whose buckets (``bucket`` wide, each level ``WIDER`` times the one below) are the first that are no
    shorter, so it touches two at most; a point goes to its bucket of each level that there is. The intervals are written once; few of them are sent to the points.
    """
    length = F.greatest(F.col(end) - F.col(start), F.lit(1))
    level = F.greatest(F.lit(0), F.ceil(F.log(length / F.lit(float(bucket))) / F.log(F.lit(float(WIDER)))).cast("int"))
    of = cut(intervals.withColumn("__level", level))
    levels = sorted(r[0] for r in of.select("__level").distinct().collect() if r[0] is not None)  # some ten at most
    wide = lambda column: F.floor(column / (F.lit(bucket).cast("bigint") * F.pow(F.lit(WIDER), F.col("__level")).cast("bigint")))
    left = points.withColumn("__level", F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>"))).withColumn("__bucket", wide(F.col(at)))
    right = of.withColumn("__bucket", F.explode(F.sequence(wide(F.col(start)), wide(F.col(end)))))
    return left.join(bounded(right, BROADCAST_ROWS // 10), ["__level", "__bucket"]).where((F.col(at) > F.col(start)) & (F.col(at) < F.col(end))).drop("__bucket", "__level")


#: Sequence numbers of one slab of points that intervals are cut from, and about the most points of intervals that are held at once.
SLICED, HELD = 1 << 16, 1 << 17


def slices(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, visit: Callable, schema: str, slab: int = SLICED, held: int = HELD) -> DataFrame:
    """What visit gives for the points with start < at < end of each interval, slab by slab of ``at`` (which numbers the points, so a slab holds no more of them).

    An interval goes to every slab that it meets, with its number ``slab`` and ``whole``, which says that it meets no other; of the points of a slab it takes a run.
    visit(points, intervals, index, offsets) gets the points of a slab in order, some of the intervals with points there by their ends, the places of their points one
    interval after the other, and where each interval's places begin; it returns a batch of rows.
    """
    first, last = F.floor((F.col(start) + 1) / slab).cast("bigint"), F.floor((F.col(end) - 1) / slab).cast("bigint")
    asked = intervals.where(F.col(end) - F.col(start) > 1).withColumn("whole", first == last).withColumn("slab", F.explode(F.sequence(first, last)))
    given = points.where(F.col(at).isNotNull())
    left = given.select(F.floor(F.col(at) / slab).cast("bigint").alias("__slab"), F.struct(*given.columns).alias("__point"))
    right = asked.select(F.col("slab").alias("__slab"), F.struct(*asked.columns).alias("__interval"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))
        side = lambda name, by: pa.Table.from_struct_array(rows[name].drop_null().combine_chunks()).sort_by(by).combine_chunks()
        if rows["__point"].null_count == len(rows) or rows["__interval"].null_count == len(rows):
            return
        have, of = side("__point", at), side("__interval", end)
        places = have[at].to_numpy()
        low = np.searchsorted(places, of[start].to_numpy(), "right")
        sizes = np.searchsorted(places, of[end].to_numpy(), "left") - low
        some = np.flatnonzero(sizes > 0)
        of, low, sizes = of.take(some), low[some], sizes[some]
        ends = np.cumsum(sizes)
        i = 0
        while i < len(sizes):
            before = ends[i] - sizes[i]
            j = max(i + 1, int(np.searchsorted(ends, before + held, "right")))
            offsets = np.concatenate([[0], ends[i:j] - before])
            index = np.arange(offsets[-1]) + np.repeat(low[i:j] - offsets[:-1], sizes[i:j])
            yield visit(have, of.slice(i, j - i), index, offsets)
            i = j

    run.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return left.unionByName(right, allowMissingColumns=True).groupBy("__slab").applyInArrow(run, schema)


def _later(heads: DataFrame, group: int = 4096, levels: int = 3) -> DataFrame:
    """(__bucket, __later): the least head of the buckets after each; by groups of buckets, and groups of groups above."""
    if levels == 0:
        after = Window.orderBy("__bucket").rowsBetween(1, Window.unboundedFollowing)  # one row for group ** 3 buckets
        return heads.select("__bucket", F.min("__head").over(after).alias("__later"))
    rows = heads.withColumn("__up", F.floor(F.col("__bucket") / group))
    after = Window.partitionBy("__up").orderBy("__bucket").rowsBetween(1, Window.unboundedFollowing)
    above = _later(rows.groupBy(F.col("__up").alias("__bucket")).agg(F.min("__head").alias("__head")), group, levels - 1)
    above = above.select(F.col("__bucket").alias("__u"), F.col("__later").alias("__beyond"))
    rows = rows.withColumn("__own", F.min("__head").over(after)).join(above, F.col("__up") == F.col("__u"))
    return rows.select("__bucket", F.coalesce("__own", "__beyond").alias("__later"))


def next_point(rows: DataFrame, points: DataFrame, at: str, point: str, bucket: int) -> DataFrame:
    """``point``: the least point above at, null if there is none. Within buckets by a window, across them over one row per bucket, in groups."""
    tagged = rows.withColumns({"__x": F.col(at), "__point": F.lit(None).cast("bigint")}).unionByName(points.select(F.col(point).alias("__x"), F.col(point).alias("__point")), allowMissingColumns=True)
    tagged = tagged.withColumn("__bucket", F.floor(F.col("__x") / bucket))
    ahead = Window.partitionBy("__bucket").orderBy("__x", F.col("__point").isNull().cast("int")).rowsBetween(1, Window.unboundedFollowing)
    inside = tagged.withColumn("__next", F.min("__point").over(ahead)).where("__point is null")
    heads = tagged.groupBy("__bucket").agg(F.min("__point").alias("__head"))
    return inside.join(_later(heads), "__bucket").withColumn(point, F.coalesce("__next", "__later")).drop("__x", "__point", "__bucket", "__next", "__later")
