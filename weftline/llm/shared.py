"""Lineage cuts, connected components and bucket counts that the operators share."""

from __future__ import annotations

import math
import os
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkContext, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import textnp

#: Beyond this many squared tasks, counts are added up in two steps.
MANY = 16
#: Rows that are counted before they are broadcast.
BROADCAST_ROWS = 200_000
#: Rows of two numbers that one file of a written table holds.
ROWS_A_FILE = 200_000


def cut(df: DataFrame, files: int | None = None) -> DataFrame:
    """``df`` as a reliable checkpoint in the shared folder, of at most so many files; files should grow with what was counted."""
    checkpoint_folder(df.sparkSession.sparkContext)
    return (df if files is None else df.coalesce(max(1, files))).checkpoint(eager=True)


def checkpoint_folder(context: SparkContext) -> None:
    """Checkpoints go to the folder that the cluster names in spark.checkpoint.dir; a temporary one is taken only where it is unset, on one machine."""
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder, and read again: columns apart and compressed, so smaller than a checkpoint."""
    context = df.sparkSession.sparkContext
    checkpoint_folder(context)
    path = f"{context.getCheckpointDir()}/{os.urandom(8).hex()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if it has at most so many rows; it is counted, so it should be written or small."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def power_of_two(n: int, least: int = 1) -> int:
    """The least power of two that is at least n and least."""
    return 1 << max(0, max(n, least) - 1).bit_length()


def bucket_count(df: DataFrame, rows_each: int, least: int = 12) -> int:
    """So many buckets that each gets about rows_each of the rows of df: a power of two, so it grows with the input."""
    return power_of_two(-(-df.count() // rows_each), least)


def components(edges: DataFrame, most_rounds: int = 60, files: int | None = None) -> DataFrame:
    """Connected components by alternating large-star and small-star steps: (a, b) edges to (node, component = least node).

    Each step keeps, per node, only the least neighbour (a partial aggregate, so no neighbour list is gathered),
    and joins it back to the edges; hot hubs are split by adaptive skew joins. Ends when the edges no longer change.
    Nodes without an edge are not in the result; null ends and loops are ignored. files: those of the first written edges, at most.
    """
    pairs = edges.select(F.col("a"), F.col("b")).where("a <> b")
    pairs = cut(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), files)
    # as many files as the counted edges fill; a step makes no more than twice the edges of the one before
    files, before = -(-pairs.count() // ROWS_A_FILE) + 1, None
    for _ in range(most_rounds):
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("k")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
        small = large.join(least, F.col("a") == F.col("k")).select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        pairs = cut(small.select("e.a", "e.b").where("a <> b").distinct().coalesce(files))
        state = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        files, before = -(-state[0] // ROWS_A_FILE) + 1, state
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bin_counts(docs: DataFrame, text: str, bits: int, bins: Callable[[textnp.Chunk], np.ndarray]) -> np.ndarray:
    """How often each of 2**bits bins occurs over all texts; bins gives the bins of the entries of a chunk.

    Each task adds up its own texts and sends one blob for each range of bins. Spark adds them up by range in two steps,
    so that a group has no more blobs than the root of the number of tasks. The driver gets 2**bits numbers whatever the input.
    """
    width = min(4096, 1 << bits)
    salts = math.isqrt(docs.rdd.getNumPartitions())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, dtype=np.int64)
        held: list[np.ndarray] = []
        for chunk in textnp.chunks(batches, text):
            held.append(bins(chunk.words()).astype(np.int32))  # a sum reads all bins, so entries of some chunks are held for it
            if sum(map(len, held)) >= min(total.size, 1 << 20):
                total += np.bincount(np.concatenate(held), minlength=1 << bits)
                held = []
        if held:
            total += np.bincount(np.concatenate(held), minlength=1 << bits)
        if total.any():
            parts = total.reshape(-1, width)
            salt = np.full(len(parts), TaskContext.get().partitionId() % salts if salts > MANY else 0, dtype=np.int32)
            blobs = pa.array([textnp.planes(p) for p in parts], type=pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts), dtype=np.int32)), pa.array(salt), blobs], names=["part", "salt", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(textnp.unplanes(raw, np.int64) for raw in table["counts"].to_pylist())
        return pa.table({"part": table["part"][:1], "salt": table["salt"][:1], "counts": pa.array([textnp.planes(total)], pa.binary())})

    schema = "part int, salt int, counts binary"
    blobs = docs.select(text).mapInArrow(count, schema)
    if salts > MANY:
        blobs = blobs.groupBy("part", "salt").applyInArrow(add, schema)
    out = np.zeros(1 << bits, dtype=np.int64)
    for row in blobs.groupBy("part").applyInArrow(add, schema).collect():
        out[row.part * width : (row.part + 1) * width] = textnp.unplanes(row.counts, np.int64)
    return out
