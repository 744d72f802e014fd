"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRACE = "seq bigint, ts_ns bigint, name string, tid bigint, vtid bigint, pid bigint, vpid bigint, procname string, ret bigint, connection_state int, sector bigint, next_tid bigint"
INTEGER_FIELDS = ("call", "entry", "duration", "proc", "pid", "tid", "ret")


def trace_read(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A1: a trace with the event schema; rows without a name are no events and are skipped."""
    reader = spark.read.schema(TRACE) if fmt in ("json", "csv", "parquet") else spark.read
    reader = reader.option("header", True) if fmt == "csv" else reader
    return reader.format(fmt).load(path).where(F.col("name").isNotNull())


def trace_stream(spark: SparkSession, path: str, fmt: str = "parquet", files_a_batch: int | None = None) -> DataFrame:
    """A1 as a stream of files with the event schema and ts, the event time; Spark keeps the offsets in the query's checkpoint."""
    reader = spark.readStream.schema(TRACE).format(fmt)
    reader = reader.option("header", True) if fmt == "csv" else reader
    reader = reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader
    rows = reader.load(path).where(F.col("name").isNotNull())
    return rows.withColumn("ts", F.timestamp_micros(F.call_function("div", F.col("ts_ns"), F.lit(1000).cast("bigint"))))


def sequence_lines(seqs: DataFrame) -> DataFrame:
    """One line per request: ten fields joined by ``;``, items by ``,``."""
    items = lambda c: F.concat_ws(",", F.col(c).cast("array<string>"))
    fields = [items(c) for c in INTEGER_FIELDS] + [F.col("start_ts").cast("string"), F.concat_ws(",", "tags"), F.col("duration_ms").cast("string")]
    return seqs.select(F.concat_ws(";", *fields).alias("value"))


def seq_write(seqs: DataFrame, path: str, fmt: str = "text") -> None:
    """A2: text lines, or Parquet by data set."""
    if fmt == "text":
        sequence_lines(seqs).write.text(path)
    else:
        seqs.write.partitionBy("dataset").format(fmt).save(path)


def seq_check(spark: SparkSession, path: str) -> DataFrame:
    """(lines, bad): how many lines a folder holds, and how many of them seq_read skips as they don't have ten fields."""
    bad = (F.size(F.split("value", ";")) != 10).cast("bigint")
    return spark.read.text(path).agg(F.count(F.lit(1)).alias("lines"), F.coalesce(F.sum(bad), F.lit(0)).alias("bad"))


def seq_read(spark: SparkSession, path: str) -> DataFrame:
    """A3: the typed columns of such lines; lines without ten fields are skipped (``seq_check`` counts them)."""
    parts = spark.read.text(path).select(F.split("value", ";").alias("f")).where(F.size("f") == 10)
    arrays = [F.transform(F.split(F.col("f")[i], ","), lambda x: x.cast("bigint")).alias(c) for i, c in enumerate(INTEGER_FIELDS)]
    return parts.select(*arrays, F.col("f")[7].cast("bigint").alias("start_ts"), F.split(F.col("f")[8], ",").alias("tags"), F.col("f")[9].cast("double").alias("duration_ms"))


def vocab_save(vocab: DataFrame, path: str) -> None:
    """A4"""
    vocab.write.mode("overwrite").parquet(path)


def vocab_load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("idx", "word")


def spans_save(spans: DataFrame, path: str) -> None:
    """A5"""
    spans.write.mode("overwrite").parquet(path)


def spans_load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def dataset_catalog(spark: SparkSession, specs: dict[str, str], data_path: str) -> DataFrame:
    """(role, name, path, linked): ``Name:folder`` lists by role; the i-th valid_novel set is linked to the i-th test_novel set."""
    rows = spark.createDataFrame(list(specs.items()), "role string, spec string")
    sets = rows.select("role", F.posexplode(F.split("spec", ",")).alias("place", "item")).select("role", "place", F.split("item", ":")[0].alias("name"), F.concat(F.lit(data_path.rstrip("/") + "/"), F.split("item", ":")[1]).alias("path"))
    tests = sets.where("role = 'test_novel'").select(F.col("place").alias("__p"), F.col("name").alias("linked"))
    return sets.join(tests, (F.col("role") == "valid_novel") & (F.col("place") == F.col("__p")), "left").select("role", "name", "path", "linked")
