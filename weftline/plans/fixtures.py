"""The driver tables as inputs of the operators (FIXTURES.md); all rows of a table are used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import events as ev
from weftline.functions.sequences import tag_select
from weftline.operators import durations, requests, util


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def trace(spark: SparkSession, sf: str) -> DataFrame:
    """T"""
    call = lambda n: F.concat(F.lit("syscall_"), F.when(F.col("k") % 2 == 0, "entry").otherwise("exit"), F.lit(f"_{n}"))
    kind = F.col("event_type")
    name = F.when(kind == "signup", ev.ENTER).when(kind == "purchase", ev.EXIT).when(kind == "view", call("read")).when(kind == "click", call("poll")).otherwise(call("futex"))
    return events(spark, sf).select(
        F.col("event_id").alias("seq"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts_ns"), name.alias("name"), (F.col("user_id") % 8).alias("tid"), (F.col("user_id") % 2).alias("pid"),
        F.concat(F.lit("proc"), F.col("user_id") % 5).alias("procname"), F.when(F.col("k") % 7 == 0, -1).otherwise(F.col("k")).alias("ret"), (F.col("k") % 10).alias("connection_state"), F.col("k"), F.col("ts").cast("timestamp").alias("ts"),
    )


def paired(spark: SparkSession, sf: str) -> DataFrame:
    return requests.pair_latency(trace(spark, sf))


def split(numbered: DataFrame) -> DataFrame:
    return numbered.withColumn("dataset", F.expr("case when rn % 5 < 3 then 'train' when rn % 5 = 3 then 'valid' else 'test' end"))


def assigned(spark: SparkSession, sf: str) -> DataFrame:
    """Events of requests with rn, data set and duration."""
    p = util.cut(paired(spark, sf))
    rows = util.cut(requests.assign_events(p, requests.request_intervals(p)))
    return requests.inter_event(rows.join(split(requests.number_requests(rows)), "request_id"))


def sequences(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sequences, call vocabulary, process vocabulary).

    Events are paired and written once, for requests and spans. They are encoded before they are cut into requests, so an event is not joined and sorted once more for each request that it belongs to.
    """
    p = requests.pair_latency(trace(spark, sf).drop("k", "ts"))
    numbered = util.cut(split(requests.requests_with_events(p, requests.request_intervals(p))))
    words = util.cut(requests.first_words(p, numbered.where("dataset = 'train'")))
    calls, procs = util.cut(requests.vocab_build(words, "sysname")), util.cut(requests.vocab_build(words, "procname"))
    rows = requests.vocab_encode(requests.vocab_encode(p, calls, "sysname", "call"), procs, "procname", "proc")
    return requests.build_sequences(durations.multi_tags(rows, durations.all_spans(p)), numbered), calls, procs


def tagged_sequences(spark: SparkSession, sf: str) -> DataFrame:
    return sequences(spark, sf)[0].withColumn("tag", tag_select(F.col("tags"), 4))


def symbols(spark: SparkSession, sf: str) -> DataFrame:
    """S: (dataset, set, role, rn, call) of every document."""
    chars = F.filter(F.split(F.coalesce("text", F.lit("")), ""), lambda c: c != "")
    code = F.transform(chars, lambda c: F.when(c == " ", 5).otherwise(6 + F.ascii(F.lower(c)) % 40))
    role = F.expr("case when doc_id % 5 < 3 then 'train' when doc_id % 5 = 3 then 'valid' else 'test' end")
    return table(spark, sf, "documents").select(F.col("lang").alias("dataset"), F.col("lang").alias("set"), role.alias("role"), F.col("doc_id").alias("rn"), F.concat(F.array(F.lit(2)), code, F.array(F.lit(3))).alias("call"))


def logits(spark: SparkSession, sf: str) -> DataFrame:
    """L"""
    rows = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"), "label")
    return rows.select("vec_id", F.expr("vec_id div 10").alias("batch"), "x", F.col("label").alias("target"), (F.col("label") % 6).alias("tag"), F.slice("x", 1, 4).alias("bits"), F.concat(F.lit("d"), F.col("vec_id") % 3).alias("dataset"), F.concat(F.lit("c"), F.col("label")).alias("cls"), F.col("x").alias("components"), (F.col("vec_id") % 63 + 1).cast("int").alias("input"))


def scores(spark: SparkSession, sf: str, *more: Column) -> DataFrame:
    """D: (id, set, novel, role, event_score, duration_score), and more of the events."""
    novel = ~F.col("event_type").isin("view", "click")
    add = lambda n: F.when(novel, n).otherwise(0)
    return events(spark, sf).select(F.col("event_id").alias("id"), F.when(novel, F.col("event_type")).otherwise("known").alias("set"), novel.alias("novel"), F.when(F.col("event_id") % 2 == 0, "valid").otherwise("test").alias("role"), (F.col("value") + add(10)).alias("event_score"), (F.col("k") + add(20)).cast("double").alias("duration_score"), *more)


def balanced(spark: SparkSession, sf: str, role: str) -> DataFrame:
    """Balanced sets of D; ``score`` is the event score."""
    from weftline.operators import detect

    rows = scores(spark, sf).where(F.col("role") == role).withColumn("score", F.col("event_score"))
    return detect.balanced_sets(rows.where("not novel").drop("set", "novel"), rows.where("novel").drop("novel"))


def verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """W"""
    rows = events(spark, sf).withColumn("y_true", F.expr("cast((event_id div 37) % 2 as int)"))
    return rows.select(F.expr("event_id div 500").alias("scenario"), F.expr("(event_id div 500) % 11").alias("ratio"), (F.col("event_id") % 500).alias("pos"), "y_true", F.when(F.col("k") % 10 == 0, 1 - F.col("y_true")).otherwise(F.col("y_true")).alias("y_pred"), F.expr("unix_micros(cast(ts as timestamp)) div 1000").alias("ts_ms"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id"))
