"""Streams of unordered files over several micro-batches against the batch forms."""

import random
import time

import pytest
from pyspark.sql import functions as F

from weftline.functions import events as ev
from weftline.operators import requests, util
from weftline.sources import tables
from weftline.streaming import state

SCHEMA = "seq bigint, ts_ns bigint, name string, tid bigint, pid bigint, connection_state int, ts timestamp"


def events(rng, n, gap=1):
    names = ["syscall_entry_read", "syscall_exit_read", "syscall_entry_poll", "syscall_exit_poll", "sched_switch", ev.ENTER, ev.EXIT]
    return [(i, 10**9 * i * gap, rng.choice(names), rng.choice([0, 1, None]), rng.choice([0, None]), rng.choice([None, 3, 6])) for i in range(n)]


def stream(spark, batches):
    """One file a batch, in this order."""
    folder = util.shared_folder(spark)
    for rows in batches:
        df = spark.createDataFrame(rows, SCHEMA.rpartition(",")[0]).withColumn("ts", F.timestamp_seconds(F.col("ts_ns") / 1e9 + 1_700_000_000))
        df.coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.02)  # files are taken by their time
    state.closing(spark.read.parquet(folder)).write.mode("append").parquet(folder)
    return spark.read.schema(SCHEMA).parquet(folder), spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.fixture(scope="module")
def shuffled(spark):
    rng = random.Random(11)
    rows = sorted(events(rng, 240), key=lambda r: r[0] + rng.uniform(-30, 30))
    batches = [rows[k : k + 40] for k in range(0, 240, 40)]
    for b in batches:
        rng.shuffle(b)
    return stream(spark, batches)


def test_unordered_files_equal_the_batch_forms(spark, shuffled):
    trace, live = shuffled
    got = state.run_once(state.stream_pairing(live, timeout="1 day", lateness="2 minutes"), util.shared_folder(spark))
    want = requests.pair_latency(trace).where("is_entry or is_exit").select("seq", "sysname", "pid", "tid", "latency", "err")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 150
    got = state.run_once(state.stream_requests(live, timeout="1 day", lateness="2 minutes"), util.shared_folder(spark))
    assert sorted(map(str, got.collect())) == sorted(map(str, requests.request_intervals(trace).collect())) and got.count() > 5


def test_rows_beyond_the_watermark_are_dropped(spark):
    e, x = "syscall_entry_read", "syscall_exit_read"
    first = [(0, 0, e, 1, 1, None), (2, 100 * 10**9, x, 1, 1, None)]
    then = [(3, 1000 * 10**9, e, 1, 1, None)]  # a batch is late by the watermark that the batch before has worked with
    late = [(1, 50 * 10**9, x, 1, 1, None), (4, 1001 * 10**9, x, 1, 1, None), (None, 1002 * 10**9, x, 1, 1, None)]
    _, live = stream(spark, [first, then, [(None, 1000 * 10**9, e, 1, 1, None)], late])
    got = state.run_once(state.stream_pairing(live, timeout="1 day", lateness="1 second"), util.shared_folder(spark))
    assert sorted((r.seq, r.latency, r.err) for r in got.collect()) == [(0, 0, 0), (2, 100 * 10**9, 0), (3, 0, 0), (4, 10**9, 0)]


def test_what_stays_open_too_long_is_forgotten(spark):
    e, x = "syscall_entry_read", "syscall_exit_read"
    rows = [(0, 0, e, 1, 1, None), (1, 7200 * 10**9, x, 1, 1, None), (2, 7201 * 10**9, e, 1, 1, None), (3, 20_000 * 10**9, e, 1, 1, None), (4, 20_001 * 10**9, x, 1, 1, None)]
    _, live = stream(spark, [rows[:1], rows[1:3], rows[3:]])
    got = state.run_once(state.stream_pairing(live, timeout="1 hour", lateness="1 second"), util.shared_folder(spark))
    assert sorted((r.seq, r.latency, r.err) for r in got.collect()) == [(0, 0, 0), (1, 0, 1), (2, 0, 0), (3, 0, 0), (4, 10**9, 0)]


def test_traces_are_read_with_pushed_filters_and_as_streams(spark, tmp_path):
    rows = [(i, 1_700_000_000_000_000_000 + 10**9 * i, None if i == 5 else "syscall_entry_read" if i % 2 else "syscall_exit_read") for i in range(40)]
    trace = spark.createDataFrame(rows, "seq bigint, ts_ns bigint, name string")
    for c, t in (x.split() for x in tables.TRACE.split(", ")):
        trace = trace if c in trace.columns else trace.withColumn(c, F.lit(None).cast(t))
    trace.repartition(3).write.parquet(f"{tmp_path}/t")
    read = tables.trace_read(spark, f"{tmp_path}/t").where("seq between 4 and 9 and ts_ns > 0")
    assert sorted(r.seq for r in read.collect()) == [4, 6, 7, 8, 9]
    assert "GreaterThanOrEqual(seq,4)" in read._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    live = tables.trace_stream(spark, f"{tmp_path}/t", files_a_batch=1)
    assert sorted(r.seq for r in state.run_once(live, f"{tmp_path}/run").collect()) == [i for i in range(40) if i != 5]


def test_bad_lines_are_counted(spark, tmp_path):
    good = "2,5,3;0,1,0;0,0,0;2,5,3;0,7,0;0,7,0;0,0,0;1000;0-0-0-0,0-0-0-0,0-0-0-0;0.0015"
    spark.createDataFrame([(good,), ("a;b",), ("",), (good + ";",)], "value string").write.text(f"{tmp_path}/s")
    assert tuple(tables.seq_check(spark, f"{tmp_path}/s").first()) == (4, 3)
    (row,) = tables.seq_read(spark, f"{tmp_path}/s").collect()
    assert row.call == [2, 5, 3] and row.start_ts == 1000
