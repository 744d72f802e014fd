"""From events to latencies, requests and token sequences."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import events as ev
from weftline.operators import util

MASK, UNKNOWN, START, END, CUT = range(5)
SPECIAL = 5


def pair_latency(trace: DataFrame, slab: int = util.SLAB) -> DataFrame:
    """``latency``, ``err`` and ``paired`` of every event, per call, process and thread.

    An exit closes the first entry since the exit before; what is open comes from a scan of slabs (``util.open_before``), so one busy thread isn't one task.
    """
    name = F.col("name")
    rows = trace.withColumns({"is_entry": ev.is_entry(name), "is_exit": ev.is_exit(name), "sysname": ev.sysname(name)})
    rows = rows.withColumn("__ts", F.when(F.col("is_entry"), F.col("ts_ns")))
    rows = util.open_before(rows, ["sysname", "pid", "tid"], "seq", "__ts", "is_exit", "__open", slab=slab)
    is_open = F.col("__open").isNotNull()
    rows = rows.withColumns({
        "paired": F.col("is_exit") & is_open,
        "latency": F.when(F.col("is_exit"), F.coalesce(F.col("ts_ns") - F.col("__open"), F.lit(0))).when(F.col("is_entry"), F.lit(0)),
        "err": F.when((F.col("is_entry") & is_open) | (F.col("is_exit") & ~is_open), 1).otherwise(0),
    })
    return rows.drop("__ts", "__open")


def history_mean(paired: DataFrame, n: int = 10, slab: int = 1_000_000) -> DataFrame:
    """C4: ``f_mean``, the mean of the last n paired latencies of the call, over all processes.

    Calls are few and unequal, so a call is split: paired exits get their rank, a slab of ranks is one window, and the n ranks
    before a slab are copied into it.
    """
    ranked = util.ordinal(paired.where("paired").select("sysname", "seq", "latency"), ["sysname"], ["seq"], "__i")
    own = (F.col("__i") / slab).cast("bigint")
    halo = ranked.withColumn("__slab", F.explode(F.sequence(own, ((F.col("__i") + n) / slab).cast("bigint"))))
    w = Window.partitionBy("sysname", "__slab").orderBy("seq").rowsBetween(-n, -1)
    means = halo.withColumn("__m", F.coalesce(F.avg("latency").over(w), F.lit(0.0))).where(F.col("__slab") == own).select(F.col("seq").alias("__seq"), "__m")
    out = paired.join(means, F.col("seq") == F.col("__seq"), "left")
    mean = F.when(F.col("paired"), F.col("__m")).when(F.col("is_entry") | F.col("is_exit"), F.lit(0.0))
    return out.withColumn("f_mean", mean).drop("__seq", "__m")


def request_intervals(trace: DataFrame, skip_states: tuple[int, ...] = (6, 7), slab: int = util.SLAB) -> DataFrame:
    """(request_id, tid, start_seq, end_seq); request_id is the seq of the completing event. The last start of a thread counts, by a scan of slabs."""
    rows = trace.where(ev.is_handler(F.col("name"))).select("seq", "tid", (F.col("name") == ev.EXIT).alias("ends"), "connection_state")
    starts = ~F.col("ends") & ~F.coalesce(F.col("connection_state").isin(*skip_states), F.lit(False))
    rows = util.open_before(rows.withColumn("start", F.when(starts, F.col("seq"))), ["tid"], "seq", "start", "ends", "start_seq", "last", slab)
    return rows.where("ends and start_seq is not null").select(F.col("seq").alias("request_id"), F.col("tid").alias("request_tid"), "start_seq", F.col("seq").alias("end_seq"))


def assign_events(trace: DataFrame, requests: DataFrame, bucket: int = 64) -> DataFrame:
    """Every non-handler event with every request that is active at that moment."""
    return util.interval_join(trace.where(~ev.is_handler(F.col("name"))), requests, "seq", "start_seq", "end_seq", bucket)


def number_requests(assigned: DataFrame) -> DataFrame:
    """(request_id, rn): completed requests with events, in the order of their ends."""
    return util.ordinal(assigned.select("request_id").distinct(), [], ["request_id"])


def warmup_skip(numbered: DataFrame, n: int = 1000) -> DataFrame:
    """Without the first n completed requests; rn starts at 1 again."""
    return numbered.where(F.col("rn") > n).withColumn("rn", F.col("rn") - n)


def errors_per_request(paired: DataFrame, assigned: DataFrame, bucket: int = 4096) -> DataFrame:
    """(request_id, errors): errors of the other events since the request completed before."""
    wrong = paired.where(~ev.is_handler(F.col("name")) & (F.col("err") > 0)).select("seq", "err")
    ends = assigned.select("request_id").distinct()
    summed = util.next_point(wrong, ends, "seq", "request_id", bucket).groupBy(F.col("request_id").alias("__r")).agg(F.sum("err").alias("errors"))
    return ends.join(summed, F.col("request_id") == F.col("__r"), "left").select("request_id", F.coalesce("errors", F.lit(0)).alias("errors"))


def inter_event(assigned: DataFrame) -> DataFrame:
    """``duration`` since the request's event before (0 for the first)."""
    before = F.lag("ts_ns").over(Window.partitionBy("request_id").orderBy("seq"))
    return assigned.withColumn("duration", F.coalesce(F.col("ts_ns") - before, F.lit(0)))


def vocab_build(assigned: DataFrame, col: str) -> DataFrame:
    """(idx, word): 5 + rank of first appearance, by request (rn) and event (seq)."""
    first = assigned.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("word")).agg(F.min(F.struct("rn", "seq")).alias("first"))
    return first.select((F.row_number().over(Window.orderBy("first", "word")) + SPECIAL - 1).alias("idx"), "word")  # one row per word


def vocab_encode(df: DataFrame, vocab: DataFrame, col: str, into: str) -> DataFrame:
    """Word to index, 1 if unknown; the vocabulary is one row per distinct call or process name."""
    return df.join(util.bounded(vocab.select(F.col("idx").alias("__idx"), F.col("word").alias("__word"))), F.col(col) == F.col("__word"), "left").withColumn(into, F.coalesce("__idx", F.lit(UNKNOWN))).drop("__idx", "__word")


def _ids(points: pa.Table, asked: pa.Table, index: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
    return asked.select(["request_id", "start_seq", "end_seq"]).to_batches()[0]


def requests_with_events(trace: DataFrame, requests: DataFrame, slab: int = util.SLICED) -> DataFrame:
    """(request_id, start_seq, end_seq, rn): as ``number_requests``, but from the intervals, without their events."""
    others = trace.where(~ev.is_handler(F.col("name"))).select("seq")
    found = util.slices(others, requests.select("request_id", "start_seq", "end_seq"), "seq", "start_seq", "end_seq", _ids, "request_id bigint, start_seq bigint, end_seq bigint", slab)
    return util.ordinal(found.distinct(), [], ["request_id"])


WORDS = ("sysname", "procname")


def _first_words(points: pa.Table, asked: pa.Table, index: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
    first = []
    for c in WORDS:  # requests stand by their ends, so by rn, and events by seq
        codes = points[c].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        first.append(np.unique(codes[index], return_index=True)[1])
    at = np.unique(np.concatenate(first))
    rn = asked["rn"].to_numpy()[np.searchsorted(offsets, at, "right") - 1]
    rows = points.select(["seq", *WORDS]).take(index[at])
    return pa.table({"rn": rn, **{c: rows[c] for c in rows.column_names}}).combine_chunks().to_batches()[0]


def first_words(trace: DataFrame, numbered: DataFrame, slab: int = util.SLICED) -> DataFrame:
    """(rn, seq, sysname, procname): of the events of the requests (``requests_with_events``) those in which a slab's requests first show a word; enough for ``vocab_build``."""
    others = trace.where(~ev.is_handler(F.col("name"))).select("seq", *WORDS)
    return util.slices(others, numbered.select("rn", "start_seq", "end_seq"), "seq", "start_seq", "end_seq", _first_words, "rn bigint, seq bigint, sysname string, procname string", slab)


#: The parallel arrays of a request that are taken from its events as they are.
ITEMS = {"call": "int", "proc": "int", "entry": "int", "pid": "bigint", "tid": "bigint", "ret": "int", "tag": "string"}


def _sequences(points: pa.Table, asked: pa.Table, index: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
    rows = points.take(index).combine_chunks()
    ts = rows["ts_ns"].combine_chunks()
    deltas = np.concatenate([[0], pc.subtract(ts.slice(1), ts.slice(0, len(ts) - 1)).fill_null(0).to_numpy(zero_copy_only=False)]).astype(np.int64)
    deltas[offsets[:-1]] = 0
    at = pa.array(offsets, pa.int32())
    packed = {c: pa.ListArray.from_arrays(at, rows[c].combine_chunks()) for c in ITEMS} | {"duration": pa.ListArray.from_arrays(at, pa.array(deltas))}
    ends = {"first_ts": ts.take(pa.array(offsets[:-1])), "last_ts": ts.take(pa.array(offsets[1:] - 1))}
    own = {c: asked[c] for c in ("dataset", "request_id", "rn", "slab", "whole")}
    return pa.table(own | packed | ends).combine_chunks().to_batches()[0]


def build_sequences(encoded: DataFrame, numbered: DataFrame, slab: int = util.SLICED) -> DataFrame:
    """One row per request with the parallel arrays, between START and END; ``duration`` as in C7.

    Reads seq, ts_ns, call, proc, name, pid, tid, ret and tag of the events, and the requests (``requests_with_events``) with their data set. The events of a request are a
    run of the trace without handlers, so slabs of it are sorted and cut; only requests that meet several slabs are put together from their pieces, one a slab.
    """
    name = F.col("name")
    others = encoded.where(~ev.is_handler(name)).select("seq", "ts_ns", "call", "proc", ev.direction(name).alias("entry"), "pid", "tid", ev.ret_code(name, F.col("ret")).cast("int").alias("ret"), "tag")
    others = others.withColumns({c: F.col(c).cast(t) for c, t in ITEMS.items()})
    arrays = ", ".join(f"{c} array<{t}>" for c, t in ITEMS.items())
    schema = f"dataset string, request_id bigint, rn bigint, slab bigint, whole boolean, {arrays}, duration array<bigint>, first_ts bigint, last_ts bigint"
    pieces = util.stored(util.slices(others, numbered.select("dataset", "request_id", "rn", "start_seq", "end_seq"), "seq", "start_seq", "end_seq", _sequences, schema, slab))
    whole = pieces.where("whole").select("dataset", "request_id", "rn", *ITEMS, "duration", F.col("first_ts").alias("start_ts"))
    x = F.col("x")
    parts = pieces.where("not whole").groupBy("dataset", "request_id", "rn").agg(F.sort_array(F.collect_list(F.struct("slab", *ITEMS, "duration", "first_ts", "last_ts"))).alias("x"))

    def since(piece: Column, i: Column) -> Column:  # the first duration of a later piece is the time since the piece before
        gap = F.coalesce(piece["first_ts"] - F.get(x, i - 1)["last_ts"], F.lit(0))
        return F.when(i == 0, piece["duration"]).otherwise(F.concat(F.array(gap), F.slice(piece["duration"], F.lit(2), F.size(piece["duration"]) - 1)))

    parts = parts.select("dataset", "request_id", "rn", *[F.flatten(x[c]).alias(c) for c in ITEMS], F.flatten(F.transform(x, since)).alias("duration"), x[0]["first_ts"].alias("start_ts"))
    wrap = lambda c, a, b: F.concat(F.array(a), F.col(c), F.array(b))
    zero, nil, none = F.lit(0), F.lit(0).cast("bigint"), F.lit("0-0-0-0")
    total = F.aggregate("duration", nil, lambda a, b: a + b)
    return whole.unionByName(parts).select(
        "dataset", "request_id", "rn", *[wrap(c, F.lit(START), F.lit(END)).alias(c) for c in ("call", "proc")], wrap("entry", zero, zero).alias("entry"), *[wrap(c, nil, nil).alias(c) for c in ("duration", "pid", "tid")], wrap("ret", zero, zero).alias("ret"),
        "start_ts", wrap("tag", none, none).alias("tags"), (total / F.lit(1e6)).alias("duration_ms"),
    )
