"""Streaming forms of pairing, request intervals and trace decisions.

Events may come late and in any order, within and across micro-batches. Each key keeps its events in state until the watermark has
passed them; then no earlier one can come, and a timer releases them in the order of seq. So the rows equal those of the batch forms whatever the
batches, as long as no event is later than ``lateness``. An event that is later is dropped (Spark counts it in numRowsDroppedByWatermark), and
what is left is paired as if it weren't there. seq must not fall while event time rises. Rows without seq or event time are skipped.

State is kept by RocksDB, which the timers need (``run_once`` sets the provider for its query; other writers set ``spark.sql.streaming.stateStore.providerClass``). The
last events of a stream come out when the watermark passes them: end a finished stream with ``closing``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from weftline.functions import events as ev

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Kinds of buffered events; a row that only moves the watermark is none.
NONE, OPENS, CLOSES = range(3)
MARK = ""
#: Sequence numbers of one piece of the state, so the most events that are in memory when they are released; rows of a key that are taken in at once.
PIECE, AT_ONCE = 1 << 15, 1 << 14
#: Stands for a value that is null.
_NULL = -(1 << 63)


class InOrder(StatefulProcessor):
    """Hands the events of a key to ``step`` in the order of seq, each once the watermark has passed it.

    State: the buffered events in pieces of ``PIECE`` sequence numbers, each in parts of packed rows, and the open value with its event time. However many events
    of a key are buffered, or come in one batch, only a piece of them is in memory. What has been open for more than ``wait`` ms is forgotten: an
    event after that finds nothing open, and the state of a silent key is removed.
    """

    def __init__(self, wait: int):
        self.wait = wait

    def step(self, key: tuple, seq: int, value: int, kind: int, found: int | None) -> tuple[Row | None, int | None]:
        """What to return for an event that finds this open, and what is open after it."""
        raise TypeError("InOrder has no step of its own")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "piece bigint, part bigint", "rows binary")
        self.pieces = handle.getMapState("pieces", "piece bigint", "parts bigint, first bigint")  # the least event time of each
        self.opened = handle.getValueState("opened", "value bigint, at bigint")
        self.due = handle.getValueState("due", "at bigint")  # the timer that counts

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = ((r.seq, r.at, _NULL if r.value is None else r.value, r.kind) for r in rows if r.kind != NONE)
        while part := list(islice(new, AT_ONCE)):
            part = np.array(part, np.int64)
            of = part[:, 0] // PIECE
            for piece in np.unique(of).tolist():
                self.hold(piece, part[of == piece])
            self.wake(int(part[:, 1].min()) + 1)
        return iter(())

    def hold(self, piece: int, rows: np.ndarray) -> None:
        """Add rows (seq, at, value, kind) to a piece."""
        parts, first = self.pieces.getValue((piece,)) if self.pieces.containsKey((piece,)) else (0, int(rows[0, 1]))
        self.held.updateValue((piece, parts), (rows.tobytes(),))
        self.pieces.updateValue((piece,), (parts + 1, min(first, int(rows[:, 1].min()))))

    def take(self, piece: int, parts: int) -> np.ndarray:
        """The rows of a piece in the order of seq, which are removed."""
        rows = []
        for part in range(parts):
            rows.append(np.frombuffer(self.held.getValue((piece, part))[0], np.int64).reshape(-1, 4))
            self.held.removeKey((piece, part))
        self.pieces.removeKey((piece,))
        rows = np.concatenate(rows)
        return rows[np.lexsort(rows.T[::-1])]

    def wake(self, at: int) -> None:
        """Set the timer to a time, unless it is set to an earlier one."""
        if not self.due.exists() or at < self.due.get()[0]:
            self.handle.registerTimer(at)
            self.due.update((at,))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        if not self.due.exists() or self.due.get()[0] != expiredTimerInfo.getExpiryTimeInMs():
            return iter(())  # one that another timer has preceded
        self.due.clear()
        return self.release(key, now)

    def release(self, key: tuple, now: int) -> Iterator[Row]:
        value, since = self.opened.get() if self.opened.exists() else (None, 0)
        pieces = sorted((piece, parts, first) for (piece,), (parts, first) in self.pieces.iterator())
        waits = [first for *_, first in pieces if first >= now]
        for piece, parts, first in pieces:
            if first >= now:
                continue
            rows = self.take(piece, parts)
            later = rows[rows[:, 1] >= now]
            if len(later):
                self.hold(piece, later)
                waits.append(int(later[:, 1].min()))
            for seq, at, own, kind in rows[rows[:, 1] < now].tolist():
                own = None if own == _NULL else own
                found = value if value is not None and at - since <= self.wait else None
                row, left = self.step(key, seq, own, kind, found)
                if row is not None:
                    yield row
                since = at if found is None or left != found else since
                value = left
        if value is not None and not waits and now - since > self.wait:
            value = None
        if value is None:
            self.opened.clear()
        else:
            self.opened.update((value, since))
        if waits:
            self.wake(min(waits) + 1)
        elif value is not None:
            self.wake(since + self.wait + 2)

    def close(self) -> None:
        pass


class Pairing(InOrder):
    def step(self, key, seq, value, kind, found):
        if kind == OPENS:
            return Row(seq=seq, sysname=key[0], pid=key[1], tid=key[2], latency=0, err=int(found is not None)), value if found is None else found
        return Row(seq=seq, sysname=key[0], pid=key[1], tid=key[2], latency=0 if found is None else value - found, err=int(found is None)), None


class Requests(InOrder):
    def step(self, key, seq, value, kind, found):
        if kind == OPENS:
            return None, value
        return None if found is None else Row(request_id=seq, request_tid=key[0], start_seq=found, end_seq=seq), None


def _ms(timeout: str) -> int:
    return int(pd.Timedelta(timeout).total_seconds() * 1000)


def _rows(stream: DataFrame, keys: list[Column], value: Column, kind: Column, lateness: str) -> DataFrame:
    kind = F.when(F.col("name") == MARK, NONE).otherwise(kind)
    # the row of closing must come as far as the watermark, so it is no row to filter
    rows = stream.withWatermark("ts", lateness).select(F.coalesce("seq", F.when(F.col("name") == MARK, F.lit(-1))).alias("seq"), "ts", *keys, F.unix_millis("ts").alias("at"), value.cast("bigint").alias("value"), kind.cast("int").alias("kind"))
    return rows.where("kind is not null and seq is not null and at is not null")


def stream_pairing(stream: DataFrame, timeout: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """pair_latency online: (seq, sysname, pid, tid, latency, err) for entries and exits, null processes and threads included.

    Reads ts, the event time. An entry that isn't closed within the timeout is forgotten.
    """
    name = F.col("name")
    kind = F.when(ev.is_entry(name), OPENS).when(ev.is_exit(name), CLOSES)
    rows = _rows(stream, [ev.sysname(name).alias("sysname"), F.col("pid"), F.col("tid")], F.col("ts_ns"), kind, lateness)
    return rows.groupBy("sysname", "pid", "tid").transformWithState(Pairing(_ms(timeout)), "seq bigint, sysname string, pid bigint, tid bigint, latency bigint, err int", "Append", "EventTime")


def stream_requests(stream: DataFrame, skip_states: tuple[int, ...] = (6, 7), timeout: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """request_intervals online: (request_id, request_tid, start_seq, end_seq) at each end; a start that has no end within the timeout is forgotten.

    Events without a thread are those of one thread, as in the batch form.
    """
    name = F.col("name")
    starts = (name == ev.ENTER) & ~F.coalesce(F.col("connection_state").isin(*skip_states), F.lit(False))
    rows = _rows(stream, [F.col("tid")], F.col("seq"), F.when(starts, OPENS).when(name == ev.EXIT, CLOSES), lateness)
    return rows.groupBy("tid").transformWithState(Requests(_ms(timeout)), "request_id bigint, request_tid bigint, start_seq bigint, end_seq bigint", "Append", "EventTime")


def closing(trace: DataFrame, beyond: str = "1 day") -> DataFrame:
    """One row with the columns of a trace that is no event and lies so far after its last event that the watermark passes all of them."""
    end = trace.agg((F.max("ts") + F.expr(f"interval {beyond}")).alias("ts"))
    own = {"ts": F.col("ts"), "name": F.lit(MARK)}
    return end.select(*[own.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in trace.schema])


def stream_trace_decision(stream: DataFrame, window: str = "1 minute", share: float = 0.8, lateness: str = "10 minutes") -> DataFrame:
    """trace_decision online, by windows of time: (scenario, start, n, do_trace, should_trace). Reads ts, scenario, y_pred, y_true."""
    rows = stream.withWatermark("ts", lateness).groupBy("scenario", F.window("ts", window).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("y_pred").cast("bigint")).alias("p"), F.sum(F.col("y_true").cast("bigint")).alias("t"))
    return rows.select("scenario", F.col("w.start").alias("start"), "n", (F.col("p") > share * F.col("n")).cast("int").alias("do_trace"), (F.col("t") > share * F.col("n")).cast("int").alias("should_trace"))


def run_once(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Process what is there, write it as Parquet below folder, and read it."""
    conf, key = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(key)
    conf.set(key, PROVIDER)
    try:
        query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode(mode).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        conf.set(key, before)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")
