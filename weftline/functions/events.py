"""Scalar functions on trace events (B1-B6). A name may contain both words; the order of the tests is part of the meaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTER, EXIT = "httpd:enter_event_handler", "httpd:exit_event_handler"
#: Kernel events that begin and end something, under the names that pairing understands.
RENAMED = {
    "block_rq_insert": "block_rq_entry",
    "block_rq_complete": "block_rq_exit",
    "timer_hrtimer_start": "timer_hrtimer_entry",
    "timer_hrtimer_cancel": "timer_hrtimer_exit",
    "timer_start": "timer_entry",
    "timer_cancel": "timer_exit",
}


def event_rename(events: DataFrame) -> DataFrame:
    """B1: begin/end names; sector only for block events, next_tid only for sched_switch."""
    name = F.col("name")
    new = F.coalesce(*[F.when(name == old, F.lit(to)) for old, to in RENAMED.items()], name)
    return events.withColumns({"name": new, "sector": F.when(new.isin("block_rq_entry", "block_rq_exit"), F.col("sector")), "next_tid": F.when(new == "sched_switch", F.col("next_tid"))})


def key_coalesce(events: DataFrame) -> DataFrame:
    """B2: tid over vtid, pid over vpid."""
    return events.withColumns({"tid": F.coalesce("tid", "vtid"), "pid": F.coalesce("pid", "vpid")}).drop("vtid", "vpid")


def connection_state(events: DataFrame) -> DataFrame:
    """-1 for a missing state of a handler event and for every other event."""
    return events.withColumn("connection_state", F.when(is_handler(F.col("name")), F.coalesce(F.col("connection_state").cast("int"), F.lit(-1))).otherwise(F.lit(-1)))


def is_handler(name: Column) -> Column:
    return name.isin(ENTER, EXIT)


def is_entry(name: Column) -> Column:
    return name.contains("entry")


def is_exit(name: Column) -> Column:
    return name.contains("exit") & ~name.contains("entry")


def sysname(name: Column, strip_suffix: bool = False) -> Column:
    """The call's name; with strip_suffix a last _entry or _exit goes too, so that renamed kernel events pair."""
    out = name
    for part in ("syscall_", "entry_", "exit_"):
        out = F.replace(out, F.lit(part), F.lit(""))
    return F.regexp_replace(out, "_(entry|exit)$", "") if strip_suffix else out


def direction(name: Column) -> Column:
    """1 entry, 2 exit, 0 neither."""
    return F.when(name.contains("entry"), 1).when(name.contains("exit"), 2).otherwise(0)


def ret_code(name: Column, ret: Column) -> Column:
    """0 at entry, 1 success, 2 failure; a missing value counts as 0, so as success."""
    return F.when(name.contains("entry"), 0).when(F.coalesce(ret, F.lit(0)) >= 0, 1).otherwise(2)
