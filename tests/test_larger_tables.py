"""What only shows on tables larger or odder than the smallest ones."""

import random

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tests.test_catalog import SF, plain
from weftline.operators import metric, ngram, rootcause, util
from weftline.plans import catalog
from weftline.streaming import state


def test_batches_of_several_classes(spark, tmp_path):
    """Beyond 10,000 vectors the batch numbers of J3 meet those of the next class."""
    one = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = one.unionByName(one.withColumn("vec_id", F.col("vec_id") + 10_000)).unionByName(one.withColumn("vec_id", F.col("vec_id") + 20_001))
    rows.write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    found = con.execute(catalog.ORACLES["J3_root_cause"])
    columns = [c[0] for c in found.description]
    df = catalog.QUERIES["J3_root_cause"](spark, str(tmp_path))
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(found.fetchall(), columns)
    assert con.execute("SELECT count(*) > 0 FROM (SELECT label * 1000 + vec_id // 10 AS b FROM embeddings GROUP BY b HAVING count(DISTINCT label) > 1)").fetchone()[0]


def test_a_round_of_k_means_is_one_small_job(spark):
    """The driver keeps something of every job, so rounds must be few jobs; both ways of a round end at the same centres."""
    rng = random.Random(31)
    rows = [(rng.choice("xyz"), [rng.gauss(0, 1) for _ in range(5)]) for _ in range(900)] + [(None, [0.0] * 5), ("x", None), ("y", [1.0, None, 1.0, 1.0, 1.0])]
    df = util.cut(spark.createDataFrame(rows, "cls string, components array<double>").repartition(3))
    found, jobs = {}, {}
    for most in (rootcause.SENT, 0):
        spark.sparkContext.setJobGroup(f"most-{most}", "")
        found[most] = {(r.cls, r.k): r.components for r in rootcause.class_centroids(df, most=most).collect()}
        jobs[most] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"most-{most}"))
    one, two = found.values()
    assert one.keys() == two.keys() == {(c, k) for c in "xyz" for k in range(3)}
    assert all(abs(a - b) < 1e-6 for key in one for a, b in zip(one[key], two[key]))
    assert 2 * jobs[rootcause.SENT] < jobs[0]


def test_k_means_takes_the_rounds_it_needs(spark):
    """Points on a ring of almost even density turn their centres for more than 200 rounds, to the fixed point of plain rounds; few of the rounds read all vectors. What is not finite doesn't count."""
    even = np.arange(30_000) * 2 * np.pi / 30_000
    angle = even
    for _ in range(50):
        angle = even - 0.005 * np.sin(3 * angle)
    x = np.round(np.stack([np.cos(angle), np.sin(angle)], 1), 6)
    rows = util.cut(spark.createDataFrame([("r", v) for v in x.tolist()], "c string, x array<double>").repartition(4))
    m, last, rounds = np.array([r.m for r in rootcause.centroid_seeds(rows, 3).orderBy("k").collect()]), None, 0
    while last is None or np.square(m - last).sum(1).max() > 1e-12:
        near = np.square(x[:, None] - m[None]).sum(2).argmin(1)
        m, last, rounds = np.array([x[near == j].mean(0) for j in range(3)]), m, rounds + 1
    odd = spark.createDataFrame([("r", [float("nan"), 1.0]), ("r", [1.0, float("-inf")]), ("odd", [float("inf"), 0.0])], rows.schema)
    spark.sparkContext.setJobGroup("ring", "")
    found = rootcause.class_centroids(rows.unionByName(odd), cls="c", components="x").orderBy("k").collect()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("ring"))
    assert [(r.c, r.k) for r in found] == [("r", 0), ("r", 1), ("r", 2)] and np.allclose([r.components for r in found], m, atol=1e-9)
    assert jobs < rounds and rounds > 200


def test_noise_is_compared_by_blocks(spark):
    """Where no bound excludes anything a query is sent to few blocks, not to every ring; distances stay those of exact sums."""
    rng = random.Random(41)
    rows = [(i, i % 2, [rng.gauss(0, 1) for _ in range(24)]) for i in range(1500)]
    rows += [(3000 + i, 0, [x + 1e-9 * i for x in rows[0][2]]) for i in range(4)] + [(4000 + i, 1, rows[1][2]) for i in range(3)]
    df = spark.createDataFrame(rows, "id bigint, g int, x array<double>").withColumn("label", F.col("id") % 7)
    found = {r.id: r for r in metric.neighbours(df.drop("label"), df, ring=8, block=300).collect()}
    x = np.array([v for *_, v in rows])
    for k, (i, g, v) in enumerate(rows):
        exact = np.zeros(len(x))
        for c in range(24):
            exact += np.square(v[c] - x[:, c])
        others = [(exact[j], rows[j][0] % 7) for j in range(len(rows)) if j != k and rows[j][1] == g]
        assert (found[i].d, found[i].label) == min(others)
    # a ring holds 8 points at most; only blocks overlap with what was seen first, so more than all others are compared where they are used
    assert sum(r.compared > 753 for r in found.values()) > 1000


def test_ngrams_are_counted_in_small_batches(spark, monkeypatch):
    rows = spark.range(0, 300, 1, 1).select(F.col("id").alias("rn"), F.array_repeat(F.lit(7), 50_000).alias("call"))  # 60 MB in one task
    sizes = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches)
    seen, own = [], util.cut

    def cut(df):
        seen.append(max(r.n for r in rows.mapInArrow(sizes, "n bigint").collect()))
        return own(df)

    monkeypatch.setattr(util, "cut", cut)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    counts = ngram.ngram_count(rows, 3)
    assert sorted((tuple(r.context), r.word, r.c) for r in counts.collect()) == [((2, 7), 7, 300), ((7, 7), 7, 300 * 49_997)]
    assert ngram.ngram_perplexity(rows, counts, 3, 0.01, ["rn"]).count() == 300
    assert seen[0] < 9 << 20 and seen[-1] < 9 << 20 and len(seen) == 3 and spark.conf.get(key) == before


class Held(dict):
    """A map or value state in memory."""

    containsKey = dict.__contains__
    getValue = dict.get
    updateValue = dict.__setitem__
    removeKey = dict.pop

    def iterator(self):
        return iter(list(self.items()))

    def exists(self):
        return () in self

    def get(self):
        return self[()]

    def update(self, value):
        self[()] = value


class Handle:
    def getMapState(self, *_):
        return Held()

    getValueState = getMapState

    def registerTimer(self, at):
        pass


def test_a_key_with_many_buffered_events_is_released_in_pieces():
    """What is held in memory at once doesn't grow with the events of a key; the order of seq stays."""
    from types import SimpleNamespace

    n = 3 * state.PIECE + 17
    most = []

    class Seen(state.InOrder):
        def step(self, key, seq, value, kind, found):
            return (seq, value, found), value

        def take(self, piece, parts):
            rows = super().take(piece, parts)
            most.append(len(rows))
            return rows

    seen = Seen(10**9)
    seen.init(Handle())
    rows = [SimpleNamespace(seq=i, at=i // 2, value=None if i % 7 == 0 else 10 * i, kind=state.OPENS) for i in range(n)]
    random.Random(3).shuffle(rows)
    assert list(seen.handleInputRows((1,), iter(rows), None)) == []
    assert max(len(v[0]) for v in seen.held.values()) <= 32 * state.AT_ONCE

    def release(now):
        due = seen.due.get()[0]
        return list(seen.handleExpiredTimer((1,), SimpleNamespace(getCurrentWatermarkInMs=lambda: now), SimpleNamespace(getExpiryTimeInMs=lambda: due)))

    half = release(n // 4)
    got = half + release(n)
    value = lambda i: None if i < 0 or i % 7 == 0 else 10 * i
    assert got == [(i, value(i), value(i - 1)) for i in range(n)] and 0 < len(half) < n
    assert max(most) <= state.PIECE and not seen.held and not seen.pieces


def test_sequences_pair_the_events_once(spark, monkeypatch):
    """Requests and spans come from one pairing that is written, and nothing else of the events' size is sorted twice."""
    from weftline.operators import requests
    from weftline.plans import fixtures as fx

    paired, cuts, pair, own = [], [], requests.pair_latency, util.cut
    monkeypatch.setattr(requests, "pair_latency", lambda *a, **k: paired.append(1) or pair(*a, **k))
    monkeypatch.setattr(util, "cut", lambda df: cuts.append(df.columns) or own(df))
    assert fx.sequences(spark, SF)[0].count() > 0
    # durations are ordered where the sequences are grouped, not written before
    assert len(paired) == 1 and not any("duration" in c for c in cuts)


def test_adaptive_tracing_numbers_requests_once(spark, monkeypatch):
    """One order numbers the requests of all sets and roles, no join brings the times to the scores, and of the requests only packed slabs are written."""
    from weftline.operators import adaptive

    ordered, placed, own, packed = [], util.ordinal, util.cut, []
    monkeypatch.setattr(util, "ordinal", lambda *a, **k: ordered.append(1) or placed(*a, **k))
    monkeypatch.setattr(util, "cut", lambda df: packed.append((df.columns, own(df).count())) or own(df))
    assert catalog.QUERIES["J2_adaptive_tracing"](spark, SF).count() > 0
    assert len(ordered) == 1
    slabs = [n for columns, n in packed if columns == ["set", "y_true", "slab", *adaptive.SLAB_OF]]
    assert slabs == [6]  # known and novel of each set, in one slab


def test_ordinals_of_many_groups(spark):
    """Groups that begin and end within ranges, null keys among them, are numbered from 1 each."""
    rng = random.Random(51)
    rows = [(rng.choice(["a", "b", None, *"cdefgh"]), k % 3, rng.randrange(10**9), [float(k)]) for k in range(700)] + [("z", 0, 1, None)]
    got = util.ordinal(spark.createDataFrame(rows, "g string, h int, x bigint, v array<double>").repartition(7), ["g", "h"], ["x"], "o").collect()
    seen, want = {}, []
    for g, h, x, v in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        seen[g, h] = seen.get((g, h), 0) + 1
        want.append((g, h, x, v, seen[g, h]))
    assert sorted(map(repr, want)) == sorted(repr((r.g, r.h, r.x, r.v, r.o)) for r in got)


def test_sequences_write_no_row_for_each_event_of_a_request(spark, monkeypatch):
    """Requests are cut from slabs of the trace: what is written between steps is the trace, once, and rows of requests."""
    from weftline.plans import fixtures as fx

    cuts, scans, own, stored = [], [], util.cut, util.stored
    monkeypatch.setattr(util, "cut", lambda df: cuts.append(own(df)) or cuts[-1])
    monkeypatch.setattr(util, "stored", lambda df: scans.append(stored(df)) or scans[-1])
    seqs = fx.sequences(spark, SF)[0]
    n, events = seqs.count(), seqs.agg(F.sum(F.size("call") - 2)).first()[0]
    whole = [df for df in scans if df.count() == 1000]  # the paired trace
    assert len(whole) == 1 and events > 1000 > n
    assert all(df.count() <= max(n, 200) for df in cuts) and all(df.count() < 1000 for df in scans if df is not whole[0])


def test_requests_of_several_slabs(spark):
    """Pieces of a long request come together in order, with the time between them; several requests are open at once, and some hold no events."""
    from weftline.functions import events as ev
    from weftline.operators import requests

    rng = random.Random(61)
    seqs = sorted(rng.sample(range(-20, 900), 420))
    names = [rng.choice([ev.ENTER, ev.EXIT, *["syscall_entry_read", "syscall_exit_read", "syscall_exit_poll"] * 4]) for _ in seqs]
    trace = [(s, None if s % 31 == 0 else s * s, n, rng.choice([0, 1, 2]), rng.choice([0, None]), rng.choice(["a", "b", None, f"p{s}"]), rng.choice([-1, 3, None]), 1) for s, n in zip(seqs, names)]
    trace = [(-30, 0, ev.ENTER, 7, 0, "a", 0, 1), (-25, 5, ev.ENTER, 8, 0, "a", 0, 1), (-24, 6, ev.EXIT, 8, 0, "a", 0, 1), *trace, (901, 9, ev.EXIT, 7, 0, "a", 0, 1)]
    df = spark.createDataFrame(trace, "seq bigint, ts_ns bigint, name string, tid bigint, pid bigint, procname string, ret bigint, connection_state int").repartition(5)
    want, started = {}, {}
    for s, _, n, tid, *_ in trace:
        if n == ev.ENTER:
            started[tid] = s
        elif n == ev.EXIT and tid in started:
            start = started.pop(tid)
            inside = [r for r in trace if start < r[0] < s and r[2] not in (ev.ENTER, ev.EXIT)]
            if inside:
                want[s] = (start, inside)
    rn = {s: i + 1 for i, s in enumerate(sorted(want))}
    first = {}
    for s in sorted(want, key=rn.get):
        for r in want[s][1]:
            if r[5] is not None:
                first.setdefault(r[5], (rn[s], r[0]))
    got = {}
    for slab in (7, 1 << 16):
        numbered = requests.requests_with_events(df, requests.request_intervals(df, slab=slab), slab)
        assert {r.request_id: (r.start_seq, r.end_seq, r.rn) for r in numbered.collect()} == {s: (want[s][0], s, rn[s]) for s in want}
        p = util.cut(requests.pair_latency(df, slab=slab))
        procs = requests.vocab_build(requests.first_words(p, numbered, slab), "procname")
        assert [r.word for r in procs.orderBy("idx").collect()] == sorted(first, key=lambda w: (first[w], w))
        encoded = p.withColumns({"call": F.length("sysname"), "proc": F.length("procname"), "tag": F.concat(F.lit("t"), F.col("seq"))})
        rows = requests.build_sequences(encoded, numbered.withColumn("dataset", F.lit("d")), slab).collect()
        got[slab] = {r.request_id: r for r in rows}
        assert len(rows) == len(want)
    assert got[7] == got[1 << 16]
    for s, (start, inside) in want.items():
        r = got[7][s]
        ts = [e[1] for e in inside]
        deltas = [0] + [0 if a is None or b is None else b - a for a, b in zip(ts, ts[1:])]
        assert (r.rn, r.start_ts, r.duration, r.duration_ms) == (rn[s], ts[0], [0, *deltas, 0], sum(deltas) / 1e6)
        assert r.tags == ["0-0-0-0", *[f"t{e[0]}" for e in inside], "0-0-0-0"] and r.pid == [0, *[e[4] for e in inside], 0] and r.tid == [0, *[e[3] for e in inside], 0]
        assert r.ret == [0, *[0 if "entry" in e[2] else 2 if (e[6] or 0) < 0 else 1 for e in inside], 0] and r.entry == [0, *[1 if "entry" in e[2] else 2 for e in inside], 0]
        assert r.call == [2, *[4] * len(inside), 3] and r.proc == [2, *[e[5] and len(e[5]) for e in inside], 3]
