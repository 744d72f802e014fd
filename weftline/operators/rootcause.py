"""Root cause by error vectors (H1-H10). Vectors are many; so may be the representatives, which are broadcast only if they are few."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators import metric, util

KINDS = ("event", "duration", "average")
#: Most representatives that are sent to every vector.
FEW = 1_000
#: Most numbers of centres, components counted, that k-means sends to every task and gets back from a round.
SENT = 2_000_000


def error_vectors(df: DataFrame, keys: list[str]) -> DataFrame:
    """H1, H2: (keys, component, event, duration, average), sparse: wrong event predictions by target id, wrong duration predictions by input id.

    Reads pred, target, input, tag_pred and tag; target or input 0 is padding.
    """
    events = df.where((F.col("pred") != F.col("target")) & (F.col("target") != 0)).select(*keys, F.col("target").alias("component"), F.lit(1).alias("e"), F.lit(0).alias("d"))
    spans = df.where((F.col("tag_pred") != F.col("tag")) & (F.col("tag") != 0) & (F.col("input") != 0)).select(*keys, F.col("input").alias("component"), F.lit(0).alias("e"), F.lit(1).alias("d"))
    sums = events.unionByName(spans).groupBy(*keys, "component").agg(F.sum("e").alias("event"), F.sum("d").alias("duration"))
    return sums.withColumn("average", (F.col("event") + F.col("duration")) / 2)


def class_mean(vectors: DataFrame, cls: str = "cls", components: str = "components") -> DataFrame:
    """H3: (cls, components): the mean vector of each class."""
    long = vectors.select(cls, F.posexplode(components).alias("pos", "v")).groupBy(cls, "pos").agg(F.avg("v").alias("m"))
    return long.groupBy(cls).agg(F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("x")).select(cls, F.col("x.m").alias("components"))  # one row per component


def _near(x: Column, centres: Column) -> Column:
    """Of an array of (k, m): the nearest and the second nearest as (d, k); ties: the least k."""
    return F.slice(F.sort_array(F.transform(centres, lambda s: F.struct(squared_distance(x, s["m"]).alias("d"), s["k"].alias("k")))), 1, 2)


def _centre_arrays(centres: DataFrame) -> DataFrame:
    """One row a class: (c, all)."""
    return util.bounded(centres.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("k", "m"))).alias("all")))


def centroid_seeds(rows: DataFrame, k: int, seed: int = 1, rounds: int = 5) -> DataFrame:
    """(c, k, m): seeds of each class by oversampled distances (k-means||). rows: (c, x), x of one length.

    From the vector with the least hash on, each round takes every vector by a seeded hash with a chance of 2k times its share of the class's squared
    distances to those taken so far. Some ten k vectors a class come together; weighted by how many vectors are nearest to each they are
    clustered by k-means++ in one small task a class, the best of ten starts. No window and no sort sees all vectors of a class.
    """
    chance = lambda r: F.pmod(F.xxhash64("x", F.lit(seed), F.lit(r)), F.lit(1 << 30)) / float(1 << 30)
    taken = util.cut(rows.groupBy("c").agg(F.min(F.struct(F.xxhash64("x", F.lit(seed)).alias("h"), "x")).alias("f")).select("c", F.col("f.x").alias("m")))
    numbered = lambda df: df.select("c", F.xxhash64("m").alias("k"), "m")
    for r in range(rounds):
        away = rows.join(_centre_arrays(numbered(taken)), "c").select("c", "x", _near(F.col("x"), F.col("all"))[0]["d"].alias("d"))
        cost = util.bounded(util.cut(away.groupBy("c").agg(F.sum("d").alias("cost")).where("cost > 0")))
        new = away.join(cost, "c").where(chance(r) < 2 * k * F.col("d") / F.col("cost")).select("c", F.col("x").alias("m")).distinct()
        taken = util.cut(taken.unionByName(new))
    weighed = rows.join(_centre_arrays(numbered(taken)), "c").select("c", _near(F.col("x"), F.col("all"))[0]["k"].alias("k")).groupBy("c", "k").agg(F.count(F.lit(1)).alias("w"))
    some = numbered(taken).join(weighed, ["c", "k"]).select("c", "m", "w")

    def choose(table: pa.Table) -> pa.Table:
        table = table.sort_by([("w", "descending")])
        x, w = np.array(table["m"].to_pylist(), dtype=float), table["w"].to_numpy().astype(float)
        x, at = np.unique(x, axis=0, return_inverse=True)
        w = np.bincount(at.reshape(-1), w)
        rng, best = np.random.default_rng(seed), (np.inf, x[:1])
        for _ in range(10):
            m = x[[rng.choice(len(x), p=w / w.sum())]]
            while len(m) < min(k, len(x)):
                d = np.square(x[:, None] - m[None]).sum(2).min(1) * w
                m = np.concatenate([m, x[[rng.choice(len(x), p=d / d.sum())]]])
            for _ in range(50):
                d = np.square(x[:, None] - m[None]).sum(2)
                own = d.argmin(1)
                m = np.array([np.average(x[own == j], axis=0, weights=w[own == j]) if (own == j).any() else m[j] for j in range(len(m))])
            cost = (np.square(x[:, None] - m[None]).sum(2).min(1) * w).sum()
            best = min(best, (cost, m), key=lambda b: b[0])
        m = best[1][np.lexsort(best[1].T[::-1])]
        return pa.table({"c": table["c"].slice(0, 1).combine_chunks().take(pa.array(np.zeros(len(m), np.int32))), "k": pa.array(np.arange(len(m), dtype=np.int32)), "m": pa.array(m.tolist(), pa.list_(pa.float64()))})

    kind = rows.schema["c"].dataType.simpleString()
    return some.groupBy("c").applyInArrow(choose, f"c {kind}, k int, m array<double>")


def class_centroids(vectors: DataFrame, k: int = 3, seed: int = 1, cls: str = "cls", components: str = "components", most_rounds: int | None = None, settled: float = 1e-12, most: int = SENT) -> DataFrame:
    """H4: (cls, k, components): k-means centres of each class, all classes at once, at a fixed point of Lloyd's rounds.

    Seeds as in ``centroid_seeds``. A round puts each vector to the nearest centre of its class (ties: the least k) and each centre to the mean of its vectors; vectors with null,
    NaN or infinite components don't count. Rounds go on to the fixed point however many it takes (each lowers the cost, so they end); with ``most_rounds`` an error is raised if so many don't
    reach it. A class with fewer distinct vectors than k has as many centres. Tasks get the centres, a row for each class and k, and add up their vectors as matrices; beyond ``most``
    numbers in what all tasks give back the centres stay in tables (``_rounds_by_joins``).
    """
    rows = vectors.select(F.col(cls).alias("c"), F.col(components).cast("array<double>").alias("x"))
    rows = util.cut(rows.where("c is not null and x is not null and not exists(x, v -> v is null or isnan(v) or abs(v) = double('infinity'))"))
    centres = util.cut(centroid_seeds(rows, k, seed))
    numbers = centres.agg(F.sum(F.size("m"))).first()[0] or 0
    wide = numbers * min(rows.rdd.getNumPartitions(), rows.sparkSession.sparkContext.defaultParallelism) > most
    centres = _rounds_by_joins(rows, centres, most_rounds, settled) if wide else _rounds(rows, centres, most_rounds, settled, most)
    return centres.select(F.col("c").alias(cls), "k", F.col("m").alias("components"))


class _Border:
    """What a task gives back of a class: sums by centre, and apart from them the vectors of the least margins (how much farther the second nearest centre is), a quarter of all at most."""

    def __init__(self, centres: np.ndarray, most: int):
        self.centres, self.most, self.seen, self.least = centres, most, 0, np.inf
        self.sums, self.counts = np.zeros_like(centres), np.zeros(len(centres), np.int64)
        self.x, self.near, self.margin = np.empty((0, centres.shape[1])), np.empty(0, np.int64), np.empty(0)

    def add(self, x: np.ndarray) -> None:
        d = metric.squared(x, self.centres)
        two = np.sqrt(np.sort(d, 1)[:, :2])
        margin = two[:, 1] - two[:, 0] if len(self.centres) > 1 else np.full(len(x), np.inf)
        self.x, self.near, self.margin = np.concatenate([self.x, x]), np.concatenate([self.near, d.argmin(1)]), np.concatenate([self.margin, margin])
        self.seen += len(x)
        self.trim(self.most)

    def trim(self, most: int) -> None:
        """All but so many vectors go into the sums; ``least`` is the least margin of those."""
        order = self.margin.argsort()
        kept, gone = order[:most], order[most:]
        if len(gone):
            self.least = np.minimum(self.least, self.margin[gone].min())
            self.sums, self.counts = _added(self.sums, self.counts, self.x[gone], self.near[gone])
            self.x, self.near, self.margin = self.x[kept], self.near[kept], self.margin[kept]


def _added(sums: np.ndarray, counts: np.ndarray, x: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return sums + np.stack([x[near == j].sum(0) for j in range(len(sums))]), counts + np.bincount(near, minlength=len(sums))


def _still(step: float, size: float, settled: float) -> bool:
    """Whether centres (squared length: size) moved no farther (squared: step) than rounding moves them, or ``settled``."""
    if not math.isfinite(step):
        raise ArithmeticError("squared distances are beyond the range of doubles")
    return step <= max(settled, 1e-24 * size)


def _rounds(rows: DataFrame, centres: DataFrame, most_rounds: int | None, settled: float, most: int) -> DataFrame:
    """Lloyd's rounds with few centres, which every task gets.

    A job puts all vectors to their centres. It gives back the sums and the vectors near a border between centres (``_Border``), together at most about ``most`` numbers. While the two centres of a
    class that moved most have not moved as far as the least margin of the summed vectors, these stay where they are, and a round needs the others alone: the same
    rounds as over all vectors, several for one job. Classes go on by themselves, and those that are settled are not read again.
    """
    spark, kind = rows.sparkSession, rows.schema["c"].dataType.simpleString()
    now: dict = {}
    for r in centres.orderBy("c", "k").toArrow().to_pylist():
        now.setdefault(r["c"], []).append(r["m"])
    now = {c: np.array(m, dtype=float) for c, m in now.items()}
    if not now:
        return centres
    numbers = sum(m.size for m in now.values())
    tasks = min(rows.rdd.getNumPartitions(), most // numbers)
    rows, moving, rounds = rows.coalesce(tasks), set(now), dict.fromkeys(now, 0)

    while moving:
        sent = spark.sparkContext.broadcast({c: now[c] for c in moving})
        room = max(0, most - tasks * numbers) // (tasks * sum(now[c].shape[1] for c in moving))

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict = {}
            for batch in (b for b in batches if b.num_rows):
                classes = batch["c"].dictionary_encode()
                x, of = metric.matrix(batch["x"]), classes.indices.to_numpy()
                for i, c in enumerate(classes.dictionary.to_pylist()):
                    found.setdefault(c, _Border(sent.value[c], room)).add(x[of == i])
            for c, b in found.items():
                b.trim(b.seen // 4)
                own = np.flatnonzero(b.counts)
                n = pa.array([*b.counts[own].tolist(), *[None] * len(b.x)], pa.int64())
                x = np.concatenate([b.sums[own], b.x])
                flat = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.reshape(-1))
                columns = [pa.array([c] * len(x), batch.schema.field("c").type), pa.array(np.concatenate([own, b.near]), pa.int32()), n, flat, pa.array(np.full(len(x), b.least))]
                yield pa.RecordBatch.from_arrays(columns, ["c", "k", "n", "x", "least"])

        some = rows if len(moving) == len(now) else rows.where(F.col("c").isin(list(moving)))
        got = some.mapInArrow(add, f"c {kind}, k int, n bigint, x array<double>, least double").toArrow().combine_chunks()  # about ``most`` numbers
        sent.destroy()
        classes = got["c"].combine_chunks().dictionary_encode()
        for i, c in enumerate(classes.dictionary.to_pylist()):
            own = got.filter(pa.array(classes.indices.to_numpy() == i))
            x, at, n, least = metric.matrix(own["x"]), own["k"].to_numpy(), own["n"].fill_null(0).to_numpy(), own["least"].to_numpy().min()
            sums, counts, apart = np.zeros_like(now[c]), np.zeros(len(now[c]), np.int64), x[n == 0]
            np.add.at(sums, at[n > 0], x[n > 0])
            np.add.at(counts, at, n)
            base, last = now[c], None
            while last is None or np.sort(np.sqrt(np.square(now[c] - base).sum(1)))[-2:].sum() + 1e-9 < least:
                near = metric.squared(apart, now[c]).argmin(1)
                if last is not None and (near == last).all():
                    moving.remove(c)
                    break
                s, n = _added(sums, counts, apart, near)
                before, last, rounds[c] = now[c], near, rounds[c] + 1
                now[c] = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], before)
                if _still(np.square(now[c] - before).sum(1).max(), np.square(now[c]).sum(1).max(), settled):
                    moving.remove(c)
                    break
                if most_rounds is not None and rounds[c] >= most_rounds:
                    raise RuntimeError(f"centres still moved after {most_rounds} rounds")
    return spark.createDataFrame([(c, j, x.tolist()) for c, m in now.items() for j, x in enumerate(m)], f"c {kind}, k int, m array<double>")


def _rounds_by_joins(rows: DataFrame, centres: DataFrame, most_rounds: int | None, settled: float) -> DataFrame:
    """Lloyd's rounds with many centres, which stay in tables.

    Vectors that can't have changed are not read: how much nearer a vector is to its centre than to the next is written once, in order of that margin; while twice what the
    centres of its class have moved since is less, it stays where it is. A round reads the others alone and corrects the sums; when
    these are over a third of all, margins are written anew.
    """
    total, base = rows.count(), None
    for _ in itertools.count() if most_rounds is None else range(most_rounds):
        if base is None:
            near = rows.join(_centre_arrays(centres), "c").select("c", "x", _near(F.col("x"), F.col("all")).alias("n"))
            margin = F.coalesce(F.sqrt(F.col("n")[1]["d"]) - F.sqrt(F.col("n")[0]["d"]), F.lit(float("inf")))
            folder = util.shared_folder(rows.sparkSession)
            near.select("c", "x", F.col("n")[0]["k"].alias("k"), margin.alias("margin")).sortWithinPartitions("margin").write.parquet(folder)
            written, base = rows.sparkSession.read.parquet(folder), centres
            sums = util.cut(written.select("c", "k", F.posexplode("x").alias("pos", "v")).groupBy("c", "k", "pos").agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n")))
            now = sums
        else:
            drift = centres.join(base.select("c", "k", F.col("m").alias("old")), ["c", "k"]).groupBy("c").agg((2 * F.sqrt(F.max(squared_distance(F.col("m"), F.col("old")))) + 1e-9).alias("drift"))
            drift = util.cut(drift)
            most = drift.agg(F.max("drift")).first()[0] or 0.0
            moved = written.where(F.col("margin") <= most).join(util.bounded(drift), "c").where("margin <= drift").join(_centre_arrays(centres), "c")
            moved = util.cut(moved.select("c", "x", F.col("k").alias("old"), _near(F.col("x"), F.col("all"))[0]["k"].alias("new")))
            if 3 * moved.count() > total:
                base = None
                continue
            changes = moved.where("old <> new").select("c", F.inline(F.array(F.struct(F.col("old").alias("k"), F.lit(-1).alias("sign")), F.struct(F.col("new").alias("k"), F.lit(1).alias("sign")))), "x")
            changes = changes.select("c", "k", "sign", F.posexplode("x").alias("pos", "v")).select("c", "k", "pos", (F.col("sign") * F.col("v")).alias("s"), F.col("sign").cast("bigint").alias("n"))
            now = sums.unionByName(changes).groupBy("c", "k", "pos").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
        means = now.where("n > 0").groupBy("c", "k").agg(F.sort_array(F.collect_list(F.struct("pos", (F.col("s") / F.col("n")).alias("v")))).alias("x")).select("c", "k", F.col("x.v").alias("n"))
        both = util.cut(centres.join(means, ["c", "k"], "left").select("c", "k", "m", F.coalesce("n", "m").alias("n")))
        centres = both.select("c", "k", F.col("n").alias("m"))
        step, size = both.agg(F.max(squared_distance(F.col("m"), F.col("n"))), F.max(dot(F.col("n"), F.col("n")))).first()
        if _still(step or 0.0, size or 0.0, settled):
            return centres
    raise RuntimeError(f"centres still moved after {most_rounds} rounds")


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def class_exemplars(vectors: DataFrame, key: str = "vec_id", cls: str = "cls", components: str = "components", **how) -> DataFrame:
    """H5: the vectors of a class whose distance to their nearest neighbour in it is at most the median of these distances.

    Neighbours are found by ``metric.neighbours`` (exact; how: its parameters). Keys are integers.
    """
    rows = vectors.select(F.col(cls).alias("g"), F.col(key).cast("bigint").alias("id"), F.col(components).cast("array<double>").alias("x"), F.lit(None).cast("int").alias("label"))
    found = metric.neighbours(rows.drop("label"), rows, **how).select("id", F.sqrt("d").alias("nearest"))
    least = util.cut(rows.select("g", "id").join(found, "id"))
    middle = util.medians(least, "g", "nearest", "median").withColumnRenamed("g", "m")
    kept = least.join(util.bounded(middle), F.col("g").eqNullSafe(F.col("m"))).where("nearest <= median").select(F.col("id").alias(key), "nearest")
    return vectors.join(kept, key)


def nearest(vectors: DataFrame, representatives: DataFrame, key: str = "vec_id", cls: str = "cls", components: str = "components", few: int = FEW, **how) -> DataFrame:
    """H6, H7: (key, predicted, distance): class of the nearest representative; ties: the least class.

    Up to ``few`` representatives go to every vector as one array; more are searched by ``metric.neighbours`` (exact; how: its parameters). Keys are integers.
    """
    reps = util.cut(representatives.select(F.col(cls).alias("c"), F.col(components).cast("array<double>").alias("r")))
    if reps.limit(few + 1).count() <= few:
        all_ = reps.agg(F.collect_list(F.struct("c", "r")).alias("__all"))
        best = F.array_min(F.transform("__all", lambda s: F.struct(squared_distance(F.col(components), s["r"]).alias("d"), s["c"].alias("c"))))
        rows = vectors.crossJoin(F.broadcast(all_)).select(key, best.alias("b"))
        return rows.select(key, F.col("b.c").alias("predicted"), F.sqrt("b.d").alias("distance"))
    asked = vectors.select(F.lit(0).alias("g"), F.col(key).cast("bigint").alias("id"), F.col(components).cast("array<double>").alias("x"))
    reps = reps.select(F.lit(0).alias("g"), F.lit(None).cast("bigint").alias("id"), F.col("r").alias("x"), F.col("c").alias("label"))
    found = metric.neighbours(asked, reps, **how)
    return found.select(F.col("id").alias(key), F.col("label").alias("predicted"), F.sqrt("d").alias("distance"))


def best_cosine(vectors: DataFrame, means: DataFrame, key: str = "vec_id", cls: str = "cls", components: str = "components", digits: int | None = None, norm: str | None = None) -> DataFrame:
    """H8: (key, predicted, similarity): class of the mean vector with the highest cosine; ties: the least class.

    digits: cosines that are equal to so many digits tie. norm: a column that stands for the length of a vector.
    """
    means_ = means.agg(F.collect_list(F.struct(F.col(cls).alias("c"), F.col(components).alias("r"))).alias("__all"))  # one mean a class
    x = F.col(components)

    def cosine(r: Column) -> Column:
        return F.coalesce(F.try_divide(dot(x, r), (F.sqrt(dot(x, x)) if norm is None else F.col(norm)) * F.sqrt(dot(r, r))), F.lit(0.0))

    level = lambda d: d if digits is None else F.round(d, digits)
    all_ = F.transform("__all", lambda s: F.struct((-cosine(s["r"])).alias("d"), s["c"].alias("c")))
    best = F.array_min(F.transform(all_, lambda s: F.struct(level(s["d"]).alias("l"), s["c"].alias("c"), s["d"].alias("d"))))
    rows = vectors.crossJoin(F.broadcast(means_)).select(key, best.alias("b"))
    return rows.where("b.d < 1").select(key, F.col("b.c").alias("predicted"), (-F.col("b.d")).alias("similarity"))


def root_cause_accuracy(predicted: DataFrame, cls: str = "cls") -> DataFrame:
    """H9: (cls, accuracy in percent, n)."""
    return predicted.groupBy(cls).agg((F.avg(F.coalesce((F.col("predicted") == F.col(cls)).cast("double"), F.lit(0.0))) * 100).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def root_cause_gated(scored: DataFrame, verdicts: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(set, accuracy, n): requests that are said to be novel and whose batch was classified rightly.

    scored: (set, batch, score); verdicts: (set, batch, right); thresholds: (set, threshold).
    """
    rows = scored.join(verdicts, ["set", "batch"]).join(F.broadcast(thresholds.select("set", "threshold")), "set")
    return rows.groupBy("set").agg((F.avg(((F.col("score") > F.col("threshold")) & F.col("right")).cast("double")) * 100).alias("accuracy"), F.count(F.lit(1)).alias("n"))
