"""Exact nearest neighbours by a metric index, for H5 and H6.

A bounded sample of the points are pivots; the points nearest to a pivot are its cell (of each group), and a cell is cut, by the distance to its pivot, into
rings of about ``block`` points. A query knows its distance to every pivot, so the triangle inequality bounds from below what is in a ring, and the plane
between two pivots what is in a cell. Each query is compared with the ring of the least bound first; after that with the rings
whose bound is below the best distance so far. All others can't hold a nearer point, so they are never compared. Where bounds exclude little (many
components, noise) a query goes to blocks of neighbouring rings instead, so that its rows stay few: all pairs then, as products of matrices in bounded tasks.

The pivots and the table of rings (``MOST_RINGS`` rows and one for each group and cell) go to every task; points and queries are only shuffled. Rings that
many queries visit are sent to several tasks. Among copies of a point the first ring gives the distance 0, and no other ring is visited.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators import util

#: Points of a ring, at least; rings, pivots and groups times pivots, at most; queries that a task compares with a ring or block.
RING, MOST_RINGS, MOST_PIVOTS, MOST_CELLS, QUERIES = 256, 100_000, 1_024, 100_000, 16_384
#: Points of a block of rings, about; as many comparisons as a row that is sent costs.
BLOCK, ROW = 16_384, 128
#: Room for rounding in bounds.
_ROOM = 1e-9


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The vectors of a column, all of one length and without nulls, as rows."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances, added up component by component as SQL does."""
    d = np.zeros((len(x), len(y)))
    for c in range(y.shape[1]):
        d += np.square(x[:, c, None] - y[None, :, c])
    return d


def closest(x: np.ndarray, y: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row of x the least ``squared`` distance to a row of y (inf: none) and its number, of equal ones the first; own: pairs that don't count.

    A product of matrices leaves few candidates, more than rounding can put in the wrong order; these are compared exactly.
    """
    xx, yy = np.square(x).sum(1), np.square(y).sum(1)
    d = x @ y.T
    d *= -2
    d += xx[:, None]
    d += yy[None, :]
    d[own] = np.inf
    least = d.min(1)
    i, j = np.nonzero(d <= np.where(np.isfinite(least), least + _ROOM * (1 + xx + yy.max()), -np.inf)[:, None])
    exact = np.zeros(len(i))
    for c in range(y.shape[1]):
        exact += np.square(x[i, c] - y[j, c])
    keep = ~own[i, j] & np.isfinite(exact)
    i, j, exact = i[keep], j[keep], exact[keep]
    order = np.lexsort((j, exact, i))
    rows, at = np.unique(i[order], return_index=True)
    best, number = np.full(len(x), np.inf), np.zeros(len(x), np.int64)
    best[rows], number[rows] = exact[order][at], j[order][at]
    return best, number


def _rows(batches: Iterator[pa.RecordBatch], size: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


class Rings:
    """The table of rings: by group, their pivots, ranges of distances, and least labels."""

    def __init__(self, table: pa.Table, pivots: np.ndarray):
        self.pivots = pivots
        self.between = np.sqrt(squared(pivots, pivots))
        self.pivot, self.low, self.high = (table[c].to_numpy() for c in ("p", "low", "high"))
        self.label, self.ring = table["label"].to_pylist(), table["ring"].to_numpy()
        self.size, self.block, self.held = (table[c].to_numpy() for c in ("n", "block", "held"))
        self.of: dict = {}
        for k, g in enumerate(table["g"].to_pylist()):
            self.of.setdefault(g, []).append(k)
        self.of = {g: np.array(k) for g, k in self.of.items()}

    def bounds(self, away: np.ndarray, rings: np.ndarray) -> np.ndarray:
        """Per query and ring: no point of the ring is nearer than this. away: distances to the pivots."""
        p = self.pivot[rings]
        to = away[:, p]
        out = np.maximum(to - self.high[rings], self.low[rings] - to)
        home = away.argmin(1)
        apart = self.between[home][:, p]
        plane = np.divide(np.square(to) - np.square(away[np.arange(len(away)), home])[:, None], 2 * apart, out=np.zeros_like(to), where=apart > 0)
        return np.maximum(np.maximum(out, plane) - _ROOM * (1 + to + self.high[rings]), 0)


def neighbours(queries: DataFrame, points: DataFrame, ring: int = RING, most_pivots: int = MOST_PIVOTS, most_rings: int = MOST_RINGS, block: int = BLOCK) -> DataFrame:
    """(id, d, label, compared): for each of queries (g, id, x) the squared distance to the nearest of points (g, id, x, label) of its group
    that has another id, its label (of equally near ones the least), and how many points it was compared with. Queries without such a point are left out.
    Keys are integers, vectors have one length.
    """
    spark = points.sparkSession
    points = util.cut(points)
    total = points.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.xxhash64("g")).alias("g")).first()
    kind, label = points.schema["g"].dataType.simpleString(), points.schema["label"].dataType.simpleString()
    if not total.n:
        return spark.createDataFrame([], f"id bigint, d double, label {label}, compared bigint")
    wanted = max(1, min(most_pivots, MOST_CELLS // total.g, total.n // ring))
    hashed = F.pmod(F.xxhash64("x"), F.lit(1 << 30))
    some = points.where(hashed < max(1, wanted * (1 << 30) // total.n)).select("x").distinct().limit(2 * wanted).toArrow()  # about as many as wanted
    pivots = np.unique(matrix((some if len(some) else points.select("x").limit(1).toArrow())["x"]), axis=0)
    near = spark.sparkContext.broadcast(pivots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _rows(batches):
            d = squared(matrix(batch["x"]), near.value)
            p = d.argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p.astype(np.int32)), pa.array(np.sqrt(d[np.arange(len(p)), p]))], [*batch.schema.names, "p", "r"])

    placed = points.select("g", "id", "x", "label").mapInArrow(place, f"g {kind}, id bigint, x array<double>, label {label}, p int, r double")
    size = max(ring, -(-total.n // most_rings))
    placed = util.ordinal(placed, ["g", "p"], ["r", "id"], "k").withColumn("b", F.call_function("div", F.col("k") - 1, F.lit(size).cast("bigint")))
    rings = placed.groupBy("g", "p", "b").agg(F.min("r").alias("low"), F.max("r").alias("high"), F.min("label").alias("label"), F.count(F.lit(1)).alias("n"))
    rings = rings.coalesce(1).withColumn("ring", F.monotonically_increasing_id())  # a row for each ring
    before = F.sum("n").over(Window.partitionBy("g").orderBy("p", "b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    blocks = Window.partitionBy("g", F.call_function("div", before, F.lit(block).cast("bigint")))
    rings = util.cut(rings.withColumns({"block": -1 - F.min("ring").over(blocks), "held": F.sum("n").over(blocks)}))
    table = spark.sparkContext.broadcast(rings.toArrow())
    stored = util.cut(placed.join(util.bounded(rings.select(F.col("g").alias("__g"), F.col("p").alias("__p"), F.col("b").alias("__b"), "ring", "block")), F.col("g").eqNullSafe(F.col("__g")) & (F.col("p") == F.col("__p")) & (F.col("b") == F.col("__b"))).select("ring", "block", "id", "x", "label"))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Rings(table.value, near.value)
        for batch in _rows(batches):
            away = np.sqrt(squared(matrix(batch["x"]), near.value))
            out = np.full(batch.num_rows, -1, np.int64)
            groups = batch["g"].to_pylist()
            for g in set(groups) & index.of.keys():
                at = np.array([k for k, h in enumerate(groups) if h == g])
                own = index.of[g]
                bound = index.bounds(away[at], own)
                # of rings with equal bounds the one of the nearest pivot
                pick = np.lexsort((away[at][:, index.pivot[own]], bound), axis=1)[:, 0]
                out[at] = index.ring[own[pick]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, "ring"])

    def more(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Rings(table.value, near.value)
        for batch in _rows(batches):
            away = np.sqrt(squared(matrix(batch["x"]), near.value))
            best = np.array([np.inf if d is None else d for d in batch["d"].to_pylist()]) ** 0.5
            visits: list[list[int]] = []
            for k, (g, seen, own) in enumerate(zip(batch["g"].to_pylist(), batch["ring"].to_pylist(), batch["label"].to_pylist())):
                rings = index.of.get(g, np.zeros(0, np.int64))
                bound = index.bounds(away[k : k + 1], rings)[0]
                keep = bound < best[k]
                for at in np.nonzero(bound == best[k])[0] if own is not None else ():
                    least_label = index.label[rings[at]]
                    keep[at] = least_label is not None and least_label < own
                rings = rings[keep & (index.ring[rings] != seen)]
                some, at = np.unique(index.block[rings], return_index=True)
                apart = ROW * len(rings) + index.size[rings].sum() <= ROW * len(some) + index.held[rings[at]].sum()
                visits.append((index.ring[rings] if apart else some).tolist())
            yield pa.RecordBatch.from_arrays([batch["id"], batch["x"], pa.array(visits, pa.list_(pa.int64()))], ["id", "x", "visits"])

    def least(a: pa.Table, b: pa.Table) -> pa.Table:
        found = pa.table({"id": a["id"].slice(0, 0), "d": pa.array([], pa.float64()), "label": b["label"].slice(0, 0), "compared": pa.array([], pa.int64())})
        if not len(a) or not len(b):
            return found
        b = b.sort_by("label")
        y, ids, parts = matrix(b["x"]), b["id"].to_numpy(zero_copy_only=False), []
        for at in range(0, len(a), 128):
            part = a.slice(at, 128)
            own = part["id"].to_numpy()[:, None] == ids[None, :]
            d, best = closest(matrix(part["x"]), y, own)
            parts.append(pa.table({"id": part["id"], "d": pa.array(d, mask=~np.isfinite(d)), "label": b["label"].take(pa.array(best, mask=~np.isfinite(d))), "compared": pa.array((~own).sum(1))}))
        return pa.concat_tables(parts)

    def compare(rows: DataFrame) -> DataFrame:
        """rows (id, x, ring): each against its ring, or its block where the number is below 0."""
        tasks = util.cut(rows.groupBy("ring").agg(F.ceil(F.count(F.lit(1)) / QUERIES).alias("tasks")))
        left = rows.join(util.bounded(tasks), "ring").withColumn("part", F.pmod(F.xxhash64("id"), "tasks"))
        right = stored.withColumn("ring", F.explode(F.array("ring", "block"))).join(util.bounded(tasks), "ring").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tasks") - 1)))
        left, right = left.select("ring", "part", "id", "x"), right.select("ring", "part", "id", "x", "label")
        return left.groupBy("ring", "part").cogroup(right.groupBy("ring", "part")).applyInArrow(least, f"id bigint, d double, label {label}, compared bigint")

    asked = util.cut(queries.select("g", "id", "x").mapInArrow(first, f"g {kind}, id bigint, x array<double>, ring bigint").where("ring >= 0"))
    found = util.cut(compare(asked))
    rest = asked.join(found.select("id", "d", "label"), "id").select("g", "id", "x", "ring", "d", "label")
    rest = util.cut(rest.mapInArrow(more, "id bigint, x array<double>, visits array<bigint>").select("id", "x", F.explode("visits").alias("ring")))
    every = found.unionByName(compare(rest))
    best = F.min(F.when(F.col("d").isNotNull(), F.struct("d", "label"))).alias("b")
    return every.groupBy("id").agg(best, F.sum("compared").alias("compared")).where("b is not null").select("id", "b.d", "b.label", "compared")
