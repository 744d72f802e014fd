"""Embedding near-dedup: spherical k-means cells, blocked cosine products within cells, one representative per group.

Cells. Spherical k-means is fitted on a bounded sample (``SAMPLE`` rows in expectation, chosen by a hash of the key); there is one cell for about ``CELL_ROWS``
rows, ``MOST_CELLS`` at most. Centres that are nearly alike become one, so that a large group of copies has a single centre. Every vector is
then assigned to its nearest centre, and visits the other cells that its partners may lie in.

No pair is lost. Let x lie in cell A and y in cell B, with the unit vector u from centre B to centre A. Then x.u >= 0 >= y.u, up to the plane between
them, and (x - y).u <= |x - y| <= sqrt(2 - 2 * least) =: d. So one of the two is within d / 2 of the plane, and visits the other's
cell if each vector visits the cells whose plane is that near. That is the default ``margin``; a smaller one trades recall for fewer visits. A
pair whose two vectors visit each other counts in the lower cell alone.

Products. The rows at home in a cell, and its visitors, are compared in blocks of ``BLOCK`` rows: normalised in double precision, one matrix product for each pair
of blocks. A cell with more rows than a block is cut in rings by the angle to its centre: rings too far apart are not compared, and
all rows of the innermost ring (half the threshold's angle) are linked to each other by the triangle inequality, without a product. So a group
of copies with a third of all rows costs no more than its own size. A pair of blocks returns, for each row with links, their number and the least key it is connected to within
the blocks: no pair is emitted. Those edges are joined to components by alternating steps (``shared.components``).

Defined cases. A vector is a row with a key; rows that repeat a key count once (of different ones the least array). Null or zero vectors and those with a null or non-finite component
link with nothing, and so do vectors of different lengths. Rows without a key are returned, link with nothing, and are kept. Labels and extra columns are not read. An empty
table gives an empty table. Keys are integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import shared, textnp

LEAST = 0.95
SAMPLE = 30_000
CELL_ROWS, MOST_CELLS = 2_000, 4_096
BLOCK = 4_096
#: Centres that are so much alike become one.
ALIKE = 0.9
ROUNDS, SEED = 8, 17
#: Rows that are multiplied at once.
_AT_ONCE = 1_024
#: Room for rounding in angles.
_ROOM = 1e-6


def unit(vectors: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of length one in double precision, filled up with zeros to a width (or cut to it)."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    sizes = np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(vectors), int(sizes.max(initial=0)) if width is None else width))
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    ok = place < out.shape[1]
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    full = np.zeros(len(vectors))  # scaled first, so that no square leaves the doubles
    np.maximum.at(full, np.repeat(np.arange(len(vectors)), sizes), np.abs(values))
    values = values / np.repeat(full, sizes)
    norm = np.sqrt(np.bincount(np.repeat(np.arange(len(vectors)), sizes), values * values, len(vectors)))
    out[np.repeat(np.arange(len(vectors)), sizes)[ok], place[ok]] = (values / np.repeat(norm, sizes))[ok]
    return out


def centres(vectors: DataFrame, rows: int, sample: int = SAMPLE, cell_rows: int = CELL_ROWS, most_cells: int = MOST_CELLS, alike: float = ALIKE) -> np.ndarray:
    """Centres of length one, fitted on a sample of (id, vector). Vectors of the commonest length are used; at most most_cells rows come to the driver."""
    share = min(1.0, sample / max(1, rows))
    some = vectors.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.lit(math.ceil(share * (1 << 30))))
    some = shared.cut(some.select(F.col("vector").cast("array<double>").alias("vector")))
    lengths = some.groupBy(F.size("vector").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "n").first()
    if lengths is None:
        return np.zeros((1, 1))
    scale = F.aggregate("vector", F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x)))
    some = some.where(F.size("vector") == lengths.n).select(array_to_vector(F.transform("vector", lambda x: x / scale)).alias("features"))
    cells = max(1, min(most_cells, -(-rows // cell_rows), lengths.c))
    found = KMeans(k=cells, distanceMeasure="cosine", maxIter=ROUNDS, seed=SEED).fit(some).clusterCenters() if cells > 1 else []
    left = [c / np.linalg.norm(c) for c in found if np.linalg.norm(c) > 0] or [np.eye(1, lengths.n)[0]]
    out: list[np.ndarray] = []
    left = np.array(left)
    while len(left):
        near = left @ left[0] >= alike
        near[0] = True
        total = left[near].sum(0)
        out.append(total / np.linalg.norm(total))
        left = left[~near]
    return np.array(out)


def _ring(angle: np.ndarray, half: float) -> np.ndarray:
    """0 for the core, in which all angles are within the threshold; from 1 on rings so wide that a link spans two borders at most."""
    return np.where(angle <= half - _ROOM, 0, 1 + np.floor(np.maximum(angle - half, 0) / (half + 10 * _ROOM))).astype(np.int32)


def assign(vectors: DataFrame, model: np.ndarray, least: float, margin: float) -> DataFrame:
    """(id, vector, dim, places): the cells of each vector, its home first, with the ring in each."""
    half = math.acos(least) / 2
    sent = vectors.sparkSession.sparkContext.broadcast(model)
    place = pa.struct([("cell", pa.int32()), ("ring", pa.int32()), ("home", pa.bool_())])

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, _AT_ONCE):
                batch = whole.slice(at, _AT_ONCE)
                vector = batch.column("vector")
                score = unit(vector, c.shape[1]) @ c.T
                home = score.argmax(1)
                top = score[np.arange(len(home)), home]
                apart = np.sqrt(np.maximum(2 - 2 * (c[home] @ c.T), 1e-18))
                goes = (top[:, None] - score) / apart <= margin + 1e-9
                goes[np.arange(len(home)), home] = True
                row, cell = np.nonzero(goes)
                at_home = cell == home[row]
                order = np.lexsort((~at_home, row))
                row, cell, at_home = row[order], cell[order], at_home[order]
                ring = _ring(np.arccos(np.clip(score[row, cell], -1, 1)), half)
                found = pa.StructArray.from_arrays([pa.array(cell.astype(np.int32)), pa.array(ring), pa.array(at_home)], fields=list(place))
                ends = pa.array(np.searchsorted(row, np.arange(len(home) + 1)).astype(np.int32))
                dim = pa.array(np.diff(vector.offsets.to_numpy()).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column("id"), vector, dim, pa.ListArray.from_arrays(ends, found)], ["id", "vector", "dim", "places"])

    kind = vectors.schema["vector"].dataType.elementType.simpleString()
    return vectors.mapInArrow(cells, f"id bigint, vector array<{kind}>, dim int, places array<struct<cell: int, ring: int, home: boolean>>")


def compare(table: pa.Table, least: float) -> pa.Table:
    """(id, n, root) of the rows of two blocks (sides 0 and 1, or one block: side 2) that have links: how many, and the least id connected to it here."""
    side, ids, home = table["side"].to_numpy(), table["id"].to_numpy(), table["own"].to_numpy()
    cell = table["cell"][0].as_py()
    x = unit(table["vector"])
    a, b = (np.flatnonzero(side == 2),) * 2 if side[0] == 2 else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    visits = table["visits"].combine_chunks()
    of = np.repeat(np.arange(len(ids)), np.diff(visits.offsets.to_numpy()))
    goes = visits.flatten().to_numpy()
    n, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
    other, where = x[b], np.full(len(ids), -1)
    where[b] = np.arange(len(b))
    mutual = {u: where[of[goes == u]] for u in np.unique(home[a]).tolist() if u < cell}  # counted in the lower cell
    mutual = {u: at[at >= 0] for u, at in mutual.items()}
    for k in range(0, len(a), _AT_ONCE):
        rows = a[k : k + _AT_ONCE]
        linked = x[rows] @ other.T >= least
        if side[0] == 2:
            linked[np.arange(len(rows)), k + np.arange(len(rows))] = False
        for u, at in mutual.items():
            linked[np.ix_(home[rows] == u, at)] = False
        own = linked.sum(1)
        n[rows] += own
        if side[0] != 2:
            n[b] += linked.sum(0)
        for r in np.flatnonzero(own):
            met = np.append(label[b[linked[r]]], label[rows[r]])
            low = met.min()
            if (met != low).any():
                label[np.isin(label, met)] = low
    some = np.flatnonzero(n)
    root = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(root, label[some], ids[some])
    return pa.table({"id": ids[some], "n": n[some], "root": root[label[some]]})


def _found(placed: DataFrame, least: float, block: int) -> DataFrame:
    """(id, n, root) of all pairs of blocks and of the cores; an id can have several rows."""
    key = ["dim", "cell", "home"]
    rows = placed.select("id", "dim", F.explode("places").alias("p")).select("id", "dim", "p.*")
    sizes = rows.groupBy(*key, "ring").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"))
    of_cell = sizes.where("home").groupBy("dim", "cell").agg((F.sum("n") > block).alias("large"))
    sizes = shared.cut(sizes.join(of_cell, ["dim", "cell"]))  # a row for each cell, side and ring: bounded by the number of cells; without rows at home there is no pair

    band = F.when(F.col("large"), F.col("ring")).otherwise(-1)
    blocks = sizes.groupBy(*key, "large", band.alias("band")).agg(F.sum("n").alias("n"))
    blocks = blocks.withColumn("splits", F.ceil(F.col("n") / block)).withColumn("split", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("splits") - 1)))
    left = blocks.select("dim", "cell", "home", "large", F.col("band").alias("band_a"), F.col("split").alias("split_a"))
    right = blocks.where("home").select("dim", "cell", F.col("band").alias("band_b"), F.col("split").alias("split_b"))
    once = ~F.col("home") | (F.struct("band_a", "split_a") <= F.struct("band_b", "split_b"))
    core = F.col("home") & F.col("large") & (F.col("band_a") == 0) & (F.col("band_b") == 0)
    pairs = left.join(right, ["dim", "cell"]).where(once & (F.abs(F.col("band_a") - F.col("band_b")) <= 2) & ~core)
    pair = ["dim", "cell", "home", "band_a", "split_a", "band_b", "split_b"]
    one = F.col("home") & (F.col("band_a") == F.col("band_b")) & (F.col("split_a") == F.col("split_b"))
    at = [F.struct(F.col("home").alias("at_home"), F.col("band_a").alias("band"), F.col("split_a").alias("split"), F.when(one, 2).otherwise(0).alias("side"))]
    at.append(F.when(~one, F.struct(F.lit(True).alias("at_home"), F.col("band_b").alias("band"), F.col("split_b").alias("split"), F.lit(1).alias("side"))))
    to = pairs.select(*pair, F.explode(F.array(*at)).alias("at")).where("at is not null").select(*pair, "at.*").withColumnRenamed("home", "of_home")

    splits = shared.cut(blocks.select("dim", "cell", F.col("home").alias("at_home"), "band", "splits").distinct())
    sent = placed.select("id", "vector", "dim", F.element_at("places", 1)["cell"].alias("own"), F.transform(F.slice("places", 2, 1 << 30), lambda p: p["cell"]).alias("visits"), F.explode("places").alias("p"))
    sent = sent.select("id", "vector", "dim", "own", "visits", "p.cell", F.col("p.home").alias("at_home"), "p.ring")
    sent = sent.join(shared.small(splits), ["dim", "cell", "at_home"]).where((F.col("band") == -1) | (F.col("band") == F.col("ring"))).drop("ring")
    sent = sent.withColumn("split", F.pmod(F.xxhash64("id"), "splits")).drop("splits")
    sent = sent.join(shared.small(shared.cut(to)), ["dim", "cell", "at_home", "band", "split"])
    by = ["dim", "cell", "of_home", "band_a", "split_a", "band_b", "split_b"]
    found = sent.groupBy(*by).applyInArrow(lambda t: compare(t, least), "id bigint, n bigint, root bigint")
    cores = sizes.where("large and home and ring = 0").select("dim", "cell", (F.col("n") - 1).alias("n"), F.col("low").alias("root"))
    inner = rows.where("home and ring = 0").join(shared.small(cores), ["dim", "cell"]).where("n > 0").select("id", "n", "root")
    return found.unionByName(inner)


def link(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = LEAST, margin: float | None = None,
         sample: int = SAMPLE, cell_rows: int = CELL_ROWS, most_cells: int = MOST_CELLS, block: int = BLOCK) -> DataFrame:
    """(id, n_links, component_id, kept) for every vector."""
    rows = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("vector"))
    once = rows.where("id is not null").groupBy("id").agg(F.min("vector").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = shared.stored(once.where(F.col("vector").isNotNull() & F.coalesce(finite, F.lit(False))).where(F.exists("vector", lambda x: x != 0)))
    model = centres(usable, usable.count(), sample, cell_rows, most_cells)
    placed = shared.stored(assign(usable, model, least, math.sqrt(max(0, 2 - 2 * least)) / 2 if margin is None else margin))
    found = shared.cut(_found(placed, least, block))
    groups = shared.components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("id").agg(F.sum("n").alias("n_links"))
    out = rows.where("id is not null").select("id").distinct().join(links, "id", "left").join(groups.withColumnRenamed("node", "id"), "id", "left")
    out = out.select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    alone = rows.where("id is null").select("id", F.lit(0).cast("bigint").alias("n_links"), F.lit(None).cast("bigint").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))


def dedup(vectors: DataFrame, key: str = "vec_id", **how) -> DataFrame:
    """The rows of vectors whose vector represents its group (the least key), and those without a key."""
    gone = link(vectors, key, **how).where(~F.col("kept")).select(F.col("id").alias("__gone"))
    return vectors.join(gone, F.col(key) == F.col("__gone"), "left_anti")
