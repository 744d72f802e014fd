"""SimHash near-dedup by a binary trie self-join.

Method. The distinct fingerprints are the leaves of a binary trie. The join starts at node pairs and goes down both sides
together, one bit at a time: each pair of nodes splits into the pairs of their children, a pair of unlike children
adds one to the error of the pair, and a pair whose error exceeds the budget is pruned. Pairs that reach the leaves are
links.

In Spark. With a budget of k, two fingerprints that link agree on one of k + 1 blocks of bits. For each block the
fingerprint is turned so that this block comes first, and its value names a subtrie (a node whose pair with itself has
error zero), which is one group of the shuffle. A subtrie with more leaves than ``group`` is split before it reaches a
task: rows go down ``STEP`` bits at a time to every node pair of the budget that has them, until the groups are small.
Only distinct fingerprints travel, so copies cost nothing, and each group returns a spanning forest of its links, so no
group emits all its pairs. The forests are closed by ``shared.components``.

Defined cases: a null text counts as empty; a document without words has fingerprint zero and links like any other;
repeated rows and equal texts share a fingerprint and a component; rows without a key keep their fingerprint but take
no part in components (null component); only the named columns are read; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import shared, textnp

SEED = 42
#: Most distinct fingerprints of one group.
GROUP = 1_000
STEP = 6
_LOWER = bytes(b + 32 if 65 <= b <= 90 else 32 if b in b"\t\n\r\x0b\x0c" else b for b in range(256))


def shingle_hashes(raw: bytes, k: int) -> np.ndarray:
    """XXH64 of each shingle of k words, repeats included; fewer words give the whole sequence, none gives nothing."""
    words = raw.translate(_LOWER).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    if len(words) <= k:
        return np.array([digest(line, SEED)], dtype=np.uint64)
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())], dtype=np.uint64)


def majority(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per row (hashes first[i]:first[i+1]), the 64 bits that more than half of the hashes have."""
    out = np.zeros(len(first) - 1, dtype=np.uint64)
    size = np.diff(first)
    full = np.flatnonzero(size > 0)
    if not len(full):
        return out
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    sums = np.add.reduceat(bits, first[:-1][full], axis=0, dtype=np.int32)
    out[full] = np.packbits(2 * sums > size[full, None], axis=1).view(">u8").ravel().astype(np.uint64)
    return out


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, tables: int = 1) -> DataFrame:
    """(key, fp bigint) for every row; with tables > 1 (key, fps array<bigint>) of so many independent fingerprints."""
    rows = docs.select(key, F.col(text).alias("__text"))
    kind = rows.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in textnp.chunks(batches, "__text", 500_000):
            raw = chunk.data.tobytes()
            each = [shingle_hashes(raw[a:b], shingle) for a, b in zip(chunk.offsets[:-1].tolist(), chunk.offsets[1:].tolist())]
            first = np.concatenate([[0], np.cumsum([len(h) for h in each])]).astype(np.int64)
            hashes = np.concatenate(each)
            if tables == 1:
                yield pa.RecordBatch.from_arrays([chunk.batch.column(0), pa.array(majority(hashes, first).view(np.int64))], names=[key, "fp"])
            else:
                many = np.stack([majority(textnp.mix(hashes + np.uint64(t * 0x9E3779B97F4A7C15 % 2**64)), first) for t in range(tables)], axis=1).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, many.size + 1, tables, dtype=np.int32)), pa.array(many.ravel()))
                yield pa.RecordBatch.from_arrays([chunk.batch.column(0), lists], names=[key, "fps"])

    return rows.mapInArrow(run, f"`{key}` {kind}, " + ("fp bigint" if tables == 1 else "fps array<bigint>"))


def _children(lo: np.ndarray, hi: np.ndarray, values: np.ndarray, bit: int) -> np.ndarray:
    """Where the one-child of each node (values[lo:hi], sorted, alike above the bit) begins."""
    mask = np.uint64(1) << np.uint64(bit)
    prefix = values[lo] & ~((mask << np.uint64(1)) - np.uint64(1)) if bit < 63 else np.zeros(len(lo), dtype=np.uint64)
    return np.clip(np.searchsorted(values, prefix | mask, "left"), lo, hi)


def walk(left: np.ndarray, right: np.ndarray, nodes: tuple, bits: int, budget: int, block: int = 250_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Leaf pairs (indexes of left and right, both sorted distinct) below the given node pairs within the budget.

    ``nodes``: arrays (a, b, c, d, err) of node pairs left[a:b], right[c:d] that are alike above the low ``bits`` bits or
    whose difference there is counted in err. left is right for a self-join, which gives each pair once. Node pairs wait on
    a stack in blocks, so memory stays bounded; a pair of nodes with one leaf each is decided at once, as in a trie
    with compressed paths.
    """
    alone = left is right
    stack = [(bits - 1, *nodes)]
    while stack:
        bit, a, b, c, d, err = stack.pop()
        if len(a) > block:
            half = len(a) // 2
            stack.append((bit, a[half:], b[half:], c[half:], d[half:], err[half:]))
            a, b, c, d, err = a[:half], b[:half], c[:half], d[:half], err[:half]
        ends = (b - a == 1) & (d - c == 1)
        if ends.any():
            low = np.uint64((1 << (bit + 1)) - 1)
            x, y = a[ends], c[ends]
            near = np.bitwise_count((left[x] ^ right[y]) & low) + err[ends] <= budget
            if alone:
                near &= x != y
            yield x[near], y[near]
            a, b, c, d, err = a[~ends], b[~ends], c[~ends], d[~ends], err[~ends]
        if not len(a):
            continue
        m, n = _children(a, b, left, bit), _children(c, d, right, bit)
        more, out = err + 1, []
        for x0, x1, y0, y1, e, twice in ((a, m, c, n, err, False), (m, b, n, d, err, False), (a, m, n, d, more, False), (m, b, c, n, more, True)):
            ok = (x1 > x0) & (y1 > y0) & (e <= budget)
            if twice and alone:
                ok &= a != c
            out.append((x0[ok], x1[ok], y0[ok], y1[ok], e[ok]))
        stack.append((bit - 1, *(np.concatenate(x) for x in zip(*out))))


class Forest:
    """Union-find over n leaves that remembers the links that joined two trees; ``labels`` unite leaves from the start.

    Up to ``spare`` links of a leaf are remembered besides. ``left`` marks a leaf of each link that is not.
    """

    def __init__(self, n: int, labels: np.ndarray | None = None, spare: int = 0):
        self.up, self.links, self.spare = list(range(n)), [], spare
        self.degree, self.left = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
        if labels is not None:
            _, first, which = np.unique(labels, return_index=True, return_inverse=True)
            self.up = first[which].tolist()

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def add(self, i: int, j: int) -> None:
        x, y = self.root(i), self.root(j)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        elif not self.spare or min(self.degree[i], self.degree[j]) >= self.spare:
            self.left[i] = True
            return
        self.degree[i] += 1
        self.degree[j] += 1
        self.links.append((i, j))

    def labels(self) -> np.ndarray:
        return np.array([self.root(i) for i in range(len(self.up))], dtype=np.int64)


def _turn(column, by: int, width: int):
    """The low width bits of column, rotated left by so many bits."""
    full = (1 << width) - 1
    if by == 0:
        return column
    low = F.shiftrightunsigned(column, width - by).bitwiseAND(F.lit((1 << by) - 1))
    if width == 64:
        return F.shiftleft(column, by).bitwiseOR(low)
    return F.shiftleft(column, by).bitwiseAND(F.lit(full)).bitwiseOR(low)


def _masks(bits: int, budget: int) -> list[tuple[int, int]]:
    return [(m, m.bit_count()) for m in range(1 << bits) if m.bit_count() <= budget]


def trie_join(values: DataFrame, budget: int = 2, width: int = 64, group: int = GROUP, table: str | None = None, extra: str | None = None, near: int | None = None, label: str | None = None, spare: int = 0) -> DataFrame:
    """Links (a, b) that connect all of ``fp`` in values at most budget bits apart, a spanning forest from each group.

    ``fp`` are bigints with width bits, distinct (within each value of ``table``, if that column is named). With ``extra``
    (an array<bigint> column that goes with each row) a pair links only if its extra bits differ in at most ``near``
    places; a and b are then the row's ``node`` instead of fp. With ``label`` rows with equal labels count as connected, up to
    ``spare`` links of a row are given beside the forest, and two columns are added: ``tree``, the node of a row of the
    tree, and ``more``, whether links within that tree were left out.
    """
    blocks = budget + 1
    edges = [round(i * width / blocks) for i in range(blocks + 1)]
    node = "node" if extra else "fp"
    carried = [F.col(node).cast("bigint").alias("node"), *([F.col(extra).alias("extra")] if extra else []), *([F.col(label).cast("bigint").alias("label")] if label else [])]
    tab = F.col(table).cast("int") if table else F.lit(0)
    turned = values.select(*carried, tab.alias("tab"), F.explode(F.array(*[F.struct(F.lit(i).alias("turn"), _turn(F.col("fp"), edges[i], width).alias("v"), F.lit(edges[i + 1] - edges[i]).alias("depth")) for i in range(blocks)])).alias("t"))
    rest = ["node", *(["extra"] if extra else []), *(["label"] if label else [])]
    up = F.expr(f"shiftrightunsigned(t.v, {width} - t.depth)")
    rows = turned.select(*rest, "tab", F.col("t.turn").alias("turn"), F.col("t.v").alias("v"), F.col("t.depth").alias("depth"), up.alias("pl"), up.alias("pr"), F.lit(0).alias("err"), F.lit(0).alias("side"))
    key = ["tab", "turn", "depth", "pl", "pr", "err"]
    todo, ready = rows, None
    while True:
        sizes = todo.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
        # at most one row for every ``group`` rows of todo
        large = shared.cut(sizes.where((F.col("n") > group) & (F.col("depth") < width - STEP)).select(*key).coalesce(4))
        if large.isEmpty():
            ready = todo if ready is None else ready.unionByName(todo)
            break
        hot = todo.join(large, key, "left_semi")
        calm = todo.join(large, key, "left_anti")
        ready = calm if ready is None else ready.unionByName(calm)
        chunk = F.expr(f"cast(shiftrightunsigned(v, {width} - depth - {STEP}) & {(1 << STEP) - 1} as bigint)")
        masks = F.array(*[F.struct(F.lit(m).cast("bigint").alias("m"), F.lit(c).alias("c")) for m, c in _masks(STEP, budget)])
        down = hot.withColumn("u", chunk).withColumn("k", F.explode(masks)).where(F.col("err") + F.col("k.c") <= budget).withColumn("w", F.col("u").bitwiseXOR(F.col("k.m")))
        alone = (F.col("pl") == F.col("pr"))
        # side 0: both sides are one node; 1: left; 2: right. The left node of a pair of a self-join has the smaller prefix.
        left = F.when(F.col("side") == 0, F.col("u") <= F.col("w")).otherwise(F.col("side") == 1)
        down = down.withColumn("__l", left)
        todo = down.select(
            *rest, "tab", "turn", "v", (F.col("depth") + STEP).alias("depth"),
            F.shiftleft("pl", STEP).bitwiseOR(F.when(F.col("__l"), F.col("u")).otherwise(F.col("w"))).alias("pl"),
            F.shiftleft("pr", STEP).bitwiseOR(F.when(F.col("__l"), F.col("w")).otherwise(F.col("u"))).alias("pr"),
            (F.col("err") + F.col("k.c")).cast("int").alias("err"),
            F.when((F.col("side") == 0) & (F.col("k.m") == 0), 0).when(F.col("__l"), 1).otherwise(2).alias("side"),
        )
        todo = shared.cut(todo)

    def join(frames):
        import pandas as pd

        for frame in _groups(frames, key):
            links = [np.zeros((0, 4), dtype=np.int64)]
            for (depth, single), rows in frame.groupby([frame["depth"], frame["side"] == 0], sort=False):
                links.append(_links(rows, key, width - int(depth), budget, bool(single), near if extra else None, spare))
            found = pd.DataFrame(np.concatenate(links), columns=["a", "b", "tree", "more"])
            yield found if label else found[["a", "b"]]

    return ready.repartition(*key).sortWithinPartitions(*key, "v").mapInPandas(join, "a bigint, b bigint" + (", tree bigint, more bigint" if label else ""))


def _groups(frames, key: list[str]):
    """Frames that end where a group ends; the last, unfinished group of each waits for the next."""
    import pandas as pd

    rest = None
    for frame in frames:
        frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        if not len(frame):
            continue
        alike = (frame[key] == frame[key].iloc[-1]).all(axis=1).to_numpy()
        last = len(alike) - int(np.argmin(alike[::-1])) if not alike.all() else 0
        rest = frame.iloc[last:]
        if last:
            yield frame.iloc[:last]
    if rest is not None and len(rest):
        yield rest


def _links(rows, key: list[str], bits: int, budget: int, single: bool, near: int | None, spare: int) -> np.ndarray:
    """A spanning forest of the links in the groups of rows, all of one depth, and up to spare links of a row besides: a, b, tree, more."""
    nodes = rows["node"].to_numpy()
    number = rows.groupby(key, sort=False).ngroup().to_numpy().astype(np.uint64)
    errs = np.zeros(int(number.max()) + 1, dtype=np.int64)
    errs[number.astype(np.int64)] = rows["err"].to_numpy()
    low = rows["v"].to_numpy().view(np.uint64) & np.uint64((1 << bits) - 1)
    if len(errs) >> (64 - bits):
        raise ValueError("too many groups in one batch")
    value = (number << np.uint64(bits)) | low
    wide = np.stack(rows["extra"].to_numpy()).view(np.uint64) if near is not None else None
    side = rows["side"].to_numpy()
    sides = [np.arange(len(value))] if single else [np.flatnonzero(side == 1), np.flatnonzero(side == 2)]
    leaves = []
    for at in sides:
        at = at[np.argsort(value[at], kind="stable")]
        start, n = textnp.runs(value[at])
        leaves.append((at, start, n, value[at][start]))
    (lat, ls, ll, lv), (rat, rs, rl, rv) = leaves[0], leaves[-1]
    groups = np.arange(len(errs), dtype=np.uint64) << np.uint64(bits)
    last = groups + np.uint64((1 << bits) - 1)
    a, b = np.searchsorted(lv, groups, "left"), np.searchsorted(lv, last, "right")
    c, d = np.searchsorted(rv, groups, "left"), np.searchsorted(rv, last, "right")
    ok = (b > a) & (d > c)
    label = rows["label"].to_numpy() if "label" in rows else None
    forest = Forest(len(value), label, spare)

    def take(i: np.ndarray, j: np.ndarray) -> None:
        if label is not None and len(i):
            ok = label[i] != label[j]
            i, j = i[ok], j[ok]
        if wide is not None and len(i):
            ok = np.bitwise_count(wide[i] ^ wide[j]).sum(axis=1) <= near
            i, j = i[ok], j[ok]
        if len(i) > 1000:
            roots = forest.labels()
            ok = roots[i] != roots[j]
            if spare:
                ok |= np.minimum(forest.degree[i], forest.degree[j]) < spare
            forest.left[i[~ok]] = True
            i, j = i[ok], j[ok]
        for x, y in zip(i.tolist(), j.tolist()):
            forest.add(x, y)

    if single:
        for start, n in zip(ls[ll > 1].tolist(), ll[ll > 1].tolist()):
            same = lat[start : start + n]
            for k in range(1, n):
                take(np.full(k, same[k]), same[:k])
    for x, y in walk(lv, rv, (a[ok], b[ok], c[ok], d[ok], errs[ok]), bits, budget):
        n, m = ll[x], rl[y]
        one = (n == 1) & (m == 1)
        take(lat[ls[x[one]]], rat[rs[y[one]]])
        for p, q in zip(x[~one].tolist(), y[~one].tolist()):
            i, j = lat[ls[p] : ls[p] + ll[p]], rat[rs[q] : rs[q] + rl[q]]
            for u in i.tolist():
                take(np.full(len(j), u), j)
    links, roots = np.array(forest.links, dtype=np.int64).reshape(-1, 2), forest.labels()
    left = np.bincount(roots, weights=forest.left, minlength=len(roots)) > 0
    root = roots[links[:, 0]]
    return np.column_stack([nodes[links], nodes[root], left[root].astype(np.int64)])


def link(prints: DataFrame, key: str = "doc_id", budget: int = 2, group: int = GROUP) -> DataFrame:
    """(key, fp, component_id) for rows of (key, fp): the least key reachable over fingerprints at most budget bits apart."""
    rows = prints.select(F.col(key).alias("__key"), F.col("fp").alias("__fp"))
    least = shared.cut(rows.where("__key is not null").groupBy("__fp").agg(F.min("__key").alias("__least")))
    closed = shared.components(trie_join(least.select(F.col("__fp").alias("fp")), budget, 64, group))
    joined = least.join(closed, F.col("__fp") == F.col("node"), "left").select("__fp", "__least", F.coalesce("component", "__fp").alias("__component"))
    smallest = joined.groupBy("__component").agg(F.min("__least").alias("component_id"))
    of_print = joined.join(smallest, "__component").select(F.col("__fp").alias("__f"), "component_id")
    out = rows.join(of_print, F.col("__fp") == F.col("__f"), "left")
    return out.select(F.col("__key").alias(key), F.col("__fp").alias("fp"), F.when(F.col("__key").isNotNull(), F.col("component_id")).alias("component_id"))


#: For similarities of whole texts: so many fingerprints of 64 bits, each read as two of WIDTH bits.
PRINTS, WIDTH, TABLE_BUDGET = 6, 32, 3
#: Most differing bits, of all PRINTS * 64, of a pair that is verified.
NEAR = 85
#: Links of a row that are verified beside a forest in the second walk, and the factor for each walk after that.
SPARE = 8
NEAR_GROUP = 20_000
BROADCAST_ROWS = 200_000
#: Rows for one file of a written table, at least: few files where there are few rows.
ROWS_A_FILE = 5_000


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """(node, component = least key) of the rows that are not alone; the rest of each component repeats its least key.

    Links: equal fingerprints, or shingle sets with a Jaccard similarity of percent or more. A pair is a candidate when one
    of ``2 * PRINTS`` tables of ``WIDTH`` bits has it within ``TABLE_BUDGET`` bits and all fingerprints together within
    ``NEAR``. Only pairs that are verified on the shingles connect: each walk sends a spanning forest of the candidates to be verified,
    and where an edge of a tree fails that stood for others, the rows of that tree are walked again with ``SPARE`` times
    as many edges a row besides, without pairs that verified links connect by then, until no candidate is left out.
    At a similarity of 0.8 a table finds a pair with probability 0.27, all twelve with 0.97.
    """
    prints = fingerprints(docs.where(F.col(key).isNotNull()), key, text, shingle, PRINTS)
    prints = shared.cut(prints.select(F.col(key).alias("key"), "fps"))
    files = prints.count() // ROWS_A_FILE + 8
    least = shared.cut(prints.groupBy("fps").agg(F.min("key").alias("node")), files)
    halves = [F.struct(F.lit(2 * i + j).alias("tab"), (F.col("fps")[i].bitwiseAND(F.lit(0xFFFFFFFF)) if j else F.shiftrightunsigned(F.col("fps")[i], 32)).alias("fp")) for i in range(PRINTS) for j in (0, 1)]
    labelled, true, tried, spare = least.withColumn("label", F.col("node")), None, None, 0
    while True:
        values = labelled.select("node", "label", "fps", F.explode(F.array(*halves)).alias("x")).select("node", "label", F.col("fps").alias("extra"), "x.tab", "x.fp")
        found = trie_join(values, TABLE_BUDGET, WIDTH, NEAR_GROUP, table="tab", extra="extra", near=NEAR, label="label", spare=spare)
        found = shared.cut(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "tree", "more").distinct(), files)
        edges = found.select("a", "b").distinct()
        edges = shared.cut(edges if tried is None else edges.join(tried, ["a", "b"], "left_anti"), files)
        new = _verified(docs, edges, key, text, shingle, percent, files)
        true, tried = (new, edges) if true is None else (shared.cut(true.unionByName(new), files), shared.cut(tried.unionByName(edges), files))
        closed = shared.components(true, files=files).withColumnRenamed("node", "c")
        all_labels = least.join(closed, F.col("node") == F.col("c"), "left").select("fps", "node", F.coalesce("component", "node").alias("label"))
        now = all_labels.select(F.col("node").alias("n"), F.col("label").alias("l"))
        waiting = found.where("more = 1").join(now.withColumnsRenamed({"n": "a", "l": "la"}), "a").join(now.withColumnsRenamed({"n": "b", "l": "lb"}), "b")
        waiting = shared.cut(waiting.select("tree", "la", "lb"), files)
        failed = waiting.where("la <> lb").select("tree").distinct()
        again = shared.cut(waiting.join(failed, "tree", "left_semi").select(F.explode(F.array("la", "lb")).alias("label")).distinct(), files)
        if again.isEmpty():
            break
        labelled = shared.cut(all_labels.join(again, "label", "left_semi").select("fps", "node", "label"), files)
        spare = max(1, spare) * SPARE
    out = prints.join(all_labels, "fps").select(F.col("key").alias("node"), F.col("label").alias("component"))
    return out.where("node <> component")


def _verified(docs: DataFrame, edges: DataFrame, key: str, text: str, shingle: int, percent: int, files: int) -> DataFrame:
    """The edges (a, b) whose rows have shingle sets with a Jaccard similarity of percent or more."""
    nodes = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    nodes = F.broadcast(nodes) if edges.count() <= BROADCAST_ROWS else nodes

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in textnp.chunks(batches, "t"):
            raw = chunk.data.tobytes()
            out = [np.unique(shingle_hashes(raw[a:b], shingle)).view(np.int64) for a, b in zip(chunk.offsets[:-1].tolist(), chunk.offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([chunk.batch.column(0), pa.array(out, type=pa.list_(pa.int64()))], names=["id", "set"])

    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("t")).join(nodes, "id", "left_semi")
    shingles = rows.select(F.col("id").cast("bigint"), "t").mapInArrow(sets, "id bigint, set array<bigint>")
    shingles = shared.cut(shingles.dropDuplicates(["id"]), files)
    both = edges.join(shingles.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").join(shingles.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    true = both.select("a", "b", common.alias("n"), (F.size("x") + F.size("y")).alias("m")).where(100 * F.col("n") >= percent * (F.col("m") - F.col("n"))).select("a", "b")
    return shared.cut(true, files)


def dedup(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The rows of docs, all columns, without those that near-duplicate a row with a smaller key (through a chain of links)."""
    gone = shared.cut(near_duplicates(docs, key, **options).select(F.col("node").alias("__gone")).distinct())
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return docs.join(gone, F.col(key) == F.col("__gone"), "left_anti")
