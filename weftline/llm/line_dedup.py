"""Line dedup by an exact set-similarity join.

A line is removed when an earlier line (smaller key, or the same key and a smaller line number) has a Jaccard similarity
of ``num / den`` or more, both as sets of words.

Method. Words are ordered by rarity (their hashed count over the whole corpus, then their hash: any one order is
right). Two lines that are similar enough share a word among the first ``n - ceil(t n) + 1`` of each, so only these prefix
words are indexed, and a word that occurs once in the corpus is left out, as no other line has it. A word that occurs more
than ``hot`` times is indexed together with each later word of a prefix that is one word longer, of which two similar
lines share two, so no list grows with the corpus for one frequent word. Lines that meet in a list pass the length filter, the
positional filter (what can still overlap from here on) and a parity filter (64 bits or, of longer lines, up to 512, one
flipped by each word: they differ in no more places than the sets do), all of which never lose a pair. What is left is
verified on the words.

In Spark. List entries are packed by bucket. Equal lines of one chunk of texts are indexed once, and equal lines of a list
collapse to the earliest (their words in order are compared by a digest of 128 bits where the texts are), so a line in every
document costs one entry per chunk. Each later line takes one earlier line of a list along to be verified where its text
is, the earliest of the nearest by parity. If a list has more that pass the filters and this one fails, the line is open: lists of open lines are joined once
more, without a limit. No group emits all its pairs, and nothing but a bounded filter of list numbers goes through
the driver. Texts are dealt out by key once and read at both places.

Defined cases: a null text counts as empty; lines without words are neither removed nor matched; rows with one key are one
document: a line number that is removed in one of them is removed in all; rows without a key pass unchanged; extra columns are
not read; an empty table gives an empty table. The key is an integer column.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import packing, shared, textnp

NUM, DEN = 4, 5
BITS = 20
#: Words of the texts that meet in one bucket, about.
WORDS_EACH = 1_500_000
#: Entries of the chunks of a task that are packed together, about: the more, the fewer and longer rows.
ENTRIES_EACH = 400_000
#: Words that occur more often are indexed in pairs.
HOT = 8_192
#: Lists of open lines that are sent to all tasks as a filter; if there are more, all entries travel.
FILTER_LISTS = 500_000
#: Keys or line numbers, of 16 bytes, that are counted before they are broadcast.
#: Words of the texts for one file of a written table, at least: few files where there is little.
WORDS_A_FILE = 500_000
BROADCAST_ROWS = 1_000_000
#: What an entry of a list carries; ``at`` is the place of the (first) shared word.
ENTRY = {"list": np.uint32, "whole": np.uint64, "parity": np.uint64, "size": np.uint32, "at": np.uint16, "wide": np.uint64}
#: Lines of more words than these have a second parity, of so many times 64 bits.
TIERS = (72, 180, 400)
WIDE = (0, 2, 4, 8)
LINKS = {"later": np.int64, "line": np.uint32, "more": np.uint8}
#: Values of ``more``: the list has no other line that passes the filters, it has, or the lines are equal by their hash.
EQUAL = 2
_PAIR = np.uint64(0x9E3779B97F4A7C15)
_LOW40, _LOW24 = np.uint64((1 << 40) - 1), np.uint64((1 << 24) - 1)


def _rarity(counts: np.ndarray) -> np.ndarray:
    """Eighths of the binary logarithm, in a byte: order enough, and 8 at most for words that occur once."""
    return np.minimum(8 * np.log2(counts + 1), 255).astype(np.uint8)


class Lines:
    """The lines of a chunk in the order of (key, number): ``row``, ``key``, ``number``, ``start`` and ``end`` in its bytes."""

    def __init__(self, chunk: textnp.Chunk, own: np.ndarray):
        self.chunk = chunk
        breaks = np.flatnonzero(chunk.data == 10)
        first = np.searchsorted(breaks, chunk.offsets)
        n = np.diff(first) + 1
        row = np.repeat(np.arange(chunk.rows), n)
        number = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        ends = np.append(breaks, 0)[first[:-1][row] + number]
        end = np.where(number == n[row] - 1, chunk.offsets[1:][row], ends)
        start = np.where(number == 0, chunk.offsets[:-1][row], np.concatenate([[0], end[:-1] + 1]))
        if not (np.diff(own) > 0).all():
            order = np.lexsort((number, own[row]))
            row, number, start, end = row[order], number[order], start[order], end[order]
        self.row, self.key, self.number, self.start, self.end = row, own[row], number, start, end

    def heads(self) -> tuple[np.ndarray, np.ndarray]:
        """(which lines are the first with their bytes, which are later ones with the bytes of another line)."""
        raw = self.chunk.data.tobytes()
        seen: dict[bytes, int] = {}
        of = [seen.setdefault(raw[a:b], k) for k, (a, b) in enumerate(zip(self.start.tolist(), self.end.tolist()))]
        of = np.array(of, dtype=np.int64)
        blank = of == seen.get(b"", -1)
        again = (self.key != self.key[of]) | (self.number != self.number[of])  # a repeated row is no later match of itself
        return of == np.arange(len(of)), again & ~blank


def _tier(size: np.ndarray) -> np.ndarray:
    return np.searchsorted(TIERS, size, "left")


def _wide(mixed: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The second parities of lines whose words begin at ``at``."""
    out = np.zeros((len(at), WIDE[-1]), dtype=np.uint64)
    tier = _tier(size)
    for t, n in enumerate(WIDE):
        rows = np.flatnonzero(tier == t)
        if n and len(rows):
            start = np.cumsum(size[rows]) - size[rows]
            words = mixed[np.arange(size[rows].sum()) + np.repeat(at[rows] - start, size[rows])]
            place = (words >> np.uint64(20)) % np.uint64(64 * n)
            bit = np.uint64(1) << (place & np.uint64(63))
            for k in range(n):
                out[rows, k] = np.bitwise_xor.reduceat(np.where(place >> np.uint64(6) == k, bit, np.uint64(0)), start)
    return out


def _entries(lines: Lines, wanted: np.ndarray, rarity: np.ndarray, num: int, den: int, most: int, keep: Callable[[np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Of the wanted lines: the line of each entry, and what it carries (``list`` with all 64 bits, ``wide`` with all columns).

    keep says which lists are wanted (default: all); what an entry carries is found for lines in those alone.
    """
    chunk = lines.chunk.words()
    words = chunk.word_hash()
    by_place = np.argsort(lines.start, kind="stable")
    first = np.append(np.searchsorted(chunk.starts, lines.start[by_place]), len(words))
    line = np.repeat(by_place, np.diff(first))
    ok = wanted[line]
    words, line = words[ok], line[ok]
    written = line, words
    rare = rarity[(words >> np.uint64(64 - BITS)).astype(np.int64)]
    rank = (line.astype(np.uint64) << np.uint64(43)) | (rare.astype(np.uint64) << np.uint64(35)) | (words >> np.uint64(29))
    order = np.argsort(rank)
    rank, sorted_words = rank[order], words[order]
    if len(lines.row) >= 1 << 21 or ((rank[1:] == rank[:-1]) & (sorted_words[1:] != sorted_words[:-1])).any():
        order = np.lexsort((words, rare, line))
        line, words, rare = line[order], words[order], rare[order]
    else:  # a rank tells line and rarity
        line, words, rare = (rank >> np.uint64(43)).astype(np.int64), sorted_words, (rank >> np.uint64(35)).astype(np.uint8)
    new = np.ones(len(line), dtype=bool)
    new[1:] = (line[1:] != line[:-1]) | (words[1:] != words[:-1])
    line, words, rare = line[new], words[new], rare[new]
    at, size = textnp.runs(line)
    if not len(at):
        return _no_entries()
    mixed = textnp.mix(words)
    place = np.arange(len(line)) - np.repeat(at, size)
    each = np.repeat(size, size)
    prefix = each - -(-num * each // den) + 1
    used = np.flatnonzero((place < prefix) & (rare > 8))
    hot = (rare[used] > 8 * np.log2(most + 1)) & (each[used] > 1)
    cold, names = used[~hot], [mixed[used[~hot]]]
    firsts = [cold]
    # hot words: with each word after them within the longer prefix
    left = used[hot]
    step = 1
    while len(left):
        left = left[place[left] + step <= prefix[left]]
        left = left[place[left] + step < each[left]]
        firsts.append(left)
        names.append(textnp.mix(mixed[left] + _PAIR * words[left + step]))
        step += 1
    first, name = np.concatenate(firsts), np.concatenate(names)
    if len(firsts) > 1:
        order = np.argsort(line[first], kind="stable")
        first, name = first[order], name[order]
    if keep is not None:
        some = keep(name)
        first, name = first[some], name[some]
        # lines without an entry left drop out
        here = np.zeros(len(lines.row), dtype=bool)
        here[line[first]] = True
        written = tuple(x[here[written[0]]] for x in written)
        some = here[line]
        first = (np.cumsum(some) - 1)[first]
        line, words, mixed, place = line[some], words[some], mixed[some], place[some]
        at, size = textnp.runs(line)
        if not len(at):
            return _no_entries()
    parity = np.bitwise_xor.reduceat(np.uint64(1) << (words & np.uint64(63)), at)
    # of each line a hash of its words in their order
    own, words = written
    start, n = textnp.runs(own)
    order = np.arange(len(own)) - np.repeat(start, n)
    sequence = np.zeros(len(lines.row), dtype=np.uint64)
    sequence[own[start]] = np.add.reduceat(textnp.mix(words + order.astype(np.uint64) * _PAIR), start) & _LOW40
    whole = sequence[line[at]]
    dense = np.repeat(np.arange(len(at)), size)[first]
    values = {"list": name, "whole": whole[dense], "parity": parity[dense], "size": size[dense], "at": place[first]}
    return line[first], values | {"wide": _wide(mixed, at, size)[dense]}


def _no_entries() -> tuple[np.ndarray, dict[str, np.ndarray]]:
    nothing = {n: np.zeros(0, np.uint64 if n == "list" else t) for n, t in ENTRY.items()}
    return np.zeros(0, np.int64), nothing | {"wide": np.zeros((0, WIDE[-1]), np.uint64)}


class Lists:
    """The lists of a bucket, equal lines collapsed to the earliest, each list in the order of sizes.

    ``stamp`` orders lines by (key, number); ``line_of`` turns stamps back.
    """

    def __init__(self, table: pa.Table, num: int, den: int):
        self.num, self.den = num, den
        key, pos, name, whole, parity, size, at, wide = packing.unpack(table, {"wide": WIDE[-1]}, **ENTRY)
        self.ends: tuple[np.ndarray, np.ndarray] | None = None
        if len(key) and (key.min() < 0 or key.max() >> 43 or pos.max() >> 20):
            order = np.lexsort((pos, key))
            new = np.ones(len(key), dtype=bool)
            new[1:] = (np.diff(key[order]) != 0) | (np.diff(pos[order]) != 0)
            stamp = np.empty(len(key), dtype=np.int64)
            stamp[order] = np.cumsum(new) - 1
            self.ends = key[order][new], pos[order][new]
        else:
            stamp = key << 20 | pos
        sizes = np.minimum(size, 4095).astype(np.uint64)
        identity = textnp.mix(parity ^ whole * _PAIR)
        order = np.argsort(name.astype(np.uint64) << np.uint64(40) | sizes << np.uint64(28) | identity >> np.uint64(36))
        if len(size) and size.max() >= 4095:
            order = np.lexsort((identity, size, name))
        stamp, name, whole, parity, size, at = (x[order] for x in (stamp, name, whole, parity, size, at))
        new = np.ones(len(name), dtype=bool)
        new[1:] = (name[1:] != name[:-1]) | (whole[1:] != whole[:-1]) | (parity[1:] != parity[:-1]) | (size[1:] != size[:-1])
        start = np.flatnonzero(new)
        self.stamp = np.minimum.reduceat(stamp, start) if len(start) else stamp
        self.name, self.parity, self.size, self.at = name[new], parity[new], size[new].astype(np.int64), at[new].astype(np.int64)
        self.wide, self.tier = wide[order[new]], _tier(self.size)
        # each line meets its equals at its rarest word once
        first = np.repeat(self.stamp, np.diff(np.append(start, len(name))))
        again = (at == 0) & (stamp != first)
        self.equal = first[again], stamp[again]

    def line_of(self, stamp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (self.ends[0][stamp], self.ends[1][stamp]) if self.ends else (stamp >> 20, stamp & ((1 << 20) - 1))

    def alike(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of lines that share a word at their places: those that pass the length, positional and parity filters.

        Besides, how far their parities differ, in thirds of what is to be expected of lines that are just alike enough: 0 to 3.
        """
        x, y = self.size[i], self.size[j]
        need = -(-self.num * (x + y) // (self.num + self.den))
        most = x + y - 2 * need
        distance = np.bitwise_count(self.parity[i] ^ self.parity[j]).astype(np.int64)
        ok = (self.num * np.maximum(x, y) <= self.den * np.minimum(x, y)) & (np.minimum(x - self.at[i], y - self.at[j]) >= need) & (distance <= most)
        i, j, most, distance = i[ok], j[ok], most[ok], distance[ok]
        tier = np.where(self.tier[i] == self.tier[j], self.tier[i], 0)
        for t in range(1, len(WIDE)):
            some = np.flatnonzero(tier == t)
            distance[some] = np.bitwise_count(self.wide[i[some], : WIDE[t]] ^ self.wide[j[some], : WIDE[t]]).sum(axis=1)
        ok = distance <= most
        i, j, most, distance, bits = i[ok], j[ok], most[ok], distance[ok], 64 * np.maximum(1, np.array(WIDE))[tier[ok]]
        expected = bits / 2 * (1 - np.exp(-2 * most / bits))
        return i, j, np.minimum(3 * distance / np.maximum(expected, 0.5), 3).astype(np.int64)

    def meetings(self, among: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(later, earlier, thirds) that pass the filters, in blocks without a repeated later line; among: only these later ones."""
        here = np.arange(len(self.name))
        lag = 1
        while True:
            here = here[: np.searchsorted(here, len(self.name) - lag)]
            there = here + lag
            # sizes ascend within a list, so what is too far away stays too far
            near = (self.name[here] == self.name[there]) & (self.num * self.size[there] <= self.den * self.size[here])
            here = here[near]
            if not len(here):
                return
            i, j = here, there[near]
            if among is not None:
                some = among[i] | among[j]
                i, j = i[some], j[some]
            i, j, far = self.alike(i, j)
            for x, y in ((i, j), (j, i)):
                ok = self.stamp[x] > self.stamp[y]
                ok = ok if among is None else ok & among[x]
                yield x[ok], y[ok], far[ok]
            lag += 1


def dedup(
    docs: DataFrame, key: str = "doc_id", text: str = "text", num: int = NUM, den: int = DEN, words_each: int = WORDS_EACH,
    carry: tuple[str, ...] = (), hot: int = HOT,
) -> DataFrame:
    """(key, n_lines, n_removed, removed array<int> of line numbers from 0, text of the lines left) for every row.

    With carry also ``carried``, a struct of those columns.
    """
    carried = [F.struct(*carry).alias("carried")] if carry else []
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), *carried)
    counts = shared.bin_counts(rows, "text", BITS, lambda c: (c.word_hash() >> np.uint64(64 - BITS)).astype(np.int64))
    buckets = shared.power_of_two(int(counts.sum()) // words_each + 1, 32)
    files = int(counts.sum()) // WORDS_A_FILE + 8
    rarity = _rarity(counts)
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    found_schema = packing.schema(*LINKS) + ", kind int"
    open_schema = packing.schema("list")

    def index(lists: np.ndarray | None = None):
        """Entries, and marks of equal lines of a chunk; with lists (sorted) only their entries, of all lines."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keep = _among(lists, number_of) if lists is not None and len(lists) else None
            held: list[tuple] = []
            for chunk in textnp.chunks(batches, "text"):
                lines = Lines(chunk, chunk.batch.column(0).to_numpy(zero_copy_only=False))
                wanted, twin = np.ones(len(lines.row), dtype=bool), np.zeros(0, np.int64)
                if lists is None:
                    wanted, again = lines.heads()
                    twin = np.flatnonzero(again)
                line, values = _entries(lines, wanted, rarity, num, den, hot, keep)
                bucket = (values["list"] >> shift).astype(np.int64)
                values["list"] = values["list"] & _LOW24
                values["wide"] = values["wide"][_tier(values["size"]) > 0]
                held.append((lines.key[twin], lines.number[twin], bucket, lines.key[line], lines.number[line], {n: v.astype(ENTRY[n], copy=False) for n, v in values.items()}))
                if sum(len(x[0]) + len(x[2]) for x in held) >= ENTRIES_EACH:
                    yield from packed_entries(held)
                    held = []
            if held:
                yield from packed_entries(held)

        return run

    def packed_entries(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        """Marks and entries of some chunks, a row for each bucket and tier; ``wide`` has only the entries of lines that have a second parity."""
        key, number, bucket, own, at = (np.concatenate(x) for x in list(zip(*held))[:5])
        if len(key):
            marks = {n: np.zeros(len(key), t) for n, t in ENTRY.items()} | {"wide": np.zeros((len(key), 0), np.uint64)}
            yield packing.pack(buckets + packing.home_of(key, buckets), key, number, **marks)
        values = {n: np.concatenate([x[5][n] for x in held]) for n in ENTRY}
        wide, tier = values.pop("wide"), _tier(values["size"])
        wider = tier[tier > 0]
        for t, n in enumerate(WIDE):
            some = np.flatnonzero(tier == t)
            if len(some):
                cells = {name: v[some] for name, v in values.items()} | {"wide": wide[wider == t, :n] if t else np.zeros((len(some), 0), np.uint64)}
                yield packing.pack(bucket[some], own[some], at[some], in_order=True, **cells)

    def number_of(name: np.ndarray) -> np.ndarray:
        """Bucket and list within it."""
        return ((name >> shift) << np.uint64(24) | name & _LOW24).astype(np.int64)

    def packed(kind: int, batch: pa.RecordBatch) -> pa.Table:
        """Rows of found_schema: 0 marks, 1 pairs (by home of the earlier line), 2 lists with more (``later`` holds them)."""
        empty = pa.nulls(len(batch), pa.binary())
        cells = [batch.column(c) if c in batch.schema.names else empty for c in ("bucket", "ids", "counts", "gaps", *LINKS)]
        return pa.table([*cells, pa.array([kind] * len(batch), pa.int32())], names=["bucket", "ids", "counts", "gaps", *LINKS, "kind"])

    def pairs_of(lists: Lists, earlier: np.ndarray, later: np.ndarray, more: np.ndarray) -> pa.Table:
        earlier, later, more = _distinct(earlier, later, more)
        (y_key, y_pos), (x_key, x_pos) = lists.line_of(earlier), lists.line_of(later)
        links = {"later": x_key, "line": x_pos.astype(np.uint32), "more": more.astype(np.uint8)}
        return packed(1, packing.pack(packing.home_of(y_key, buckets), y_key, y_pos, **links))

    def meet(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        if bucket >= buckets:
            marks = table.select(["bucket", "ids", "counts", "gaps"]).combine_chunks().to_batches()
            return pa.concat_tables([packed(0, b) for b in marks]).set_column(0, "bucket", pa.array([bucket - buckets] * len(table), pa.int32()))
        lists = Lists(table, num, den)
        n = len(lists.name)
        passed, nearest = np.zeros(n, dtype=np.int64), np.full(n, 4)
        who = np.full(n, np.iinfo(np.int64).max)
        for x, y, far in lists.meetings():
            passed[x] += 1
            # of the nearest the earliest, so that other lists and other copies choose the same
            ok = (far < nearest[x]) | ((far == nearest[x]) & (lists.stamp[y] < who[x]))
            x = x[ok]
            nearest[x], who[x] = far[ok], lists.stamp[y[ok]]
        found, more = np.flatnonzero(passed > 0), np.flatnonzero(passed > 1)
        y, x = np.concatenate([lists.equal[0], who[found]]), np.concatenate([lists.equal[1], lists.stamp[found]])
        pairs = pairs_of(lists, y, x, np.concatenate([np.full(len(lists.equal[0]), EQUAL), (passed[found] > 1).astype(np.int64)]))
        flags = packing.pack(np.full(len(more), bucket), *lists.line_of(lists.stamp[more]), later=lists.name[more].astype(np.int64))
        return pa.concat_tables([pairs, packed(2, flags)])

    def meet_open(table: pa.Table, asked: pa.Table) -> pa.Table:
        """All pairs of the open lines in their lists."""
        if not len(table) or not len(asked):
            return packed(1, packing.pack(*[np.zeros(0, np.int64)] * 3))
        lists = Lists(table, num, den)
        wanted = np.rec.fromarrays(packing.unpack(asked, list=np.int64))
        each = np.rec.fromarrays([*lists.line_of(lists.stamp), lists.name.astype(np.int64)], dtype=wanted.dtype)
        found = [(lists.stamp[y], lists.stamp[x]) for x, y, _ in lists.meetings(np.isin(each, wanted))]
        y, x = (np.concatenate(z) for z in zip(*found)) if found else [np.zeros(0, np.int64)] * 2
        return pairs_of(lists, y, x, np.zeros(len(x), np.int64))

    sent_schema = packing.schema() + ", later array<bigint>, line array<int>, words string, digest binary"
    binary = {n: pa.binary() for n in ("ids", "counts", "gaps")}
    longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
    sent_types = {"bucket": pa.int32(), **binary, "later": longs, "line": ints, "words": pa.string(), "digest": pa.binary()}

    def fetch(texts: pa.Table, pairs: pa.Table) -> pa.Table:
        """The earlier lines on their way to the later ones: each once to a bucket, for how many lines there it may be.

        Where the lines should be equal a digest of 128 bits goes instead.
        """
        if not len(pairs) or not len(texts):
            return pa.table({n: pa.array([], t) for n, t in sent_types.items()})
        y_key, y_pos, x_key, x_pos, more = packing.unpack(pairs, **LINKS)
        each = _distinct(packing.home_of(x_key, buckets), more == EQUAL, y_key, y_pos, x_key, x_pos.astype(np.int64))
        new = np.ones(len(each[0]), dtype=bool)
        new[1:] = np.any([x[1:] != x[:-1] for x in each[:4]], axis=0)
        heads = np.flatnonzero(new)
        ends = np.append(heads[1:], len(new))
        where = _lines_by_key(texts, np.unique(y_key))
        out: list[tuple] = []
        for a, b, home, equal, k, p in zip(heads.tolist(), ends.tolist(), *(x[heads].tolist() for x in each[:4])):
            for line in {x[p] for x in where.get(k, ()) if p < len(x)}:
                out.append((a, b, home, None if equal else line, _digest(line) if equal else None))
        offsets = pa.array(np.cumsum([0, *(b - a for a, b, *_ in out)]).astype(np.int32))
        take = np.concatenate([np.arange(a, b) for a, b, *_ in out]) if out else np.zeros(0, np.int64)
        lists = [pa.ListArray.from_arrays(offsets, pa.array(each[c][take].astype(t))) for c, t in ((4, np.int64), (5, np.int32))]
        nothing = [pa.nulls(len(out), t) for t in binary.values()]
        rest = [pa.array([x[c] for x in out], t) for c, t in ((3, pa.string()), (4, pa.binary()))]
        return pa.table([pa.array([x[2] for x in out], pa.int32()), *nothing, *lists, *rest], names=list(sent_types))

    def matched(texts: pa.Table, sent: pa.Table) -> dict[int, set[int]]:
        """Lines to remove, by key: those marked, and those that are alike a line that was sent."""
        gone: dict[int, set[int]] = {}
        marks = sent.filter(pc.is_valid(sent["ids"])).select(["bucket", "ids", "counts", "gaps"])
        for k, p in zip(*(x.tolist() for x in packing.unpack(marks))):
            gone.setdefault(k, set()).add(p)
        pairs = sent.filter(pc.is_null(sent["ids"]))
        if not len(pairs):
            return gone
        lines = _lines_by_key(texts, np.unique(pairs["later"].combine_chunks().flatten().to_numpy()))
        for keys, numbers, words, digest in zip(*(pairs[c].to_pylist() for c in ("later", "line", "words", "digest"))):
            x: set[bytes] = set()
            for k, p in zip(keys, numbers):
                done = gone.setdefault(k, set())
                for own in lines.get(k, ()):
                    if p in done or p >= len(own):
                        continue
                    if digest is not None:
                        alike = _digest(own[p]) == digest
                    elif not (alike := own[p] == words):
                        x = x or set(words.encode().split())
                        y = set(own[p].encode().split())
                        both = len(x & y)
                        alike = den * both >= num * (len(x) + len(y) - both)
                    if alike:
                        done.add(p)
        return gone

    def remove(texts: pa.Table, sent: pa.Table) -> pa.Table:
        gone = matched(texts, sent)
        n_lines = pc.add(pc.count_substring(texts["text"], "\n"), 1).cast(pa.int64())
        removed, kept = [], []
        for k, n, s in zip(texts["key"].to_pylist(), n_lines.to_pylist(), texts["text"].to_pylist()):
            out = sorted(p for p in gone.get(k, ()) if p < n) if k is not None else []
            removed.append(out)
            if out:
                drop = set(out)
                s = "\n".join(x for p, x in enumerate(s.split("\n")) if p not in drop)
            kept.append(s)
        sizes = pa.array([len(x) for x in removed], pa.int64())
        cells = {"key": texts["key"], "n_lines": n_lines, "n_removed": sizes, "removed": pa.array(removed, pa.list_(pa.int32()))}
        return pa.table(cells | {"text": pa.array(kept, pa.string())} | ({"carried": texts["carried"]} if carry else {}))

    keyed = rows.select("key", "text").where("key is not null")
    placed = rows.withColumn("bucket", packing.home(F.coalesce("key", F.xxhash64("text")), buckets)).groupBy("bucket")
    found = shared.cut(keyed.mapInArrow(index(), packing.schema(*ENTRY)).groupBy("bucket").applyInArrow(meet, found_schema), files)
    open_lists = _open_lists(rows, found, num, den, files)
    if open_lists is not None:
        names = open_lists.select(F.expr("shiftleft(cast(bucket as bigint), 24) | list").alias("n")).distinct()
        lists = None
        if names.limit(FILTER_LISTS + 1).count() <= FILTER_LISTS:
            lists = np.sort(names.toPandas()["n"].to_numpy(np.int64))
        asked = open_lists.mapInArrow(_packed_lists, open_schema).groupBy("bucket")
        again = keyed.mapInArrow(index(np.zeros(0, np.int64) if lists is None else lists), packing.schema(*ENTRY)).groupBy("bucket")
        found = found.unionByName(shared.cut(again.cogroup(asked).applyInArrow(meet_open, found_schema), files))
    pairs = placed.cogroup(found.where("kind = 1").groupBy("bucket")).applyInArrow(fetch, sent_schema)
    nothing = [F.lit(None).cast(t).alias(n) for n, t in (("later", "array<bigint>"), ("line", "array<int>"), ("words", "string"), ("digest", "binary"))]
    marks = found.where("kind = 0").select("bucket", "ids", "counts", "gaps", *nothing)
    of_carried = f", carried {rows.schema['carried'].dataType.simpleString()}" if carry else ""
    schema = "key bigint, n_lines bigint, n_removed bigint, removed array<int>, text string" + of_carried
    return placed.cogroup(pairs.unionByName(marks).groupBy("bucket")).applyInArrow(remove, schema).withColumnRenamed("key", key)


def _among(lists: np.ndarray, number_of: Callable[[np.ndarray], np.ndarray]) -> Callable[[np.ndarray], np.ndarray]:
    """Which names of lists have a number among the sorted ones; 22 bits of a number say that most have not."""
    low = np.int64((1 << 22) - 1)
    may = np.zeros(1 << 22, dtype=bool)
    may[lists & low] = True

    def keep(name: np.ndarray) -> np.ndarray:
        number = number_of(name)
        some = np.flatnonzero(may[number & low])
        number = number[some]
        return some[lists[np.minimum(np.searchsorted(lists, number), len(lists) - 1)] == number]

    return keep


def _digest(line: str) -> bytes:
    """Of the words in their order."""
    return blake2b(b" ".join(line.encode().split()), digest_size=16).digest()


def _distinct(*columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct rows of the columns, sorted by the first, then the second and so on."""
    order = np.lexsort(columns[::-1])
    columns = tuple(x[order] for x in columns)
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.any([x[1:] != x[:-1] for x in columns], axis=0)
    return tuple(x[new] for x in columns)


def _lines_by_key(texts: pa.Table, keys: np.ndarray) -> dict[int, list[list[str]]]:
    """The lines of the texts of some keys; different texts of one key each."""
    some = texts.select(["key", "text"]).filter(pc.is_in(texts["key"], pa.array(keys, pa.int64())))
    out: dict[int, dict[str, list[str]]] = {}
    for k, s in zip(some["key"].to_pylist(), some["text"].to_pylist()):
        of = out.setdefault(k, {})
        if s not in of:
            of[s] = s.split("\n")
    return {k: list(of.values()) for k, of in out.items()}


def _flagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of lists that have more lines than tries."""
    for batch in batches:
        key, pos, later, line, more = packing.unpack(pa.Table.from_batches([batch]), **LINKS)
        each = _distinct(*(x[more == 1] for x in (key, pos, later, line.astype(np.int64))))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in each], names=["k", "p", "later", "line"])


def _unpacked_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, list, later, line) of the lists that have more lines than tries."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        bucket = np.concatenate([np.full(textnp.unplanes(c, np.uint32).sum(), b) for b, c in zip(*(table[n].to_pylist() for n in ("bucket", "counts")))])
        key, pos, name = packing.unpack(table, later=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), pa.array(name), pa.array(key), pa.array(pos)], names=["bucket", "list", "later", "line"])


def _packed_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bucket, name, later, line = (batch.column(n).to_numpy() for n in ("bucket", "list", "later", "line"))
        yield packing.pack(bucket.astype(np.int64), later, line, list=name)


def _bounded(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _open_lists(rows: DataFrame, found: DataFrame, num: int, den: int, files: int) -> DataFrame | None:
    """(bucket, list, later, line) of lists with more lines than tries, of lines whose tries there all fail; None if there are none."""
    pairs = found.where("kind = 1").select("bucket", "ids", "counts", "gaps", *LINKS)
    pairs = shared.cut(pairs.mapInArrow(_flagged, "k bigint, p bigint, later bigint, line bigint").distinct(), files)
    if pairs.isEmpty():
        return None
    both_ends = F.array(F.struct("k", "p"), F.struct(F.col("later").alias("k"), F.col("line").alias("p")))
    ends = pairs.select(F.explode(both_ends).alias("e")).select("e.k", "e.p").distinct()
    lines = rows.join(_bounded(ends), F.col("key") == F.col("k")).select("k", "p", F.get(F.split("text", "\n"), F.col("p").cast("int")).alias("s"))
    # hashes of words decide who is open; what is removed is verified on the words themselves
    words = F.array_distinct(F.transform(F.filter(F.split("s", r"[\x20\x09-\x0D]+"), lambda w: w != ""), lambda w: F.xxhash64(w)))
    lines = shared.cut(lines.where("s is not null").select("k", "p", words.alias("w")), files)
    mine = lines.select(F.col("k").alias("later"), F.col("p").alias("line"), F.col("w").alias("v"))
    n = F.size(F.array_intersect("w", "v"))
    ok = den * n >= num * (F.size("w") + F.size("v") - n)
    tried = pairs.join(lines, ["k", "p"]).join(mine, ["later", "line"]).groupBy("later", "line").agg(F.max(ok.cast("int")).alias("ok"))
    still = shared.cut(tried.where("ok = 0").select("later", "line"), files)
    if still.isEmpty():
        return None
    lists = found.where("kind = 2").select("bucket", "ids", "counts", "gaps", "later")
    lists = lists.mapInArrow(_unpacked_lists, "bucket int, list bigint, later bigint, line bigint")
    return shared.cut(lists.join(_bounded(still), ["later", "line"], "left_semi").select("bucket", "list", "later", "line"), files)
