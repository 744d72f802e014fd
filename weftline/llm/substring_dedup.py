"""Substring dedup by fixed-block anchors.

A word sequence of ``window`` words that occurs earlier (smaller key, or the same key and an earlier start) is removed
wherever it occurs again.

Method. Every text is cut into non-overlapping reference blocks of ``window // 2`` words; their hashes are the index. A
repeated sequence of ``window`` words holds a whole block of its first occurrence, so every rolling window of
block length of every text probes the index, and a hit of another place is an anchor. Anchors are extended in the texts:
each sequence of ``window`` words around an anchor is compared by two independent hashes, of 96 bits together; its first
occurrence stays and the other starts are marked. Neighbouring marked starts merge into the maximal exact repeats, whose
words go.

In Spark. Windows are packed by bucket (``packing``): 4 bytes a window for the probe, 12 for the comparison, which only sees
sequences around anchors. Before a shuffle only one window of each hash is kept, by chunk of texts for the probe and by
home bucket for the comparison (the least; the other places are later ones for certain), so a passage in every document
adds one entry for each of these to the buckets of its windows, and no pairs are made. The number of buckets follows the
bytes of the texts, so a bucket keeps its size as the input grows. Texts are dealt out by key once and read at both places.

Defined cases: a null text counts as empty; texts shorter than the window lose nothing; rows with the same key count as
the same document (a repeated row isn't its own duplicate, and each copy of the row gets the same result); rows without
a key are neither searched nor changed; extra columns are not read; an empty table gives an empty table. The key is an
integer column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import packing, shared, textnp

WINDOW = 20
#: Bytes of the texts that meet in one bucket, about; a longer text is alone in being larger.
BYTES_EACH = 14_000_000


def _keys(batch) -> np.ndarray:
    return pc.fill_null(batch.column(batch.schema.get_field_index("key")), 0).to_numpy(zero_copy_only=False)


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, bytes_each: int = BYTES_EACH) -> DataFrame:
    """(key, n_words, n_removed, spans array<struct<start,end>> of removed words, kept text) for every row."""
    block = window // 2
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = shared.power_of_two(total // bytes_each + 1, 32)
    shift = np.uint64(64 - (buckets.bit_length() - 1))

    def through(table: pa.Table, names: list[str]) -> pa.Table | None:
        """Rows of packed places that need no comparison are sent on to their home as they are."""
        bucket = table["bucket"][0].as_py()
        if bucket < buckets:
            return None
        return table.select(names).set_column(0, "bucket", pa.array([bucket - buckets] * len(table), pa.int32()))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in textnp.chunks(batches, "text"):
            chunk.words()
            hashes, at = chunk.windows(chunk.word_hash(), block)
            long = np.diff(chunk.first) >= window
            ok = long[chunk.doc[at]]
            hashes, at = hashes[ok], at[ok]
            order = np.argsort(hashes, kind="stable")
            start, n = textnp.runs(hashes[order])
            indexed = np.logical_or.reduceat((chunk.pos[at] % block == 0)[order], start) if len(start) else np.zeros(0, dtype=bool)
            own = _keys(chunk.batch)
            # what a chunk has more than once is around an anchor, or does no harm
            some = at[np.sort(order[np.repeat(n > 1, n)])]
            nothing = {"print": np.zeros(len(some), np.uint32), "indexed": np.zeros(len(some), np.uint8)}
            yield packing.pack(buckets + packing.home_of(own[chunk.doc[some]], buckets), own[chunk.doc[some]], chunk.pos[some], **nothing)
            by_place = np.argsort(order[start])
            one = order[start][by_place]
            hashes, at, indexed = hashes[one], at[one], indexed[by_place]
            ascending = bool((np.diff(own) > 0).all())
            yield packing.pack((hashes >> shift).astype(np.int64), own[chunk.doc[at]], chunk.pos[at], in_order=ascending, print=hashes.astype(np.uint32), indexed=indexed.astype(np.uint8))

    places = ["bucket", "ids", "counts", "gaps"]

    def anchors(table: pa.Table) -> pa.Table:
        if (out := through(table, places)) is not None:
            return out
        key, pos, prints, indexed = packing.unpack(table, print=np.uint32, indexed=np.uint8)
        order = np.argsort(prints)
        start, n = textnp.runs(prints[order])
        hit = np.maximum.reduceat(indexed[order], start) > 0 if len(start) else np.zeros(0, dtype=bool)
        hit = order[np.repeat(hit & (n > 1), n)]
        return pa.Table.from_batches([packing.pack(packing.home_of(key[hit], buckets), key[hit], pos[hit])])

    def extend(texts: pa.Table, hits: pa.Table) -> pa.Table:
        key, pos = packing.unpack(hits)
        wanted = np.unique(key)
        texts = texts.filter(pc.is_in(texts["key"], pa.array(wanted)))
        order = np.lexsort((pos, key))
        key, pos = key[order], pos[order]
        found: list[tuple[np.ndarray, ...]] = []
        for chunk in textnp.chunks(iter(texts.combine_chunks().to_batches()), "text"):
            chunk.words()
            own = _keys(chunk.batch)
            a, b = np.searchsorted(key, own, "left"), np.searchsorted(key, own, "right")
            flag = np.zeros(len(chunk.starts) + 1, dtype=np.int64)
            where = np.concatenate([pos[x:y] + f for x, y, f in zip(a, b, chunk.first)]) if len(own) else np.zeros(0, dtype=np.int64)
            flag[where[where < len(chunk.starts)]] = 1
            total = np.concatenate([[0], np.cumsum(flag)])
            words = chunk.word_hash()
            first, at = chunk.windows(words, window)
            second, _ = chunk.windows(textnp.mix(words ^ np.uint64(0x5851F42D4C957F2D)), window)
            near = total[at + window - block + 1] > total[at]
            at = at[near]
            found.append((own[chunk.doc[at]], chunk.pos[at], first[near], second[near]))
        key, pos, first, second = (np.concatenate(x) for x in zip(*found)) if found else [np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64)]
        order = np.lexsort((pos, key, second, first))
        key, pos, first, second = (x[order] for x in (key, pos, first, second))
        new = np.ones(len(key), dtype=bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        of = np.flatnonzero(new)[np.cumsum(new) - 1] if len(key) else np.zeros(0, np.int64)
        again = (key != key[of]) | (pos != pos[of])
        nothing = {"hash": np.zeros(again.sum(), np.uint64), "more": np.zeros(again.sum(), np.uint32)}
        marks = packing.pack(buckets + packing.home_of(key[again], buckets), key[again], pos[again], **nothing)
        least = packing.pack((second[new] >> shift).astype(np.int64), key[new], pos[new], hash=first[new], more=second[new].astype(np.uint32))
        return pa.Table.from_batches([marks, least])

    def later(table: pa.Table) -> pa.Table:
        if (out := through(table, places)) is not None:
            return out
        key, pos, first, second = packing.unpack(table, hash=np.uint64, more=np.uint32)
        order = np.lexsort((pos, key, second, first))
        key, pos, first, second = (x[order] for x in (key, pos, first, second))
        again = np.zeros(len(key), dtype=bool)
        again[1:] = (first[1:] == first[:-1]) & (second[1:] == second[:-1])
        return pa.Table.from_batches([packing.pack(packing.home_of(key[again], buckets), key[again], pos[again])])

    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def remove(texts: pa.Table, marks: pa.Table) -> pa.Table:
        key, pos = packing.unpack(marks)
        order = np.lexsort((pos, key))
        key, pos = key[order], pos[order]
        ids, n_words, n_removed, spans, kept = texts["key"].to_pylist(), [], [], [], []
        for k, s in zip(ids, texts["text"].to_pylist()):
            words = s.encode().split()
            starts = pos[np.searchsorted(key, k, "left") : np.searchsorted(key, k, "right")] if k is not None else pos[:0]
            starts = starts[starts + window <= len(words)]
            n_words.append(len(words))
            if not len(starts):
                n_removed.append(0)
                spans.append([])
            else:
                steps = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(steps, starts, 1)
                np.add.at(steps, starts + window, -1)
                gone = np.cumsum(steps)[:-1] > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                spans.append([{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2])])
                n_removed.append(int(gone.sum()))
                words = [w for w, g in zip(words, gone.tolist()) if not g]
            kept.append(b" ".join(words).decode())
        return pa.table({"key": texts["key"], "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "spans": pa.array(spans, span), "text": pa.array(kept, pa.string())})

    placed = rows.withColumn("bucket", packing.home(F.coalesce("key", F.xxhash64("text")), buckets))
    hits = rows.where("key is not null").mapInArrow(probe, packing.schema("print", "indexed")).groupBy("bucket").applyInArrow(anchors, packing.schema())
    around = placed.groupBy("bucket").cogroup(hits.groupBy("bucket")).applyInArrow(extend, packing.schema("hash", "more"))
    marks = around.groupBy("bucket").applyInArrow(later, packing.schema())
    out = placed.groupBy("bucket").cogroup(marks.groupBy("bucket")).applyInArrow(remove, "key bigint, n_words bigint, n_removed bigint, spans array<struct<start:int,end:int>>, text string")
    return out.withColumnRenamed("key", key)
