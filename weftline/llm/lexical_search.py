"""Ranked lexical search over a length-stratified index: the k best documents of every item.

A document of n terms has the normaliser m = 25 + (75 * n * N) div L (N documents with a term, L terms in all), and a term that
occurs tf times in it adds w * (10^9 * tf) div (1000 * tf + 8 * m), with w = floor(1000 * ln((2N + 2) / (2df + 1))). So all that a
posting adds beside w depends on (m, tf) alone.

Index. Documents with equal m form a stratum. Within a stratum the postings of a term are ordered by tf, highest first; the
impact of a tf is computed once for the stratum and serves all terms. The first posting of a term bounds what the stratum can
add for it, and the sum over an item's terms bounds every score in the stratum. An item visits strata from the highest
bound down, in growing groups, and stops where the bound falls below its k-th best score so far (equal bounds are visited, since a
tie may have a smaller key). Skipped strata can't hold a result, so the ranking is exact.

In Spark. One pass over the whole texts (``terms``) gives n and the postings of the terms that items hold, written as Parquet.
Whole strata are dealt out by hash; one with more than ``docs_each`` documents (copies, a hot length) is split by row, so no task
gets an unbounded stratum. Each part ranks all items of a block and gives at most k rows for each; those are merged by a window. Items
are taken in blocks of ``ITEM_TERMS`` (item, term) rows by hash, which bounds what is broadcast and what the driver sees; each block is
searched against all documents. One item with more terms than that is a block of its own.

Defined cases. A null or empty text has no term; such a document counts neither in N nor among the results. Rows without a key
count in N, L and df but can't be returned. Repeated rows are documents each. Equal scores rank by the smaller key. Repeated rows of an item
count once; rows of one item with different texts are one item with the terms of all. Rows without an item id, and items
without a term or without a match, give nothing. Empty tables give an empty table. Extra columns are not read. Keys are integers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm import shared, terms, textnp

#: Documents of one part of the index.
DOCS_EACH = 8192
#: (item, term) rows of one block of items.
ITEM_TERMS = 400_000
#: Documents that an item visits first; each later visit takes this many times more.
FIRST_VISIT, GROWTH = 256, 8

FOUND = "item bigint, doc bigint, score bigint"


def item_terms(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item, term, times) of the distinct rows of items."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found, times = [], [], []
            for own, raw in zip(batch.column("item").to_pylist(), terms.raw_texts(batch, "text")):
                counted = Counter()
                for words in terms.slices(raw, terms.LETTERS_AND_DIGITS):
                    counted.update(words)
                ids += [own] * len(counted)
                found += counted.keys()
                times += counted.values()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), terms.strings(found), pa.array(times, pa.int64())], ["item", "term", "times"])

    rows = items.where(F.col(item).isNotNull()).select(F.col(item).cast("bigint").alias("item"), F.col(text).alias("text")).distinct()
    return rows.mapInArrow(count, "item bigint, term string, times bigint").groupBy("item", "term").agg(F.sum("times").alias("times"))


class Part:
    """The index of some strata: postings by term, stratum and falling tf."""

    def __init__(self, doc: np.ndarray, m: np.ndarray, sizes: np.ndarray, term: np.ndarray, tf: np.ndarray, n_terms: int):
        order = np.argsort(m, kind="stable")
        place = np.empty(len(doc), np.int64)
        place[order] = np.arange(len(doc))
        self.doc, m = doc[order], m[order]
        self.first, self.docs = textnp.runs(m)
        stratum = np.repeat(np.arange(len(self.first)), self.docs)
        at = np.repeat(place, sizes)
        wide = int(tf.max(initial=0)) + 1
        keys, which = np.unique(stratum[at] * wide + tf, return_inverse=True)
        times = keys % wide
        impact = 1_000_000_000 * times // (1000 * times + 8 * m[self.first][keys // wide])  # once for each tf of a stratum
        own = term * np.int64(len(self.first) + 1) + stratum[at]
        order = np.lexsort((-tf, own))
        self.at, self.impact, term = at[order], impact[which[order]], term[order]
        self.run, self.length = textnp.runs(own[order])
        self.run_stratum = stratum[self.at[self.run]]
        self.most = self.impact[self.run]
        self.of_term = np.searchsorted(term[self.run], np.arange(n_terms + 1))

    def best(self, held: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best documents of an item that holds these terms with these weights."""
        sizes = self.of_term[held + 1] - self.of_term[held]
        runs = _ranges(self.of_term[held], sizes)
        weight = np.repeat(weight, sizes)
        bound = np.zeros(len(self.first), np.int64)
        np.add.at(bound, self.run_stratum[runs], weight * self.most[runs])
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        seen = np.cumsum(self.docs[order])
        best, scores, least, at, visit = np.zeros(0, np.int64), np.zeros(0, np.int64), 1, 0, FIRST_VISIT
        while at < len(order) and bound[order[at]] >= least:
            to = max(at + 1, int(np.searchsorted(seen, (seen[at - 1] if at else 0) + visit, "right")))
            chosen = np.zeros(len(self.first), bool)
            chosen[order[at:to][bound[order[at:to]] >= least]] = True
            some = chosen[self.run_stratum[runs]]
            length = self.length[runs[some]]
            postings = _ranges(self.run[runs[some]], length)
            total = np.zeros(len(self.doc), np.int64)
            np.add.at(total, self.at[postings], np.repeat(weight[some], length) * self.impact[postings])
            new = np.flatnonzero(total >= least)
            best, scores = np.concatenate([best, new]), np.concatenate([scores, total[new]])
            if len(best) > 4 * k:  # the sort need not see what is surely not among the k best
                high = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
                best, scores = best[high], scores[high]
            top = np.lexsort((self.doc[best], -scores))[:k]
            best, scores = best[top], scores[top]
            least = max(1, int(scores[-1])) if len(scores) == k else 1
            at, visit = to, visit * GROWTH
        return best, scores


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, so many as its size."""
    return np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


def _postings(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """(doc, n, terms, tfs) of all rows with a term; terms are places in the vocabulary."""
    place = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = place.value.get
        for batch in batches:
            docs, sizes, held, tfs, lengths = [], [], [], [], [0]
            for own, raw in zip(batch.column("doc").to_pylist(), terms.raw_texts(batch, "text")):
                n, counted = 0, Counter()
                for words in terms.slices(raw, terms.LETTERS_AND_DIGITS):
                    n += len(words)
                    counted.update(map(find, words))
                if n:
                    counted.pop(None, None)
                    docs.append(own)
                    sizes.append(n)
                    held += counted.keys()
                    tfs += counted.values()
                    lengths.append(len(held))
            ends = pa.array(lengths, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, t)) for x, t in ((held, pa.int32()), (tfs, pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(sizes, pa.int64()), *lists], ["doc", "n", "terms", "tfs"])

    return docs.mapInArrow(count, "doc bigint, n bigint, terms array<int>, tfs array<bigint>")


def _search(rows: DataFrame, asked: DataFrame, k: int, docs_each: int) -> DataFrame:
    """The k best of each part for the items of one block (item, term, times)."""
    spark = rows.sparkSession
    table = asked.orderBy("item", "term").toArrow()  # at most about ITEM_TERMS rows
    codes = table["term"].combine_chunks().dictionary_encode()
    if isinstance(codes, pa.ChunkedArray):
        codes = codes.combine_chunks()
    vocabulary = codes.dictionary.cast(pa.binary()).to_pylist()
    held, times = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64), table["times"].to_numpy()
    ids = table["item"].to_numpy()
    docs = shared.stored(_postings(rows, vocabulary))
    n, total = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    found = docs.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(F.lit(1000) * F.log((F.lit(2 * n + 2)) / (2 * F.col("df") + 1)))
    weights = np.zeros(len(vocabulary), np.int64)
    for t, w in found.select("t", weight.cast("bigint")).collect():  # one row for each term of the block
        weights[t] = w
    first, sizes = textnp.runs(ids)
    model = spark.sparkContext.broadcast((ids[first], np.append(first, len(ids)), held, times * weights[held], len(vocabulary)))

    def rank(table: pa.Table) -> pa.Table:
        items, bounds, held, weight, n_terms = model.value
        lists = table["terms"].combine_chunks(), table["tfs"].combine_chunks()
        term, tf = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in lists)
        part = Part(table["doc"].to_numpy(), table["m"].to_numpy(), np.diff(lists[0].offsets.to_numpy()), term, tf, n_terms)
        out: list[list[np.ndarray]] = [[], [], []]
        for item, a, b in zip(items, bounds[:-1], bounds[1:]):
            best, scores = part.best(held[a:b], weight[a:b], k)
            for column, x in zip(out, (np.full(len(best), item), part.doc[best], scores)):
                column.append(x)
        return pa.table([pa.array(np.concatenate(c), pa.int64()) for c in out], ["item", "doc", "score"])

    m = F.lit(25) + F.expr(f"(cast(75 as decimal(38,0)) * n * {n}) div {max(total, 1)}")
    docs = docs.where(F.col("doc").isNotNull() & (F.size("terms") > 0)).withColumn("m", m.cast("bigint"))
    strata = docs.groupBy("m").agg(F.count(F.lit(1)).alias("size"))
    parts = -(-n // docs_each) or 1
    large = strata.where(F.col("size") > docs_each).select(F.col("m").alias("large"), F.call_function("div", F.col("size"), F.lit(docs_each)).alias("splits"))
    docs = docs.withColumn("row", F.monotonically_increasing_id()).join(shared.small(shared.cut(large)), F.col("m") == F.col("large"), "left")
    split = F.when(F.col("splits").isNull(), 0).otherwise(F.pmod("row", F.col("splits") + 1))
    dealt = docs.select(F.pmod(F.xxhash64("m", split), F.lit(parts)).alias("part"), "doc", "m", "terms", "tfs")
    return dealt.groupBy("part").applyInArrow(rank, FOUND)


def search(docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", docs_each: int = DOCS_EACH, rows_each: int = ITEM_TERMS) -> DataFrame:
    """(item, rank, doc, score): for each item its k highest-scoring documents with a score above 0."""
    asked = shared.cut(item_terms(items, item, item_text))
    rows = docs.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("text"))
    blocks = -(-asked.count() // rows_each)
    found = docs.sparkSession.createDataFrame([], FOUND)
    for b in range(blocks):
        found = found.unionByName(_search(rows, asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b), k, docs_each))
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item", "rank", "doc", "score")
