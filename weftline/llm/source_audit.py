"""Source divergence audit: how far the term frequencies of each source of a language lie from those of the others.

Terms are cut by a translate table (``terms``): ``bytes.translate`` lowers letters and blanks separators in one pass, ``bytes.split`` cuts,
and a Counter for each document gives its frequencies, and by its keys the document counts. A task adds the Counters of its
documents up and sends one sparse row for each (lang, source, term) that occurs. Each language keeps its ``least_docs`` terms (V of them).

A group (lang, source) gives each kept term with count occurrences p = 1 + floor(10^9 * (count + 1) / (N + V)), N being the group's
occurrences of kept terms, and so does the whole language (q). Two values are compared by f(p, q) = floor((p - q)^2 / q).

Part ``pair``. The value of a group against another source of its language is the sum of f over all V terms. It is never summed
over terms that don't occur: with p0 and q0, what the two sources give a term without occurrences,
    value = (V - n_p - n_q + n_both) * f(p0, q0) + sum over the group's terms of f(p, q0) + sum over the other's terms of f(p0, q)
            + sum over the terms of both of [f(p, q) - f(p, q0) - f(p0, q)].
The second and third sum run over the histogram of p of one source (few distinct values); the last meets the sources of a term in buckets of
terms and blocks of sources, as numpy arrays.
Part ``term``. The terms of a group with p above the language's q, by f, the first ``most_terms``.

In Spark. Group counts are dealt out by (lang, term) once, which serves the counts per source, the document counts per language
and the totals. Nothing is gathered by source, so a source with a third of all rows is no hot key; tables of one row for each source are broadcast behind a
count. Sums are decimals, the rest 64-bit integers: all exact.

Defined cases. Null text, lang and source count as ''. Rows are documents each, repeated ones too. A group without terms has its rows of part ``pair``
like any other; a language with V = 0 has the value 0 in all of them; a source alone in its language has none. Very long texts are cut in slices. An empty table gives
an empty table. Extra columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm import shared, terms, textnp

LEAST_DOCS = 3
MOST_TERMS = 200
SCALE = 1_000_000_000
#: Distinct (group, term) entries that a task holds before it sends them.
HELD = 300_000
#: Rows of kept terms in one bucket, sources in one block, and pairs of entries that a task forms at once.
BUCKET_ROWS, BLOCK_SOURCES, PAIRS_AT_ONCE = 150_000, 256, 1 << 21


def count_terms(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", held: int = HELD) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term, added up within tasks; a term can have several rows."""

    def rows(groups: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in groups.items():
            found = [pa.array([x], pa.string()).take(pa.array(np.zeros(len(n), np.int32))) for x in (lang, source)]
            numbers = [pa.array(list(n.values()), pa.int64()), pa.array([docs[t] for t in n], pa.int64())]
            yield pa.RecordBatch.from_arrays([*found, terms.strings(list(n)), *numbers], ["lang", "source", "term", "n", "docs"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for batch in batches:
            names = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())
            for group, raw in zip(names, terms.raw_texts(batch, "text")):
                own: Counter = Counter()
                for words in terms.slices(raw, terms.LETTERS):
                    own.update(words)
                n, seen = groups.setdefault(group, (Counter(), Counter()))
                size -= len(n)
                n.update(own)
                seen.update(own.keys())
                size += len(n)
                if size > held:
                    yield from rows(groups)
                    groups, size = {}, 0
        yield from rows(groups)

    read = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"))], F.col(text).alias("text"))
    return read.mapInArrow(count, "lang string, source string, term string, n bigint, docs bigint")


def _share(count: str, total: str, kept: str) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + kept)); the product needs more than 64 bits."""
    return F.expr(f"1 + (cast({SCALE} as decimal(38,0)) * ({count} + 1)) div ({total} + {kept})")


def _f(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def _both(table: pa.Table) -> pa.Table:
    """Per ordered pair of sources that a bucket's terms share: their number, and the sum of the third bracket in two halves."""
    table = table.combine_chunks()
    codes = [table[c].combine_chunks().dictionary_encode() for c in ("term", "source")]
    codes = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in codes]
    term, source = (c.indices.to_numpy(zero_copy_only=False).astype(np.int64) for c in codes)
    order = np.argsort(term, kind="stable")
    source, p, p0, block = source[order], *(table[c].to_numpy()[order] for c in ("p", "p0", "own_block"))
    start, size = textnp.runs(term[order])
    width = len(codes[1].dictionary)
    same = table["block_a"][0].as_py() == table["block_b"][0].as_py()
    total = np.zeros((3, width * width), np.int64)
    ends = np.cumsum(size * size)
    a = 0
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS_AT_ONCE, "right")))
        rows = np.arange(start[a], start[b - 1] + size[b - 1])
        of = np.repeat(np.arange(a, b), size[a:b])
        left = np.repeat(rows, size[of])
        right = np.arange(len(left)) + np.repeat(start[of] - np.cumsum(size[of]) + size[of], size[of])
        ok = source[left] != source[right]
        if not same:
            ok &= block[left] != block[right]
        left, right = left[ok], right[ok]
        f = lambda x, y: (x - y) * (x - y) // y
        more = f(p[left], p[right]) - f(p[left], p0[right]) - f(p0[left], p[right])
        at = source[left] * width + source[right]
        for row, x in zip(total, (np.ones(len(at), np.int64), more >> 32, more & 0xFFFFFFFF)):
            np.add.at(row, at, x)
        a = b
    at = np.flatnonzero(total[0])
    names = [codes[1].dictionary.take(pa.array(x)) for x in (at // width, at % width)]
    lang = table["lang"].combine_chunks()[:1].take(pa.array(np.zeros(len(at), np.int32)))
    return pa.table([lang, *names, *(pa.array(row[at]) for row in total)], ["lang", "source", "item", "n_both", "high", "low"])


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, most_terms: int = MOST_TERMS,
          bucket_rows: int = BUCKET_ROWS, block_sources: int = BLOCK_SOURCES) -> DataFrame:
    """(lang, source, part, item, value, rank), see above."""
    by_term, dec = Window.partitionBy("lang", "term"), "decimal(38,0)"
    counts = count_terms(docs, text, lang, source).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = counts.withColumns({"in_docs": F.sum("docs").over(by_term), "total": F.sum("n").over(by_term), "head": F.row_number().over(by_term.orderBy("source"))})
    kept = shared.stored(counts.where(F.col("in_docs") >= least_docs).select("lang", "term", "source", "n", "total", (F.col("head") == 1).alias("head")))

    names = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"))]).distinct()
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("own"), F.count(F.lit(1)).alias("n_terms"), F.sum(F.col("head").cast("bigint")).alias("heads"))
    groups = names.join(sums, ["lang", "source"], "left").na.fill(0, ["own", "n_terms", "heads"])
    langs = groups.groupBy("lang").agg(F.sum("own").alias("all"), F.sum("heads").alias("v"), F.count(F.lit(1)).alias("sources"))
    groups = shared.cut(groups.join(langs, "lang").drop("heads"))
    p0 = F.when(F.col("v") > 0, _share("0", "own", "greatest(v, 1)")).otherwise(1)
    groups = groups.select("lang", "source", "own", "n_terms", "all", "v", "sources", p0.alias("p0"))
    sized = kept.join(shared.small(groups), ["lang", "source"])
    sized = sized.select("lang", "term", "source", "head", "v", "sources", "p0", _share("n", "own", "v").alias("p"), _share("total", "all", "v").alias("q"))

    ranks = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    told = sized.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _f("p", "q").alias("value"))
    told = told.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= most_terms)

    # terms of both sources: in buckets of terms and blocks of sources
    buckets = -(-kept.count() // bucket_rows) or 1
    blocks = F.call_function("div", F.col("sources") + (block_sources - 1), F.lit(block_sources))
    met = sized.select("lang", "term", "source", "p", "p0", F.pmod(F.xxhash64("term"), F.lit(buckets)).alias("bucket"), F.pmod(F.xxhash64("source"), blocks).alias("own_block"), blocks.alias("blocks"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    met = met.withColumns({"block_a": F.least("own_block", "other"), "block_b": F.greatest("own_block", "other")}).drop("other", "blocks")
    both = met.groupBy("lang", "bucket", "block_a", "block_b").applyInArrow(_both, "lang string, source string, item string, n_both bigint, high bigint, low bigint")
    exact = F.sum(F.col("high").cast(dec)) * F.lit(1 << 32) + F.sum(F.col("low").cast(dec))
    both = both.groupBy("lang", "source", "item").agg(F.sum("n_both").alias("n_both"), exact.cast(dec).alias("of_both"))

    # terms of one source, against what the other gives a term without occurrences
    ones = shared.cut(sized.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("h")))
    other = shared.small(groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0")))
    summed = lambda p, q: F.sum(F.col("h").cast(dec) * _f(p, q)).cast(dec)
    apart = ones.join(other, "lang").where("source <> item").groupBy("lang", "source", "item").agg(summed("p", "q0").alias("of_own"), summed("q0", "p").alias("of_other"))
    own = apart.select("lang", "source", "item", "of_own")
    theirs = apart.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "of_other")

    pairs = groups.join(shared.small(groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), F.col("n_terms").alias("m_terms"))), "lang").where("source <> item")
    for part in (both, own, theirs):
        pairs = pairs.join(part, ["lang", "source", "item"], "left")
    pairs = pairs.na.fill(0, ["n_both"])
    rest = (F.col("v") - F.col("n_terms") - F.col("m_terms") + F.col("n_both")).cast(dec) * _f("p0", "q0")
    value = rest + sum(F.coalesce(F.col(c), F.lit(0).cast(dec)) for c in ("of_both", "of_own", "of_other"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.when(F.col("v") > 0, value).otherwise(0).cast("bigint").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(ranks))
    return pairs.unionByName(told)
