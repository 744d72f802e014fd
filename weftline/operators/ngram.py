"""Next-event and duration models by counting (E1-E6). The n-grams of a request start with START padding; END is left out.

Up to ``PACKED`` tokens fit in one number of 63 bits; then n-grams are counted and looked up by that number, not by an array.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from weftline.operators import util


def _grams(seqs: DataFrame, n: int, *keep: str) -> DataFrame:
    """(keep, pos, context, word) of each n-gram; the places are exploded first, so the rest stays in generated code."""
    padded = F.concat(F.array_repeat(F.lit(2), n - 2), F.slice(F.col("call"), F.lit(1), F.greatest(F.size("call") - 1, F.lit(0))))
    rows = seqs.select(*keep, padded.alias("__s")).where(F.size("__s") >= n)
    rows = rows.select(*keep, "__s", F.explode(F.sequence(F.lit(1), F.size("__s") - (n - 1))).alias("pos"))
    return rows.select(*keep, "pos", F.slice("__s", F.col("pos"), n - 1).alias("context"), F.get("__s", F.col("pos") + n - 2).alias("word"))


#: Longest n-grams that are packed, at 63 // n bits a token.
PACKED = 3
#: Most n-grams that are sent to every task, at 16 bytes each.
SENT = 2_000_000
#: Tokens of sequences that a task looks up at once.
_AT_ONCE = 1 << 18


def _pack(tokens: list[Column], n: int) -> Column:
    """One number for n tokens that fit."""
    out = F.lit(0).cast("bigint")
    for t in tokens:
        out = F.shiftleft(out, 63 // n).bitwiseOR(t.cast("bigint"))
    return out


def _windows(calls: pa.ListArray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the n-grams of all requests of a column, one after the other: their numbers and whether a token doesn't fit; and how many each request has."""
    bits, pad = 63 // n, n - 2
    offsets = calls.offsets.to_numpy().astype(np.int64)
    sizes = np.maximum(np.diff(offsets) - 1, 0)  # without END
    own = calls.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    inner = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    begin = np.cumsum(sizes + pad) - sizes - pad
    s = np.full(int((sizes + pad).sum()), 2, np.int64)
    s[np.repeat(begin + pad, sizes) + inner] = own[np.repeat(offsets[:-1] - offsets[0], sizes) + inner]
    bad = (s < 0) | (s >= 1 << bits)
    m = np.maximum(sizes + pad - (n - 1), 0)
    at = np.repeat(begin - np.cumsum(m) + m, m) + np.arange(m.sum())
    g, odd = np.zeros(len(at), np.int64), np.zeros(len(at), bool)
    for j in range(n):
        g = (g << bits) | s[at + j]
        odd |= bad[at + j]
    return g, odd, m


def _slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Rows whose lists together have about _AT_ONCE items."""
    for batch in batches:
        ends = np.cumsum(np.diff(batch.column(column).offsets.to_numpy()))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _AT_ONCE, "right")))
            yield batch.slice(at, to - at)
            at = to


def _calls(seqs: DataFrame, *keep: str) -> DataFrame:
    return seqs.select(*keep, F.coalesce("call", F.array().cast("array<int>")).alias("__call"))


def _counted(seqs: DataFrame, n: int) -> DataFrame:
    """(context, word, c): a task counts the n-grams of some requests at once, by their numbers."""
    bits = 63 // n

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, "__call"):
            g, odd, _ = _windows(batch.column("__call"), n)
            if odd.any():
                raise ValueError(f"tokens beyond {bits} bits: use packed=False")
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.unique(g, return_counts=True)], ["g", "c"])

    counts = _calls(seqs).mapInArrow(count, "g bigint, c bigint").groupBy("g").agg(F.sum("c").alias("c"))
    token = lambda j: F.shiftright("g", bits * (n - 1 - j)).bitwiseAND(F.lit((1 << bits) - 1).cast("bigint")).cast("int")
    return counts.select(F.array(*[token(j) for j in range(n - 1)]).alias("context"), token(n - 1).alias("word"), "c")


def _place() -> Column:
    # one number, not a struct: only a buffer of fixed size lets the partial counts be hashed instead of sorted
    return (F.col("rn").cast("decimal(20,0)") * F.lit(10**12).cast("decimal(13,0)") + F.col("pos")).cast("decimal(38,0)")


def ngram_count(seqs: DataFrame, n: int, max_sample: int | None = None, with_first: bool = False, packed: bool | None = None) -> DataFrame:
    """(context, word, c, n): counts over the requests (rn, with max_sample only the first), and those of the context.

    with_first: also ``first``, where the word was first seen, as one number that orders by (rn, pos). packed: default up to PACKED tokens, without first.
    """
    kept = seqs if max_sample is None else seqs.where(F.col("rn") <= max_sample)
    keep = ["rn"] if with_first else []
    if not keep and (n <= PACKED if packed is None else packed):
        with util.small_batches(seqs.sparkSession):
            counts = util.cut(_counted(kept, n))
    else:
        counts = _grams(kept, n, *keep).groupBy("context", "word").agg(F.count(F.lit(1)).alias("c"), *[F.min(_place()).alias("first") for _ in keep])
    total = F.sum("c").over(Window.partitionBy("context"))  # a context has a row for each word of the vocabulary at most
    return counts.withColumn("n", total).select("context", "word", "c", "n", *(["first"] if with_first else []))


def ngram_predict(counts: DataFrame) -> DataFrame:
    """(context, prediction): the most frequent word; ties: the one seen first. counts: with_first."""
    return counts.groupBy("context").agg(F.min(F.struct((-F.col("c")).alias("c"), "first", "word")).alias("b")).select("context", F.col("b.word").alias("prediction"))


def ngram_accuracy(seqs: DataFrame, counts: DataFrame, n: int, by: str = "dataset") -> DataFrame:
    """(by, correct, total, accuracy); a context that wasn't seen counts as wrong. Test n-grams are counted before the join."""
    asked = _grams(seqs, n, by).groupBy(by, "context", "word").agg(F.count(F.lit(1)).alias("m"))
    hit = asked.join(ngram_predict(counts), "context", "left")
    out = hit.groupBy(by).agg(F.sum(F.when(F.col("prediction") == F.col("word"), F.col("m")).otherwise(0)).alias("correct"), F.sum("m").alias("total"))
    return out.withColumn("accuracy", F.col("correct") / F.col("total"))


def ngram_nll(seqs: DataFrame, counts: DataFrame, n: int, epsilon: float, keys: list[str], most: int = util.BROADCAST_ROWS) -> DataFrame:
    """(keys, word, m, nll): negative log-likelihood of the n-grams of a request, m of which are alike.

    If there are at most ``most`` counts, each n-gram looks its own up and no n-gram is shuffled; else the distinct ones of
    each request are joined to them.
    """
    counts = util.cut(counts.select("context", "word", (F.col("c") / F.col("n")).alias("share")))
    asked, known = _grams(seqs, n, *keys), util.bounded(counts, most)
    nll = (-F.log(F.coalesce(F.col("share"), F.lit(epsilon)))).alias("nll")
    if known is not counts:
        return asked.join(known, ["context", "word"], "left").select(*keys, "word", F.lit(1).cast("bigint").alias("m"), nll)
    asked = asked.groupBy(*keys, "context", "word").agg(F.count(F.lit(1)).alias("m"))
    return asked.join(known, ["context", "word"], "left").select(*keys, "word", "m", nll)


def event_score(token_nll: DataFrame, keys: list[str]) -> DataFrame:
    """E5: mean negative log-likelihood of each request."""
    return token_nll.groupBy(*keys).agg((F.sum(F.col("nll") * F.col("m")) / F.sum("m")).alias("event_score"))


def request_nll(seqs: DataFrame, counts: DataFrame, n: int, epsilon: float, keys: list[str], most: int = SENT, salts: int = 16) -> DataFrame:
    """(keys, nll, m): the sum of the negative log-likelihoods of a request's n-grams, and how many they are.

    If there are at most ``most`` counts and their tokens fit, they are sent as two sorted arrays (number of the n-gram, share), and a task looks the n-grams of whole requests up
    without making a row of any. Beyond that the distinct n-grams of each request are joined to them; the contexts of START padding, which every
    request asks for, are dealt out by ``salts``.
    """
    counts = util.cut(counts.select("context", "word", (F.col("c") / F.col("n")).alias("share")))
    top = counts.agg(F.max(F.greatest(F.array_max("context"), F.col("word")))).first()[0] if n <= PACKED and counts.limit(most + 1).count() <= most else None
    if top is None or top >= 1 << 63 // n:
        starts = F.get("context", F.lit(0)) == 2
        asked = _grams(seqs, n, *keys).groupBy(*keys, "context", "word").agg(F.count(F.lit(1)).alias("m"))
        asked = asked.withColumn("__salt", F.when(starts, F.pmod(F.xxhash64(*keys), F.lit(salts)).cast("int")).otherwise(0))
        known = counts.withColumn("__salt", F.explode(F.when(starts, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
        found = asked.join(known, ["context", "word", "__salt"], "left").withColumn("nll", -F.log(F.coalesce(F.col("share"), F.lit(epsilon))))
        return found.groupBy(*keys).agg(F.sum(F.col("nll") * F.col("m")).alias("nll"), F.sum("m").alias("m"))
    tokens = [F.get("context", F.lit(j)) for j in range(n - 1)] + [F.col("word")]
    table = counts.select(_pack(tokens, n).alias("g"), "share").toArrow()  # at most ``most`` rows
    order = np.argsort(table["g"].to_numpy())
    sent = seqs.sparkSession.sparkContext.broadcast((table["g"].to_numpy()[order], -np.log(table["share"].to_numpy()[order])))
    unseen = float(-np.log(epsilon))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, nll = sent.value
        for batch in _slices(batches, "__call"):
            g, odd, m = _windows(batch.column("__call"), n)
            k = np.minimum(np.searchsorted(grams, g), len(grams) - 1)
            cost = np.where((grams[k] == g) & ~odd, nll[k], unseen)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.bincount(np.repeat(np.arange(len(m)), m), cost, len(m))), pa.array(m)], [*keys, "nll", "m"])

    rows = _calls(seqs, *keys)
    kinds = StructType([*(rows.schema[k] for k in keys), StructField("nll", DoubleType()), StructField("m", LongType())])
    with util.small_batches(seqs.sparkSession):
        return util.cut(rows.mapInArrow(score, kinds).where("m > 0").groupBy(*keys).agg(F.sum("nll").alias("nll"), F.sum("m").alias("m")))


def ngram_perplexity(seqs: DataFrame, counts: DataFrame, n: int, epsilon: float, keys: list[str], most: int = SENT) -> DataFrame:
    """(keys, perplexity), to nine digits, so that equal requests tie in whatever order their terms were added."""
    return request_nll(seqs, counts, n, epsilon, keys, most).select(*keys, F.round(F.exp(F.col("nll") / F.col("m")), 9).alias("perplexity"))


def _tagged(seqs: DataFrame, *keep: str) -> DataFrame:
    """Each position with a tag: the call, the call before it, the tag."""
    rows = seqs.select(*keep, F.explode(F.transform(F.sequence(F.lit(2), F.size("call") - 1), lambda i: F.struct(F.get("call", i - 2).alias("before"), F.get("call", i - 1).alias("own"), F.get("tag", i - 1).alias("tag")))).alias("t"))
    return rows.select(*keep, "t.before", "t.own", "t.tag").where("tag <> 0")


def duration_score(seqs: DataFrame, train: DataFrame, n_category: int, keys: list[str]) -> DataFrame:
    """(keys, duration_score) from P(tag | call before, call) of the train requests; ``tag`` is an array<int> beside call."""
    counts = _tagged(train).groupBy("before", "own", "tag").agg(F.count(F.lit(1)).alias("c"))
    counts = counts.join(counts.groupBy("before", "own").agg(F.sum("c").alias("n")), ["before", "own"])
    asked = _tagged(seqs, *keys).groupBy(*keys, "before", "own", "tag").agg(F.count(F.lit(1)).alias("m"))
    nll = asked.join(counts, ["before", "own", "tag"], "left").withColumn("nll", -F.log(F.coalesce(F.col("c") / F.col("n"), F.lit(1.0 / n_category))))
    scored = nll.groupBy(*keys).agg((F.sum(F.col("nll") * F.col("m")) / (F.sum("m") + 1e-8)).alias("duration_score"))
    return seqs.select(*keys).join(scored, keys, "left").select(*keys, F.coalesce("duration_score", F.lit(0.0)).alias("duration_score"))
