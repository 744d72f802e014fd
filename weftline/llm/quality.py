"""Quality rules: base counts of every document, and a hashed n-gram log-likelihood ratio.

Method. Word n-grams (n = 1, 2) are hashed into ``2**bits`` bins. Two multinomials are estimated over the bins with
add-``alpha`` smoothing: the raw corpus from all n-grams of all documents, the trusted target from labelled documents
(quality 1, not toxic). A document's score is the mean over its n-grams of ``ln p_target - ln p_raw``, and it is kept
when the score reaches a threshold that is fitted once, on the labelled documents, and then holds for every document. For
that fit each labelled document is scored by the target of the other half of the labels, as its own words would praise it.

Bounds: the labelled documents are the ``sample`` label rows with the smallest hash of their id (a documented bound, so
that side can be broadcast). The number of bins grows with the bytes of the corpus, so n-grams do not crowd in them, up to
``2**MOST_BITS``, as the model of 32 MB is then sent to every task. The raw counts come from the whole corpus.

Defined cases: a null text counts as empty (no words, base rule fails); labels that are null, contradictory (any row
says bad) or without a document are not used; without usable labels of both kinds the ratio decides nothing and every
document that passes the base rule is kept; repeated rows give repeated results and count twice in the corpus; extra
columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import shared, textnp

#: Bins are a power of two, one for about so many bytes of the corpus, between these.
BYTES_A_BIN, LEAST_BITS, MOST_BITS = 1_024, 17, 22
SAMPLE = 20_000
ALPHA = 0.5
#: Share of the labelled good documents (quality 1 and not toxic) that the fitted threshold must keep.
KEEP_GOOD = 0.995
MIN_WORDS = 10
#: In percent of the words.
MOST_REPEATED = 20
REPEAT_WINDOW = 5
SYMBOLS = "#*$%&|<>"

_IS_SYMBOL = np.zeros(256, dtype=bool)
_IS_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_BLANK = b" \t\n\r\x0b\x0c"
_FILTER = 1 << 21


@dataclass(frozen=True)
class Model:
    """Log ratio of each bin, and the least score of a kept document (None: no labels, all are kept)."""

    bits: int
    ratio: np.ndarray
    threshold: float | None


def _bins(chunk: textnp.Chunk, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and row of every n-gram of a chunk."""
    one = chunk.word_hash()
    two, at = chunk.windows(one, 2)
    shift = np.uint64(64 - bits)
    return np.concatenate([one >> shift, two >> shift]).astype(np.int64), np.concatenate([chunk.doc, chunk.doc[at]])


def _counts(docs: DataFrame, text: str, bits: int) -> np.ndarray:
    return shared.bin_counts(docs, text, bits, lambda chunk: _bins(chunk, bits)[0])


def scores_of(chunk: textnp.Chunk, model: Model) -> np.ndarray:
    bins, row = _bins(chunk, model.bits)
    n = np.bincount(row, minlength=chunk.rows)
    return np.bincount(row, weights=model.ratio[bins], minlength=chunk.rows) / np.maximum(n, 1)


def _threshold(scores: np.ndarray, good: np.ndarray) -> float | None:
    """The cut with the largest difference of the shares kept of good and of bad documents that keeps KEEP_GOOD of the good ones; ties: the least."""
    if good.all() or not good.any():
        return None
    cuts = np.unique(scores)
    kept_good = 1 - np.searchsorted(np.sort(scores[good]), cuts, "left") / good.sum()
    kept_bad = 1 - np.searchsorted(np.sort(scores[~good]), cuts, "left") / (~good).sum()
    allowed = kept_good >= KEEP_GOOD
    cuts, gain = cuts[allowed], (kept_good - kept_bad)[allowed]
    best = int(np.argmax(gain))
    below = scores[scores < cuts[best]]
    return float((cuts[best] + below.max()) / 2) if len(below) else float(cuts[best])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", bits: int | None = None, sample: int = SAMPLE) -> Model:
    """Fit the two multinomials and the threshold; without bits their number follows the corpus."""
    if bits is None:
        size = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
        bits = min(MOST_BITS, max(LEAST_BITS, (size // BYTES_A_BIN).bit_length()))
    clean = labels.groupBy(F.col(key).alias("__key")).agg(F.min("quality").alias("__quality"), F.max("toxic").alias("__toxic")).where("__key is not null and __quality is not null")
    chosen = clean.orderBy(F.xxhash64("__key"), "__key").limit(sample)
    labelled = docs.select(F.col(key).alias("__id"), F.col(text).alias("__text")).join(F.broadcast(chosen), F.col("__id") == F.col("__key"))
    labelled = labelled.select("__text", (F.col("__quality") == 1).alias("__good"), (F.coalesce(F.col("__toxic"), F.lit(0)) != 0).alias("__toxic"), F.pmod(F.xxhash64("__key", F.lit(1)), F.lit(2)).cast("int").alias("__fold"))
    labelled = shared.cut(labelled)
    raw = _counts(docs, text, bits)
    folds = [_counts(labelled.where(f"__good and not __toxic and __fold = {k}"), "__text", bits) for k in (0, 1)]
    target = folds[0] + folds[1]
    part = lambda counts: np.log((counts + ALPHA) / (counts.sum() + ALPHA * len(counts)))
    ratio = part(target) - part(raw)
    if not folds[0].any() or not folds[1].any():
        return Model(bits, ratio, None)
    other = [(part(folds[1 - k]) - part(raw)).astype(np.float32) for k in (0, 1)]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in textnp.chunks(batches, "__text"):
            chunk.words()
            both = np.stack([scores_of(chunk, Model(bits, r, None)) for r in other])
            fold = chunk.batch.column(3).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(both[fold, np.arange(chunk.rows)]), pc.and_not(chunk.batch.column(1), chunk.batch.column(2)), pa.array(np.diff(chunk.first))], names=["score", "good", "n"])

    rows = labelled.mapInArrow(score, "score double, good boolean, n bigint").where("n > 0").select("score", "good").collect()  # at most `sample` ids
    return Model(bits, ratio, _threshold(np.array([r.score for r in rows]), np.array([r.good for r in rows], dtype=bool)))


def measure(chunk: textnp.Chunk) -> dict[str, np.ndarray]:
    """The base counts of every row of a chunk."""
    out = {"n_words": np.diff(chunk.first)}
    points = (chunk.data & 0xC0) != 0x80
    space = textnp._SPACE[chunk.data]
    out["word_chars"] = chunk.per_row(points & ~space, chunk.offsets)
    out["n_symbols"] = chunk.per_row(_IS_SYMBOL[chunk.data], chunk.offsets)
    raw, dup = chunk.data.tobytes(), np.zeros(chunk.rows, dtype=np.int64)
    for k, (a, b) in enumerate(zip(chunk.offsets[:-1], chunk.offsets[1:])):
        lines = raw[a:b].split(b"\n")
        if len(lines) > 1:
            lines = [x for x in lines if x.strip(_BLANK)]
            dup[k] = len(lines) - len(set(lines))
    out["n_dup_lines"] = dup
    covered = np.zeros(len(chunk.starts), dtype=bool)
    windows, at = chunk.windows(chunk.word_hash(), REPEAT_WINDOW)
    if len(windows):
        keyed = textnp.mix(windows + chunk.doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        slot = (keyed & np.uint64(_FILTER - 1)).astype(np.int64)
        some = np.flatnonzero(np.bincount(slot, minlength=_FILTER)[slot] > 1)
        _, inverse, n = np.unique(keyed[some], return_inverse=True, return_counts=True)
        hits = at[some[n[inverse] > 1]]
        for j in range(REPEAT_WINDOW):
            covered[hits + j] = True
    out["n_repeat_words"] = chunk.per_row(covered, chunk.first)
    return out


def judge(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, score, base_failed, kept) for every row."""
    rows = docs.select(key, F.col(text).alias("__text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in textnp.chunks(batches, "__text"):
            got = measure(chunk.words())
            scores = scores_of(chunk, model)
            failed = (got["n_words"] < MIN_WORDS) | (100 * got["n_repeat_words"] > MOST_REPEATED * got["n_words"])
            kept = ~failed if model.threshold is None else ~failed & (scores >= model.threshold)
            yield pa.RecordBatch.from_arrays([chunk.batch.column(0), *(pa.array(got[n].astype(np.int64)) for n in names), pa.array(scores), pa.array(failed), pa.array(kept)], names=[key, *names, "score", "base_failed", "kept"])

    longs = ", ".join(f"{n} bigint" for n in names)
    return rows.mapInArrow(run, f"`{key}` {rows.schema[0].dataType.simpleString()}, {longs}, score double, base_failed boolean, kept boolean")


def keep(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of docs, all columns, that ``judge`` keeps; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in textnp.chunks(batches, text):
            got = measure(chunk.words())
            kept = (got["n_words"] >= MIN_WORDS) & (100 * got["n_repeat_words"] <= MOST_REPEATED * got["n_words"])
            if model.threshold is not None:
                kept &= scores_of(chunk, model) >= model.threshold
            yield chunk.batch.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)
