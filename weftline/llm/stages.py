"""The stages of the corpus pipeline: five of the operators, from ``documents`` to token digests.

Each stage takes (spark, docs, sf_dir) and works on everything that the stage before kept. All but the last return the columns
of ``documents``: doc_id, text, lang, source, n_chars.

1. quality rules: documents that fail the base counts or the likelihood-ratio threshold go;
2. line dedup: later matches of a line go, and documents that have no word left go with them;
3. SimHash near-dedup: of each group of near copies (five-word shingles, similarity 0.8) the least doc_id stays;
4. benchmark decontamination: documents with an item of the benchmark go;
5. BPE encoding and decoding: the digests of ids and decoded text of what is left.

Null or repeated rows are treated as the operators' docstrings say; empty tables pass through.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import bpe, decontaminate, line_dedup, quality, shared, simhash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(docs, shared.read(spark, sf_dir, "labels"))
    return quality.keep(docs.select(*COLUMNS), model)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup(docs, carry=("lang", "source"))
    out = out.where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.select("doc_id", "text", "carried.lang", "carried.source", F.length("text").cast("bigint").alias("n_chars"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.dedup(docs.select(*COLUMNS))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs.select(*COLUMNS), shared.read(spark, sf_dir, "benchmark"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs, bpe.public_path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_deduplication),
    ("simhash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("bpe encoding and decoding", bpe_encoding),
]

def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """Apply the stages to documents; what each returns is written as Parquet, in the shared folder, and read again."""
    context = spark.sparkContext
    shared.checkpoint_folder(context)
    base = folder or f"{context.getCheckpointDir()}/corpus-pipeline-{os.urandom(6).hex()}"
    docs = shared.read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{base}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
