"""The registered queries of the thirteen operators: each applies its operator to its whole table and returns the contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import bpe, chat_quotes, decontaminate, html_extract, lexical_search, line_dedup, oracles, pii, quality, simhash, source_audit, stages, substring_dedup, url_filters, vector_dedup
from weftline.llm.shared import read


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(read(spark, sf_dir, "pages"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_quotes.link(read(spark, sf_dir, "conversations"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.repeats(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", "removed", F.sha2("text", 256).alias("kept_sha256"))


def op6_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the key in spark.weftline.pii.key; where none is set (tests) with one that hides nothing from a reader of this file."""
    return pii.pseudonymise(read(spark, sf_dir, "documents"), spark.conf.get("spark.weftline.pii.key", "a key for tests only"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = simhash.link(simhash.fingerprints(read(spark, sf_dir, "documents")))
    return linked.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    return quality.judge(docs, model).drop("score")


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    found = html_extract.extract(pages.select(F.struct("page_id", "url").alias("k"), "html"), html_extract.default_model(spark), key="k")
    return found.select("k.page_id", "k.url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"), bpe.public_path("byte_bpe_50k.json"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical_search.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")


def op12_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.link(read(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.run(spark, sf_dir)


def queries() -> dict:
    named = [op1_url_filters, op2_decontamination, op3_quotation_links, op4_substring_dedup, op5_line_dedup, op6_pseudonyms, op7_simhash, op8_quality, op9_main_text, op10_bpe, op11_lexical_search, op12_vector_dedup, op13_source_audit, pipeline]
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filters": url_filters.oracle(), "op2_decontamination": oracles.DECONTAMINATION, "op4_substring_dedup": oracles.SUBSTRINGS,
            "op11_lexical_search": oracles.LEXICAL_SEARCH, "op12_vector_dedup": oracles.VECTOR_DEDUP, "op13_source_audit": oracles.SOURCE_AUDIT}
