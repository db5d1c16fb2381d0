"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from stackline.llm import decontaminate, fill_middle, html_labeller, ngram_join, packing, quality_rules, secret_scan, sharding, substring_dedup, token_counts, url_filter, vector_codes, warc
from stackline.llm import sql as oracle
from stackline.llm.staging import bounded_batches

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_report(_table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(secret_scan.scan(_table(spark, sf_dir, "documents")))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(_table(spark, sf_dir, "pages"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.document_components(_table(spark, sf_dir, "documents"))


def op5_ngram_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The join with each document's number of links, which the SQL of ``op5_ngram_join`` has no column for."""
    return ngram_join.document_components(_table(spark, sf_dir, "documents"), links=True)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), TOKENIZER, kept=500_000)  # its workers have room that those of the pipeline lack


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    out = sharding.shard(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_labeller.extract(_table(spark, sf_dir, "pages"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.section_tokens(_table(spark, sf_dir, "documents"), TOKENIZER)


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(_table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(_table(spark, sf_dir, "embeddings"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_url_filter, op3_secret_scan, op4_warc, op5_ngram_join, op5_ngram_links, op6_best_fit_packing, op7_sharding, op8_html_text, op9_decontamination, op10_token_counts, op11_substring_dedup, op12_vector_codes, op13_fill_middle)}


def oracle_sql() -> dict[str, str]:
    return {"op5_ngram_join": oracle.NGRAM_JOIN, "op4_warc": oracle.WARC, "op1_quality_rules": oracle.QUALITY_RULES, "op2_url_filter": url_filter.sql(), "op9_decontamination": oracle.DECONTAMINATION, "op11_substring_dedup": substring_dedup.SQL, "op12_vector_codes": vector_codes.sql(), "op13_fill_middle": fill_middle.SQL}
