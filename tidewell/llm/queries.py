"""The opN_<name> queries: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import bpe, chat_format, decontaminate, quality, simhash, suffix_index, token_counts, unit_dedup, url_filter, vector_dedup
from tidewell.llm.common import table


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return unit_dedup.unit_dedup(docs)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary())


#: The rules that the url query is to apply.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, RULES, url_filter.UrlModel(url_filter.labelled_table(spark)))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_index.without_repeats(table(spark, sf_dir, "documents")).drop("spans")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.chat_format(table(spark, sf_dir, "conversations"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.vector_groups(table(spark, sf_dir, "embeddings"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_round_trip(table(spark, sf_dir, "documents"), vocabulary())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_token_counts": op2_token_counts,
        "op3_url_filter": op3_url_filter,
        "op4_suffix_dedup": op4_suffix_dedup,
        "op5_quality_classifier": op5_quality_classifier,
        "op6_chat_format": op6_chat_format,
        "op7_benchmark_decontamination": op7_benchmark_decontamination,
        "op8_embedding_near_dedup": op8_embedding_near_dedup,
        "op9_simhash_near_dedup": op9_simhash_near_dedup,
        "op10_bpe": op10_bpe,
    }


def oracle_sql() -> dict[str, str]:
    return {}
