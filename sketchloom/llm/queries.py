"""The queries opN_<name> over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, exact_dedup, hard_negatives, langid, licenses, packing, pii, ranked_search, simhash, suffix_dedup, token_lengths, toxicity
from .common import documents, word_tokenizer_path


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(documents(spark, sf_dir))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digests(documents(spark, sf_dir))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(documents(spark, sf_dir))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return langid.identify(docs, langid.train(docs))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal_digests(documents(spark, sf_dir))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_digests(spark, spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_lengths.length_report(documents(spark, sf_dir), word_tokenizer_path())


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(documents(spark, sf_dir), word_tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hard_negatives.shifted_labels(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir)).drop("finds")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": op1_pii,
        "op2_exact_dedup": op2_exact_dedup,
        "op3_simhash": op3_simhash,
        "op4_language_id": op4_language_id,
        "op5_token_counts": op5_token_counts,
        "op6_suffix_dedup": op6_suffix_dedup,
        "op7_decontamination": op7_decontamination,
        "op8_chat_format": op8_chat_format,
        "op9_packing": op9_packing,
        "op10_toxicity": op10_toxicity,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_licenses": op12_licenses,
        "op13_ranked_search": op13_ranked_search,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": exact_dedup.ORACLE, "op8_chat_format": chat.ORACLE, "op11_hard_negatives": hard_negatives.ORACLE, "op12_licenses": licenses.oracle(), "op13_ranked_search": ranked_search.ORACLE}
