"""Exact histogram of encoded lengths and the suffix sums over it.

Documents are encoded where they lie; only (length, count) pairs are shuffled.
For each context limit L that occurs as a length the result answers: how many
documents and tokens there are at L or above, the documents' total when cut
at L, and the share of documents that fit. Any other limit falls between two
rows: truncated_total(L) = tokens_below + L * docs_from of the next row.

Null texts count as empty, with 0 tokens. No documents give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, token_bytes, whole_text

#: Lengths in one block of the two-level sums.
BLOCK = 1024


def lengths(docs: DataFrame, tokenizer: str) -> DataFrame:
    """n_tokens of every whole text."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = token_bytes(tokenizer)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(memo.of(x.as_py())) // 4 for x in batch.column(0)], pa.int64())], ["n_tokens"])

    return docs.select(whole_text("text").alias("text")).mapInArrow(encode, "n_tokens long")


def histogram(docs: DataFrame, tokenizer: str) -> DataFrame:
    return lengths(docs, tokenizer).groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_sums(counts: DataFrame) -> DataFrame:
    """Sums from each length on, by blocks of lengths so that no window holds all of them."""
    counts = counts.withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    blocks = counts.groupBy("block").agg(F.sum("n_docs").alias("b_docs"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("b_tokens"))
    coarse = blocks.withColumn("coarse", F.floor(F.col("block") / BLOCK))
    tops = coarse.groupBy("coarse").agg(F.sum("b_docs").alias("c_docs"), F.sum("b_tokens").alias("c_tokens"))
    above = Window.orderBy(F.desc("coarse")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each 2**20 tokens of the longest text
    whole = Window.partitionBy()
    tops = tops.select(
        "coarse",
        *(F.coalesce(F.sum(f"c_{k}").over(above), F.lit(0)).alias(f"over_{k}") for k in ("docs", "tokens")),
        *(F.sum(f"c_{k}").over(whole).alias(f"all_{k}") for k in ("docs", "tokens")),
    )
    after = Window.partitionBy("coarse").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = coarse.join(tops, "coarse").select("block", "all_docs", "all_tokens", *((F.coalesce(F.sum(f"b_{k}").over(after), F.lit(0)) + F.col(f"over_{k}")).alias(f"later_{k}") for k in ("docs", "tokens")))
    within = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    return counts.join(blocks, "block").select(
        "n_tokens",
        "n_docs",
        (F.sum("n_docs").over(within) + F.col("later_docs")).alias("docs_from"),
        (F.sum(F.col("n_docs") * F.col("n_tokens")).over(within) + F.col("later_tokens")).alias("tokens_from"),
        "all_docs",
        "all_tokens",
    )


def length_report(docs: DataFrame, tokenizer: str) -> DataFrame:
    """n_tokens, n_docs, docs_from, tokens_from, truncated_total, quantile."""
    return suffix_sums(stored(histogram(docs, tokenizer))).select(
        "n_tokens",
        "n_docs",
        "docs_from",
        "tokens_from",
        (F.col("all_tokens") - F.col("tokens_from") + F.col("docs_from") * F.col("n_tokens")).alias("truncated_total"),
        ((F.col("all_docs") - F.col("docs_from") + F.col("n_docs")) / F.col("all_docs")).alias("quantile"),
    )
