"""From raw documents to packed training windows: five stages over whole tables.

Each stage reads what its predecessor wrote. The first one numbers the rows,
and all decide row by row: other rows with the same doc_id, or without one, are
not touched. Of rows that repeat one stays; of copies the one with the smallest
doc_id does, and one without an id only where no copy has one. Null and empty
texts go in the first stage, as texts without a letter do. A null source is a
source of its own. Further columns stay as they are up to the last stage. An
empty table gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchloom.llm import decontaminate, exact_dedup, langid, packing, simhash
from sketchloom.llm.common import documents, id_or_last, stored, word_tokenizer_path
from sketchloom.session import ship

ROW = "pipeline_row"
#: Rows of a batch that goes to Python: three tasks of an executor hold one in the JVM and one in their worker.
BATCH = 1000


def small_batches(spark: SparkSession) -> SparkSession:
    """spark with the package at its executors, and with batches of at most BATCH rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH:
        spark.conf.set(name, str(BATCH))
    return ship(spark)


def numbered(docs: DataFrame) -> DataFrame:
    """docs with a stored unique number of each row."""
    return docs if ROW in docs.columns else stored(docs.withColumn(ROW, F.monotonically_increasing_id()))


def by_row(docs: DataFrame) -> DataFrame:
    """docs with the row's number in place of its doc_id, for the operators."""
    return docs.withColumn("doc_id", F.col(ROW))


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows of docs whose number is not among the dropped ones."""
    return docs.join(stored(dropped.select(ROW).distinct()), ROW, "left_anti").select(docs.columns)


def later(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Of the rows of each class (doc_id: a row's number, class), all but the one with the smallest doc_id; null ids come last."""
    rows = docs.select(ROW, id_or_last("doc_id").alias("id")).join(classes.select(F.col("doc_id").alias(ROW), "class"), ROW)
    first = rows.groupBy("class").agg(F.min(F.struct("id", ROW))[ROW].alias(ROW))
    return rows.select(ROW).join(first, ROW, "left_anti")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts in which no language is found, and numbers the rows that stay."""
    kept = langid.in_a_language(docs, langid.train(docs))
    return kept if ROW in docs.columns else kept.withColumn(ROW, F.monotonically_increasing_id())


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, keeps the one with the smallest doc_id."""
    docs = numbered(docs)
    copies = stored(exact_dedup.dedup(by_row(docs)).where("group_size > 1").select("doc_id", F.col("keep_id").alias("class")))
    return without(docs, later(docs, copies))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked fingerprints, keeps the document with the smallest doc_id."""
    docs = numbered(docs)
    linked = stored(simhash.near_dedup(by_row(docs)).select("doc_id", F.col("component_id").alias("class")))
    return without(docs, later(docs, linked))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a test item."""
    docs = numbered(docs)
    found = decontaminate.leaks(by_row(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without(docs, found.select(F.col("doc_id").alias(ROW)))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents that are left, in windows of 4096 tokens."""
    return packing.pack(docs, word_tokenizer_path())


STAGES = [
    ("language_id", lambda spark, docs, sf_dir: language_id(small_batches(spark), docs, sf_dir)),
    ("exact_dedup", lambda spark, docs, sf_dir: exact(small_batches(spark), docs, sf_dir)),
    ("near_dedup", lambda spark, docs, sf_dir: near(small_batches(spark), docs, sf_dir)),
    ("decontaminate", lambda spark, docs, sf_dir: clean(small_batches(spark), docs, sf_dir)),
    ("packing", lambda spark, docs, sf_dir: packed(small_batches(spark), docs, sf_dir)),
]

#: Language scores, SimHash, BM25 and token ids are beyond SQL; tests/llm checks the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents below sf_dir, each written as Parquet and read by the next."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
