"""Responses judged as their files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.attempts import extension, judged

RESPONSE = "run_id string, attempt_no int, content string, request_id string, elapsed_ms double"


def arriving(spark: SparkSession, folder: str, files_at_once: int = 1_000) -> DataFrame:
    """A stream of the attempts in a folder of JSON lines."""
    return spark.readStream.schema(RESPONSE).option("maxFilesPerTrigger", files_at_once).json(folder)


def judge_stream(attempts: DataFrame, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append each attempt once, with its decode, judgement and extension, as Parquet below epoch=N.

    Judging looks at one attempt alone, so the stream keeps no state; choosing
    between attempts is a batch job over the folder. A batch that runs again
    after a failure overwrites its own epoch.
    """

    def judge(rows: DataFrame, epoch: int) -> None:
        out = judged(rows).withColumn("ext", extension(F.col("content"))).drop("graph")
        out.write.mode("overwrite").partitionBy("ext").parquet(f"{folder}/epoch={epoch}")

    return attempts.writeStream.foreachBatch(judge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
