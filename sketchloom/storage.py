"""Tables between the steps of a job."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors share; a local folder only where the session is local and it is unset, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


#: Lists of paths, one for each open scope.
_open: list[list[str]] = []


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables kept inside are dropped at the end; results have to be written or collected before."""
    made: list[str] = []
    _open.append(made)
    try:
        yield
    finally:
        _open.remove(made)
        context = spark.sparkContext
        for path in map(context._jvm.org.apache.hadoop.fs.Path, made):
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def kept(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder and read from there by all that use it; a scope drops it."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of a table's files for each part of a shuffle of what is made from it, so that a task holds no more from a larger table.
PART = 2 << 20


def parts_of(spark: SparkSession, path: str) -> None:
    """Shuffles get as many parts as keep a part's size, whatever that of the table at path; a session that has more keeps them."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    size = place.getFileSystem(context._jsc.hadoopConfiguration()).getContentSummary(place).getLength()
    parts = -(-size // PART)
    if parts > int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))


def dealt(rows: DataFrame) -> DataFrame:
    """rows with those of a diagram in one part, in as many parts as the session's shuffles have; joins by (diagram_id, ...) then find them where they lie."""
    conf = rows.sparkSession.conf
    conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return rows.repartition(int(conf.get("spark.sql.shuffle.partitions")), "diagram_id")
