"""Files in and out: request texts, expected graphs, markers, artifacts, JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.attempts import extension
from ..operators.evaluate import evaluated, report

GRAPH_SCHEMA = (
    "title string, diagram_type string, orientation string, "
    "nodes array<struct<id:string,type:string,label:string,parent_id:string,reference_number:string,notes:string,x:double,y:double,width:double,height:double>>, "
    "edges array<struct<id:string,source:string,target:string,relation:string,direction:string,label:string,style:string>>"
)


def stem(name: str = "_metadata.file_name", suffix: str = r"\.[^.]*$"):
    return F.regexp_replace(F.url_decode(F.col(name)), suffix, "")


def read_requests(spark: SparkSession, folder: str) -> DataFrame:
    """case_id, text: every *.txt whole; order by case_id for the order of names."""
    rows = spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
    return rows.select(stem(suffix=r"\.txt$").alias("case_id"), F.col("value").alias("text"))


def read_expected(spark: SparkSession, folder: str) -> DataFrame:
    """case_id and the declared columns of each reviewed graph (*.json, error markers apart)."""
    rows = spark.read.schema(GRAPH_SCHEMA).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
    return rows.select(stem(suffix=r"\.json$").alias("case_id"), "*").where(~F.col("case_id").endswith(".error"))


def read_error_marks(spark: SparkSession, folder: str) -> DataFrame:
    """case_id of each case that has a <case>.error.json."""
    rows = spark.read.option("pathGlobFilter", "*.error.json").text(folder, wholetext=True)
    return rows.select(stem(suffix=r"\.error\.json$").alias("case_id"))


def read_positions(spark: SparkSession, folder: str) -> DataFrame:
    """diagram_id, pos, line of positioned texts (*.plain)."""
    rows = spark.read.option("pathGlobFilter", "*.plain").text(folder, wholetext=True)
    return rows.select(stem().alias("diagram_id"), F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line"))


def read_artifacts(spark: SparkSession, folder: str) -> DataFrame:
    """path (below the folder) and sha256 of every file in it and below."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    root = folder.rstrip("/").replace("file://", "")
    path = F.regexp_replace(F.url_decode(F.col("path")), "^[a-z]+:/*", "/")
    return rows.select(F.substring(path, F.lit(len(root) + 2), F.length(path)).alias("path"), F.sha2("content", 256).alias("sha256"))


def write_documents(df: DataFrame, folder: str, column: str = "document", keep_nulls: bool = True) -> None:
    """One JSON document for each row, keys in alphabetical order; a folder that holds data is refused."""
    out = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": str(not keep_nulls).lower()}).alias(column)
    df.select(out).write.mode("errorifexists").text(folder)


def write_responses(responses: DataFrame, folder: str) -> None:
    """Raw responses by whether they parse as JSON: folders ext=json and ext=txt."""
    responses.select("run_id", "attempt_no", "content", extension(F.col("content")).alias("ext")).write.mode("errorifexists").partitionBy("ext").parquet(folder)


def is_below(path: str, folder: str) -> bool:
    """Whether a path lies in a folder or is the folder."""
    return f"{path.rstrip('/')}/".startswith(f"{folder.rstrip('/')}/")


def evaluate_folders(spark: SparkSession, texts: str, expected: str, answers: DataFrame, output: str) -> DataFrame:
    """Reads the requests (texts), the reviewed graphs and error markers (expected), compares the answers with them and writes graphs, cases and differences below output; returns the report.

    The output must not lie below the reviewed graphs, and must hold nothing yet.
    """
    if is_below(output, expected):
        raise ValueError("the output must not lie below the reviewed graphs")
    cases, differences, documents = evaluated(read_requests(spark, texts), read_expected(spark, expected), read_error_marks(spark, expected), answers)
    documents.write.mode("errorifexists").json(f"{output}/graphs")
    cases.write.mode("errorifexists").parquet(f"{output}/cases")
    differences.write.mode("errorifexists").parquet(f"{output}/differences")
    return report(spark.read.parquet(f"{output}/cases"))
