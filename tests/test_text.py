"""Wrapping and white space against Python's own functions."""

import random
import textwrap

from pyspark.sql import functions as F

import __spark_entry__ as entry
from sketchloom.functions import text as tx

PARTS = [*"ab-  \n\tß", "longword" * 3, "x" * 31, " " * 6]


def wrapped(label, width):
    return textwrap.wrap(label, width=width, break_long_words=True, break_on_hyphens=False) or [""]


def test_wrap(spark):
    rng = random.Random(1)
    labels = ["", " ", "\t", " " * 40, *("".join(rng.choices(PARTS, k=rng.randrange(30))) for _ in range(2000))]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(labels)], "i long, label string")
    for width in (5, 30):
        got = {r["i"]: r["lines"] for r in rows.select("i", tx.wrap(F.col("label"), width).alias("lines")).collect()}
        assert [(x, got[i]) for i, x in enumerate(labels) if got[i] != wrapped(x, width)] == []


def test_strip_and_quote(spark):
    rows = spark.createDataFrame([("  a b\x0b\n",), ("",), ('q"\\\n',)], "t string")
    got = rows.select(tx.strip(F.col("t")).alias("s"), tx.quoted(F.col("t")).alias("q"), tx.one_line(F.col("t")).alias("o")).collect()
    assert [r["s"] for r in got] == ["a b", "", 'q"\\']
    assert got[2]["q"] == '"q\\"\\\\\\n"'
    assert got[2]["o"] == 'q"\\'


def test_label_wrap_wraps_whole_texts(spark, tmp_path):
    rng = random.Random(3)
    texts = [None, "", "\t", " " * 99, "x" * 5000, " ".join(["word"] * 20_000), "a" * 40 + "\xa0" * 70 + "b", *("".join(rng.choices([*PARTS, "\xa0"], k=rng.randrange(200))) for _ in range(500))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["n_lines"], r["wrapped"]) for r in entry.queries()["label_wrap"](spark, str(tmp_path)).collect()}
    for i, x in enumerate(texts):
        assert got[i] == ((None, None) if x is None else (len(wrapped(x, 30)), "\n".join(wrapped(x, 30))))
