"""Session settings, and the package's way to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark import SparkConf
from pyspark.sql import SparkSession


def session(name: str = "sketchloom", cpus: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs expect; what is set already (spark-submit, a cluster's defaults) stays.

    cpus: run locally on so many. Without it, and without a master from outside, all local ones.
    """
    given = SparkConf()
    settings = {
        "spark.master": f"local[{cpus or '*'}]",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if given.get("spark.master", settings["spark.master"]).startswith("local"):
        settings["spark.sql.shuffle.partitions"] = "8"
    builder = SparkSession.builder.appName(name)
    for key, value in ({k: v for k, v in settings.items() if not given.contains(k)} | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once for each application."""
    context = spark.sparkContext
    if not getattr(context, "_sketchloom_sent", False):
        top = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="sketchloom-"), "sketchloom.zip")
        with zipfile.ZipFile(path, "w") as out:
            for folder, _, names in os.walk(top):
                for name in names:
                    if name.endswith(".py"):
                        file = os.path.join(folder, name)
                        out.write(file, os.path.relpath(file, os.path.dirname(top)))
        context.addPyFile(path)
        context._sketchloom_sent = True
    return spark
