"""Connected components over links by alternating large-star and small-star steps (Kiveris et al. 2014).

Links stay a distributed table; hubs cost no more than their links, since each
step takes minima before the shuffle and joins on keys that Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def star(links: DataFrame, large: bool) -> DataFrame:
    """One step over distinct links (a < b): each node hands its larger (or smaller) neighbours its least one."""
    turned = links.select(F.col("b").alias("a"), F.col("a").alias("b"))
    both = links.unionByName(turned) if large else turned
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.join(least, "a")
    if large:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("m").alias("a"), "b")
    else:
        out = joined.where(F.col("b") != F.col("m")).select(F.col("m").alias("a"), "b").unionByName(least.select(F.col("m").alias("a"), F.col("a").alias("b")))
    return out.where(F.col("a") < F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component (its least node) of every node that has a link. links: two columns a, b of longs."""
    a, b = links.columns
    links = links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct()
    links, seen = checkpointed(links), None
    while True:
        state = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state["n"] == 0 or (state["n"], state["h"]) == seen:
            break
        seen = state["n"], state["h"]
        links = checkpointed(star(star(links, True), False))
    hubs = links.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return links.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(hubs)
