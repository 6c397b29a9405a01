"""Components, ranks and parent chains of diagrams of any size, by joins.

For diagrams that do not fit the bits of a long (see graph): nodes and pairs
stay rows, spread over the cluster, and each round is a few joins whose result
is written to the shared folder. All large diagrams go through the same rounds.

Strong components: least ids are passed along the pairs and against them, with
jumps (what reaches a node's least id reaches the node), until nothing changes.
A node for which both are the same id is in that id's component; pairs whose
ends differ in either id join no component and go; the rest starts again. The
least id of what is left always finds its component, and nodes without a way in
or without a way out are components by themselves at once.

Ranks: runs of components with one way in and out are chased to their heads by
doubling steps, so that a chain takes as many rounds as its length has bits;
what is left is peeled level by level, sources first.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import kept

D = "diagram_id"


def renamed(df: DataFrame, **names: str) -> DataFrame:
    """diagram_id and the columns named: new name = old name."""
    return df.select(D, *(F.col(old).alias(new) for new, old in names.items()))


def chased(links: DataFrame, most: int) -> DataFrame:
    """links (diagram_id, id, up, steps: 0 where id is an end and up is id itself) followed to their ends by doubling; after log2(most) rounds what has not ended never will."""
    for _ in range(math.ceil(math.log2(max(most, 1))) + 1):
        ahead = renamed(links, up="id", further="up", more="steps")
        after = kept(links.join(ahead, [D, "up"], "left").select(D, "id", F.coalesce("further", "up").alias("up"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), (F.coalesce("more", F.lit(0)) > 0).alias("moved")))
        links = after.drop("moved")
        if after.where("moved").isEmpty():
            break
    return links


def largest(rows: DataFrame) -> int:
    """The number of rows of the largest diagram."""
    return rows.groupBy(D).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def endless(nodes: DataFrame) -> DataFrame:
    """diagram_id, id of nodes (with distinct ids) whose chain of parents never ends. A parent that is no node of the diagram ends it."""
    there = nodes.select(D, F.col("id").alias("parent_id"), F.lit(True).alias("found"))
    linked = nodes.select(D, "id", "parent_id").join(there, [D, "parent_id"], "left")
    links = kept(linked.select(D, "id", F.when(F.col("found"), F.col("parent_id")).otherwise(F.col("id")).alias("up"), F.when(F.col("found"), 1).otherwise(0).cast("long").alias("steps")))
    ends = links.where("steps = 0").select(D, F.col("id").alias("up"))
    return chased(links, largest(links)).join(ends, [D, "up"], "left_anti").select(D, "id")


def least_labels(nodes: DataFrame, pairs: DataFrame, source: str, target: str) -> DataFrame:
    """diagram_id, id, label: the least id from which a way along the pairs leads to the node (itself included)."""
    labels = nodes.select(D, "id", F.col("id").alias("label"))
    ways = renamed(pairs, id=source, to=target)
    while True:
        passed = ways.join(labels, [D, "id"]).groupBy(D, "to").agg(F.min("label").alias("passed"))
        nearer = labels.join(renamed(passed, id="to", passed="passed"), [D, "id"], "left").select(D, "id", F.col("label").alias("old"), F.least("label", F.coalesce("passed", "label")).alias("label"))
        nearer = kept(nearer)
        jumps = renamed(nearer, label="id", further="label")
        after = kept(nearer.join(jumps, [D, "label"]).select(D, "id", "old", F.least("label", "further").alias("label")))
        labels = after.drop("old")
        if after.where("label <> old").isEmpty():
            return labels


def components(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """diagram_id, id, component (the least id of the strong component) of nodes; pairs: source, target between them."""
    found, left = [], kept(nodes.select(D, "id"))
    pairs = kept(pairs.where("source <> target").select(D, "source", "target"))
    while True:
        into, out = renamed(pairs, id="target").distinct(), renamed(pairs, id="source").distinct()
        inner = kept(into.join(out, [D, "id"]))
        found.append(left.join(inner, [D, "id"], "left_anti").select(D, "id", F.col("id").alias("component")))
        if inner.isEmpty():
            break
        own = lambda name, rows, key: rows.join(renamed(inner, **{key: "id"}), [D, key], "left_semi")
        pairs = kept(own("target", own("source", pairs, "source"), "target").select(D, "source", "target"))
        forth, back = least_labels(inner, pairs, "source", "target"), least_labels(inner, pairs, "target", "source")
        both = kept(forth.join(renamed(back, id="id", back="label"), [D, "id"]).withColumn("done", F.col("label") == F.col("back")))
        found.append(both.where("done").select(D, "id", F.col("label").alias("component")))
        left = both.where("not done").select(D, "id", "label", "back")
        end = lambda name: left.select(D, F.col("id").alias(name), F.struct("label", "back").alias(f"{name}_class"))
        pairs = kept(pairs.join(end("source"), [D, "source"]).join(end("target"), [D, "target"]).where("source_class = target_class").select(D, "source", "target"))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return kept(out)


def longest_paths(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """diagram_id, id, rank: the number of pairs on the longest way to a node; distinct pairs (source, target) without a circle."""
    alone = lambda key: pairs.groupBy(D, key).agg(F.count("*").alias("n")).where("n = 1").select(D, key)
    runs = kept(pairs.join(alone("source"), [D, "source"], "left_semi").join(alone("target"), [D, "target"], "left_semi"))
    links = nodes.select(D, "id").join(renamed(runs, id="target", up="source"), [D, "id"], "left")
    links = kept(links.select(D, "id", F.coalesce("up", "id").alias("up"), F.when(F.col("up").isNotNull(), 1).otherwise(0).cast("long").alias("steps")))
    heads = kept(chased(links, largest(links)))
    cross = pairs.join(runs, [D, "source", "target"], "left_anti")
    ways = kept(cross.join(renamed(heads, source="id", head="up", steps="steps"), [D, "source"]).select(D, F.col("head").alias("source"), "target", (F.col("steps") + 1).alias("steps")))
    waiting = kept(heads.where("steps = 0").select(D, "id", F.lit(0).cast("long").alias("rank")))
    done = []
    while not waiting.isEmpty():
        held = renamed(ways, id="target").distinct()
        free = kept(waiting.join(held, [D, "id"], "left_anti"))
        done.append(free)
        reached = ways.join(renamed(free, source="id", rank="rank"), [D, "source"]).groupBy(D, "target").agg(F.max(F.col("rank") + F.col("steps")).alias("reached"))
        rest = waiting.join(free.select(D, "id"), [D, "id"], "left_anti").join(renamed(reached, id="target", reached="reached"), [D, "id"], "left")
        waiting = kept(rest.select(D, "id", F.greatest("rank", F.coalesce("reached", F.lit(0))).alias("rank")))
        ways = kept(ways.join(renamed(free, source="id"), [D, "source"], "left_anti"))
    ranks = nodes.select(D, "id", F.lit(0).cast("long").alias("rank")).where("false")
    for part in done:
        ranks = ranks.unionByName(part)
    return heads.join(renamed(kept(ranks), up="id", rank="rank"), [D, "up"]).select(D, "id", (F.col("rank") + F.col("steps")).alias("rank"))


def ranked(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """diagram_id, id, component, rank of nodes (distinct ids); pairs: distinct (source, target) between them."""
    found = components(nodes, pairs)
    joined = pairs
    for end in ("source", "target"):
        joined = joined.join(found.select(D, F.col("id").alias(end), F.col("component").alias(f"{end}_component")), [D, end])
    joined = joined.where("source_component <> target_component").select(D, F.col("source_component").alias("source"), F.col("target_component").alias("target")).distinct()
    ranks = longest_paths(renamed(found, id="component").distinct(), kept(joined))
    return found.join(renamed(ranks, component="id", rank="rank"), [D, "component"]).select(D, "id", "component", F.col("rank").cast("int").alias("rank"))
