"""Components and ranks of diagrams: directed pairs, strong components, longest paths.

Each diagram is one row: its node ids in order and the pairs between them. For
each node, the nodes it reaches are bits of a long; closure and ranks are steps
over the rows of a batch, so the corpus takes one shuffle and no loop over
diagrams. Diagrams of more than SMALL nodes do not fit a long; these stay rows
and go through large_graphs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ..functions.binding import let
from ..storage import kept
from . import large_graphs

#: Nodes of a diagram whose sets fit the bits of a long.
SMALL = 62
RANKED = "array<struct<id:string,component:string,rank:int>>"


def layout_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes that are no other node's parent."""
    parents = nodes.where(F.col("parent_id").isNotNull()).select("diagram_id", F.col("parent_id").alias("id")).distinct()
    return nodes.join(parents, ["diagram_id", "id"], "left_anti")


def directed_pairs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct (diagram_id, source, target) between the given nodes; associations and undirected edges give none."""
    ids = nodes.select("diagram_id", "id").distinct()
    inside = edges
    for end in ("source", "target"):
        inside = inside.join(ids.withColumnRenamed("id", end), ["diagram_id", end], "left_semi")
    return inside.select("diagram_id", F.explode(pair_ways()).alias("p")).select("diagram_id", "p.source", "p.target").distinct()


def pair_ways() -> Column:
    """The (source, target) pairs that an edge stands for, as an array."""
    there = F.struct("source", "target")
    back = F.struct(F.col("target").alias("source"), F.col("source").alias("target"))
    ways = F.when(F.col("direction") == "bidirectional", F.array(there, back)).when(F.col("direction") == "reverse", F.array(back)).otherwise(F.array(there))
    return F.when((F.col("relation") != "association") & (F.col("direction") != "none"), ways)


def packed(nodes: DataFrame, edges: DataFrame, *carried: str) -> DataFrame:
    """One row for each diagram: all nodes (id, parent_id and the carried columns), containers, ids (sorted, without containers), pairs between them.

    Two shuffles, both on diagram_id; what follows on a diagram needs no other.
    """
    by_node = nodes.groupBy("diagram_id").agg(F.array_sort(F.collect_list(F.struct("id", "parent_id", *carried))).alias("nodes"))
    by_edge = edges.select("diagram_id", pair_ways().alias("ways")).where("ways is not null").groupBy("diagram_id").agg(F.array_distinct(F.flatten(F.collect_list("ways"))).alias("pairs"))
    none = F.array().cast("array<struct<source:string,target:string>>")
    rows = by_node.join(by_edge, "diagram_id", "left").withColumn("containers", F.array_distinct(F.filter(F.transform("nodes", lambda n: n["parent_id"]), lambda p: p.isNotNull())))
    rows = rows.withColumn("ids", F.array_except(F.array_distinct(F.transform("nodes", lambda n: n["id"])), "containers"))
    inside = let(F.col("ids"), lambda ids: F.filter(F.coalesce("pairs", none), lambda p: F.array_contains(ids, p["source"]) & F.array_contains(ids, p["target"])))
    return rows.withColumn("pairs", inside)


def levels(sizes: np.ndarray, row: np.ndarray, source: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Component (its least node) and rank of each node, graphs by nodes, for graphs of sizes nodes with pairs (row, source, target); all graphs take each step together."""
    nodes = np.arange(sizes.max(initial=0))
    reach = np.tile(np.int64(1) << nodes, (len(sizes), 1))
    np.bitwise_or.at(reach, (row, source), np.int64(1) << target)
    for k in nodes:
        reach |= -(reach >> k & 1) & reach[:, [k]]
    # the nodes that reach each node, and of those the ones that it does not reach
    to = np.zeros_like(reach)
    for j in nodes:
        to |= (reach[:, [j]] >> nodes & 1) << j
    mutual = reach & to
    above, rank = to ^ mutual, np.zeros_like(reach)
    while True:
        more = np.zeros_like(rank)
        for j in nodes:
            np.maximum(more, (above >> j & 1) * (rank[:, [j]] + 1), out=more)
        if (more == rank).all():
            return np.bitwise_count((mutual & -mutual) - 1).astype(np.int64), rank
        rank = more


#: Graphs of like size that take their steps together.
TOGETHER = 2048


def placed(ids: pa.Array, pairs: pa.Array) -> pa.Array:
    """64 x component + rank of each node (as places among the ids); pairs: 64 x source + target."""
    n, many, code = np.diff(ids.offsets.to_numpy()).astype(np.int64), np.diff(pairs.offsets.to_numpy()), pairs.flatten().to_numpy().astype(np.int64)
    begins, first = np.cumsum(np.append(0, n)), np.cumsum(np.append(0, many))
    out, order = np.zeros(begins[-1], np.int32), np.argsort(n, kind="stable")
    for at in range(0, len(n), TOGETHER):
        own = order[at : at + TOGETHER]
        row = np.repeat(np.arange(len(own)), many[own])
        place = np.arange(len(row)) + np.repeat(first[own] - np.cumsum(many[own]) + many[own], many[own])
        component, rank = levels(n[own], row, code[place] // 64, code[place] % 64)
        x, y = np.nonzero(np.arange(component.shape[1]) < n[own][:, None])
        out[begins[own][x] + y] = 64 * component[x, y] + rank[x, y]
    return pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(out))


def ranked(graphs: DataFrame) -> DataFrame:
    """graphs (ids, pairs) of up to SMALL nodes plus ranked: (id, component, rank) of each id; component is its least id."""
    at = lambda ids, end: F.array_position(ids, end).cast("int") - 1
    codes = let(F.col("ids"), lambda ids: F.transform("pairs", lambda p: 64 * at(ids, p["source"]) + at(ids, p["target"])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("levels", placed(batch.column("ids"), batch.column("codes")))

    rows = graphs.withColumn("codes", codes)
    rows = rows.mapInArrow(run, StructType([*rows.schema, StructField("levels", ArrayType(IntegerType()))]))
    told = F.transform("ids", lambda i, k: let(F.get("levels", k), lambda x: F.struct(i.alias("id"), F.get("ids", F.shiftright(x, 6)).alias("component"), x.bitwiseAND(F.lit(63)).alias("rank"))))
    return rows.withColumn("ranked", told.cast(RANKED)).drop("codes", "levels")


def split(nodes: DataFrame, most: int = SMALL) -> tuple[DataFrame, DataFrame | None]:
    """The nodes of diagrams of at most `most` nodes, and the ids of the larger ones (None if there are none)."""
    large = kept(nodes.groupBy("diagram_id").agg(F.count("*").alias("n")).where(F.col("n") > most).select("diagram_id"))
    return (nodes, None) if large.isEmpty() else (nodes.join(large, "diagram_id", "left_anti"), large)


def ranks_of_large(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    own = kept(layout_nodes(nodes).select("diagram_id", "id").distinct())
    return large_graphs.ranked(own, kept(directed_pairs(own, edges)))


def ranks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """diagram_id, id, component, rank of all nodes that lay themselves out."""
    small, large = split(nodes)
    out = ranked(packed(small, edges)).select("diagram_id", F.inline("ranked"))
    if large is None:
        return out
    of = lambda df: df.join(large, "diagram_id", "left_semi")
    return out.unionByName(ranks_of_large(of(nodes), of(edges)))


def ranked_nodes(nodes: DataFrame, edges: DataFrame, *carried: str) -> DataFrame:
    """diagram_id, id, parent_id, the carried columns, is_container (its id is a parent's) and rank (null for containers) of every node."""
    small, large = split(nodes)
    rows = ranked(packed(small, edges, *carried)).withColumn("rank_of", F.map_from_entries(F.transform("ranked", lambda r: F.struct(r["id"], r["rank"]))))
    rows = rows.select("diagram_id", "containers", "rank_of", F.inline("nodes"))
    rows = rows.withColumns({"is_container": F.array_contains("containers", F.col("id")), "rank": F.element_at("rank_of", F.col("id"))}).drop("containers", "rank_of")
    if large is None:
        return rows
    of = lambda df: df.join(large, "diagram_id", "left_semi")
    parents = is_container_id(of(nodes)).withColumn("is_container", F.lit(True))
    more = of(nodes).join(ranks_of_large(of(nodes), of(edges)).drop("component"), ["diagram_id", "id"], "left").join(parents, ["diagram_id", "id"], "left")
    return rows.unionByName(more.withColumn("is_container", F.coalesce("is_container", F.lit(False))).select(rows.columns))


def condensation(pairs: DataFrame, components: DataFrame) -> DataFrame:
    """Distinct pairs of different components that a directed pair joins."""
    out = pairs
    for end in ("source", "target"):
        side = components.select("diagram_id", F.col("id").alias(end), F.col("component").alias(f"{end}_component"))
        out = out.join(side, ["diagram_id", end])
    return out.where("source_component <> target_component").select("diagram_id", "source_component", "target_component").distinct()


def is_container_id(nodes: DataFrame) -> DataFrame:
    """diagram_id, id of nodes whose id is used as a parent."""
    return nodes.where(F.col("parent_id").isNotNull()).select("diagram_id", F.col("parent_id").alias("id")).distinct()

