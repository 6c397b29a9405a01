"""Normalization of graphs: reciprocal edges, edge ids, rules in their order.

Rules are windows, groupings and joins on (diagram_id, ...), each over all diagrams.
Findings are rows (diagram_id, phase, k1, k2, sub, rule, message); the order of
(phase, k1, k2, sub) is the order in which a reader would meet them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tables, text
from ..functions.binding import let
from ..storage import dealt, kept
from . import large_graphs, packed

FINDING = ("diagram_id", "phase", "k1", "k2", "sub", "rule", "message")


def finding(rows: DataFrame, phase: int, rule: str | Column, message: Column, k1: Column, k2: Column | None = None, sub: int | Column = 0) -> DataFrame:
    rule = F.lit(rule) if isinstance(rule, str) else rule
    return rows.select("diagram_id", F.lit(phase).alias("phase"), k1.alias("k1"), (F.lit("") if k2 is None else k2).alias("k2"), (F.lit(sub) if isinstance(sub, int) else sub).alias("sub"), rule.alias("rule"), message.alias("message"))


def by_position(rows: DataFrame, phase: int, rule: str | Column, message: Column, sub: int | Column = 0) -> DataFrame:
    """Findings that are met in list order; positions become fixed-width text, so that keys are text in all findings."""
    return finding(rows, phase, rule, message, F.format_string("%012d", F.col("pos").cast("long")), sub=sub)


def collapse_reciprocal(edges: DataFrame) -> DataFrame:
    """The first of each pair of opposite, otherwise equal forward edges, made bidirectional; its partner goes.

    The k-th edge of a direction pairs with the k-th of the other; self-loops
    pair first with second, third with fourth.
    """
    same = ["diagram_id", "is_forward", "low", "high", "relation", "label", "style"]
    rows = dealt(edges).withColumns({"is_forward": F.col("direction") == "forward", "low": F.least("source", "target"), "high": F.greatest("source", "target")})
    nth = F.row_number().over(Window.partitionBy(*same, F.col("source") == F.col("low")).orderBy("pos"))
    rows = rows.withColumn("slot", nth)
    rows = rows.withColumn("slot", F.when(F.col("low") == F.col("high"), F.floor((F.col("slot") - 1) / 2)).otherwise(F.col("slot")))
    pair = Window.partitionBy(*same, "slot").orderBy("pos")
    rows = rows.withColumn("place", F.row_number().over(pair)).withColumn("paired", F.count("*").over(pair.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) == 2)
    kept = rows.where(~F.col("is_forward") | (F.col("place") == 1))
    return kept.withColumn("direction", F.when(F.col("is_forward") & F.col("paired"), "bidirectional").otherwise(F.col("direction"))).select(edges.columns)


def fill_numbers(rows: DataFrame, column: str, prefix: str, missing: Column, used: Column | None = None) -> DataFrame:
    """Give the k-th missing row of a diagram the k-th smallest prefix + n that no row of the diagram has.

    The k-th free number is k plus the used numbers u_j (sorted) with u_j - j < k,
    so one running count over the diagram answers it.
    """
    number = F.when(F.col(column).rlike(f"^{prefix}[1-9][0-9]{{0,17}}$"), F.substring(column, len(prefix) + 1, 18).cast("long"))
    out = dealt(rows).withColumns({"lacks": missing, "number": number})
    first = F.row_number().over(Window.partitionBy("diagram_id", column).orderBy("pos")) == 1
    out = out.withColumn("is_used", F.col("number").isNotNull() & first & ~F.col("lacks"))
    rank = F.row_number().over(Window.partitionBy("diagram_id", "is_used").orderBy("number", "pos"))
    nth = F.row_number().over(Window.partitionBy("diagram_id", "lacks").orderBy("pos"))
    out = out.withColumns({"rank": rank, "nth": nth})
    key = F.when(F.col("is_used"), F.col("number") - F.col("rank")).when(F.col("lacks"), F.col("nth") - 1)
    before = Window.partitionBy("diagram_id").orderBy(F.col("key").asc_nulls_last(), F.col("lacks"), "pos").rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("key", key).withColumn("below", F.sum(F.col("is_used").cast("long")).over(before))
    return out.withColumn(column, F.when(F.col("lacks"), F.concat(F.lit(prefix), (F.col("nth") + F.col("below")).cast("string"))).otherwise(F.col(column))).select(rows.columns)


def assign_edge_ids(edges: DataFrame) -> DataFrame:
    """Ids e1, e2, ... for edges without one, in list order, skipping those in use."""
    return fill_numbers(edges, "id", "e", F.coalesce(F.col("id"), F.lit("")) == "")


def again(rows: DataFrame, *key: str) -> DataFrame:
    """Rows whose key an earlier row of the diagram has."""
    nth = F.row_number().over(Window.partitionBy("diagram_id", *key).orderBy("pos"))
    return rows.withColumn("nth", nth).where("nth > 1")


def duplicate_nodes(nodes: DataFrame) -> DataFrame:
    return by_position(again(nodes, "id"), 1, "duplicate_node", text.message("duplicate_node", id=F.col("id")))


def duplicate_edges(edges: DataFrame) -> DataFrame:
    named = edges.where(F.coalesce(F.col("id"), F.lit("")) != "")
    return by_position(again(named, "id"), 2, "duplicate_edge", text.message("duplicate_edge", id=F.col("id")))


def dangling_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """An edge's source, then its target, that no node of the diagram has."""
    end = lambda sub, name: F.struct(F.lit(sub).alias("sub"), F.lit(name).alias("end"), F.col(name).alias("id"))
    ends = edges.select("diagram_id", "pos", F.inline(F.array(end(0, "source"), end(1, "target"))))
    lost = ends.join(nodes.select("diagram_id", "id"), ["diagram_id", "id"], "left_anti")
    message = text.message("dangling_edge", end=F.col("end"), id=F.col("id"))
    return by_position(lost, 3, "dangling_edge", message, F.col("sub"))


def with_parents(nodes: DataFrame) -> DataFrame:
    """Nodes that name a parent, with the parent's type and its own parent (null if there is none)."""
    first = F.min_by(F.struct("type", "parent_id"), "pos").alias("p")  # of nodes with one id the first
    parents = nodes.groupBy(F.col("diagram_id").alias("d"), F.col("id").alias("pid")).agg(first)
    parents = parents.select("d", "pid", F.col("p.type").alias("parent_type"), F.col("p.parent_id").alias("grandparent_id"), F.lit(True).alias("found"))
    children = nodes.where(F.col("parent_id").isNotNull())
    return children.join(parents, (children["diagram_id"] == parents["d"]) & (children["parent_id"] == parents["pid"]), "left").drop("d", "pid")


def containment_findings(nodes: DataFrame) -> DataFrame:
    """What is wrong with a node's parent, and nodes whose parent has a parent, from one join."""
    told = lambda phase, rule: F.struct(F.lit(phase).alias("phase"), F.lit(rule).alias("rule"), text.message(rule, id=F.col("id"), parent_id=F.col("parent_id")).alias("message"))
    wrong = (
        F.when(F.col("parent_id") == F.col("id"), told(4, "self_parent"))
        .when(F.col("found").isNull(), told(4, "missing_parent"))
        .when(~tables.is_container(F.col("parent_type")), told(4, "parent_type"))
    )
    deep = F.when(F.col("grandparent_id").isNotNull(), told(6, "containment_depth"))
    rows = with_parents(nodes).select("diagram_id", "pos", F.explode(F.array_compact(F.array(wrong, deep))).alias("f"))
    return rows.select("diagram_id", F.col("f.phase").alias("phase"), F.format_string("%012d", F.col("pos").cast("long")).alias("k1"), F.lit("").alias("k2"), F.lit(0).alias("sub"), F.col("f.rule").alias("rule"), F.col("f.message").alias("message"))


def parent_rules(nodes: DataFrame) -> DataFrame:
    return containment_findings(nodes).where("phase = 4")


def too_deep(nodes: DataFrame) -> DataFrame:
    return containment_findings(nodes).where("phase = 6")


def containment_cycles(nodes: DataFrame) -> DataFrame:
    """Nodes from which the chain of parents comes back to a node it has passed.

    Only diagrams with unique ids (elsewhere an earlier rule has the word) in
    which some parent has a parent are looked at. A chain that has not ended after
    as many steps as there are nodes runs in a circle; steps double, in the row of
    a diagram or, for large diagrams, by joins.
    """
    parts, large = packed.by_size({"nodes": (nodes, ["pos", "id", "parent_id"])})
    found = circles(parts["nodes"][0])
    if large is not None:
        own = kept(nodes.join(large, "diagram_id", "left_semi"))
        unique = own.groupBy("diagram_id").agg((F.count("*") == F.countDistinct("id")).alias("u")).where("u").select("diagram_id")
        own = kept(own.join(unique, "diagram_id", "left_semi"))
        found = found.unionByName(large_graphs.endless(own).join(own.select("diagram_id", "id", "pos"), ["diagram_id", "id"]).select("diagram_id", "pos", "id"))
    return by_position(found, 5, "containment_cycle", text.message("containment_cycle", id=F.col("id")))


def circles(nodes: DataFrame) -> DataFrame:
    """diagram_id, pos, id of such nodes, each diagram in one row."""
    rows = nodes.groupBy("diagram_id").agg(F.array_sort(F.collect_list(F.struct("pos", "id", "parent_id"))).alias("all"))
    ids = F.transform("all", lambda n: n["id"])
    links = F.filter("all", lambda n: n["parent_id"].isNotNull())
    deep = F.arrays_overlap(F.transform(links, lambda n: n["parent_id"]), F.transform(links, lambda n: n["id"]))
    rows = rows.where((F.size(F.array_distinct(ids)) == F.size("all")) & deep)
    # where each node's parent stands (0: none, or not in the diagram); doubling the step leaves 0 for every chain that ends
    up = let(ids, lambda ids: F.transform("all", lambda n: F.coalesce(F.array_position(ids, n["parent_id"]).cast("int"), F.lit(0))))
    jump = lambda up: F.transform(up, lambda p: F.when(p == 0, 0).otherwise(F.get(up, p - 1)))
    far = F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(F.size("all") + 1)).cast("int")), up, lambda up, _: let(up, jump))
    bad = F.transform(F.filter(F.arrays_zip(F.col("all").alias("n"), far.alias("far")), lambda z: z["far"] > 0), lambda z: z["n"])
    return rows.select("diagram_id", F.explode(bad).alias("n")).select("diagram_id", "n.pos", "n.id")


def duplicate_references(nodes: DataFrame) -> DataFrame:
    rows = nodes.where(F.col("reference_number").isNotNull()).withColumn("reference", text.strip(F.col("reference_number"))).where("reference <> ''")
    return by_position(again(rows, "reference"), 7, "duplicate_reference", text.message("duplicate_reference", id=F.col("reference")))


def geometry_present(nodes: DataFrame) -> DataFrame:
    """Diagrams of which some node has a coordinate or a size already."""
    given = [c for c in ("x", "y", "width", "height") if c in nodes.columns]
    if not given:
        nodes, given = nodes.withColumn("x", F.lit(None)), ["x"]
    has = F.coalesce(*map(F.col, given)).isNotNull()
    rows = nodes.groupBy("diagram_id").agg(F.bool_or(has).alias("has")).where("has").withColumn("pos", F.lit(0))
    return by_position(rows, 0, "geometry", text.message("geometry"))


def normalization_findings(nodes: DataFrame, edges: DataFrame, extracted: bool = False) -> DataFrame:
    nodes, edges = dealt(nodes), dealt(edges)
    parts = [duplicate_nodes(nodes), duplicate_edges(edges), dangling_edges(nodes, edges), containment_findings(nodes), containment_cycles(nodes), duplicate_references(nodes)]
    if extracted:
        parts.append(geometry_present(nodes))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def first_failure(findings: DataFrame) -> DataFrame:
    """diagram_id, rule, message of the first finding of each diagram."""
    first = F.min(F.struct("phase", "k1", "k2", "sub", "rule", "message")).alias("first")
    return findings.groupBy("diagram_id").agg(first).select("diagram_id", "first.rule", "first.message")


def failures(nodes: DataFrame, edges: DataFrame, extracted: bool = False) -> DataFrame:
    """diagram_id, rule, message of the first rule that each diagram breaks.

    A diagram is packed into a row and judged there, all in one shuffle; those
    too large for a row go through one table for each rule.
    """
    geometry = tuple(c for c in ("x", "y", "width", "height") if extracted and c in nodes.columns)
    parts = {"nodes": (nodes, ["pos", "id", "type", "parent_id", "reference_number", *geometry]), "edges": (edges, ["pos", "id", "source", "target"])}
    small, large = packed.by_size(parts)
    found = packed.pack(small).select("diagram_id", packed.failure(F.col("nodes"), F.col("edges"), geometry).alias("f")).where("f is not null").select("diagram_id", "f.rule", "f.message")
    if large is None:
        return found
    of = lambda df: df.join(large, "diagram_id", "left_semi")
    return found.unionByName(first_failure(normalization_findings(of(nodes), of(edges), extracted)))


def normalize(nodes: DataFrame, edges: DataFrame, extracted: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges with all ids, failures): tables of the diagrams that pass, and the first failure of the others."""
    edges = collapse_reciprocal(edges) if extracted else edges
    broken = kept(failures(nodes, edges, extracted))
    bad = broken.select("diagram_id")
    return nodes.join(bad, "diagram_id", "left_anti"), assign_edge_ids(edges.join(bad, "diagram_id", "left_anti")), broken
