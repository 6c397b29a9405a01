"""Layered layout of all diagrams in one job: sizes, ranks, boxes, containers, page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import tables as t
from . import graph


def sized(nodes: DataFrame) -> DataFrame:
    """nodes plus lines, wrapped, own_width, own_height."""
    out = nodes.withColumn("lines", g.lines_of(F.col("type"), F.col("label")))
    return out.withColumns({
        "wrapped": F.array_join("lines", "\n"),
        "own_width": g.node_width(F.col("type"), F.col("lines")),
        "own_height": g.node_height(F.col("type"), F.col("lines"), F.col("reference_number")),
    })


def layered(rows: DataFrame) -> DataFrame:
    """rows plus x and y of the nodes that have a rank.

    rows: diagram_id, orientation, id, rank (null for containers), own_width,
    own_height. All windows lie inside a diagram and share one order.
    """
    down = F.col("orientation") == "top_to_bottom"
    rows = rows.withColumns({"own": F.when(down, F.col("own_width")).otherwise(F.col("own_height")), "deep": F.when(down, F.col("own_height")).otherwise(F.col("own_width"))})
    diagram, band = Window.partitionBy("diagram_id"), Window.partitionBy("diagram_id", "rank")
    rows = rows.withColumns({
        "nth": F.row_number().over(band.orderBy("id")),
        "at": F.coalesce(F.sum(F.col("own") + t.NODE_GAP).over(band.orderBy("id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "across": F.sum("own").over(band) + t.NODE_GAP * (F.count("*").over(band) - 1),
        "along": F.max("deep").over(band),
    })
    leads = F.col("rank").isNotNull() & (F.col("nth") == 1)  # one row speaks for its band
    up_to = diagram.orderBy(F.col("rank").asc_nulls_last(), "id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({
        "through": F.sum(F.when(leads, F.col("along") + t.RANK_GAP).otherwise(0.0)).over(up_to),
        "content_across": F.max(F.when(leads, F.col("across"))).over(diagram),
        "content_along": F.sum(F.when(leads, F.col("along"))).over(diagram) + t.RANK_GAP * (F.sum(leads.cast("int")).over(diagram) - 1),
    })
    offset, spare = F.col("through") - F.col("along") - t.RANK_GAP, (F.col("content_across") - F.col("across")) / 2
    page_height = F.bround(F.col("content_along") + 2 * t.MARGIN, 4)
    x = F.when(down, t.MARGIN + spare + F.col("at") + F.col("own") / 2).otherwise(t.MARGIN + offset + F.col("along") / 2)
    y = F.when(down, page_height - t.MARGIN - offset - F.col("along") / 2).otherwise(t.MARGIN + (F.col("content_across") + F.col("across")) / 2 - F.col("at") - F.col("own") / 2)
    placed = F.col("rank").isNotNull()
    return rows.withColumns({"x": F.when(placed, F.bround(x, 4)), "y": F.when(placed, F.bround(y, 4))})


def around_children(rows: DataFrame) -> DataFrame:
    """rows with x, y, width, height of containers too: around their children, no smaller than their own size.

    rows: is_container, and x, y, own_width, own_height of all others. A container
    and its children meet in one window.
    """
    rows = rows.withColumns({"width": F.when(~F.col("is_container"), F.col("own_width")), "height": F.when(~F.col("is_container"), F.col("own_height"))})
    family = Window.partitionBy("diagram_id", F.when(F.col("is_container"), F.col("id")).otherwise(F.col("parent_id")))
    rows = rows.withColumns({
        "l": F.min(g.left()).over(family) - t.CONTAINER_PAD,
        "r": F.max(g.right()).over(family) + t.CONTAINER_PAD,
        "b": F.min(g.bottom()).over(family) - t.CONTAINER_PAD,
        "u": F.max(g.top()).over(family) + t.CONTAINER_TOP,
    })
    box = {"x": (F.col("l") + F.col("r")) / 2, "y": (F.col("b") + F.col("u")) / 2, "width": F.greatest(F.col("r") - F.col("l"), F.col("own_width")), "height": F.greatest(F.col("u") - F.col("b"), F.col("own_height"))}
    return rows.withColumns({k: F.when(F.col("is_container"), F.bround(v, 4)).otherwise(F.col(k)) for k, v in box.items()})


def childless_boxes(nodes: DataFrame, boxes: DataFrame) -> DataFrame:
    """diagram_id, id of parents of which some child has no box."""
    children = nodes.where(F.col("parent_id").isNotNull()).select("diagram_id", "id", "parent_id")
    return children.join(boxes, ["diagram_id", "id"], "left_anti").select("diagram_id", F.col("parent_id").alias("id")).distinct()


def fit_page(boxes: DataFrame, margin: float = 0.5, minimum_width: Column | float = 0.0, minimum_height: Column | float = 0.0) -> DataFrame:
    """boxes, shifted right and up so that all keep the margin, plus page_width and page_height (no smaller than the minima)."""
    least = lambda x: x if isinstance(x, Column) else F.lit(x)
    all_of = Window.partitionBy("diagram_id")
    shifted = boxes.withColumns({"dx": F.greatest(F.lit(0.0), margin - F.min(g.left()).over(all_of)), "dy": F.greatest(F.lit(0.0), margin - F.min(g.bottom()).over(all_of))})
    moved = (F.col("dx") > 0) | (F.col("dy") > 0)
    shifted = shifted.withColumns({"x": F.when(moved, F.bround(F.col("x") + F.col("dx"), 4)).otherwise(F.col("x")), "y": F.when(moved, F.bround(F.col("y") + F.col("dy"), 4)).otherwise(F.col("y"))})
    return shifted.withColumns({
        "page_width": F.bround(F.greatest(least(minimum_width), F.max(g.right()).over(all_of) + margin), 4),
        "page_height": F.bround(F.greatest(least(minimum_height), F.max(g.top()).over(all_of) + margin), 4),
    }).drop("dx", "dy")


def layout(diagrams: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """diagram_id, id, x, y, width, height, page_width, page_height of every node, containers included.

    Diagrams without nodes have no rows; see empty_diagrams.
    """
    rows = graph.ranked_nodes(sized(nodes), edges, "own_width", "own_height").join(diagrams.select("diagram_id", "orientation"), "diagram_id")
    boxes = around_children(layered(rows)).select("diagram_id", "id", "x", "y", "width", "height")
    return fit_page(boxes, margin=t.MARGIN)


def positioned(nodes: DataFrame, boxes: DataFrame) -> DataFrame:
    """nodes with wrapped labels and the geometry of layout()."""
    return sized(nodes).drop("x", "y", "width", "height", "label", "lines", "own_width", "own_height").withColumnRenamed("wrapped", "label").join(boxes, ["diagram_id", "id"])


def empty_diagrams(diagrams: DataFrame, nodes: DataFrame) -> DataFrame:
    """Diagrams that cannot be laid out, as they have no node."""
    return diagrams.join(nodes.select("diagram_id").distinct(), "diagram_id", "left_anti")


def layout_findings(boxes: DataFrame, nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """diagram_id, id, rule for boxes that do not assemble: missing, unknown, not positive, outside the page."""
    both = nodes.select("diagram_id", "id", F.lit(True).alias("is_node")).join(boxes.withColumn("is_box", F.lit(True)), ["diagram_id", "id"], "full_outer").join(pages, "diagram_id")
    sound = g.positive(F.col("x")) & g.positive(F.col("y")) & g.positive(F.col("width")) & g.positive(F.col("height"))
    rule = F.when(F.col("is_box").isNull(), "missing").when(F.col("is_node").isNull(), "unknown").when(~sound, "not_positive").when(g.outside(F.col("page_width"), F.col("page_height")), "outside_page")
    return both.select("diagram_id", "id", rule.alias("rule")).where("rule is not null")
