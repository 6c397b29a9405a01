"""Drawing tables: shapes in order, connectors with their ends and styles, reference callouts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import tables as t
from ..storage import dealt
from .normalize import fill_numbers


def shapes(nodes: DataFrame) -> DataFrame:
    """nodes plus draw_order (containers first, else list order) and their template marker."""
    container = t.is_container(F.col("type"))
    order = F.row_number().over(Window.partitionBy("diagram_id").orderBy(~container, "pos"))
    return nodes.withColumns({"marker": t.looked_up(F.col("type"), t.NODE_VISUALS, 0), "is_container": container, "draw_order": order})


def unknown_visuals(nodes: DataFrame, inventory: DataFrame) -> DataFrame:
    """Nodes of an unknown type, or whose marker the template does not have."""
    known = inventory.where(F.col("marker").isin(*(v[0] for v in t.NODE_VISUALS.values())))  # no more markers than types, so they go to the nodes
    rows = shapes(nodes).join(F.broadcast(known.select("marker", F.lit(True).alias("there")).distinct()), "marker", "left")
    return rows.where("marker is null or there is null").select("diagram_id", "id", "type", F.when(F.col("marker").isNull(), "unknown_type").otherwise("missing_marker").alias("rule"))


def marker_counts(shapes_: DataFrame, markers: DataFrame) -> DataFrame:
    """marker, n of required markers that do not match exactly one template shape."""
    return markers.join(shapes_, "marker", "left").groupBy("marker").agg(F.count("shape_id").alias("n")).where("n <> 1")


def drawing_findings(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """Nodes that cannot be drawn: geometry missing, not finite, or off the page by more than the tolerance."""
    numbers = [F.col(c) for c in ("x", "y", "width", "height")]
    missing, odd = F.lit(False), F.lit(False)
    for n in numbers:
        missing, odd = missing | n.isNull(), odd | ~g.finite(n)
    odd = odd | (F.col("width") <= 0) | (F.col("height") <= 0)
    rule = F.when(missing, "no_geometry").when(odd, "not_finite").when(g.outside(F.col("page_width"), F.col("page_height"), g.TOLERANCE), "outside_page")
    return nodes.join(pages, "diagram_id").select("diagram_id", "id", rule.alias("rule")).where("rule is not null")


def automatic_references(nodes: DataFrame) -> DataFrame:
    """nodes with 1, 2, ... as reference numbers where there is none, skipping those in use."""
    return fill_numbers(nodes, "reference_number", "", F.col("reference_number").isNull())


def between(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges with the boxes of both ends."""
    out = edges
    for end, p in (("source", "s_"), ("target", "t_")):
        out = out.join(nodes.select("diagram_id", F.col("id").alias(end), *(F.col(c).alias(f"{p}{c}") for c in ("x", "y", "width", "height"))), ["diagram_id", end])
    return out


def connectors(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """A row for each edge: both ends on the boxes' borders, transform and style.

    Ends lie where the line between centres leaves each box. A self-loop leaves
    and enters on the right; other edges between equal centres get null ends.
    """
    return connected(between(edges, nodes))


def connected(rows: DataFrame) -> DataFrame:
    """The same for edges that carry the boxes of both ends (s_x, ..., t_height)."""
    dx, dy = F.col("t_x") - F.col("s_x"), F.col("t_y") - F.col("s_y")
    same, loop = (dx == 0) & (dy == 0), F.col("source") == F.col("target")

    def border(p: str, axis: str, sign: int) -> Column:
        scale = F.lit(1.0) / F.greatest(F.abs(dx) / (F.col(f"{p}width") / 2), F.abs(dy) / (F.col(f"{p}height") / 2))
        at_loop = F.col("s_x") + F.col("s_width") / 2 if axis == "x" else F.col("s_y") + (F.col("s_height") / 4 if p == "t_" else -F.col("s_height") / 4)
        return F.when(~same, F.col(f"{p}{axis}") + sign * (dx if axis == "x" else dy) * scale).when(loop, at_loop)

    rows = rows.withColumns({"begin_x": border("s_", "x", 1), "begin_y": border("s_", "y", 1), "end_x": border("t_", "x", -1), "end_y": border("t_", "y", -1)})
    for axis, size in (("x", "line_width"), ("y", "line_height")):
        delta = F.col(f"end_{axis}") - F.col(f"begin_{axis}")
        flat = F.abs(delta) <= 1e-12
        rows = rows.withColumns({size: F.when(flat, 0.25).otherwise(delta), f"pin_{axis}": F.when(flat, F.col(f"begin_{axis}")).otherwise((F.col(f"begin_{axis}") + F.col(f"end_{axis}")) / 2)})
    style = F.when(F.col("style_explicit"), F.col("style")).otherwise(t.looked_up(F.col("relation"), t.RELATION_VISUALS, 0))
    return rows.withColumns({
        "line_style": style,
        "pattern": t.looked_up(style, t.LINE_PATTERNS),
        "weight": t.looked_up(F.col("relation"), t.RELATION_VISUALS, 1) / 72.0,
        "begin_arrow": F.when(t.looked_up(F.col("direction"), t.ARROWS, 0), t.ARROW_STYLE).otherwise(0),
        "end_arrow": F.when(t.looked_up(F.col("direction"), t.ARROWS, 1), t.ARROW_STYLE).otherwise(0),
        "local_x": F.col("line_width") / 2,
        "local_y": F.col("line_height") / 2,
    })


def callouts(nodes: DataFrame, pages: DataFrame, width: float = t.CALLOUT_WIDTH, height: float = t.CALLOUT_HEIGHT) -> DataFrame:
    """Where each reference number goes: the first of right, left, above, below at which text and carrier fit the page.

    side is null where nothing fits.
    """
    return called_out(nodes.where(F.col("reference_number").isNotNull()).join(pages, "diagram_id"), width, height)


def called_out(rows: DataFrame, width: float = t.CALLOUT_WIDTH, height: float = t.CALLOUT_HEIGHT) -> DataFrame:
    """The same for nodes with a reference number that carry their page."""
    tw, th = min(t.CALLOUT_TEXT_WIDTH, width), min(t.CALLOUT_TEXT_HEIGHT, height)
    page_width, page_height = F.col("page_width"), F.col("page_height")

    def candidate(side: str, x: Column, y: Column) -> Column:
        """What a place gives, null where text or carrier do not fit."""
        low_x, high_x = F.greatest(F.lit(width / 2), x + tw / 2 - width / 2), F.least(page_width - width / 2, x - tw / 2 + width / 2)
        low_y, high_y = F.greatest(F.lit(height / 2), y + th / 2 - height / 2), F.least(page_height - height / 2, y - th / 2 + height / 2)
        on_page = (x - tw / 2 >= 0) & (x + tw / 2 <= page_width) & (y - th / 2 >= 0) & (y + th / 2 <= page_height)
        place = F.struct(F.lit(side).alias("side"), x.alias("text_x"), y.alias("text_y"), F.least(F.greatest(x, low_x), high_x).alias("root_x"), F.least(F.greatest(y, low_y), high_y).alias("root_y"))
        return F.when(on_page & (low_x <= high_x) & (low_y <= high_y), place)

    options = (
        candidate("right", g.right() + t.CALLOUT_GAP + tw / 2, F.col("y")),
        candidate("left", g.left() - t.CALLOUT_GAP - tw / 2, F.col("y")),
        candidate("above", F.col("x"), g.top() + t.CALLOUT_GAP + th / 2),
        candidate("below", F.col("x"), g.bottom() - t.CALLOUT_GAP - th / 2),
    )
    small = (page_width < width) | (page_height < height)
    rows = rows.withColumn("best", F.when(~small, F.coalesce(*options)))
    return rows.select(
        "diagram_id", "id", "reference_number", F.col("best.side").alias("side"), F.col("best.text_x").alias("text_x"), F.col("best.text_y").alias("text_y"),
        F.col("best.root_x").alias("root_x"), F.col("best.root_y").alias("root_y"),
        (F.col("x") - F.col("best.root_x") + width / 2).alias("leader_x"), (g.bottom() - F.col("best.root_y") + height / 2).alias("leader_y"),
    )


def leftover_markers(nodes: DataFrame) -> DataFrame:
    """diagram_id, id, rule of nodes whose text still holds a marker of the template."""
    return nodes.where(F.col("label").rlike("__template_[a-z_]+__")).select("diagram_id", "id", F.lit("marker_left").alias("rule"))


@dataclass
class Drawing:
    """The tables of one draw job: nodes with their boxes, shapes, connectors, callouts, and findings (diagram_id, id, rule)."""

    nodes: DataFrame
    shapes: DataFrame
    connectors: DataFrame
    callouts: DataFrame
    findings: DataFrame


NODE, EDGE, PLACE = ["pos", "id", "type", "label", "parent_id", "reference_number"], ["pos", "id", "source", "target", "relation", "direction", "label", "style", "style_explicit"], ["pos", "node_id", "x", "y", "width", "height"]
BOX = ("x", "y", "width", "height")


def draw(nodes: DataFrame, placements: DataFrame, edges: DataFrame, pages: DataFrame) -> Drawing:
    """All tables of the drawings; each costs what it needs only.

    A node is drawn in its last placement; nodes without one are left out, and
    connectors whose ends are. All tables are dealt by diagram once, and joined
    and ordered where they lie, so that no diagram has to fit a row.
    """
    nodes, placements, edges, pages = (dealt(df) for df in (nodes, placements, edges, pages))
    nth = F.row_number().over(Window.partitionBy("diagram_id", "node_id").orderBy(*(F.desc(c) for c in PLACE if c != "node_id")))
    boxes = placements.withColumn("nth", nth).where("nth = 1").select("diagram_id", F.col("node_id").alias("id"), *BOX)
    placed = nodes.select("diagram_id", *NODE).join(boxes, ["diagram_id", "id"])
    page = pages.groupBy("diagram_id").agg(F.min(F.struct("page_width", "page_height")).alias("page")).select("diagram_id", "page.page_width", "page.page_height")
    own = placed.join(page, "diagram_id", "left").select("diagram_id", "page_width", "page_height", *NODE, *BOX)
    again = F.row_number().over(Window.partitionBy("diagram_id", "id").orderBy("pos"))
    lines = between(edges.select("diagram_id", *EDGE), placed.withColumn("nth", again).where("nth = 1"))  # of nodes with one id the first
    drawn = shapes(placed).select("diagram_id", *NODE, *BOX, "marker", "is_container", "draw_order")
    bare = own.drop("page_width", "page_height")
    findings = drawing_findings(bare, own.where("page_width is not null").select("diagram_id", "page_width", "page_height").distinct()).unionByName(leftover_markers(own))
    return Drawing(own, drawn, connected(lines), called_out(own.where("reference_number is not null and page_width is not null")), findings)


def inventory(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """diagram_id, expected_shapes (nodes, edges and callouts), expected_connections (two for each edge), unique_ids, of the nodes of a drawing, which carry their page.

    A callout belongs to each node with a reference number and a page. Nodes and
    edges that are dealt by diagram are counted where they lie.
    """
    called = F.col("reference_number").isNotNull() & F.col("page_width").isNotNull()
    ids = nodes.groupBy("diagram_id", "id").agg(F.count("*").alias("n"), F.count(F.when(called, 1)).alias("callouts"))
    ids = ids.groupBy("diagram_id").agg(F.sum("n").alias("nodes"), F.count("id").alias("ids"), F.sum("callouts").alias("callouts"))
    out = ids.join(edges.groupBy("diagram_id").agg(F.count("*").alias("edges")), "diagram_id", "left").na.fill(0, ["edges"])
    return out.select("diagram_id", (F.col("nodes") + F.col("edges") + F.col("callouts")).alias("expected_shapes"), (2 * F.col("edges")).alias("expected_connections"), (F.col("nodes") == F.col("ids")).alias("unique_ids"))
