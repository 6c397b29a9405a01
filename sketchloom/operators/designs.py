"""Rules for proposed geometry: coverage, hints, page bounds, overlaps, containers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as tx
from ..storage import dealt, kept
from . import packed
from .normalize import again, assign_edge_ids, by_position, finding


def last_placements(placements: DataFrame) -> DataFrame:
    """Of several placements of a node the last one counts."""
    nth = F.row_number().over(Window.partitionBy("diagram_id", "node_id").orderBy(F.desc("pos")))
    return placements.withColumn("nth", nth).where("nth = 1").drop("nth", "pos").withColumnRenamed("node_id", "id")


def duplicate_placements(placements: DataFrame) -> DataFrame:
    return by_position(again(placements, "node_id"), 1, "duplicate_placement", tx.message("duplicate_placement", id=F.col("node_id")))


def coverage(nodes: DataFrame, placements: DataFrame) -> DataFrame:
    """Nodes without a placement, then placements without a node: one grouping of both sides' ids."""
    ids = nodes.select("diagram_id", "id", F.lit(True).alias("is_node"))
    boxes = placements.select("diagram_id", F.col("node_id").alias("id"), F.lit(False).alias("is_node"))
    one_side = ids.unionByName(boxes).groupBy("diagram_id", "id").agg(F.bool_and("is_node").alias("missing"), F.bool_or("is_node").alias("known")).where("missing or not known")
    missing = F.col("missing")
    message = F.when(missing, tx.message("missing_placement", id=F.col("id"))).otherwise(tx.message("unknown_placement", id=F.col("id")))
    rule = F.when(missing, "missing_placement").otherwise("unknown_placement")
    return finding(one_side, 2, rule, message, F.col("id")).withColumn("phase", F.when(F.col("rule") == "missing_placement", 2).otherwise(3))


def hint_rules(edges: DataFrame, hints: DataFrame) -> DataFrame:
    """Hints of one edge twice, and hints for edges that are not there (edges: with their final ids)."""
    twice = by_position(again(hints, "edge_id"), 4, "duplicate_hint", tx.message("duplicate_hint", id=F.col("edge_id")), 0)
    ids = edges.select("diagram_id", F.col("id").alias("edge_id")).distinct()
    lost = by_position(hints.join(ids, ["diagram_id", "edge_id"], "left_anti"), 4, "unknown_hint", tx.message("unknown_hint", id=F.col("edge_id")), 1)
    return twice.unionByName(lost)


def hint_map(hints: DataFrame) -> DataFrame:
    """diagram_id, hints: map of edge_id to its sides; of several hints of an edge the last counts."""
    last = hints.groupBy("diagram_id", "edge_id").agg(F.max_by(F.struct("source_side", "target_side"), "pos").alias("sides"))
    return last.groupBy("diagram_id").agg(F.map_from_entries(F.collect_list(F.struct("edge_id", "sides"))).alias("hints"))


def out_of_page(boxes: DataFrame, pages: DataFrame) -> DataFrame:
    bad = boxes.join(pages, "diagram_id").where(g.outside(F.col("page_width"), F.col("page_height")))
    return finding(bad, 5, "outside_page", tx.message("outside_page", id=F.col("id")), F.col("id"))


#: Boards of up to so many boxes are one cell; cells of others are powers of four.
FEW, LEVEL_BASE, TOP_LEVEL = 64, 4.0, 510


def overlaps(boxes: DataFrame, few: int = FEW) -> DataFrame:
    """Pairs of overlapping boxes that are not parent and child.

    Sizes are untrusted, so no box is dealt into a number of cells that depends
    on them. A box has a level by its width and one by its height: the least
    power of four that is not under it. A pair meets on the greater level of
    either axis, where each covers two cells an axis at most; a box enters the
    cells of its own level once for each level that its board has. Boxes that
    share a cell are of its order of size, so few meet in vain, whatever the
    mixture. A pair is told in the first cell that both cover. Boxes too thin or
    too small to overlap by the tolerance, or without sound numbers, take no part.
    """
    rows = boxes.select("diagram_id", "id", "parent_id", "x", "y", "width", "height", g.left().alias("left"), g.bottom().alias("bottom"), (g.right() - g.left()).alias("across"), (g.top() - g.bottom()).alias("along"))
    sound = lambda c: (F.col(c) > g.TOLERANCE) & ~F.isnan(c)
    rows = rows.where(sound("across") & sound("along") & (F.col("across") * F.col("along") > g.TOLERANCE))
    level = lambda c: F.when(F.col(c) >= 1e300, TOP_LEVEL).otherwise(F.ceil(F.log(LEVEL_BASE, F.col(c)) + 1e-9).cast("int"))
    rows = rows.withColumn("own", F.struct(level("across").alias("x"), level("along").alias("y")))
    boards = rows.groupBy("diagram_id").agg(F.count("*").alias("n"), F.collect_set("own").alias("levels"))
    one = F.struct(F.lit(TOP_LEVEL).alias("x"), F.lit(TOP_LEVEL).alias("y"))
    small = F.col("n") <= few
    rows = rows.join(boards, "diagram_id").withColumn("own", F.when(small, one).otherwise(F.col("own")))
    rows = rows.withColumn("other", F.explode(F.when(small, F.array(one)).otherwise(F.col("levels"))))
    met = lambda axis: F.greatest(F.col(f"own.{axis}"), F.col(f"other.{axis}"))
    cell = lambda value, axis: F.when(met(axis) >= TOP_LEVEL, 0).otherwise(F.floor(value / F.pow(F.lit(LEVEL_BASE), met(axis))))
    ends = lambda low, high, axis: F.explode(F.array_distinct(F.array(cell(low, axis), cell(high, axis))))
    rows = rows.withColumns({"first_x": cell(F.col("left"), "x"), "first_y": cell(F.col("bottom"), "y")})
    cells = rows.withColumn("cx", ends(g.left(), g.right(), "x")).withColumn("cy", ends(g.bottom(), g.top(), "y"))
    columns = ("id", "parent_id", "x", "y", "width", "height", "first_x", "first_y")
    side = lambda p, mine, theirs: cells.select("diagram_id", "cx", "cy", F.col("own").alias(mine), F.col("other").alias(theirs), *(F.col(c).alias(f"{p}{c}") for c in columns))
    pairs = side("a_", "la", "lb").join(side("b_", "lb", "la"), ["diagram_id", "cx", "cy", "la", "lb"]).where(F.col("a_id") < F.col("b_id"))
    first = (F.col("cx") == F.greatest("a_first_x", "b_first_x")) & (F.col("cy") == F.greatest("a_first_y", "b_first_y"))
    kin = F.coalesce(F.col("a_parent_id") == F.col("b_id"), F.lit(False)) | F.coalesce(F.col("b_parent_id") == F.col("a_id"), F.lit(False))
    return pairs.where(first & ~kin & (g.overlap_area("a_", "b_") > g.TOLERANCE)).select("diagram_id", "a_id", "b_id")


def overlap_findings(boxes: DataFrame) -> DataFrame:
    message = tx.message("overlap", id=F.col("a_id"), other=F.col("b_id"))
    return finding(overlaps(boxes), 6, "overlap", message, F.col("a_id"), F.col("b_id"))


def outside_parent(boxes: DataFrame) -> DataFrame:
    parents = boxes.select("diagram_id", F.col("id").alias("parent_id"), *(F.col(c).alias(f"p_{c}") for c in ("x", "y", "width", "height")))
    bad = boxes.join(parents, ["diagram_id", "parent_id"]).where((g.left() < g.left("p_")) | (g.bottom() < g.bottom("p_")) | (g.right() > g.right("p_")) | (g.top() > g.top("p_")))
    message = tx.message("outside_container", id=F.col("id"), parent_id=F.col("parent_id"))
    return finding(bad, 7, "outside_container", message, F.col("id"), F.col("parent_id"))


def known_boxes(nodes: DataFrame, placements: DataFrame) -> DataFrame:
    """The counting placement of each node that has one, with the node's parent."""
    return last_placements(dealt(placements)).join(dealt(nodes).select("diagram_id", "id", "parent_id"), ["diagram_id", "id"])


def geometry_values(placements: DataFrame) -> DataFrame:
    """Placements of which a number is missing, not finite or not above zero."""
    sound = g.positive(F.col("x")) & g.positive(F.col("y")) & g.positive(F.col("width")) & g.positive(F.col("height"))
    return placements.where(~sound)


def design_findings(nodes: DataFrame, edges: DataFrame, placements: DataFrame, hints: DataFrame, pages: DataFrame) -> DataFrame:
    """All findings of designs whose graphs are normalized already."""
    boxes = kept(known_boxes(nodes, placements))  # read by three rules, two of them joins with itself
    out = duplicate_placements(placements)
    for part in (coverage(nodes, placements), hint_rules(edges, hints), out_of_page(boxes, pages), overlap_findings(boxes), outside_parent(boxes)):
        out = out.unionByName(part)
    return out


def listed(findings: DataFrame) -> DataFrame:
    """diagram_id, n, findings: the messages of each diagram in order, joined by "; "."""
    key = F.struct("phase", "k1", "k2", "sub", "message")
    rows = findings.groupBy("diagram_id").agg(F.array_sort(F.collect_list(key)).alias("all"))
    return rows.select("diagram_id", F.size("all").cast("long").alias("n"), F.array_join(F.transform("all", lambda f: f["message"]), "; ").alias("findings"))


def checked(nodes: DataFrame, edges: DataFrame, placements: DataFrame, hints: DataFrame, pages: DataFrame) -> DataFrame:
    """listed() findings of designs whose graphs break no rule; edges may lack ids, as they are before they are numbered.

    A design is packed into a row and judged there, all in one shuffle; those
    too large for a row go through one table for each rule.
    """
    parts = {
        "nodes": (nodes, ["pos", "id", "parent_id"]), "edges": (edges, ["pos", "id"]), "placements": (placements, ["pos", "node_id", "x", "y", "width", "height"]),
        "hints": (hints, ["pos", "edge_id"]), "pages": (pages, ["page_width", "page_height"]),
    }
    small, large = packed.by_size(parts)
    page = lambda name: F.get("pages", F.lit(0))[name]
    messages = packed.design_messages(*map(F.col, ("nodes", "edges", "placements", "hints")), page("page_width"), page("page_height"))
    rows = kept(packed.pack(small).select("diagram_id", messages.alias("found"))).where(F.size("found") > 0)  # a filter on messages themselves would judge each design twice
    found = rows.select("diagram_id", F.size("found").cast("long").alias("n"), F.array_join("found", "; ").alias("findings"))
    if large is None:
        return found
    of = lambda df: df.join(large, "diagram_id", "left_semi")
    return found.unionByName(listed(design_findings(of(nodes), assign_edge_ids(of(edges)), of(placements), of(hints), of(pages))))


def resolved_critiques(critiques: DataFrame, initial: Column) -> DataFrame:
    """Which design is final, and whether the critique is consistent.

    Approved critiques have no revision; rejected ones have one, and it must be valid.
    """
    revised = F.col("revised_design")
    outcome = (
        F.when(F.col("approved") & revised.isNotNull(), "invalid_critique")
        .when(~F.col("approved") & revised.isNull(), "invalid_critique")
        .when(revised.isNotNull() & ~F.col("revision_valid"), "invalid_critique")
        .otherwise("ok")
    )
    rows = critiques.withColumn("outcome", outcome)
    ok = F.col("outcome") == "ok"
    return rows.withColumns({"revision_applied": ok & revised.isNotNull(), "final_design": F.when(ok, F.coalesce(revised, initial))})


def flat_issues(critiques: DataFrame) -> DataFrame:
    """A row for each issue of each critique, with its place, and for each node it names."""
    issues = critiques.select("run_id", F.posexplode("issues").alias("pos", "issue")).select("run_id", "pos", "issue.*")
    return issues.withColumn("node_id", F.explode_outer("node_ids"))
