"""Comparison of a drawing before a move, after it, and reopened."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

#: Pins persist if they stay within this.
NEAR = 1e-4


def near(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= NEAR


def first_by_label(shapes: DataFrame) -> DataFrame:
    """Of the shapes with one label (white space apart) the first: page order, then depth first inside a group."""
    rows = shapes.withColumn("label", text.one_line(F.col("label")))
    nth = F.row_number().over(Window.partitionBy("drawing", "label").orderBy("root_pos", "dfs_pos"))
    return rows.withColumn("nth", nth).where("nth = 1").drop("nth")


STAGES = (("b", "before"), ("m", "moved"), ("r", "reopened"))


def staged(before: DataFrame, moved: DataFrame, reopened: DataFrame) -> DataFrame:
    """All shapes of the three stages: drawing, label (white space apart), root_pos, dfs_pos (0: top level), pin_x, pin_y, signatures, stage."""
    columns = ("drawing", text.one_line(F.col("label")).alias("label"), "root_pos", "dfs_pos", "pin_x", "pin_y", "signatures")
    sides = [rows.select(*columns, F.lit(p).alias("stage")) for (p, _), rows in zip(STAGES, (before, moved, reopened), strict=True)]
    return sides[0].unionByName(sides[1]).unionByName(sides[2])


def inventory(before: DataFrame, moved: DataFrame, reopened: DataFrame) -> DataFrame:
    """drawing, kind (shape: by label, top level only; connection: by signature), item, before, moved, reopened: what the pages hold, as bags of items, where the bags differ."""
    rows = staged(before, moved, reopened)
    of = lambda df, kind, item: df.select("drawing", F.lit(kind).alias("kind"), item.alias("item"), "stage")
    items = of(rows.where("dfs_pos = 0"), "shape", F.col("label")).unionByName(of(rows, "connection", F.explode("signatures")))
    bags = items.groupBy("drawing", "kind", "item").agg(*(F.count(F.when(F.col("stage") == p, 1)).alias(n) for p, n in STAGES))
    return bags.where("before <> moved or moved <> reopened")


def unfolded(rows: DataFrame) -> DataFrame:
    """staged() rows of one table that holds all stages of a shape in a row, read once: drawing, label, root_pos, dfs_pos, and before, moved, reopened (pin_x, pin_y, signatures; null: not there)."""
    rows = rows.withColumn("label", text.one_line(F.col("label")))
    stages = F.array(*(F.struct(F.lit(p).alias("stage"), F.col(name).alias("shape")) for p, name in STAGES))
    rows = rows.select("drawing", "label", "root_pos", "dfs_pos", F.inline(stages)).where("shape is not null")
    return rows.select("drawing", "label", "root_pos", "dfs_pos", "shape.*", "stage")


def compared(before: DataFrame, moved: DataFrame, reopened: DataFrame) -> DataFrame:
    """compared_stages() of a table for each stage."""
    return compared_stages(staged(before, moved, reopened))


def compared_stages(rows: DataFrame) -> DataFrame:
    """drawing, shapes, moved_far, pins_lost, signatures_changed of each drawing, and its shapes and connections in each stage.

    rows: all shapes of the pages (see staged). A page's counts are those
    of all its top-level shapes and connections; positions and signatures are
    compared for the first shape of each label, which is looked up in each stage
    anew. A label that a stage lacks counts as moved, lost and changed.
    """
    shape = F.struct("pin_x", "pin_y", F.array_sort("signatures").alias("signatures"))
    of = lambda p, value: F.when(F.col("stage") == p, value)
    place = F.struct("root_pos", "dfs_pos")
    top = F.when(F.col("dfs_pos") == 0, 1)
    by_label = rows.groupBy("drawing", "label").agg(
        *(F.min_by(shape, of(p, place)).alias(p) for p, _ in STAGES),
        *(F.count(of(p, top)).alias(f"{p}_shapes") for p, _ in STAGES), *(F.coalesce(F.sum(of(p, F.size("signatures"))), F.lit(0)).alias(f"{p}_connections") for p, _ in STAGES),
    )

    def differ(a: str, b: str, unlike: Column) -> Column:
        here = F.col(a).isNotNull(), F.col(b).isNotNull()
        return (here[0] != here[1]) | (here[0] & here[1] & unlike)

    far = lambda a, b: differ(a, b, ~(near(F.col(a)["pin_x"], F.col(b)["pin_x"]) & near(F.col(a)["pin_y"], F.col(b)["pin_y"])))
    other = lambda a, b: differ(a, b, F.col(a)["signatures"] != F.col(b)["signatures"])
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    return by_label.groupBy("drawing").agg(
        F.count("*").alias("shapes"), count(far("b", "m")).alias("moved_far"), count(far("m", "r")).alias("pins_lost"), count(other("b", "m") | other("m", "r")).alias("signatures_changed"),
        *(F.sum(f"{p}_{what}").cast("long").alias(f"{what}_{n}") for what in ("shapes", "connections") for p, n in STAGES),
    )


def outcomes(comparison: DataFrame) -> DataFrame:
    """drawing, failed: the first check that a compared drawing fails, or null."""
    same = lambda what: (F.col(f"{what}_before") == F.col(f"{what}_moved")) & (F.col(f"{what}_moved") == F.col(f"{what}_reopened"))
    failed = F.when(~same("shapes"), "shape_count").when(~same("connections"), "connection_count").when(F.col("signatures_changed") > 0, "signatures").when(F.col("pins_lost") > 0, "pins")
    return comparison.select("drawing", failed.alias("failed"))
