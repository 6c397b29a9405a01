"""Boxes given by centre, width and height, in inches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables, text

#: Overlaps and page bounds of drawings are judged with this tolerance.
TOLERANCE = 1e-6


def left(b: str = "") -> Column:
    return F.col(f"{b}x") - F.col(f"{b}width") / 2


def right(b: str = "") -> Column:
    return F.col(f"{b}x") + F.col(f"{b}width") / 2


def bottom(b: str = "") -> Column:
    return F.col(f"{b}y") - F.col(f"{b}height") / 2


def top(b: str = "") -> Column:
    return F.col(f"{b}y") + F.col(f"{b}height") / 2


def overlap_area(a: str, b: str) -> Column:
    """The common area; 0 if it is thinner than the tolerance."""
    width = F.least(right(a), right(b)) - F.greatest(left(a), left(b))
    height = F.least(top(a), top(b)) - F.greatest(bottom(a), bottom(b))
    return F.when((width <= TOLERANCE) | (height <= TOLERANCE), 0.0).otherwise(width * height)


def outside(page_width: Column, page_height: Column, tolerance: float = 0.0) -> Column:
    """Whether x, y, width, height leave the page."""
    return (left() < -tolerance) | (bottom() < -tolerance) | (right() > page_width + tolerance) | (top() > page_height + tolerance)


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))


def positive(value: Column) -> Column:
    """Finite and above zero (NaN sorts above all numbers in Spark, so it is ruled out by name)."""
    return finite(value) & (value > 0)


def lines_of(node_type: Column, label: Column) -> Column:
    return F.when(tables.is_container(node_type), text.wrap(label, 48)).otherwise(text.wrap(label, 30))


def node_width(node_type: Column, lines: Column) -> Column:
    measured = F.array_max(F.transform(lines, F.length)) * 0.11 + 0.6
    limit = F.when(tables.is_container(node_type), 7.5).otherwise(5.0)
    return F.bround(F.least(F.greatest(tables.looked_up(node_type, tables.NODE_VISUALS, 1), measured), limit), 4)


def node_height(node_type: Column, lines: Column, reference: Column) -> Column:
    reserve = F.when(F.coalesce(reference, F.lit("")) != "", 0.3).otherwise(0.0)
    measured = F.size(lines) * 0.28 + 0.36 + reserve
    limit = F.when(tables.is_container(node_type), 4.0).otherwise(3.0)
    return F.bround(F.least(F.greatest(tables.looked_up(node_type, tables.NODE_VISUALS, 2) + reserve, measured), limit), 4)
