"""Graphs as DOT text, and boxes read back from positioned text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tables as t
from ..functions.text import quoted
from ..storage import dealt
from .layout import around_children, fit_page, sized


def number(value: Column) -> Column:
    """A size, which has no more than four decimals and no sign, with all four; a format string is parsed again for each row."""
    n = F.rint(value * 10_000).cast("long")
    return F.concat(((n - n % 10_000) / 10_000).cast("long").cast("string"), F.lit("."), F.lpad((n % 10_000).cast("string"), 4, "0"))


def texts(name: str) -> dict[str, Column]:
    """What lines are made of: head of a diagram, edge, node up to its label, and that label."""
    direction = F.when(F.col("orientation") == "top_to_bottom", "TB").otherwise("LR")
    head = F.concat(F.lit(f'digraph {name} {{\n  graph [rankdir="'), direction, F.lit(f'", nodesep="{t.NODE_GAP:.4f}", ranksep="{t.RANK_GAP:.4f}"];\n  node [fixedsize="true", shape="box"];'))
    node = F.concat(quoted(F.col("id")), F.lit(' [width="'), number(F.col("own_width")), F.lit('", height="'), number(F.col("own_height")), F.lit('", label='))
    weight = t.looked_up(F.col("relation"), t.RELATION_VISUALS, 2).cast("string")
    loose = (F.col("relation") == "association") | (F.col("direction") == "none")
    edge = F.concat(F.lit("  "), quoted(F.col("source")), F.lit(" -> "), quoted(F.col("target")), F.lit(' [weight="'), weight, F.when(loose, F.lit('", constraint="false"];')).otherwise(F.lit('"];')))
    return {"head": head, "node": node, "label": quoted(F.col("wrapped")), "edge": edge}


def opening(name: Column, label: Column) -> Column:
    """The first line of a cluster; label is quoted already."""
    return F.concat(F.lit("  subgraph "), quoted(F.concat(F.lit("cluster_"), name)), F.lit(" {\n    graph [label="), label, F.lit(', margin="24.0000"];'))


def dot_lines(diagrams: DataFrame, nodes: DataFrame, edges: DataFrame, name: str = "diagram") -> DataFrame:
    """diagram_id, section, k1, k2, k3, line: the lines in the order of the keys.

    Free nodes by id, clusters by parent with their children by id, edges by
    source, target and id. name: the graph's name in the first line.
    """
    rows = lambda df, section, k1, k2, k3, line: df.select("diagram_id", F.lit(section).alias("section"), k1.alias("k1"), k2.alias("k2"), k3.alias("k3"), line.alias("line"))
    none = F.lit("")
    said, own = texts(name), sized(nodes)
    node = F.concat(said["node"], said["label"], F.lit("];"))
    parents = nodes.where(F.col("parent_id").isNotNull()).select("diagram_id", F.col("parent_id").alias("id")).distinct()
    free = own.where(F.col("parent_id").isNull()).join(parents, ["diagram_id", "id"], "left_anti")
    clusters = own.join(parents, ["diagram_id", "id"], "left_semi")
    children = own.where(F.col("parent_id").isNotNull())
    parts = [
        rows(diagrams, 0, none, none, none, said["head"]),
        rows(free, 1, F.col("id"), none, none, F.concat(F.lit("  "), node)),
        rows(clusters, 2, F.col("id"), none, none, opening(F.col("id"), said["label"])),
        rows(children, 2, F.col("parent_id"), F.lit("1"), F.col("id"), F.concat(F.lit("    "), node)),
        rows(clusters, 2, F.col("id"), F.lit("2"), none, F.lit("  }")),
        rows(edges, 3, F.col("source"), F.col("target"), F.coalesce("id", F.lit("")), said["edge"]),
        rows(diagrams, 4, none, none, none, F.lit("}")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def export_dot(diagrams: DataFrame, nodes: DataFrame, edges: DataFrame, name: str = "diagram") -> DataFrame:
    """diagram_id, dot: one text for each graph, the lines of dot_lines in their order.

    Each table is read once; which nodes are clusters is told where a diagram's lines lie together.
    """
    said, inside = texts(name), F.col("parent_id").isNotNull()
    node = F.concat(F.when(inside, "    ").otherwise("  "), said["node"])
    rows = lambda df, section, k1, k2, k3, line, size=F.lit(0): df.select("diagram_id", F.struct(section.alias("section"), k1.alias("k1"), k2.alias("k2"), k3.alias("k3"), line.alias("line"), size.alias("size")).alias("x"))
    none = F.lit("")
    parts = [
        rows(diagrams, F.lit(0), none, none, none, said["head"]),
        rows(sized(nodes), F.when(inside, 2).otherwise(1), F.coalesce("parent_id", "id"), F.when(inside, "1").otherwise(""), F.when(inside, F.col("id")).otherwise(""), F.concat(node, said["label"], F.lit("];")), F.length(said["label"])),
        rows(edges, F.lit(3), F.col("source"), F.col("target"), F.coalesce("id", none), said["edge"]),
    ]
    count = lambda section: F.count_if(F.col("x.section") == section).cast("int")
    lists = dealt(reduce(DataFrame.unionByName, parts)).groupBy("diagram_id").agg(F.sort_array(F.collect_list("x")).alias("all"), *(count(i).alias(f"n{i}") for i in range(3)))
    cut = lambda start, n: F.slice("all", start + 1, n)
    n0, n1, n2 = (F.col(f"n{i}") for i in range(3))
    lists = lists.select("diagram_id", "n0", cut(F.lit(0), n0)["line"].alias("heads"), cut(n0, n1).alias("outer"), cut(n0 + n1, n2).alias("inner"), cut(n0 + n1 + n2, F.size("all"))["line"].alias("edges"))
    parents = lists.withColumn("parents", F.array_distinct("inner.k1")).withColumn("n", F.greatest(F.ceil(F.sqrt(F.size("parents"))).cast("int"), F.lit(1)))
    at = lambda id: F.pmod(F.hash(id), F.col("n"))
    lists = parents.withColumn("parents_at", F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.filter("parents", lambda p: at(p) == i)))
    has = lambda id: F.exists(F.get("parents_at", at(id)), lambda p: p == id)  # noqa: E731  # by hash, so that many containers are not compared with each node

    def cluster(x: Column, id: Column) -> Column:
        """The first and the last line of a node's cluster."""
        label = F.substring(x["line"], -2 - x["size"], x["size"])
        own = lambda k2, line: F.struct(F.lit(2).alias("section"), id.alias("k1"), F.lit(k2).alias("k2"), F.lit("").alias("k3"), line.alias("line"), F.lit(0).alias("size"))
        return F.array(own("", opening(id, label)), own("2", F.lit("  }")))

    clusters = lambda items, key: F.flatten(F.transform(F.filter(items, lambda x: has(x[key])), lambda x: cluster(x, x[key])))
    nested = F.when(F.arrays_overlap("inner.k3", "parents"), clusters("inner", "k3")).otherwise(F.slice("inner", 1, 0))
    free = F.filter("outer", lambda x: ~has(x["k1"]))
    lists = lists.select("*", free["line"].alias("free"), F.sort_array(F.concat(clusters("outer", "k1"), nested, "inner"))["line"].alias("boxes"))
    lines = F.concat("heads", "free", "boxes", "edges", F.array_repeat(F.lit("}"), n0))
    return lists.select("diagram_id", F.concat(F.array_join(lines, "\n"), F.lit("\n")).alias("dot"))


#: A field of positioned text: quoted (with escapes) or bare.
FIELD = r'("(?:[^"\\]|\\.)*"|[^\s"]+)'


def parsed_positions(lines: DataFrame) -> DataFrame:
    """diagram_id, id, x, y, width, height, ok, graph_width, graph_height from lines of positioned text (diagram_id, pos, line).

    Margins are added to centres. ok is false for all boxes of a text without a
    graph record of positive size, with a short or unreadable record, or
    without nodes; such a text has one row with a null id.
    """
    rows = lines.select("diagram_id", "pos", F.regexp_extract_all("line", F.lit(FIELD), F.lit(1)).alias("f"))

    def field(i: int) -> Column:
        bare = F.get("f", F.lit(i))
        inside = F.substring(bare, F.lit(2), F.length(bare) - 2)
        return F.when(bare.startswith('"'), F.when(F.contains(inside, F.lit("\\")), F.regexp_replace(inside, r"\\(.)", "$1")).otherwise(inside)).otherwise(bare)

    value = lambda i: field(i).try_cast("double").alias(f"v{i}")
    rows = rows.select("diagram_id", "pos", field(0).alias("kind"), field(1).alias("id"), *map(value, (2, 3, 4, 5)), F.size("f").alias("fields"))
    is_graph, is_node = F.col("kind") == "graph", F.col("kind") == "node"
    lacks = lambda *names: reduce(Column.__or__, (F.col(n).isNull() for n in names))
    bad = F.when(is_graph, (F.col("fields") < 4) | lacks("v2", "v3")).when(is_node, (F.col("fields") < 6) | lacks("v2", "v3", "v4", "v5"))
    rows = dealt(rows.withColumns({"bad": bad, "graph": F.coalesce(is_graph, F.lit(False)), "box": F.coalesce(is_node & ~bad, F.lit(False))}).drop("kind", "fields"))
    text = Window.partitionBy("diagram_id")
    page = F.max_by(F.struct(F.col("v2").alias("w"), F.col("v3").alias("h")), F.when(F.col("graph"), F.col("pos"))).over(text)
    rows = rows.withColumns({"broken": F.bool_or("bad").over(text), "page": page, "boxes": F.count(F.when(F.col("box"), 1)).over(text)}).where("box or boxes = 0")
    ok = F.coalesce(~F.col("broken") & (F.col("page.w") > 0) & (F.col("page.h") > 0) & (F.col("boxes") > 0), F.lit(False))
    own = lambda value: F.when(F.col("box"), value)
    numbers = {"x": F.bround(F.col("v2") + t.MARGIN, 4), "y": F.bround(F.col("v3") + t.MARGIN, 4), "width": F.bround("v4", 4), "height": F.bround("v5", 4)}
    flat = rows.select("diagram_id", ok.alias("ok"), F.col("page.w").alias("graph_width"), F.col("page.h").alias("graph_height"), own(F.col("id")).alias("id"), "pos", *(own(v).alias(k) for k, v in numbers.items()))
    return flat.groupBy("diagram_id", "ok", "graph_width", "graph_height", "id").agg(*(F.max_by(c, "pos").alias(c) for c in numbers))


def with_own_sizes(boxes: DataFrame, nodes: DataFrame) -> DataFrame:
    """boxes with the computed sizes of their nodes, centres kept; unknown ids keep what they have."""
    own = sized(nodes).select("diagram_id", "id", "own_width", "own_height")
    return boxes.join(own, ["diagram_id", "id"], "left").withColumns({"width": F.coalesce("own_width", "width"), "height": F.coalesce("own_height", "height")}).drop("own_width", "own_height")




def imported(nodes: DataFrame, lines: DataFrame) -> DataFrame:
    """diagram_id, id, x, y, width, height, page_width, page_height of all nodes, from positioned text: parsed, with the nodes' own sizes, containers around their children, on a page that holds all and is no smaller than the text's.

    Only diagrams whose text is ok, gives a box to every node that is no
    container, and names no others; unplaced() tells the rest.
    """
    boxes = parsed_positions(lines).where("ok")
    good = nodes.select("diagram_id").distinct().join(unplaced(nodes, lines).select("diagram_id").distinct(), "diagram_id", "left_anti")
    parents = nodes.where(F.col("parent_id").isNotNull()).select("diagram_id", F.col("parent_id").alias("id"), F.lit(True).alias("inside")).distinct()
    rows = sized(nodes).join(good, "diagram_id").join(boxes.select("diagram_id", "id", "x", "y"), ["diagram_id", "id"], "left").join(parents, ["diagram_id", "id"], "left")
    rows = around_children(rows.withColumn("is_container", F.coalesce("inside", F.lit(False)))).select("diagram_id", "id", "x", "y", "width", "height")
    pages = boxes.select("diagram_id", "graph_width", "graph_height").distinct()
    out = fit_page(rows.join(pages, "diagram_id"), t.MARGIN, F.col("graph_width") + 2 * t.MARGIN, F.col("graph_height") + 2 * t.MARGIN)
    return out.drop("graph_width", "graph_height")


def unplaced(nodes: DataFrame, lines: DataFrame) -> DataFrame:
    """diagram_id, id, rule of what keeps a positioned text from being a layout: malformed, missing (a node without a box) or unknown (a box without a node)."""
    boxes = parsed_positions(lines)
    parents = nodes.where(F.col("parent_id").isNotNull()).select("diagram_id", F.col("parent_id").alias("id")).distinct()
    own = nodes.select("diagram_id", "id", F.lit(True).alias("is_node")).join(parents, ["diagram_id", "id"], "left_anti")
    both = own.join(boxes.where("ok").select("diagram_id", "id", F.lit(True).alias("is_box")), ["diagram_id", "id"], "full_outer")
    both = both.join(parents.withColumn("inside", F.lit(True)), ["diagram_id", "id"], "left").where("inside is null")
    both = both.join(boxes.where("not ok").select("diagram_id").distinct(), "diagram_id", "left_anti")
    rule = F.when(F.col("is_box").isNull(), "missing").when(F.col("is_node").isNull(), "unknown")
    malformed = boxes.where("not ok").select("diagram_id", F.lit(None).cast("string").alias("id"), F.lit("malformed").alias("rule")).distinct()
    return both.select("diagram_id", "id", rule.alias("rule")).where("rule is not null").unionByName(malformed)
