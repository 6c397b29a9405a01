"""The rules of graphs and designs over packed rows: a diagram's lists in one row, all rules as expressions on it.

pack() brings the tables of a diagram together in one shuffle; responses come
packed anyway. The rules and their order are those of normalize and designs,
which stay the way for diagrams of more than LARGE list items: what follows
compares items of a list with each other, and one row has to fit a task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import tables, text
from ..functions.binding import let
from ..storage import kept

#: Items (nodes, edges, placements, hints) of a diagram that is judged in one row.
LARGE = 256
EDGE = ("id", "source", "target", "relation", "direction", "label", "style")


def typed_union(parts: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """diagram_id and a struct column for each part, one of them set in each row."""
    kinds = {name: df.select(F.struct(*columns).alias(name)).schema[name].dataType for name, (df, columns) in parts.items()}
    rows = [df.select("diagram_id", *(F.struct(*columns).alias(n) if n == name else F.lit(None).cast(kinds[n]).alias(n) for n in kinds)) for name, (df, columns) in parts.items()]
    return reduce(DataFrame.unionByName, rows)


def pack(parts: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """diagram_id and a list for each part (table, columns; lists are in the order of the columns, so the place comes first)."""
    lists = [F.sort_array(F.collect_list(name)).alias(name) for name in parts]
    return typed_union(parts).groupBy("diagram_id").agg(*lists)


def large_ids(parts: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """diagram_id of diagrams with more than LARGE items."""
    rows = reduce(DataFrame.unionByName, [df.select("diagram_id") for df, _ in parts.values()])
    return rows.groupBy("diagram_id").agg(F.count("*").alias("n")).where(F.col("n") > LARGE).select("diagram_id")


def by_size(parts: dict[str, tuple[DataFrame, list[str]]]) -> tuple[dict[str, tuple[DataFrame, list[str]]], DataFrame | None]:
    """The parts without large diagrams, and the ids of these (None if there are none: one count of all items tells)."""
    large = kept(large_ids(parts))
    if large.isEmpty():
        return parts, None
    return {name: (df.join(large, "diagram_id", "left_anti"), columns) for name, (df, columns) in parts.items()}, large


def each(items: Column, name: str) -> Column:
    return F.transform(items, lambda x: x[name])


def first(items: Column) -> Column:
    return F.get(items, F.lit(0))


def repeats(items: Column, key: str) -> Column:
    """The items whose key an earlier item has; no search where all keys differ."""
    none = F.slice(items, 1, 0)
    search = lambda keys: F.filter(items, lambda x, i: F.array_position(keys, x[key]) <= i)
    return let(each(items, key), lambda keys: F.when(F.size(F.array_distinct(keys)) == F.size(keys), none).otherwise(search(keys)))


def rule(name: str | Column, message: Column) -> Column:
    return F.struct((F.lit(name) if isinstance(name, str) else name).alias("rule"), message.alias("message"))


def named(found: Column, name: str, **values: str) -> Column:
    """The finding `name` told of an item, or null if there is none."""
    return let(found, lambda x: F.when(x.isNotNull(), rule(name, text.message(name, **{k: x[v] for k, v in values.items()}))))


def dangling(ids: Column, edges: Column) -> Column:
    end = lambda e, name: F.struct(F.lit(name).alias("end"), e[name].alias("id"))
    ends = F.flatten(F.transform(edges, lambda e: F.array(end(e, "source"), end(e, "target"))))
    return named(first(F.filter(ends, lambda x: ~F.coalesce(F.array_contains(ids, x["id"]), F.lit(False)))), "dangling_edge", end="end", id="id")


def wrong_parent(nodes: Column, ids: Column, kids: Column) -> Column:
    able = each(F.filter(nodes, lambda n: tables.is_container(n["type"])), "id")

    def told(able: Column) -> Column:
        bad = first(F.filter(kids, lambda k: (k["parent_id"] == k["id"]) | ~F.array_contains(able, k["parent_id"])))
        own = lambda b, name: rule(name, text.message(name, id=b["id"], parent_id=b["parent_id"]))
        which = lambda b: F.when(b["parent_id"] == b["id"], own(b, "self_parent")).when(~F.array_contains(ids, b["parent_id"]), own(b, "missing_parent")).when(b.isNotNull(), own(b, "parent_type"))
        return let(bad, which)

    return let(able, told)


def circle(nodes: Column, ids: Column) -> Column:
    """The first node from which the chain of parents never ends (steps double; 0 stands for no parent)."""
    up = F.transform(nodes, lambda n: F.coalesce(F.array_position(ids, n["parent_id"]).cast("int"), F.lit(0)))
    jump = lambda up: F.transform(up, lambda p: F.when(p == 0, 0).otherwise(F.get(up, p - 1)))
    far = F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(F.size(ids) + 1)).cast("int")), up, lambda up, _: let(up, jump))
    return let(far, lambda far: first(F.filter(nodes, lambda _, i: F.get(far, i) > 0)))


def too_deep(nodes: Column, ids: Column, kids: Column) -> Column:
    """A circle of parents, else the first node whose parent has a parent."""

    def told(deep: Column) -> Column:
        looped = lambda c: F.coalesce(named(c, "containment_cycle", id="id"), named(first(deep), "containment_depth", id="id"))
        return F.when(F.size(deep) > 0, let(circle(nodes, ids), looped))

    return let(each(kids, "id"), lambda named_: let(F.filter(kids, lambda k: F.array_contains(named_, k["parent_id"])), told))


def failure(nodes: Column, edges: Column, geometry: tuple[str, ...] = ()) -> Column:
    """(rule, message) of the first rule that a graph breaks, null if it breaks none. geometry: fields that an extracted node must not have."""

    def told(nodes: Column, edges: Column, ids: Column, kids: Column) -> Column:
        named_edges = F.filter(edges, lambda e: F.coalesce(e["id"], F.lit("")) != "")
        references = F.filter(F.transform(nodes, lambda n: F.struct(text.strip(n["reference_number"]).alias("id"))), lambda r: F.coalesce(r["id"], F.lit("")) != "")
        rules = [
            named(first(repeats(nodes, "id")), "duplicate_node", id="id"),
            named(first(repeats(named_edges, "id")), "duplicate_edge", id="id"),
            dangling(ids, edges),
            F.when(F.size(kids) > 0, F.coalesce(wrong_parent(nodes, ids, kids), too_deep(nodes, ids, kids))),
            named(first(repeats(references, "id")), "duplicate_reference", id="id"),
        ]
        if geometry:
            drawn = F.exists(nodes, lambda n: F.coalesce(*(n[c] for c in geometry)).isNotNull())
            rules.insert(0, F.when(drawn, rule("geometry", text.message("geometry"))))
        return F.coalesce(*rules)

    parts = F.struct(nodes.alias("nodes"), edges.alias("edges"), each(nodes, "id").alias("ids"), F.filter(nodes, lambda n: n["parent_id"].isNotNull()).alias("kids"))
    return let(parts, lambda p: told(p["nodes"], p["edges"], p["ids"], p["kids"]))


def collapsed(edges: Column) -> Column:
    """edges as collapse_reciprocal leaves them: the k-th edge of a way pairs with the k-th back, self-loops first with second."""
    key = lambda e: F.struct(F.least(e["source"], e["target"]).alias("low"), F.greatest(e["source"], e["target"]).alias("high"), e["relation"].alias("relation"), e["label"].alias("label"), e["style"].alias("style"))
    forward = lambda e: F.coalesce(e["direction"] == "forward", F.lit(False))
    keys = F.transform(F.filter(edges, forward), key)

    def paired(marked: Column) -> Column:
        """Slots: k-th of its way, or k-th pair of a self-loop's."""
        before = lambda m: F.size(F.filter(marked, lambda o: (o["i"] < m["i"]) & o["key"].eqNullSafe(m["key"]) & (o["way"] == m["way"])))
        slotted = F.transform(marked, lambda m: F.struct(m["i"].alias("i"), m["key"].alias("key"), m["way"].alias("way"), F.when(m["loop"], F.floor(before(m) / 2).cast("int")).otherwise(before(m)).alias("slot"), m["loop"].alias("loop")))

        def joined(slotted: Column) -> Column:
            partner = lambda i: first(F.filter(slotted, lambda m: m["i"] == i))
            others = lambda m: F.filter(slotted, lambda o: (o["i"] != m["i"]) & o["key"].eqNullSafe(m["key"]) & (o["slot"] == m["slot"]) & (m["loop"] | (o["way"] != m["way"])))
            met = F.transform(edges, lambda e, i: F.struct(e.alias("e"), i.alias("i"), let(partner(i), lambda m: F.when(m.isNotNull(), F.get(each(others(m), "i"), F.lit(0)))).alias("with")))
            kept = F.filter(met, lambda x: x["with"].isNull() | (x["i"] < x["with"]))
            return F.transform(kept, lambda x: F.when(x["with"].isNotNull(), x["e"].withField("direction", F.lit("bidirectional"))).otherwise(x["e"]))

        return let(slotted, joined)

    every = F.transform(edges, lambda e, i: F.struct(i.alias("i"), key(e).alias("key"), (e["source"] == F.least(e["source"], e["target"])).alias("way"), (e["source"] == e["target"]).alias("loop"), forward(e).alias("forward")))
    pairs = let(F.filter(every, lambda m: m["forward"]), paired)
    return F.when(F.size(F.array_distinct(keys)) == F.size(keys), edges).otherwise(pairs)


def edge_ids(edges: Column) -> Column:
    """All ids that the edges have or get: the k-th edge without one gets the k-th free e<n>."""
    ids = F.transform(edges, lambda e: F.coalesce(e["id"], F.lit("")))
    free = lambda n, used: F.array_except(F.transform(F.sequence(F.lit(1), n), lambda k: F.concat(F.lit("e"), k.cast("string"))), used)
    filled = lambda n, used: F.when(n > F.size(used), F.concat(used, F.slice(free(n, used), F.lit(1), n - F.size(used)))).otherwise(used)
    return let(F.array_remove(ids, ""), lambda used: filled(F.size(edges), used))


def box(p: Column) -> dict[str, Column]:
    return {"left": p["x"] - p["width"] / 2, "right": p["x"] + p["width"] / 2, "bottom": p["y"] - p["height"] / 2, "top": p["y"] + p["height"] / 2}


def design_messages(nodes: Column, edges: Column, placements: Column, hints: Column, page_width: Column, page_height: Column) -> Column:
    """The messages of all rules for placements, in their order, of a design whose graph breaks no rule."""
    say = lambda items, name, **values: F.transform(items, lambda x: text.message(name, **{k: x[v] for k, v in values.items()}))

    def told(ids: Column, placed: Column) -> Column:
        missing = F.array_sort(F.array_distinct(F.array_except(ids, placed)))
        unknown = F.array_sort(F.array_except(placed, ids))
        lists = [
            say(repeats(placements, "node_id"), "duplicate_placement", id="node_id"),
            F.transform(missing, lambda i: text.message("missing_placement", id=i)),
            F.transform(unknown, lambda i: text.message("unknown_placement", id=i)),
            let(edge_ids(edges), hint_messages),
            let(boxes(ids, placed), box_messages),
        ]
        return F.concat(*lists)

    def hint_messages(known: Column) -> Column:
        keys = each(hints, "edge_id")
        of = lambda keys: F.flatten(F.transform(hints, lambda h, i: F.array_compact(F.array(
            F.when(F.array_position(keys, h["edge_id"]) <= i, text.message("duplicate_hint", id=h["edge_id"])),
            F.when(~F.array_contains(known, h["edge_id"]), text.message("unknown_hint", id=h["edge_id"]))))))
        return let(keys, of)

    def boxes(ids: Column, placed: Column) -> Column:
        """The last placement of each node, sorted by id."""
        parent = lambda p: F.get(nodes, F.array_position(ids, p["node_id"]).cast("int") - 1)["parent_id"]
        known = F.filter(placements, lambda p: F.array_contains(ids, p["node_id"]))
        search = F.filter(placements, lambda p, i: F.array_contains(ids, p["node_id"]) & ~F.exists(F.slice(placements, i + 2, F.size(placements)), lambda q: q["node_id"] == p["node_id"]))
        last = F.when(F.size(placed) == F.size(placements), known).otherwise(search)
        return F.sort_array(F.transform(last, lambda p: F.struct(p["node_id"].alias("id"), parent(p).alias("parent_id"), *(c.alias(n) for n, c in box(p).items()))))

    def box_messages(found: Column) -> Column:
        outside = F.filter(found, lambda b: (b["left"] < 0) | (b["bottom"] < 0) | (b["right"] > page_width) | (b["top"] > page_height))
        kin = lambda a, b: F.coalesce(a["parent_id"] == b["id"], F.lit(False)) | F.coalesce(b["parent_id"] == a["id"], F.lit(False))
        across = lambda a, b: F.least(a["right"], b["right"]) - F.greatest(a["left"], b["left"])
        along = lambda a, b: F.least(a["top"], b["top"]) - F.greatest(a["bottom"], b["bottom"])
        gone = lambda high, low: high - low <= 0  # noqa: E731  never of NaN
        apart = lambda a, b: F.coalesce(gone(a["right"], b["left"]) | gone(b["right"], a["left"]) | gone(a["top"], b["bottom"]) | gone(b["top"], a["bottom"]), F.lit(False))  # noqa: E731  most pairs are, which is told soonest
        meet = lambda a, b: ~apart(a, b) & (across(a, b) > g.TOLERANCE) & (along(a, b) > g.TOLERANCE) & (across(a, b) * along(a, b) > g.TOLERANCE) & ~kin(a, b)
        met = F.flatten(F.transform(found, lambda a, i: F.transform(F.filter(F.slice(found, i + 2, F.size(found)), lambda b: meet(a, b)), lambda b: text.message("overlap", id=a["id"], other=b["id"]))))
        leaves = lambda b, p: (b["left"] < p["left"]) | (b["bottom"] < p["bottom"]) | (b["right"] > p["right"]) | (b["top"] > p["top"])
        around = lambda holders, b: first(F.filter(holders, lambda p: p["id"] == b["parent_id"]))
        beyond = lambda holders: F.filter(found, lambda b: b["parent_id"].isNotNull() & F.coalesce(let(around(holders, b), lambda p: leaves(b, p)), F.lit(False)))
        parents = F.array_compact(F.array_distinct(each(found, "parent_id")))
        out = let(let(parents, lambda ids: F.filter(found, lambda p: F.array_contains(ids, p["id"]))), beyond)
        return F.concat(say(outside, "outside_page", id="id"), met, say(out, "outside_container", id="id", parent_id="parent_id"))

    return let(F.struct(each(nodes, "id").alias("ids"), F.array_distinct(each(placements, "node_id")).alias("placed")), lambda s: told(s["ids"], s["placed"]))
