"""Comparison of graphs with reviewed ones, field by field, and reports over cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import let
from ..storage import kept
from . import attempts as responses
from . import packed

MISSING = "<missing>"
NODE_FIELDS = ("height", "id", "label", "notes", "parent_id", "reference_number", "type", "width", "x", "y")
EDGE_FIELDS = ("direction", "label", "relation", "source", "style", "target")
GRAPH_FIELDS = ("diagram_type", "orientation", "title")


def graph_documents(diagrams: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """diagram_id, document: each graph as JSON with sorted keys, without nulls and without the ids of edges, in one shuffle. Fields that a table lacks are absent."""
    own = lambda df, fields: [f for f in fields if f in df.columns]
    parts = {"diagrams": (diagrams, own(diagrams, GRAPH_FIELDS)), "nodes": (nodes, ["pos", *own(nodes, NODE_FIELDS)]), "edges": (edges, ["pos", *own(edges, EDGE_FIELDS)])}
    fields = lambda name: F.transform(name, lambda x: F.struct(*(x[f].alias(f) for f in parts[name][1] if f != "pos"))).alias(name)
    top = {f: F.get("diagrams", F.lit(0))[f].alias(f) for f in parts["diagrams"][1]} | {name: fields(name) for name in ("nodes", "edges")}
    return packed.pack(parts).select("diagram_id", F.to_json(F.struct(*(top[f] for f in sorted(top)))).alias("document"))


def children(path: Column, expected: Column, actual: Column) -> Column:
    """array of (path, expected, actual): what two documents of one kind hold, by sorted key or by place."""
    child = lambda at, e, a: F.struct(at.alias("path"), F.to_json(e).alias("expected"), F.to_json(a).alias("actual"))
    read = lambda kind: F.struct(*(F.try_variant_get(F.try_parse_json(v), "$", kind).alias(n) for n, v in (("e", expected), ("a", actual))))
    keys = lambda m: F.sort_array(F.array_union(F.map_keys(m["e"]), F.map_keys(m["a"])))
    named = lambda k: F.when(path == "", k).otherwise(F.concat(path, F.lit("."), k))
    of_objects = let(read("map<string,variant>"), lambda m: F.transform(keys(m), lambda k: child(named(k), m["e"][k], m["a"][k])))
    size = lambda m: F.greatest(F.size(m["e"]), F.size(m["a"]))
    placed = lambda i: F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))
    of_lists = let(read("array<variant>"), lambda m: F.transform(F.when(size(m) > 0, F.sequence(F.lit(0), size(m) - 1)).otherwise(F.array().cast("array<int>")), lambda i: child(placed(i), F.get(m["e"], i), F.get(m["a"], i))))
    return F.when(F.startswith(expected, F.lit("{")), of_objects).otherwise(of_lists)


def structural_differences(pairs: DataFrame, key: str) -> DataFrame:
    """key, path, expected, actual of all places at which two documents (key, expected, actual: JSON texts) differ, to any depth.

    Objects are compared by the keys of either, lists place by place; what one
    side lacks is one difference that holds the whole of the other's, and so are
    values of unlike kinds. Numbers are compared as numbers. No level of the
    documents takes a shuffle, and equal parts go no further down.
    """
    both = lambda mark: F.startswith("expected", F.lit(mark)) & F.startswith("actual", F.lit(mark))
    number = lambda c: F.when(~F.startswith(c, F.lit('"')), F.col(c).try_cast("double"))
    same = F.col("expected").eqNullSafe(F.col("actual")) | F.coalesce(number("expected") == number("actual"), F.lit(False))
    shown = lambda c: F.coalesce(F.when(F.startswith(c, F.lit('"')), F.try_variant_get(F.try_parse_json(F.col(c)), "$", "string")).otherwise(F.col(c)), F.lit(MISSING)).alias(c)
    told = lambda rows: rows.where("not deeper").select(key, "path", shown("expected"), shown("actual"))
    plain = lambda c: F.nullif(F.to_json(F.try_parse_json(F.col(c))), F.lit("null")).alias(c)  # noqa: E731  keys sorted, white space gone
    rows, found = kept(pairs.select(key, F.lit("").alias("path"), plain("expected"), plain("actual"))), []  # a filter on expressions would parse the documents for each use of them
    while True:
        rows = kept(rows.where(~same).withColumn("deeper", F.coalesce(both("{") | both("["), F.lit(False))))
        found.append(told(rows))
        rows = rows.where("deeper")
        if rows.isEmpty():
            break
        rows = rows.select(key, F.inline_outer(children(F.col("path"), F.col("expected"), F.col("actual"))))  # outer, as Spark asks for the size of an inner one's list first, and computes it twice; the nulls of an empty one are equal
        rows = rows.select(key, "path", *(F.when(F.col(c) != "null", F.col(c)).alias(c) for c in ("expected", "actual")))  # JSON null counts as absent
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def list_differences(expected: DataFrame, actual: DataFrame, key: str, name: str, fields: list[str]) -> DataFrame:
    """key, k, path, expected, actual of list elements that differ.

    An element that one side lacks is one difference that holds the whole
    element; else each field is one. Null counts as absent.
    """
    side = lambda rows, p: rows.select(key, "pos", F.lit(True).alias(f"{p}there"), *(F.col(f).cast("string").alias(f"{p}{f}") for f in fields))
    both = side(expected, "e_").join(side(actual, "a_"), [key, "pos"], "full_outer")
    whole = lambda p: F.to_json(F.struct(*(F.col(f"{p}{f}").alias(f) for f in sorted(fields))))
    place = F.concat(F.lit(f"{name}["), F.col("pos").cast("string"), F.lit("]"))
    lost = F.col("e_there").isNull() | F.col("a_there").isNull()
    shown = lambda p, value: F.when(F.col(f"{p}there").isNull(), MISSING).otherwise(value)
    element = F.struct(place.alias("path"), shown("e_", whole("e_")).alias("expected"), shown("a_", whole("a_")).alias("actual"), lost.alias("differs"))
    each = [
        F.struct(F.concat(place, F.lit(f".{f}")).alias("path"), F.coalesce(f"e_{f}", F.lit(MISSING)).alias("expected"), F.coalesce(f"a_{f}", F.lit(MISSING)).alias("actual"), (~lost & ~F.col(f"e_{f}").eqNullSafe(F.col(f"a_{f}"))).alias("differs"))
        for f in sorted(fields)
    ]
    rows = both.select(key, "pos", F.explode(F.filter(F.array(element, *each), lambda d: d["differs"])).alias("d"))
    return rows.select(key, F.col("pos").alias("k"), "d.path", "d.expected", "d.actual")


def field_differences(expected: DataFrame, actual: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """The same for single fields of a graph, such as its title."""
    side = lambda rows, p: rows.select(key, *(F.col(f).cast("string").alias(f"{p}{f}") for f in fields))
    both = side(expected, "e_").join(side(actual, "a_"), key)
    each = [F.struct(F.lit(f).alias("path"), F.coalesce(f"e_{f}", F.lit(MISSING)).alias("expected"), F.coalesce(f"a_{f}", F.lit(MISSING)).alias("actual"), (~F.col(f"e_{f}").eqNullSafe(F.col(f"a_{f}"))).alias("differs")) for f in sorted(fields)]
    rows = both.select(key, F.explode(F.filter(F.array(*each), lambda d: d["differs"])).alias("d"))
    return rows.select(key, F.lit(-1).cast("long").alias("k"), "d.path", "d.expected", "d.actual")


def case_results(answers: DataFrame, differences: DataFrame, error_marked: DataFrame) -> DataFrame:
    """case_id, status, actual, differences.

    answers: case_id, actual (graph, no_diagram or the name of a failure).
    no_diagram matches where an error is expected; a graph never does there;
    a failure is an error; else a graph matches if nothing differs.
    """
    counts = differences.groupBy("case_id").agg(F.count("*").alias("differences"))
    rows = answers.join(counts, "case_id", "left").join(error_marked.select("case_id", F.lit(True).alias("marked")).distinct(), "case_id", "left")
    marked = F.col("marked").isNotNull()
    n = F.coalesce("differences", F.lit(0))
    status = (
        F.when((F.col("actual") == "no_diagram") & marked, "match").when(F.col("actual") == "no_diagram", "mismatch")
        .when(F.col("actual") != "graph", "error").when(marked | (n > 0), "mismatch").otherwise("match")
    )
    return rows.select("case_id", status.alias("status"), "actual", F.when((F.col("actual") == "graph") & ~marked, n).otherwise(0).cast("long").alias("differences"))


def report(cases: DataFrame, *by: str) -> DataFrame:
    """case_count and mismatch_count (all that do not match, errors too)."""
    return cases.groupBy(*by).agg(F.count("*").alias("case_count"), F.sum((F.col("status") != "match").cast("long")).alias("mismatch_count"))


def document_of(graph: Column, nodes: tuple[str, ...], edges: Column) -> Column:
    """A graph as the JSON by which graphs are compared: sorted keys, no nulls, no ids of edges."""
    pick = lambda items, fields: F.transform(items, lambda x: F.struct(*(x[f].alias(f) for f in fields)))
    return F.to_json(F.struct(graph["diagram_type"].alias("diagram_type"), pick(edges, EDGE_FIELDS).alias("edges"), pick(graph["nodes"], nodes).alias("nodes"), graph["orientation"].alias("orientation"), graph["title"].alias("title")))


def evaluated(requests: DataFrame, expected: DataFrame, error_marks: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cases, differences, documents) of a corpus: requests (case_id, text), reviewed graphs (case_id and the graph's columns), cases of which an error is expected, and answers.

    answers: case_id, attempt_no, content, request_id, elapsed_ms, failure (the
    name of what kept a case from being answered, else null). An answer is
    decoded, judged and repaired once, as in attempts; what is left of it is
    compared as a structure. documents: case_id, document of each graph.
    """
    failed = answers.where(F.col("failure").isNotNull()).groupBy("case_id").agg(F.min("failure").alias("failure"))
    given = answers.where(F.col("failure").isNull()).withColumnRenamed("case_id", "run_id").drop("failure")
    chosen = responses.chosen(responses.judged(given), requests.withColumnRenamed("case_id", "run_id"))
    graphs = responses.decoded(chosen, "graph").withColumnRenamed("run_id", "case_id").join(failed, "case_id", "left")
    named = F.when(F.col("outcome").isin("ok", "repaired"), "graph").when(F.col("outcome").isin("no_diagram", "empty_request"), "no_diagram").otherwise("ExtractionValidationError")
    actual = F.when(F.col("outcome") == "empty_request", "no_diagram").otherwise(F.coalesce("failure", named))
    fields = lambda e: F.struct(*(F.coalesce(e[c], F.lit(responses.DEFAULTS[c])).alias(c) if c in responses.DEFAULTS else e[c].alias(c) for c in packed.EDGE))
    edges = packed.collapsed(F.transform(F.col("graph.edges"), fields))
    drawn = tuple(f for f in NODE_FIELDS if f not in ("x", "y", "width", "height"))
    rows = kept(graphs.select("case_id", actual.alias("actual"), F.when(actual == "graph", document_of(F.col("graph"), drawn, edges)).alias("document")))
    reviewed = F.struct("title", "diagram_type", "orientation", F.coalesce("nodes", F.expr("slice(nodes, 1, 0)")).alias("nodes"))
    wanted = expected.select("case_id", document_of(reviewed, NODE_FIELDS, F.col("edges")).alias("expected"))
    pairs = wanted.join(rows.where("actual = 'graph'").select("case_id", F.col("document").alias("actual")), "case_id").join(error_marks.select("case_id").distinct(), "case_id", "left_anti")
    differences = kept(structural_differences(pairs, "case_id"))
    return case_results(rows.select("case_id", "actual"), differences, error_marks), differences, rows.where("document is not null").select("case_id", "document")
