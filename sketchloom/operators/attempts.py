"""Responses to graphs, designs and critiques: decoding, judgement, the choice of an attempt, repair requests."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import json_text
from ..functions import text as tx
from ..functions.binding import let
from ..storage import kept
from . import designs, normalize, packed
from .decode import SHAPES, content_as, last_key_counts, parsed, verdict


def is_json(content: Column) -> Column:
    return json_text.is_document(content)


def extension(content: Column) -> Column:
    """Where a raw response is kept: json if it is a document, else txt."""
    return F.when(is_json(content), "json").otherwise("txt")


def by_text(attempts: DataFrame, told: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """attempts plus what told() adds to their content: worked out once for each text, however many responses have it."""
    texts = kept(told(attempts.select("content").distinct())).withColumnRenamed("content", "told_content")
    return attempts.join(texts, F.col("content").eqNullSafe(F.col("told_content")), "left").drop("told_content")


def decoded(attempts: DataFrame, what: str = "graph") -> DataFrame:
    """attempts plus the decoded content in a column named what (graph, design or critique; null if it is none), and decode: ok, or why it is none."""
    return by_text(attempts, lambda texts: decoded_texts(texts, what))


def decoded_texts(texts: DataFrame, what: str) -> DataFrame:
    last_key_counts(texts.sparkSession)
    shape = SHAPES[what]
    rows = texts.withColumn("value", parsed(F.col("content")))
    rows = rows.withColumn("decode", verdict(shape))
    return rows.withColumn(what, F.when(F.col("decode") == "ok", content_as(shape))).drop("value")


def flattened(graphs: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Node rows and edge rows of a graph column, in list order, with defaults where keys are absent."""
    nodes = graphs.select(F.col(key).alias("diagram_id"), F.posexplode("graph.nodes").alias("pos", "n")).select("diagram_id", "pos", "n.*")
    edges = graphs.select(F.col(key).alias("diagram_id"), F.posexplode("graph.edges").alias("pos", "e")).select("diagram_id", "pos", "e.*")
    default = lambda name, value: F.coalesce(name, F.lit(value))
    return nodes, edges.withColumns({"style_explicit": F.col("style").isNotNull(), "relation": default("relation", "flow"), "direction": default("direction", "forward"), "style": default("style", "solid")})


def rebuilt(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """diagram_id, nodes, edges: the lists in their order."""
    listing = lambda rows, name: rows.groupBy("diagram_id").agg(F.array_sort(F.collect_list(F.struct("pos", *(c for c in rows.columns if c not in ("diagram_id", "pos"))))).alias(name))
    return listing(nodes, "nodes").join(listing(edges, "edges"), "diagram_id", "left")


def laid_out(good: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Placements, hints (with defaults where keys are absent) and pages of a design column."""
    boxes = good.select(F.col(key).alias("diagram_id"), F.posexplode("design.layout.placements").alias("pos", "p")).select("diagram_id", "pos", "p.*")
    hints = good.select(F.col(key).alias("diagram_id"), F.posexplode("design.layout.connector_hints").alias("pos", "h")).select("diagram_id", "pos", "h.*")
    auto = {c: F.coalesce(c, F.lit("auto")) for c in ("source_side", "target_side")}
    pages = good.select(F.col(key).alias("diagram_id"), "design.layout.page_width", "design.layout.page_height")
    return boxes.withColumn("importance", F.coalesce("importance", F.lit("secondary"))), hints.withColumns(auto), pages


DEFAULTS = {"relation": "flow", "direction": "forward", "style": "solid"}


def finding_in_row(what: str) -> Column:
    """The finding against a decoded graph or design of at most packed.LARGE items, null if there is none."""
    graph = F.col("graph") if what == "graph" else F.col("design.graph")
    fields = lambda e: F.struct(*(F.coalesce(e[c], F.lit(DEFAULTS[c])).alias(c) if c in DEFAULTS else e[c].alias(c) for c in packed.EDGE))

    def told(nodes: Column, edges: Column) -> Column:
        broken = packed.failure(nodes, edges)["message"]
        if what == "graph":
            return broken
        layout = F.col("design.layout")
        messages = packed.design_messages(nodes, edges, layout["placements"], layout["connector_hints"], layout["page_width"], layout["page_height"])
        return F.coalesce(broken, F.nullif(F.array_join(messages, "; "), F.lit("")))

    lists = F.struct(graph["nodes"].alias("nodes"), packed.collapsed(F.transform(graph["edges"], fields)).alias("edges"))
    return let(lists, lambda x: told(x["nodes"], x["edges"]))


def findings_by_tables(good: DataFrame, what: str) -> DataFrame:
    """key, finding of decoded graphs or designs of any size."""
    graphs = good if what == "graph" else good.withColumn("graph", F.col("design.graph"))
    nodes, edges = flattened(graphs, "key")
    nodes, edges, failures = normalize.normalize(nodes, edges)
    found = failures.select(F.col("diagram_id").alias("key"), F.col("message").alias("finding"))
    if what == "design":
        boxes, hints, pages = laid_out(graphs.join(found, "key", "left_anti"), "key")
        rules = designs.listed(designs.design_findings(nodes, edges, boxes, hints, pages))
        found = found.unionByName(rules.select(F.col("diagram_id").alias("key"), F.col("findings").alias("finding")))
    return found


def judged(attempts: DataFrame, what: str = "graph") -> DataFrame:
    """decoded() plus what each attempt is by itself (judgement: ok, no_diagram, or invalid) and the finding that speaks against it.

    A graph has to pass normalization; without nodes it says that there is no
    diagram. A design has to pass normalization and the rules for its
    placements; it may have no nodes. A text comes in one row and is judged
    there, without a shuffle; only those of more than packed.LARGE items go
    through tables.
    """
    return by_text(attempts, lambda texts: judged_texts(texts, what))


def judged_texts(texts: DataFrame, what: str) -> DataFrame:
    ok = F.col("decode") == "ok"
    graph = "graph" if what == "graph" else "design.graph"
    lists = [f"{graph}.nodes", f"{graph}.edges", *(["design.layout.placements", "design.layout.connector_hints"] if what == "design" else [])]
    items = reduce(Column.__add__, (F.size(c) for c in lists))
    rows = kept(decoded_texts(texts, what).withColumn("large", ok & (items > packed.LARGE)).withColumn("key", F.monotonically_increasing_id().cast("string")))
    small = F.when(ok & ~F.col("large"), finding_in_row(what))
    if rows.where("large").isEmpty():
        rows = rows.withColumn("finding", small)
    else:
        found = findings_by_tables(rows.where("large"), what)
        rows = rows.where("not large").withColumn("finding", small).unionByName(rows.where("large").join(found, "key", "left"), allowMissingColumns=True)
    empty = F.size("graph.nodes") == 0 if what == "graph" else F.lit(False)
    judgement = F.when(ok & empty, "no_diagram").when(ok & F.col("finding").isNull(), "ok").otherwise("invalid")
    return rows.drop("large", "key").withColumn("judgement", judgement).withColumn("finding", F.when(ok, F.col("finding")).otherwise(F.col("decode")))


def chosen(judgements: DataFrame, requests: DataFrame) -> DataFrame:
    """A row for each request: outcome, chosen content, and what its attempts cost.

    The first attempt counts if it is valid or says that there is no diagram;
    else the second; never a third. Attempts behind the deciding one are not
    counted. Outcomes: empty_request, no_diagram, ok, repaired, failed.
    """
    rows = judgements.where("attempt_no <= 2")
    first = F.max(F.when(F.col("attempt_no") == 1, F.col("judgement"))).over(Window.partitionBy("run_id"))
    used = rows.withColumn("first", first).where((F.col("attempt_no") == 1) | (F.col("first") == "invalid"))
    by_run = used.groupBy("run_id").agg(
        F.max_by("judgement", "attempt_no").alias("last"),
        F.max_by("content", "attempt_no").alias("content"),
        F.count("*").alias("attempts"),
        F.array_sort(F.collect_list(F.when(F.col("request_id").isNotNull(), F.struct("attempt_no", "request_id")))).alias("ids"),
        F.sum(F.coalesce("elapsed_ms", F.lit(0.0))).alias("elapsed_ms"),
    )
    out = requests.join(by_run, "run_id", "left")
    blank = tx.is_blank(F.col("text"))
    outcome = F.when(blank, "empty_request").when(F.col("last") == "no_diagram", "no_diagram").when((F.col("last") == "ok") & (F.col("attempts") == 1), "ok").when(F.col("last") == "ok", "repaired").otherwise("failed")
    counted = lambda value, none: F.when(blank | F.col("last").isNull(), none).otherwise(value)
    return out.select(
        "run_id",
        outcome.alias("outcome"),
        F.when(outcome.isin("ok", "repaired"), F.col("content")).alias("content"),
        counted(F.col("attempts"), F.lit(0)).cast("long").alias("attempts"),
        counted(F.array_join(F.transform("ids", lambda x: x["request_id"]), ","), F.lit("")).alias("request_ids"),
        counted(F.col("elapsed_ms"), F.lit(0.0)).alias("elapsed_ms"),
    )


#: What is asked for after an invalid answer. Callers with wording of their own give it; {source}, {finding} and {response} are filled in.
REPAIR = "The answer below was refused: {finding}\nSend it again as one JSON document that keeps its meaning and mends this.\n\n{response}"
REPAIR_WITH_SOURCE = "Request:\n{source}\n\n" + REPAIR
CRITIQUE_REQUEST = "Request:\n{source}\n\nDesign that was drawn:\n{design}"


def repair_queue(judgements: DataFrame, requests: DataFrame, template: str = REPAIR) -> DataFrame:
    """run_id, prompt: what to ask for where the first attempt of a request that is not blank is invalid."""
    rows = judgements.where("attempt_no = 1 and judgement = 'invalid'").join(requests.where(~tx.is_blank(F.col("text"))), "run_id")
    return rows.select("run_id", tx.filled(template, source=F.col("text"), finding=F.col("finding"), response=F.col("content")).alias("prompt"))


def critique_request(source: Column, design: Column, template: str = CRITIQUE_REQUEST) -> Column:
    return tx.filled(template, source=source, design=F.to_json(design, {"pretty": "true", "ignoreNullFields": "false"}))


def reviewed(critiques: DataFrame) -> DataFrame:
    """Critique responses (run_id, content, initial: the design's JSON) resolved: run_id, outcome, revision_applied, final_design.

    A response that is no critique is invalid; a revision has to decode and to
    pass all rules for designs.
    """
    revised = F.to_json(F.try_variant_get(parsed(F.col("content")), "$.revised_design", "variant"))

    def told(texts: DataFrame) -> DataFrame:
        rows = kept(decoded_texts(texts, "critique").withColumn("revised_design", F.when((F.col("decode") == "ok") & F.col("critique.revised_design").isNotNull(), revised)))
        revisions = judged(rows.where("revised_design is not null").select(F.col("revised_design").alias("content")).distinct(), "design")
        rows = rows.join(revisions.select(F.col("content").alias("revised_design"), (F.col("judgement") == "ok").alias("revision_valid")), "revised_design", "left")
        return rows.select("content", "decode", F.coalesce("critique.approved", F.lit(True)).alias("approved"), "revised_design", F.coalesce("revision_valid", F.lit(True)).alias("revision_valid"))

    known = by_text(critiques.select("run_id", "content", "initial"), told).drop("content")
    out = designs.resolved_critiques(known, F.col("initial"))
    wrong = F.col("decode") != "ok"
    return out.select(
        "run_id", F.when(wrong, "invalid_critique").otherwise(F.col("outcome")).alias("outcome"), (~wrong & F.col("revision_applied")).alias("revision_applied"),
        F.when(~wrong, F.col("final_design")).alias("final_design"),
    )
