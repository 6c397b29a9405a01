"""Structural differences against a recursion, and the draw job against its parts."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F
from test_graphs import EDGE, NODE, edge
from test_packed import told

from sketchloom.functions.tables import MARKERS
from sketchloom.operators import designs, dot, drawing, evaluate, packed
from sketchloom.sources import files
from sketchloom.storage import kept, scope, shared_folder


def differences(expected, actual, path=""):
    if isinstance(expected, dict) and isinstance(actual, dict):
        for k in sorted({k for d in (expected, actual) for k in d}):
            yield from differences(expected.get(k), actual.get(k), f"{path}.{k}" if path else k)
    elif isinstance(expected, list) and isinstance(actual, list):
        for i in range(max(len(expected), len(actual))):
            yield from differences(*(x[i] if i < len(x) else None for x in (expected, actual)), f"{path}[{i}]")
    elif expected != actual or isinstance(expected, bool) != isinstance(actual, bool):
        show = lambda x: "<missing>" if x is None else x if isinstance(x, str) else json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        yield path, show(expected), show(actual)


def anything(rng, depth):
    kind = rng.randrange(7 if depth else 4)
    if kind < 4:
        return rng.choice([None, True, 0, 1, 2.5, "", "a", 'q"uote', "<missing>", "é"])
    if kind == 4:
        return [anything(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {k: anything(rng, depth - 1) for k in rng.sample("abcd", rng.randrange(1, 4))}


def spoiled(rng, value):
    if isinstance(value, dict) and value and rng.random() < 0.8:
        return {k: spoiled(rng, v) if rng.random() < 0.5 else v for k, v in value.items()}
    if isinstance(value, list) and value and rng.random() < 0.8:
        return [spoiled(rng, v) for v in value][: rng.choice([len(value), len(value) - 1])]
    return anything(rng, 2) if rng.random() < 0.4 else value


def test_structural_differences_of_any_depth(spark):
    rng = random.Random(5)
    pairs = []
    for i in range(300):
        value = {"top": anything(rng, 6), "more": anything(rng, 3)}
        pairs.append((i, value, spoiled(rng, value)))
    pairs.append((900, {"n": 1}, {"n": 1.0}))
    frame = spark.createDataFrame([(i, json.dumps(a), json.dumps(b)) for i, a, b in pairs], "case_id long, expected string, actual string")
    got = told(evaluate.structural_differences(frame, "case_id"), "case_id", "path", "expected", "actual")
    assert got == sorted(((i, *d) for i, a, b in pairs for d in differences(a, b)), key=repr) and len(got) > 100


def test_draw_job_equals_its_parts(spark, monkeypatch):
    rng, nodes, edges, placements = random.Random(8), [], [], []
    for g in map(str, range(40)):
        ids = [f"n{i}" for i in range(rng.randrange(1, 7))]
        nodes += [(g, i, x, rng.choice(["housing", "process", "sensor"]), rng.choice([x, MARKERS[0]]), None, rng.choice([None, "7"])) for i, x in enumerate(ids)]
        edges += [(g, i, *edge(rng.choice([*ids, "zz"]), rng.choice(ids))) for i in range(rng.randrange(0, 6))]
        placements += [(g, i, rng.choice([*ids, "ghost"]), rng.uniform(0, 9), rng.uniform(0, 9), rng.choice([0.5, 1.5, float("nan")]), 0.5) for i in range(9)]
    nodes, edges = spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE)
    placements = spark.createDataFrame(placements, "diagram_id string, pos long, node_id string, x double, y double, width double, height double")
    pages = nodes.select("diagram_id").distinct().where("diagram_id <> '3'").select("diagram_id", F.lit(9.0).alias("page_width"), F.lit(8.0).alias("page_height"))
    boxed = nodes.join(designs.last_placements(placements), ["diagram_id", "id"])
    parts = (drawing.shapes(boxed), drawing.connectors(edges, boxed), drawing.callouts(boxed, pages), drawing.drawing_findings(boxed, pages).unionByName(drawing.leftover_markers(boxed)))
    shown = (("diagram_id", "id", "marker", "draw_order", "x", "width"), ("diagram_id", "pos", "begin_x", "end_y", "line_style", "end_arrow"), ("diagram_id", "id", "side", "root_x", "leader_y"), ("diagram_id", "id", "rule"))
    want = [told(p, *c) for p, c in zip(parts, shown, strict=True)]
    for large in (256, 9):
        monkeypatch.setattr(packed, "LARGE", large)
        job = drawing.draw(nodes, placements, edges, pages)
        got = [told(t, *c) for t, c in zip((job.shapes, job.connectors, job.callouts, job.findings), shown, strict=True)]
        assert [repr(g) for g in got] == [repr(w) for w in want] and all(want)
    assert {r[2] for r in want[3]} >= {"marker_left", "not_finite"}


GRAPH = {"title": "t", "diagram_type": "flowchart", "orientation": "top_to_bottom", "nodes": [{"id": "a", "type": "process", "label": "A", "notes": "n"}, {"id": "b", "type": "process", "label": "B"}], "edges": [{"source": "a", "target": "b"}]}


def test_evaluation_of_folders(spark, tmp_path):
    texts, expected = tmp_path / "text", tmp_path / "expected"
    texts.mkdir()
    expected.mkdir()
    reviewed = {**GRAPH, "edges": [{"id": "e1", "source": "a", "target": "b", "relation": "flow", "direction": "forward", "style": "solid", "label": None}]}
    both = {**GRAPH, "edges": [{"source": "a", "target": "b"}, {"source": "b", "target": "a"}]}  # one edge after normalization
    for case in ("same", "differs", "nothing", "marked", "down", "broken", "repaired", "blank"):
        (texts / f"{case}.txt").write_text("  " if case == "blank" else f"draw {case}")
        if case in ("nothing", "marked", "blank"):
            (expected / f"{case}.error.json").write_text("{}")
        else:
            (expected / f"{case}.json").write_text(json.dumps(reviewed))
    answers = [
        ("same", 1, json.dumps(GRAPH), None), ("differs", 1, json.dumps({**both, "title": "x", "nodes": [{**GRAPH["nodes"][0], "notes": None}, {**GRAPH["nodes"][1], "reference_number": "7"}]}), None), ("nothing", 1, json.dumps({**GRAPH, "nodes": []}), None),
        ("marked", 1, json.dumps(GRAPH), None), ("down", 1, None, "ProviderError"), ("broken", 1, "no", None), ("broken", 2, "none", None), ("repaired", 1, json.dumps(GRAPH) + " x", None), ("repaired", 2, json.dumps(GRAPH), None),
    ]
    frame = spark.createDataFrame([(c, n, t, None, None, f) for c, n, t, f in answers], "case_id string, attempt_no int, content string, request_id string, elapsed_ms double, failure string")
    out = str(tmp_path / "out")
    total = files.evaluate_folders(spark, str(texts), str(expected), frame, out).first()
    got = {r["case_id"]: (r["status"], r["actual"], r["differences"]) for r in spark.read.parquet(f"{out}/cases").collect()}
    assert got == {
        "same": ("match", "graph", 0), "differs": ("mismatch", "graph", 4), "nothing": ("match", "no_diagram", 0), "marked": ("mismatch", "graph", 0), "down": ("error", "ProviderError", 0),
        "broken": ("error", "ExtractionValidationError", 0), "repaired": ("match", "graph", 0), "blank": ("match", "no_diagram", 0),
    }
    assert (total["case_count"], total["mismatch_count"]) == (8, 4)
    assert told(spark.read.parquet(f"{out}/differences"), "path", "expected", "actual") == [("edges[0].direction", "forward", "bidirectional"), ("nodes[0].notes", "n", "<missing>"), ("nodes[1].reference_number", "<missing>", "7"), ("title", "t", "x")]
    with pytest.raises(ValueError, match="below"):
        files.evaluate_folders(spark, str(texts), str(expected), frame, f"{expected}/out")


def test_positions_become_a_layout(spark):
    nodes = spark.createDataFrame([("g", 0, "box", "subsystem", "Box", None, None), ("g", 1, "a", "process", "A", "box", None), ("g", 2, "b", "process", "B", None, None), ("bad", 0, "a", "process", "A", None, None), ("lacks", 0, "a", "process", "A", None, None), ("lacks", 1, "b", "process", "B", None, None)], NODE)
    lines = [("g", 0, "graph 1 20.0 3.0"), ("g", 1, "node a 1.5 2 1 0.5 x"), ("g", 2, "node b 9.0 2 1 0.5 x"), ("bad", 0, "graph 1 0 0"), ("bad", 1, "node a 1 1 1 1 x"), ("lacks", 0, "graph 1 4 4"), ("lacks", 1, "node a 1 1 1 1 x"), ("lacks", 2, "node c 1 1 1 1 x")]
    lines = spark.createDataFrame(lines, "diagram_id string, pos int, line string")
    got = {r["id"]: (r["x"], r["y"], r["width"], r["height"], r["page_width"], r["page_height"]) for r in dot.imported(nodes, lines).collect()}
    # a at (2.5, 3.0) with its own size 2.25 x 0.65; around it half an inch, 0.9 above, at least 5.0 x 2.5; all shifted by what the margin wants
    assert got == {"box": (3.5, 3.2, 5.0, 2.5, 22.0, 5.45), "a": (3.5, 3.0, 2.25, 0.65, 22.0, 5.45), "b": (11.0, 3.0, 2.25, 0.65, 22.0, 5.45)}
    assert told(dot.unplaced(nodes, lines), "diagram_id", "id", "rule") == [("bad", None, "malformed"), ("lacks", "b", "missing"), ("lacks", "c", "unknown")]


def test_a_scope_drops_its_tables(spark):
    folder = shared_folder(spark).removeprefix("file://")
    outside = kept(spark.range(3))
    before = set(os.listdir(folder))
    with scope(spark):
        assert kept(spark.range(5)).count() == 5
        with scope(spark):
            kept(spark.range(2))
        assert len(set(os.listdir(folder)) - before) == 1
    assert set(os.listdir(folder)) == before and outside.count() == 3
