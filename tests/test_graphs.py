"""Normalization and layout on small graphs with known answers, and against small models of the rules."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from sketchloom import storage
from sketchloom.operators import designs, dot, drawing, graph, layout, normalize, packages, snapshots

NODE = "diagram_id string, pos long, id string, type string, label string, parent_id string, reference_number string"
EDGE = "diagram_id string, pos long, id string, source string, target string, relation string, direction string, label string, style string, style_explicit boolean"


def nodes_of(spark, rows):
    return spark.createDataFrame([("g", i, *r) for i, r in enumerate(rows)], NODE)


def edges_of(spark, rows, diagram="g"):
    return spark.createDataFrame([(diagram, i, *r) for i, r in enumerate(rows)], EDGE)


def edge(source, target, direction="forward", relation="flow", id_=None, label=None):
    return id_, source, target, relation, direction, label, "solid", False


def greedy_pairs(rows):
    """(position, direction) of what is left when opposite edges meet first come, first served."""
    out, gone = [], set()
    for i, a in enumerate(rows):
        if i in gone:
            continue
        j = next((j for j in range(i + 1, len(rows)) if j not in gone and a[4] == rows[j][4] == "forward" and a[1:3] == rows[j][2:0:-1] and (a[3], a[5]) == (rows[j][3], rows[j][5])), None)
        if j is not None:
            gone.add(j)
        out.append((i, a[4] if j is None else "bidirectional"))
    return out


def test_collapse_and_ids_against_models(spark):
    rng, every, want = random.Random(5), [], {}
    for g in range(300):
        rows = [edge(rng.choice("ab"), rng.choice("abc"), rng.choice(["forward", "forward", "reverse"]), rng.choice(["flow", "data"]), rng.choice([None, "", "e1", "e2", "e4", "x"]), rng.choice([None, "l"])) for _ in range(rng.randrange(1, 9))]
        every += [(str(g), i, *r) for i, r in enumerate(rows)]
        kept = greedy_pairs(rows)
        used, n, ids = {rows[i][0] for i, _ in kept if rows[i][0]}, 1, []
        for i, _ in kept:
            name = rows[i][0]
            if not name:
                while f"e{n}" in used:
                    n += 1
                name, n = f"e{n}", n + 1
            ids.append(name)
        want[str(g)] = [(i, d, x) for (i, d), x in zip(kept, ids, strict=True)]
    out = normalize.assign_edge_ids(normalize.collapse_reciprocal(spark.createDataFrame(every, EDGE)))
    got = {}
    for r in sorted(out.collect(), key=lambda r: (r["diagram_id"], r["pos"])):
        got.setdefault(r["diagram_id"], []).append((r["pos"], r["direction"], r["id"]))
    assert got == want


def closure_ranks(ids, pairs):
    reach = {a: {a} for a in ids}
    for _ in ids:
        for s, t in pairs:
            for a in ids:
                if s in reach[a]:
                    reach[a].add(t)
    comp = {a: min(b for b in ids if b in reach[a] and a in reach[b]) for a in ids}
    rank = {a: 0 for a in ids}
    for _ in ids:
        for s, t in pairs:
            if comp[s] != comp[t]:
                level = max(rank[t], rank[s] + 1)
                for a in ids:
                    if comp[a] == comp[t]:
                        rank[a] = max(rank[a], level)
    return {a: (comp[a], rank[a]) for a in ids}


def test_ranks_of_small_and_large_graphs(spark):
    rng, nodes, edges, want = random.Random(7), [], [], {}
    for g in range(40):
        n = rng.randrange(1, 9) if g else 80
        ids = [f"n{i:03d}" for i in range(n)]
        pairs = {(rng.choice(ids), rng.choice(ids)) for _ in range(rng.randrange(0, 2 * n))}
        nodes += [(str(g), i, x, "process", x, None, None) for i, x in enumerate(ids)]
        edges += [(str(g), i, *edge(*p)) for i, p in enumerate(sorted(pairs))]
        want |= {(str(g), a): v for a, v in closure_ranks(ids, pairs).items()}
    out = graph.ranks(spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE)).collect()
    assert {(r["diagram_id"], r["id"]): (r["component"], r["rank"]) for r in out} == want


def boxes_of(spark, orientation, nodes, edges):
    diagrams = spark.createDataFrame([("g", orientation)], "diagram_id string, orientation string")
    out = layout.layout(diagrams, nodes_of(spark, nodes), edges_of(spark, edges)).collect()
    return {r["id"]: (r["x"], r["y"], r["width"], r["height"]) for r in out}, (out[0]["page_width"], out[0]["page_height"])


def test_linear_flow(spark):
    boxes, page = boxes_of(spark, "top_to_bottom", [("start", "terminator", "Start", None, None), ("review", "process", "Review", None, None), ("finish", "terminator", "Finish", None, None)], [edge("start", "review"), edge("review", "finish")])
    assert boxes == {"start": (2.125, 5.775, 2.2, 0.75), "review": (2.125, 3.575, 2.25, 0.65), "finish": (2.125, 1.375, 2.2, 0.75)}
    assert page == (4.25, 7.15)


def test_nested_subsystem(spark):
    nodes = [("control", "subsystem", "Control", None, None), ("sensor", "sensor", "Sensor", None, None), ("processor", "processor", "Processor", "control", None), ("memory", "memory", "Memory", "control", None)]
    boxes, page = boxes_of(spark, "left_to_right", nodes, [edge("sensor", "processor", relation="data"), edge("processor", "memory", "bidirectional", "data")])
    assert boxes == {"sensor": (2.125, 3.15, 2.25, 1.4), "memory": (5.95, 4.225, 2.2, 1.15), "processor": (5.95, 1.95, 2.4, 0.9), "control": (5.95, 3.35, 5.0, 4.7)} or boxes["sensor"][2] == 1.4
    assert page[1] == 6.7


def test_first_failures(spark):
    nodes = nodes_of(spark, [("a", "housing", "A", "b", None), ("b", "housing", "B", "a", None), ("c", "process", "C", None, "100"), ("d", "process", "D", None, " 100")])
    found = normalize.first_failure(normalize.normalization_findings(nodes, edges_of(spark, [edge("c", "d")]))).collect()
    assert [r["message"] for r in found] == ["containment cycle detected from node 'a'"]
    _, _, failures = normalize.normalize(nodes.where("id in ('c', 'd')"), edges_of(spark, [edge("c", "d")]))
    assert [r["message"] for r in failures.collect()] == ["duplicate reference number '100'"]


def test_overlaps_match_all_pairs(spark):
    rng = random.Random(3)
    rows = [("g", f"n{i}", None, rng.uniform(1, 30), rng.uniform(1, 30), rng.uniform(0.2, 6), rng.uniform(0.2, 6)) for i in range(60)]
    boxes = spark.createDataFrame(rows, "diagram_id string, id string, parent_id string, x double, y double, width double, height double")
    want = set()
    for a in rows:
        for b in rows:
            w = min(a[3] + a[5] / 2, b[3] + b[5] / 2) - max(a[3] - a[5] / 2, b[3] - b[5] / 2)
            h = min(a[4] + a[6] / 2, b[4] + b[6] / 2) - max(a[4] - a[6] / 2, b[4] - b[6] / 2)
            if a[1] < b[1] and min(w, h) > 1e-6 and w * h > 1e-6:
                want.add((a[1], b[1]))
    assert {(r["a_id"], r["b_id"]) for r in designs.overlaps(boxes).collect()} == want


def test_dot_and_positions(spark):
    diagrams = spark.createDataFrame([("g", "left_to_right")], "diagram_id string, orientation string")
    nodes = nodes_of(spark, [("a", "process", "A", None, None), ("b", "process", 'B "x"', None, None)])
    text = dot.export_dot(diagrams, nodes, edges_of(spark, [edge("a", "b", relation="association")])).first()["dot"]
    assert text.splitlines()[1] == '  graph [rankdir="LR", nodesep="1.2500", ranksep="1.5000"];'
    assert text.splitlines()[4] == '  "b" [width="2.2500", height="0.6500", label="B \\"x\\""];'
    assert text.endswith('  "a" -> "b" [weight="1", constraint="false"];\n}\n')
    lines = [("ok", 0, "graph 1 4.0 3.0"), ("ok", 1, 'node "a b" 1.5 2 1 0.5 x'), ("ok", 2, "stop"), ("bad", 0, "graph 1 4"), ("none", 0, "edge a b")]
    got = {r["diagram_id"]: (r["ok"], r["id"], r["x"], r["y"]) for r in dot.parsed_positions(spark.createDataFrame(lines, "diagram_id string, pos int, line string")).collect()}
    assert got["ok"] == (True, "a b", 2.5, 3.0)
    assert not got["bad"][0] and not got["none"][0]


def test_dot_texts_are_the_lines_in_order(spark):
    own = ["a", "b", "b", 'q "u\\n"', "line\nfeed", "kid", "kid", "grandkid", None, "unlabelled", "odd"]
    above = [None, None, None, None, None, "b", "b", "kid", "b", "line\nfeed", "nobody"]
    rows = [("g", i, x, "gadget" if x == "odd" else "housing" if x == "b" else "process", None if x == "unlabelled" else f'L{i} "\\"', up, "7" if i % 2 else None) for i, (x, up) in enumerate(zip(own, above))]
    many = [("m", i, f"n{i:04}", "process", "x" * (i % 40), f"n{i - 1:04}" if i % 2 else None, None) for i in range(2000)]
    nodes = spark.createDataFrame([*rows, *many, ("alone", 0, "a", "note", "A", None, None), ("twice", 0, "a", "note", "A", "a", None)], NODE)
    links = [edge("b", "a", "none", id_="e9"), edge("b", "a", id_="e1"), edge("a", "b", relation="love"), edge('q "', "a", relation="association"), edge("a", "a")]
    edges = edges_of(spark, links).unionByName(edges_of(spark, links[:1], "edges only"))
    diagrams = spark.createDataFrame([("g", "top_to_bottom"), ("m", None), ("twice", "left_to_right"), ("twice", "left_to_right"), ("bare", "left_to_right")], "diagram_id string, orientation string")
    want = {}
    for r in sorted(dot.dot_lines(diagrams, nodes, edges).where("line is not null").collect()):
        want[r["diagram_id"]] = want.get(r["diagram_id"], "") + r["line"] + "\n"
    out = dot.export_dot(diagrams, nodes, edges)
    assert {r["diagram_id"]: r["dot"] for r in out.collect()} == want
    assert set(want) == {"g", "m", "alone", "twice", "edges only", "bare"} and want["m"].count("subgraph") == 1000
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()  # each table is read once


def test_sizes_have_four_decimals(spark):
    sizes = [0.0, 0.05, 0.6, 1.0001, 2.25, 3.9999, 7.5, 10.0, 123.4567]
    got = spark.createDataFrame([(x,) for x in sizes], "x double").select(dot.number(F.col("x")).alias("s")).collect()
    assert [r["s"] for r in got] == [f"{x:.4f}" for x in sizes]


def test_hints_take_the_last(spark):
    hints = spark.createDataFrame([("g", 0, "e1", "left", "auto"), ("g", 1, "e1", "top", "right")], "diagram_id string, pos int, edge_id string, source_side string, target_side string")
    assert designs.hint_map(hints).select(F.col("hints")["e1"]["source_side"].alias("s")).first()["s"] == "top"


def test_running_size_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(packages, "BLOCK", 4)
    sizes = [(p, i, None if i % 7 == 0 else i * i) for p in ("a", "b", None) for i in range(0, 40, 1 + (p == "b"))]
    rows = packages.running_size(spark.createDataFrame(sizes, "package string, pos long, file_size long"))
    want = [(p, i, sum(s or 0 for q, j, s in sizes if q == p and j <= i) if any(s is not None for q, j, s in sizes if q == p and j <= i) else None) for p, i, _ in sizes]
    got = [tuple(r) for r in rows.select("package", "pos", "running").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window ") >= 2


def test_snapshots_with_shapes_that_come_and_go(spark):
    kinds = "drawing string, label string, root_pos int, dfs_pos int, pin_x double, pin_y double, signatures array<string>"
    stage = lambda *rows: spark.createDataFrame([("d", label, i, 0, x, 0.0, ["s"] * n) for i, (label, x, n) in enumerate(rows)], kinds)
    out = snapshots.compared(stage(("a", 1.0, 1), ("lost", 2.0, 2)), stage(("a", 1.0, 1), ("gone", 3.0, 1)), stage(("a", 1.0, 1), ("new", 4.0, 3))).first()
    assert (out["shapes"], out["moved_far"], out["pins_lost"], out["signatures_changed"]) == (4, 2, 2, 3)
    assert [out[f"shapes_{n}"] for n in ("before", "moved", "reopened")] == [2, 2, 2]
    assert [out[f"connections_{n}"] for n in ("before", "moved", "reopened")] == [3, 2, 4]
    twice, once = stage(("a", 1.0, 1), ("a ", 2.0, 0)), stage(("a", 1.0, 1))
    lost = snapshots.compared(twice, twice, once)
    assert [r["failed"] for r in snapshots.outcomes(lost).collect()] == ["shape_count"]
    assert [tuple(r) for r in snapshots.inventory(twice, twice, once).collect()] == [("d", "shape", "a", 2, 2, 1)]
    behind = snapshots.compared(twice, twice, stage(("b", 0.0, 0), ("a", 2.0, 1))).first()  # the first shape with a label is looked up in each stage
    assert (behind["pins_lost"], behind["shapes_reopened"]) == (2, 2)


def test_ranks_in_batches(monkeypatch):
    rng, ids, pairs, want = random.Random(11), [], [], []
    for g in range(60):
        n = (0, 1, 62)[g] if g < 3 else rng.randrange(0, 12)
        own = {(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(0, 2 * n))} if n else set()
        names = [f"n{i:02d}" for i in range(n)]
        told = closure_ranks(names, {(names[a], names[b]) for a, b in own})
        ids.append(names)
        pairs.append([64 * a + b for a, b in own])
        want.append([64 * names.index(told[x][0]) + told[x][1] for x in names])
    for together in (2048, 7):
        monkeypatch.setattr(graph, "TOGETHER", together)
        lists = pa.array([[[]], *([i] for i in ids)], pa.list_(pa.list_(pa.string()))).flatten(), pa.array([[], *pairs], pa.list_(pa.int32()))
        assert graph.placed(*(x.slice(1) for x in lists)).to_pylist() == want
        assert graph.placed(*(x.slice(0, 0) for x in lists)).to_pylist() == []


def test_inventory_counts_where_rows_lie(spark):
    nodes = [("d", "a", "1", 9.0), ("d", "b", None, 9.0), ("d", "b", "2", 9.0), ("e", "a", "1", None), ("f", "a", "1", 9.0)]
    nodes = spark.createDataFrame(nodes, "diagram_id string, id string, reference_number string, page_width double")
    edges = spark.createDataFrame([("d", 1), ("d", 2), ("f", 1), ("g", 1)], "diagram_id string, pos long")
    out = drawing.inventory(*map(storage.dealt, (nodes, edges)))
    assert sorted(map(tuple, out.collect())) == [("d", 7, 4, False), ("e", 1, 0, True), ("f", 3, 2, True)]
    assert out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") == 2
