"""Packed rows against the rules as tables, the decoder against a reading by hand, boxes of any size, large graphs by joins."""

import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F
from test_graphs import EDGE, NODE, closure_ranks, edge

from sketchloom.functions import json_text
from sketchloom.operators import attempts, decode, designs, graph, large_graphs, normalize, packed

# Decoding.

SPELLED = re.compile(r"[+-]?(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+)?", re.ASCII)
RANKS = list(decode.REASONS)


def fault(value, field):
    """The first reason against a value, as a reader of the rules would give it."""
    if value is None:
        return None if field.nullable else "wrong_type"
    if field.kind == "object":
        return fault_of_object(value, field.of)
    if field.kind == "list":
        if not isinstance(value, list):
            return "wrong_type"
        found = [fault(v, decode.Field("object", of=field.of) if field.of else decode.Field()) for v in value]
        return min((f for f in found if f), key=RANKS.index, default=None)
    if field.kind == "flag":
        words = [w for ws in decode.TRUTHS.values() for w in ws]
        good = isinstance(value, bool) or value in (0, 1) or isinstance(value, str) and value.lower() in words
        return None if good else "wrong_type"
    if field.kind == "measure":
        if isinstance(value, str):
            if not SPELLED.fullmatch(value.strip()):
                return "wrong_type"
            value = float(value.strip().replace("_", ""))
        elif not isinstance(value, int | float):
            return "wrong_type"
        return None if 0 < value <= 1.7976931348623157e308 else "out_of_domain"
    if not isinstance(value, str):
        return "wrong_type"
    return "out_of_domain" if field.choices and value not in field.choices else None


def fault_of_object(value, shape):
    if not isinstance(value, dict):
        return "wrong_type"
    found = ["unknown_key" for k in value if k not in shape]
    found += [("missing_key" if f.required else None) if k not in value else fault(value[k], f) for k, f in shape.items()]
    return min((f for f in found if f), key=RANKS.index, default=None)


def read_by_hand(text, shape):
    try:
        value = json.loads(text)
    except ValueError:
        return "no_json"
    if not isinstance(value, dict):
        return "no_object"
    if re.search("NaN|Infinity", re.sub(r'"(?:[^"\\]|\\.)*"', "", text)):
        return "out_of_domain"
    return fault_of_object(value, shape) or "ok"


NODE_TEXT = {"id": "a", "type": "process", "label": "A"}
DESIGN = {
    "graph": {"title": "t", "diagram_type": "flowchart", "orientation": "left_to_right", "nodes": [NODE_TEXT, {**NODE_TEXT, "id": "b", "notes": None}], "edges": [{"source": "a", "target": "b"}, {"source": "b", "target": "a", "relation": "data"}]},
    "layout": {"composition": "radial", "page_width": 9, "page_height": 7.5, "placements": [{"node_id": "a", "x": 2, "y": 2, "width": 1, "height": 1}, {"node_id": "b", "x": 5, "y": 2, "width": 1, "height": 1}], "connector_hints": [{"edge_id": "e1"}]},
    "rationale": "r",
}
ODD_VALUES = ["9", " 9.5\n", "1_000", "1__0", "1_", ".5", "5.", "1e3", "+2", "nan", "Infinity", "", "x", True, False, None, 0, -1, 1, 1.0, 2.5, 10**400, 1e-9, [], {}, [1], {"a": 1}, "yes", "ON", "no", "left"]


def spots(value, path=()):
    yield path
    for k, v in value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ():
        yield from spots(v, (*path, k))


def changed(rng, document):
    """The document's text with a value, a key or the text itself spoiled in one of many ways."""
    document = json.loads(json.dumps(document))
    path = rng.choice([p for p in spots(document) if p])
    holder = document
    for k in path[:-1]:
        holder = holder[k]
    way = rng.randrange(4)
    if way == 0:
        del holder[path[-1]]
    elif way == 1 and isinstance(holder, dict):
        holder["odd"] = 1
    elif way > 1:
        holder[path[-1]] = rng.choice(ODD_VALUES)
    text = json.dumps(document)
    spoil = rng.randrange(14)
    at = rng.randrange(len(text) + 1)
    edits = {0: text + " x", 1: text + text, 2: text + "]", 3: text[:at] + rng.choice(',:"]}\\\t\x01') + text[at:], 4: text[:at], 5: "﻿" + text, 6: " \n" + text + "\r\t", 7: text.replace('"rationale": "r"', '"rationale": 5, "rationale": "r"'), 8: text.replace('"x": 2', '"x": NaN'), 9: text.replace('"a"', "'a'", 1)}
    return edits.get(spoil, text)


TEXTS = ["", " ", "null", "5", "-", "01", "1.", "[]", "[1 2]", '"a"', "{}", "{} {}", "{}, {}", "1] [2", '1}, {"a": 1', '{"a":1}}', "[" * 40 + "]" * 40, "[" * 1500 + "]" * 1500, '{"a": "\\u12G4"}', '{"a": "\t"}', "// no\n{}", "{'a': 1}", "{a: 1}", "[1,]", "[NaN, -Infinity]", "nul", "truefalse", '["' + "x" * 100_000 + '\\n"]', "9" * 3000, None]


def test_decode_equals_a_reading_by_hand(spark):
    rng = random.Random(8)
    critique = {"approved": False, "summary": "s", "issues": [{"severity": "low", "category": "overlap", "description": "d", "node_ids": ["a"]}], "revised_design": DESIGN}
    for what, document in (("graph", DESIGN["graph"]), ("design", DESIGN), ("critique", critique)):
        texts = [*TEXTS, json.dumps(document), *(changed(rng, document) for _ in range(400))]
        rows = spark.createDataFrame(list(enumerate(texts)), "run_id long, content string").repartition(4)
        got = {r["run_id"]: r for r in attempts.decoded(rows, what).select("run_id", "decode", what, attempts.extension(F.col("content")).alias("ext")).collect()}
        for i, text in enumerate(texts):
            try:
                is_json = text is not None and text.count("[") < 1000 and json.loads(text) is not ...
            except ValueError:
                is_json = False
            assert got[i]["ext"] == ("json" if is_json else "txt"), text
            want = "no_json" if not is_json else read_by_hand(text, decode.SHAPES[what])
            assert got[i]["decode"] == want, text
            assert (got[i][what] is not None) == (want == "ok")
        assert {got[i]["decode"] for i in got} == set(RANKS) | {"ok"}


def test_lenient_scalars_and_last_keys(spark):
    text = json.dumps(DESIGN).replace('"x": 2', '"x": "1_0.5"').replace('"page_width": 9', '"page_width": 1, "page_width": true').replace('"rationale": "r"', '"rationale": 1, "rationale": "last"')
    design = attempts.decoded(spark.createDataFrame([(1, text)], "run_id long, content string"), "design").first()["design"]
    assert (design["layout"]["placements"][0]["x"], design["layout"]["page_width"], design["rationale"]) == (10.5, 1.0, "last")
    words = {w: flag == "true" for flag, ws in decode.TRUTHS.items() for w in ws}
    rows = [(w, json.dumps({"approved": w, "summary": "s"})) for w in [*words, *(w.upper() for w in words)]] + [("n1", '{"approved": 1.0, "summary": "s"}'), ("n0", '{"approved": 0, "summary": "s"}')]
    got = {r["run_id"]: r["critique"]["approved"] for r in attempts.decoded(spark.createDataFrame(rows, "run_id string, content string"), "critique").collect()}
    assert got == words | {w.upper(): f for w, f in words.items()} | {"n1": True, "n0": False}


def test_grammar_alone_equals_the_parser(spark):
    rng = random.Random(9)
    texts = [t for t in TEXTS if t is not None and t.count("[") < 500] + [changed(rng, DESIGN) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    for r in rows.select("i", F.coalesce(json_text.by_grammar(F.col("t")), F.lit(False)).alias("g"), json_text.is_document(F.col("t")).alias("d")).collect():
        assert r["g"] == r["d"], texts[r["i"]]


# Packed rules.


def random_graphs(rng, n):
    nodes, edges = [], []
    for g in range(n):
        ids = [f"n{i}" for i in range(rng.randrange(1, 7))]
        rows = [(x, rng.choice(["housing", "subsystem", "subsystem", "process"]), x, rng.choice([None, None, *ids, "zz"]) if rng.random() < 0.6 else None, rng.choice([None, "", "1", " 1 ", "2", "3", "4", "5"])) for x in ids]
        if rng.random() < 0.2:
            rows.append(rows[0])
        nodes += [(str(g), i, *r) for i, r in enumerate(rows)]
        ends = [*ids, "zz"] if rng.random() < 0.2 else ids
        edges += [(str(g), i, *edge(rng.choice(ends), rng.choice(ends), rng.choice(["forward", "forward", "none"]), rng.choice(["flow", "data"]), rng.choice([None, "", "e1", "e2", "e3"]), rng.choice([None, "l"]))) for i in range(rng.randrange(0, 7))]
    return nodes, edges


def told(frame, *columns):
    return sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr)


def test_packed_failures_equal_the_tables(spark, monkeypatch):
    nodes, edges = random_graphs(random.Random(2), 400)
    nodes, edges = spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE)
    columns = ("diagram_id", "rule", "message")
    by_rows = told(normalize.failures(nodes, edges), *columns)
    assert by_rows == told(normalize.first_failure(normalize.normalization_findings(nodes, edges)), *columns)
    assert len({r[1] for r in by_rows}) == 9
    monkeypatch.setattr(packed, "LARGE", 6)  # some diagrams are large now
    assert told(normalize.failures(nodes, edges), *columns) == by_rows
    placed = nodes.withColumn("x", F.when(F.col("pos") == 1, 1.0))
    geometry = {r["diagram_id"] for r in normalize.failures(placed, edges, extracted=True).where("rule = 'geometry'").collect()}
    assert geometry == {r["diagram_id"] for r in placed.where("x is not null").collect()}


def test_packed_collapse_and_ids_equal_the_tables(spark):
    _, edges = random_graphs(random.Random(6), 400)
    frame = spark.createDataFrame(edges, EDGE)
    lists = packed.pack({"edges": (frame, ["pos", *packed.EDGE])})
    kept = packed.collapsed(F.col("edges"))
    got = lists.select("diagram_id", F.transform(kept, lambda e: F.struct(e["pos"], e["direction"])).alias("e"), F.array_sort(F.array_distinct(packed.edge_ids(kept))).alias("ids")).collect()
    collapsed = normalize.collapse_reciprocal(frame)
    numbered = normalize.assign_edge_ids(collapsed)
    want, ids = {}, {}
    for r in sorted(numbered.collect(), key=lambda r: (r["diagram_id"], r["pos"])):
        want.setdefault(r["diagram_id"], []).append((r["pos"], r["direction"]))
        ids.setdefault(r["diagram_id"], set()).add(r["id"])
    assert {r["diagram_id"]: [tuple(e) for e in r["e"]] for r in got} == want and {r["diagram_id"]: r["ids"] for r in got} == {k: sorted(v) for k, v in ids.items()}
    assert lists._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_packed_designs_equal_the_tables(spark, monkeypatch):
    rng, nodes, edges, placements, hints, pages = random.Random(4), [], [], [], [], []
    for g in map(str, range(250)):
        ids = [f"n{i}" for i in range(rng.randrange(0, 6))]
        nodes += [(g, i, x, "housing", x, rng.choice([None, ids[0]]) if i else None, None) for i, x in enumerate(ids)]
        edges += [(g, i, *edge("n0", "n0", id_=rng.choice([None, "e2", "x"]))) for i in range(rng.randrange(0, 3))]
        placements += [(g, i, rng.choice([*ids, "ghost"]), rng.uniform(0, 9), rng.uniform(0, 9), rng.choice([0.5, 1.5, 9.0]), rng.choice([0.5, 3.0])) for i in range(rng.randrange(0, 8))]
        hints += [(g, i, rng.choice(["e1", "e2", "e3", "x"])) for i in range(rng.randrange(0, 4))]
        pages.append((g, 9.0, 8.0))
    box = "x double, y double, width double, height double"
    tables = [spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE), spark.createDataFrame(placements, f"diagram_id string, pos long, node_id string, {box}"), spark.createDataFrame(hints, "diagram_id string, pos long, edge_id string"), spark.createDataFrame(pages, "diagram_id string, page_width double, page_height double")]
    columns = ("diagram_id", "n", "findings")
    got = told(designs.checked(*tables), *columns)
    assert got == told(designs.listed(designs.design_findings(tables[0], normalize.assign_edge_ids(tables[1]), *tables[2:])), *columns) and got
    monkeypatch.setattr(packed, "LARGE", 12)
    assert told(designs.checked(*tables), *columns) == got


def test_large_responses_go_through_tables(spark, monkeypatch):
    rng = random.Random(3)
    texts = [json.dumps(DESIGN), *(changed(rng, DESIGN) for _ in range(60)), json.dumps(DESIGN).replace('"x": 5', '"x": 2.5'), json.dumps(DESIGN).replace('"width": 1,', '"width": 1e12,')]
    rows = spark.createDataFrame([(i, 1, t) for i, t in enumerate(texts)], "run_id long, attempt_no int, content string")
    columns = ("run_id", "decode", "judgement", "finding")
    in_rows = told(attempts.judged(rows, "design"), *columns)
    monkeypatch.setattr(packed, "LARGE", 5)
    assert told(attempts.judged(rows, "design"), *columns) == in_rows and {r[2] for r in in_rows} == {"ok", "invalid"}


# Boxes of any size.

BOX = "diagram_id string, id string, parent_id string, x double, y double, width double, height double"


def meet(a, b):
    w = min(a[3] + a[5] / 2, b[3] + b[5] / 2) - max(a[3] - a[5] / 2, b[3] - b[5] / 2)
    h = min(a[4] + a[6] / 2, b[4] + b[6] / 2) - max(a[4] - a[6] / 2, b[4] - b[6] / 2)
    return a[1] < b[1] and w > 1e-6 and h > 1e-6 and w * h > 1e-6 and a[2] != b[1] and b[2] != a[1]


@pytest.mark.parametrize("few", [0, 64])
def test_overlaps_of_all_sizes(spark, few):
    rng = random.Random(5)
    size = lambda: 10.0 ** rng.choice([-9, -3, 0, 0, 0.3, 1, 3, 12, 200, 308])
    at = lambda: rng.choice([rng.uniform(0, 20), rng.uniform(0, 20), 10.0 ** rng.uniform(0, 14), 4.0 ** rng.randrange(9), -rng.uniform(0, 50)])
    rows = [("g", f"n{i:03d}", rng.choice([None, "n001"]), at(), at(), size(), size()) for i in range(250)]
    rows += [("h", "a", None, float("nan"), 1.0, 1.0, 1.0), ("h", "b", None, 1.0, 1.0, float("inf"), 1.0), ("h", "c", None, None, 1.0, 1.0, 1.0), ("h", "d", None, 1.0, 1.0, 1.0, 1.0)]
    got = designs.overlaps(spark.createDataFrame(rows, BOX).where("diagram_id = 'g'"), few).collect()
    assert sorted((r["a_id"], r["b_id"]) for r in got) == sorted((a[1], b[1]) for a in rows[:250] for b in rows[:250] if meet(a, b))
    assert designs.overlaps(spark.createDataFrame(rows, BOX), few).where("diagram_id = 'h'").count() >= 0


def test_overlaps_of_a_large_board(spark):
    rng = random.Random(6)
    rows = [("g", f"n{i}", None, 3.0 * (i % 170), 3.0 * (i // 170), rng.uniform(1, 2.9), rng.uniform(1, 2.9)) for i in range(28_900)]  # a grid of boxes that do not meet
    rows += [("g", f"w{i}", None, 255.0, 1.5 + 3.0 * i, 1e12, 0.05) for i in range(100)] + [("g", "tall", None, 1.5, 1.0, 0.05, 1e9)]
    start = time.time()
    found = designs.overlaps(spark.createDataFrame(rows, BOX)).collect()
    assert {r["a_id"][0] + r["b_id"][0] for r in found} <= {"nw", "tw", "nt"} and sum("tall" in (r["a_id"], r["b_id"]) for r in found) >= 100
    assert time.time() - start < 60


# Large graphs.


def test_large_graphs_equal_the_model(spark):
    rng, nodes, pairs, want = random.Random(11), [], [], {}
    for g in range(3):
        n = rng.choice([12, 30])
        ids = [f"n{i:02d}" for i in range(n)]
        rng.shuffle(ids)
        own = {(rng.choice(ids), rng.choice(ids)) for _ in range(round(n * [0.8, 1.3, 2][g]))} | set(zip(ids[:8], ids[1:8], strict=False))
        nodes += [(str(g), x) for x in ids]
        pairs += [(str(g), *p) for p in own]
        want |= {(str(g), a): v for a, v in closure_ranks(ids, own).items()}
    out = large_graphs.ranked(spark.createDataFrame(nodes, "diagram_id string, id string"), spark.createDataFrame(pairs, "diagram_id string, source string, target string")).collect()
    assert {(r["diagram_id"], r["id"]): (r["component"], r["rank"]) for r in out} == want


def test_chains_and_rings_take_few_rounds(spark):
    n = 3000
    row = spark.range(n).select(F.lit("chain").alias("diagram_id"), F.format_string("n%05d", (F.col("id") * 7919) % n).alias("id"), F.col("id").alias("k"))
    name = lambda k: F.format_string("n%05d", (k * 7919) % n)
    chain = row.select("diagram_id", "id", F.when(F.col("k") > 0, name(F.col("k") - 1)).alias("parent_id"))
    ring = row.select(F.lit("ring").alias("diagram_id"), "id", name((F.col("k") + n - 1) % n).alias("parent_id"))
    tail = spark.createDataFrame([("ring", "tail", "n00000"), ("self", "a", "a"), ("lost", "a", "zz")], "diagram_id string, id string, parent_id string")
    got = {(r["diagram_id"], r["id"]) for r in large_graphs.endless(chain.unionByName(ring).unionByName(tail)).collect()}
    assert len(got) == n + 2 and {d for d, _ in got} == {"ring", "self"} and ("ring", "tail") in got
    pairs = chain.where("parent_id is not null").select("diagram_id", F.col("parent_id").alias("source"), F.col("id").alias("target"))
    ranks = large_graphs.longest_paths(chain.select("diagram_id", "id"), pairs).collect()
    assert sorted(r["rank"] for r in ranks) == list(range(n))


def test_cycles_and_ranks_of_large_diagrams(spark, monkeypatch):
    nodes, edges = random_graphs(random.Random(12), 60)
    nodes, edges = spark.createDataFrame(nodes, NODE).dropDuplicates(["diagram_id", "id"]), spark.createDataFrame(edges, EDGE)
    cycles, ranks = told(normalize.containment_cycles(nodes), "diagram_id", "message"), told(graph.ranks(nodes, edges), "diagram_id", "id", "component", "rank")
    rows = told(graph.ranked_nodes(nodes, edges, "type"), "diagram_id", "id", "type", "is_container", "rank")
    monkeypatch.setattr(packed, "LARGE", 3)
    split = graph.split
    monkeypatch.setattr(graph, "split", lambda nodes: split(nodes, 3))
    assert told(normalize.containment_cycles(nodes), "diagram_id", "message") == cycles and cycles
    assert told(graph.ranks(nodes, edges), "diagram_id", "id", "component", "rank") == ranks
    assert told(graph.ranked_nodes(nodes, edges, "type"), "diagram_id", "id", "type", "is_container", "rank") == rows
