"""Sources and sinks over temporary folders."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from sketchloom.functions import text as tx
from sketchloom.operators import attempts
from sketchloom.sources import files


def test_requests_expected_and_marks(spark, tmp_path):
    (tmp_path / "b case.txt").write_text("two\nlines")
    (tmp_path / "a.txt").write_text("one")
    (tmp_path / "x.json").write_text(json.dumps({"title": "t", "diagram_type": "flowchart", "orientation": "top_to_bottom", "nodes": [{"id": "a", "type": "process", "label": "A"}], "edges": []}, indent=1))
    (tmp_path / "y.error.json").write_text("{}")
    assert sorted(map(tuple, files.read_requests(spark, str(tmp_path)).collect())) == [("a", "one"), ("b case", "two\nlines")]
    assert [(r["case_id"], r["nodes"][0]["id"]) for r in files.read_expected(spark, str(tmp_path)).collect()] == [("x", "a")]
    assert [r["case_id"] for r in files.read_error_marks(spark, str(tmp_path)).collect()] == ["y"]


def test_artifacts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.bin").write_bytes(b"abc")
    got = {r["path"]: r["sha256"] for r in files.read_artifacts(spark, str(tmp_path)).collect()}
    assert got == {"in/a.bin": hashlib.sha256(b"abc").hexdigest()}


def test_documents_and_responses(spark, tmp_path):
    rows = spark.createDataFrame([("r", 1, '{"a": 1}'), ("r", 2, "no")], "run_id string, attempt_no int, content string")
    files.write_documents(rows.selectExpr("run_id", "cast(null as string) as empty", "attempt_no"), str(tmp_path / "out"))
    assert sorted(spark.read.text(str(tmp_path / "out")).toPandas()["value"])[0] == '{"attempt_no":1,"empty":null,"run_id":"r"}'
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        files.write_documents(rows, str(tmp_path / "out"))
    files.write_responses(rows, str(tmp_path / "raw"))
    assert {(r["attempt_no"], r["ext"]) for r in spark.read.parquet(str(tmp_path / "raw")).collect()} == {(1, "json"), (2, "txt")}
    assert files.is_below("/a/b", "/a") and not files.is_below("/ab", "/a")


GOOD = {"title": "t", "diagram_type": "flowchart", "orientation": "top_to_bottom", "nodes": [{"id": "a", "type": "process", "label": "A"}], "edges": [{"source": "a", "target": "a", "relation": "flow"}]}


def changed(**parts):
    return json.dumps(GOOD | parts)


def test_strict_decoding(spark):
    node, edge = GOOD["nodes"][0], GOOD["edges"][0]
    cases = [
        (json.dumps(GOOD), "ok"),
        ("{", "no_json"),
        ("[1]", "no_object"),
        (json.dumps({k: v for k, v in GOOD.items() if k != "title"}), "missing_key"),
        (changed(extra=1), "unknown_key"),
        (changed(nodes=[node | {"x": 1.0}]), "unknown_key"),
        (changed(nodes=[node | {"label": 5}]), "wrong_type"),
        (changed(nodes=[node | {"label": None}]), "wrong_type"),
        (changed(nodes=[node | {"notes": None}]), "ok"),
        (changed(nodes=[{"id": "a", "type": "process"}]), "missing_key"),
        (changed(edges=[{"source": "a", "target": "a"}]), "ok"), (json.dumps({k: v for k, v in GOOD.items() if k not in ("nodes", "edges")}), "ok"),
        (changed(edges=[edge | {"direction": None}]), "wrong_type"), (changed(edges=[edge | {"style": None}]), "wrong_type"), (changed(nodes=[5]), "wrong_type"), (changed(nodes=None), "wrong_type"),
        ("null", "no_object"), ("", "no_json"), (None, "no_json"),
        (changed(nodes="none"), "wrong_type"),
        (changed(title=None), "wrong_type"),
        (changed(edges=[edge | {"style": "wavy"}]), "out_of_domain"),
        (changed(nodes=[node | {"type": "gadget"}]), "out_of_domain"),
    ]
    rows = spark.createDataFrame([(str(i), 1, c) for i, (c, _) in enumerate(cases)], "run_id string, attempt_no int, content string")
    got = {r["run_id"]: r["decode"] for r in attempts.decoded(rows).collect()}
    assert [got[str(i)] for i in range(len(cases))] == [want for _, want in cases]
    nodes, edges = attempts.flattened(attempts.decoded(rows).where("decode = 'ok'"), "run_id")
    assert nodes.count() == 3 and edges.where("direction = 'forward' and relation = 'flow' and not style_explicit").count() == 3


PLAN = {"composition": "radial", "page_width": 9, "page_height": 7.5, "placements": [{"node_id": "a", "x": 2, "y": 2.0, "width": 1, "height": 1}]}
DESIGN = {"graph": GOOD | {"edges": []}, "layout": PLAN, "rationale": "r"}
BOX = PLAN["placements"][0]


def judged(spark, contents, what):
    rows = spark.createDataFrame([(str(i), 1, c) for i, c in enumerate(contents)], "run_id string, attempt_no int, content string")
    got = {r["run_id"]: (r["decode"], r["judgement"], r["finding"]) for r in attempts.judged(rows, what).collect()}
    return [got[str(i)] for i in range(len(contents))]


def test_judgement_of_graphs_and_designs(spark):
    node = GOOD["nodes"][0]
    assert [(d, j) for d, j, _ in judged(spark, [json.dumps(GOOD), changed(nodes=[]), changed(nodes=[node, node]), changed(edges=[{"source": "a", "target": "z"}]), "x"], "graph")] == [
        ("ok", "ok"), ("ok", "no_diagram"), ("ok", "invalid"), ("ok", "invalid"), ("no_json", "invalid"),
    ]
    plan = lambda **x: json.dumps(DESIGN | {"layout": PLAN | x})
    two = GOOD | {"nodes": [node, node | {"id": "b"}], "edges": []}
    cases = [
        (json.dumps(DESIGN), "ok", "ok", None), (json.dumps(DESIGN | {"graph": GOOD | {"nodes": [], "edges": []}, "layout": PLAN | {"placements": []}}), "ok", "ok", None),
        (plan(placements=[]), "ok", "invalid", "missing placement for node 'a'"), (plan(placements=[BOX | {"width": 0}]), "out_of_domain", "invalid", "out_of_domain"),
        (plan(placements=[BOX | {"importance": "vital"}]), "out_of_domain", "invalid", "out_of_domain"), (plan(composition="loose"), "out_of_domain", "invalid", "out_of_domain"),
        (plan(connector_hints=[{"edge_id": "e9"}]), "ok", "invalid", "connector hint references unknown edge 'e9'"), (plan(page_width="9"), "ok", "ok", None), (plan(page_width="wide"), "wrong_type", "invalid", "wrong_type"),
        (json.dumps({k: v for k, v in DESIGN.items() if k != "rationale"}), "missing_key", "invalid", "missing_key"), (json.dumps(DESIGN | {"layout": {k: v for k, v in PLAN.items() if k != "placements"}}), "missing_key", "invalid", "missing_key"),
        (json.dumps(DESIGN | {"graph": two, "layout": PLAN | {"placements": [BOX, BOX | {"node_id": "b", "x": 2.5}]}}), "ok", "invalid", "placements for nodes 'a' and 'b' overlap"),
        (json.dumps(DESIGN | {"graph": GOOD | {"nodes": [node, node]}}), "ok", "invalid", "duplicate node ID 'a'"), (plan(placements=[BOX | {"x": 8.9}]), "ok", "invalid", "placement for node 'a' is outside page bounds"),
    ]
    assert judged(spark, [c[0] for c in cases], "design") == [c[1:] for c in cases]


def test_reviews(spark):
    issue = {"severity": "low", "category": "spacing", "description": "d"}
    say = lambda approved, revised=..., **more: json.dumps({"approved": approved, "summary": "s"} | ({} if revised is ... else {"revised_design": revised}) | more)
    broken = DESIGN | {"layout": PLAN | {"placements": []}}
    cases = [
        (say(True), "ok", False), (say(True, None, issues=[issue]), "ok", False), (say(True, DESIGN), "invalid_critique", False), (say(False), "invalid_critique", False), (say(False, DESIGN), "ok", True),
        (say(False, broken), "invalid_critique", False), (say(False, DESIGN | {"more": 1}), "invalid_critique", False), (say("maybe"), "invalid_critique", False), (say("yes"), "ok", False),
        (say(True, issues=[issue | {"severity": "huge"}]), "invalid_critique", False), (say(True, issues=[issue | {"category": "taste"}]), "invalid_critique", False), (say(True, issues=[issue | {"node_ids": [1]}]), "invalid_critique", False), ("x", "invalid_critique", False),
    ]
    rows = spark.createDataFrame([(str(i), c[0], "first") for i, c in enumerate(cases)], "run_id string, content string, initial string")
    got = {r["run_id"]: r for r in attempts.reviewed(rows).collect()}
    assert [(got[str(i)]["outcome"], got[str(i)]["revision_applied"]) for i in range(len(cases))] == [c[1:] for c in cases]
    assert [got[str(i)]["final_design"] for i in (0, 2)] == ["first", None] and json.loads(got["4"]["final_design"]) == DESIGN


def test_requests_from_templates(spark):
    rows = spark.createDataFrame([("s", "f", "r", ("d", None))], "a string, b string, c string, g struct<x:string,y:string>")
    row = rows.select(tx.filled("{source}: {finding} {response}{", source=F.col("a"), finding=F.col("b"), response=F.col("c")).alias("t"), attempts.critique_request(F.col("a"), F.col("g"), "{design}|{source}").alias("u")).first()
    assert row["t"] == "s: f r{" and json.loads(row["u"].split("|")[0]) == {"x": "d", "y": None}
