"""What keeps jobs in proportion to their tables: plans, parts and how often a text is judged."""

import os
import random
import textwrap
import time

from pyspark.sql import functions as F

import __spark_entry__ as entry
from sketchloom import storage
from sketchloom.functions import text as tx
from sketchloom.llm import decontaminate
from sketchloom.operators import attempts, dot, drawing, evaluate

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_each_text_is_judged_once(spark, monkeypatch):
    kept, most = attempts.kept, []
    monkeypatch.setattr(attempts, "kept", lambda df: most.append(df.count()) or kept(df))
    texts = ["no", None, '{"title": "t", "diagram_type": "flowchart", "orientation": "left_to_right", "nodes": [{"id": "a", "type": "process", "label": "A"}]}']
    rows = spark.createDataFrame([(str(i), 1, texts[i % 3]) for i in range(300)], "run_id string, attempt_no int, content string")
    got = {(r["content"], r["judgement"], r["finding"]): r["count"] for r in attempts.judged(rows).groupBy("content", "judgement", "finding").count().collect()}
    assert got == {("no", "invalid", "no_json"): 100, (None, "invalid", "no_json"): 100, (texts[2], "ok", None): 100}
    assert max(most) == 3


def test_each_review_is_judged_once(spark, monkeypatch):
    kept, most = attempts.kept, []
    monkeypatch.setattr(attempts, "kept", lambda df: most.append(df.count()) or kept(df))
    out = entry.queries()["review_outcomes"](spark, SF)
    assert out.count() > 100 and max(most) < 40


def test_wrap_of_long_texts(spark):
    rng = random.Random(4)
    words = ["a", "bcd", "efghi jk", "x" * 31, "y" * 45, " ", "   z", "\t", "\xe9t\xe9"]
    texts = [" ".join(rng.choices(words, k=400_000)), " " * 30 + "w" * 31, " " * 29 + "ab " + "v" * 70, "u" * 29 + "  " + "t" * 40, "s" * 29 + " " + "r" * 40]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i long, label string")
    begun = time.monotonic()
    got = {r["i"]: r["lines"] for r in rows.select("i", tx.wrap(F.replace(F.col("label"), F.lit("\t"), F.lit(" ")), 30).alias("lines")).collect()}
    assert time.monotonic() - begun < 10
    assert [got[i] for i in range(len(texts))] == [textwrap.wrap(x.replace("\t", " "), width=30, break_on_hyphens=False) for x in texts]


def test_markers_go_to_the_nodes(spark):
    told = plan(entry.queries()["visual_gaps"](spark, SF))
    assert "BroadcastHashJoin" in told and "SortMergeJoin" not in told and told.count("hashpartitioning(marker") == 1  # for the distinct markers


def test_drawings_need_no_packed_rows(spark):
    nodes = spark.createDataFrame([("d", 0, "a", "process", "A", None, "1"), ("d", 1, "b", "process", "B", None, None), ("d", 2, "b", "sensor", "again", None, None)], "diagram_id string, pos long, id string, type string, label string, parent_id string, reference_number string")
    places = spark.createDataFrame([("d", 0, "a", 1.0, 1.0, 1.0, 1.0), ("d", 1, "b", 9.0, 9.0, 1.0, 1.0), ("d", 2, "b", 5.0, 1.0, 1.0, 1.0)], "diagram_id string, pos long, node_id string, x double, y double, width double, height double")
    edges = spark.createDataFrame([("d", 0, "e", "a", "b", "flow", "forward", None, "solid", False)], "diagram_id string, pos long, id string, source string, target string, relation string, direction string, label string, style string, style_explicit boolean")
    pages = spark.createDataFrame([("d", 12.0, 7.0)], "diagram_id string, page_width double, page_height double")
    job = drawing.draw(nodes, places, edges, pages)
    assert [(r["begin_x"], r["end_x"]) for r in job.connectors.collect()] == [(1.5, 4.5)]  # one line, though two nodes are b
    assert sorted(r["label"] for r in job.shapes.collect()) == ["A", "B", "again"]
    assert all("collect_list" not in plan(t) for t in (job.shapes, job.connectors, job.callouts, job.findings))


def test_positions_are_dealt_once(spark):
    lines = spark.createDataFrame([("d", 0, "graph 1 9 9"), ("d", 1, 'node "a \\"b" 1 2 "3" 4'), ("e", 0, "graph 1 9"), ("f", 0, "edge")], "diagram_id string, pos long, line string")
    out = dot.parsed_positions(lines)
    assert plan(out).count("Exchange hashpartitioning") == 1
    assert sorted((r["diagram_id"], r["id"], r["ok"], r["width"]) for r in out.collect()) == [("d", 'a "b', True, 3.0), ("e", None, False, None), ("f", None, False, None)]


def test_parts_grow_with_the_table(spark, monkeypatch):
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    try:
        monkeypatch.setattr(storage, "PART", 2000)
        want = -(-os.path.getsize(f"{SF}/lineitem.parquet") // 2000)
        told = plan(entry.queries()["hint_findings"](spark, SF))
        assert spark.conf.get(name) == str(want) and f", {want}), REPARTITION_BY_NUM" in told
    finally:
        spark.conf.set(name, before)


def test_parents_are_joined_once(spark):
    told = plan(entry.queries()["schematic_parent_findings"](spark, SF))
    assert told.count("LeftOuter") == 1


def test_items_are_retrieved_before_they_are_verified(monkeypatch):
    item = "alpha beta gamma delta epsilon zeta eta theta. iota kappa lambda mu nu xi omicron"
    index = decontaminate.Index([(1, item)])
    asked = []
    monkeypatch.setattr(index, "verified", lambda ids: asked.append(len(ids)) or {0: (1.0, 1.0, 1.0)})
    assert index.search("nothing of it, but for alpha") == [] and asked == []
    assert [hit[0] for hit in index.search(item)] == [1] and len(asked) == 1


def test_each_design_is_judged_once(spark):
    """The rules are in no filter beside the column: they are evaluated in one place."""
    out = entry.queries()["design_findings"](spark, SF)
    assert "lambdafunction" not in plan(out) and out.count() > 50


def test_snapshots_are_read_once(spark):
    out = entry.queries()["snapshot_compare"](spark, SF)
    assert plan(out).split("== Initial Plan ==")[-1].count("Window [") == 1


def test_one_line(spark):
    rng = random.Random(8)
    texts = [None, "", " ", *("".join(rng.choices(" \t\n\r\x0b\f\xa0aé", k=rng.randrange(12))) for _ in range(500))]
    rows = spark.createDataFrame([(x,) for x in texts], "t string")
    old = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce("t", F.lit("")), r"[\r\n\t]+", " "), r"\s+", " "))
    assert rows.where(~tx.one_line(F.col("t")).eqNullSafe(old)).count() == 0


def test_documents_are_parsed_once(spark, monkeypatch):
    """No table of differences is written from a plan that parses in a filter."""
    kept, plans = evaluate.kept, []
    monkeypatch.setattr(evaluate, "kept", lambda df: plans.append(plan(df)) or kept(df))
    pairs = spark.createDataFrame([("a", '{"x": [1, {"y": null, "z": []}], "w": {}}', '{"x": [1, {"z": [2]}], "w": {"v": null}}')], "case_id string, expected string, actual string")
    got = [tuple(r) for r in evaluate.structural_differences(pairs, "case_id").collect()]
    assert got == [("a", "x[1].z[0]", "<missing>", "2")]
    assert not [line for p in plans for line in p.splitlines() if "Filter " in line and "parsejson" in line.lower()]
