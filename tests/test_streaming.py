"""Responses that arrive in two batches are judged once each."""

import json

from sketchloom.streaming.responses import arriving, judge_stream

GRAPH = {"title": "t", "diagram_type": "flowchart", "orientation": "top_to_bottom", "nodes": [{"id": "a", "type": "process", "label": "A"}], "edges": []}


def test_two_batches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for run, content in (("good", json.dumps(GRAPH)), ("bad", "no json"), ("empty", json.dumps(GRAPH | {"nodes": []}))):
        (tmp_path / "in" / f"{run}.json").write_text(json.dumps({"run_id": run, "attempt_no": 1, "content": content}) + "\n")
        judge_stream(arriving(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = sorted((r["run_id"], r["judgement"], r["ext"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("bad", "invalid", "txt"), ("empty", "no_diagram", "json"), ("good", "ok", "json")]
