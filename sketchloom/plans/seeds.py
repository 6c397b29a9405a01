"""Diagram tables derived from the given tables, as SQL that Spark and DuckDB both read.

@name stands for a given table. Each entry may use those above it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..functions.tables import MARKERS, sql_case
from ..storage import kept, parts_of

SEEDS = {
    # flows: one diagram for each user and day, one edge for each step
    "flow_events": """
        SELECT CAST(user_id AS STRING) || '/' || CAST(CAST(ts AS DATE) AS STRING) AS diagram_id, user_id, event_id, ts, event_type, value, props,
          CAST(row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS BIGINT) AS k,
          lead(event_type) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS next_type
        FROM @events""",
    "flow_diagrams": """
        SELECT diagram_id, 'flow' AS title, 'flowchart' AS diagram_type,
          CASE WHEN min(user_id) % 2 = 0 THEN 'top_to_bottom' ELSE 'left_to_right' END AS orientation
        FROM flow_events GROUP BY diagram_id""",
    "flow_nodes": """
        SELECT diagram_id, row_number() OVER (PARTITION BY diagram_id ORDER BY first_k) AS pos, event_type AS id,
          CASE event_type WHEN 'click' THEN 'process' WHEN 'view' THEN 'document' WHEN 'purchase' THEN 'database' WHEN 'signup' THEN 'interface' ELSE 'decision' END AS type,
          event_type AS label, CAST(NULL AS STRING) AS parent_id, CAST(NULL AS STRING) AS reference_number
        FROM (SELECT diagram_id, event_type, min(k) AS first_k FROM flow_events GROUP BY diagram_id, event_type) AS f""",
    "flow_edges": """
        SELECT diagram_id, k AS pos, CASE WHEN k % 3 = 0 THEN 'e' || CAST(k AS STRING) END AS id, event_type AS source, next_type AS target,
          CASE next_type WHEN 'error' THEN 'control' WHEN 'purchase' THEN 'data' WHEN 'click' THEN 'flow' WHEN 'view' THEN 'association' ELSE 'communication' END AS relation,
          CASE WHEN k % 7 = 0 THEN 'reverse' ELSE 'forward' END AS direction, CAST(NULL AS STRING) AS label, 'solid' AS style, false AS style_explicit
        FROM flow_events WHERE next_type IS NOT NULL""",
    # schematics: one diagram for each order, its lines inside a housing, its suppliers outside
    "order_lines": """
        SELECT 'o' || CAST(l_orderkey AS STRING) AS diagram_id, l_orderkey, l_suppkey, l_partkey, l_linenumber, l_quantity, l_discount, l_tax, l_returnflag,
          CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS BIGINT) AS n
        FROM @lineitem""",
    "schematic_diagrams": "SELECT DISTINCT diagram_id, 'order' AS title, 'component_schematic' AS diagram_type, 'left_to_right' AS orientation FROM order_lines",
    "schematic_nodes": """
        SELECT DISTINCT diagram_id, CAST(0 AS BIGINT) AS pos, 'order' AS id, 'housing' AS type, 'Order' AS label, CAST(NULL AS STRING) AS parent_id, '100' AS reference_number FROM order_lines
        UNION ALL
        SELECT diagram_id, n AS pos, 'l' || CAST(n AS STRING) AS id, CASE l_returnflag WHEN 'A' THEN 'component' WHEN 'N' THEN 'sensor' ELSE 'memory' END AS type,
          'Part ' || CAST(l_partkey AS STRING) AS label, 'order' AS parent_id, CASE WHEN n % 4 = 0 THEN NULL ELSE CAST(n AS STRING) END AS reference_number FROM order_lines
        UNION ALL
        SELECT diagram_id, 1000 + row_number() OVER (PARTITION BY diagram_id ORDER BY l_suppkey) AS pos, 's' || CAST(l_suppkey AS STRING) AS id, 'power_source' AS type,
          'Supplier ' || CAST(l_suppkey AS STRING) AS label, CAST(NULL AS STRING) AS parent_id, CAST(NULL AS STRING) AS reference_number
        FROM (SELECT DISTINCT diagram_id, l_suppkey FROM order_lines) AS s""",
    "schematic_edges": """
        SELECT diagram_id, 2 * n AS pos, CAST(NULL AS STRING) AS id, 's' || CAST(l_suppkey AS STRING) AS source, 'l' || CAST(n AS STRING) AS target,
          'power' AS relation, 'forward' AS direction, CAST(NULL AS STRING) AS label, 'dashed' AS style, n % 3 = 0 AS style_explicit FROM order_lines
        UNION ALL
        SELECT diagram_id, 2 * n + 1 AS pos, CASE WHEN n % 2 = 0 THEN 'e' || CAST(n AS STRING) END AS id, 'l' || CAST(n AS STRING) AS source, 's' || CAST(l_suppkey AS STRING) AS target,
          'data' AS relation, 'forward' AS direction, 'reports' AS label, 'solid' AS style, false AS style_explicit FROM order_lines""",
    # the same with mistakes: repeated ids and references, wrong and circular parents, edges to nothing
    "dirty_nodes": """
        SELECT diagram_id, pos, CASE WHEN pos BETWEEN 1 AND 999 AND pos % 6 = 0 THEN 'l1' ELSE id END AS id,
          CASE WHEN pos BETWEEN 1 AND 999 AND pos % 3 <> 0 THEN 'subsystem' ELSE type END AS type, label,
          CASE WHEN pos BETWEEN 1 AND 999 THEN CASE WHEN pos % 7 = 5 THEN id WHEN pos % 5 = 1 THEN 'l' || CAST(pos + 1 AS STRING)
            WHEN pos % 5 = 2 AND length(diagram_id) % 2 = 0 THEN 'l' || CAST(pos - 1 AS STRING) ELSE parent_id END ELSE parent_id END AS parent_id,
          CASE WHEN pos % 5 = 3 THEN ' 100 ' ELSE reference_number END AS reference_number
        FROM schematic_nodes""",
    "dirty_edges": """
        SELECT diagram_id, pos, CASE WHEN pos % 9 = 5 THEN 'e2' ELSE id END AS id, CASE WHEN pos % 13 = 6 THEN 'nobody' ELSE source END AS source,
          CASE WHEN pos % 11 = 3 THEN 'nowhere' ELSE target END AS target, relation, direction, label, style, style_explicit FROM schematic_edges""",
    "labels_of": "SELECT doc_id, text FROM @documents",
    # designs: proposed boxes and connector hints for the schematics
    "placements": """
        SELECT diagram_id, CAST(0 AS BIGINT) AS pos, 'order' AS node_id, 5e0 AS x, 3.5e0 AS y, 9e0 AS width, 6e0 AS height FROM (SELECT DISTINCT diagram_id FROM order_lines) AS d
        UNION ALL
        SELECT diagram_id, n AS pos, CASE WHEN l_quantity > 49 THEN 'ghost' || CAST(n AS STRING) ELSE 'l' || CAST(n AS STRING) END AS node_id,
          1.5e0 + (n % 4) * 2e0 + l_discount * 5e0 AS x, 1.5e0 + floor(n / 4) * 1.5e0 + l_tax * 5e0 AS y, 0.5e0 + l_quantity / 32e0 AS width, 0.75e0 AS height
        FROM order_lines WHERE l_quantity > 1
        UNION ALL
        SELECT diagram_id, 1000 + n AS pos, 's' || CAST(l_suppkey AS STRING) AS node_id, 10.5e0 AS x, 0.5e0 + n * 1e0 AS y, 1.5e0 AS width, 0.5e0 AS height FROM order_lines""",
    "pages_of": "SELECT DISTINCT diagram_id, 12e0 AS page_width, 7e0 AS page_height FROM order_lines",
    "hints": """
        SELECT diagram_id, n AS pos, 'e' || CAST(CASE WHEN n % 5 = 4 THEN 1 WHEN n % 7 = 6 THEN 90 + n ELSE n END AS STRING) AS edge_id, 'left' AS source_side, 'auto' AS target_side FROM order_lines""",
    # responses: valid graphs and many ways to fail
    "attempts": """
        SELECT diagram_id AS run_id, k AS attempt_no, CAST(CAST(round(value * 100) AS BIGINT) % 12 AS INT) AS kind,
          CASE CAST(round(value * 100) AS BIGINT) % 12
            WHEN 0 THEN '{"title": "t", "diagram_type": "flowchart", "orientation": "left_to_right", "nodes": [{"id": "a", "type": "process", "label": "' || event_type || '"}], "edges": []}'
            WHEN 1 THEN 'no json ' || event_type
            WHEN 2 THEN '{"title": "t", "orientation": "left_to_right", "nodes": [], "edges": []}'
            WHEN 3 THEN '{"title": "t", "diagram_type": "flowchart", "orientation": "left_to_right", "nodes": [{"id": "a", "type": "process", "label": "' || event_type || '", "x": 1}], "edges": []}'
            WHEN 4 THEN '{"title": "t", "diagram_type": "flowchart", "orientation": "left_to_right", "nodes": [], "edges": []}'
            WHEN 5 THEN '{"title": "t", "diagram_type": "flowchart", "orientation": "left_to_right", "nodes": [{"id": "a", "type": "gadget", "label": "b"}], "edges": []}'
            WHEN 6 THEN '{"title": "t", "diagram_type": "flowchart", "orientation": "left_to_right", "nodes": [{"id": "a", "type": "process", "label": "' || event_type || '"}, {"id": "b", "type": "process", "label": "' || event_type || '"}], "edges": [{"source": "a", "target": "b"}]}'
            WHEN 7 THEN '{"title": "t", "diagram_type": "flowchart", "orientation": "left_to_right"}'
            WHEN 8 THEN '{"title": "t", "diagram_type": "flowchart", "orientation": "left_to_right", "nodes": [{"id": "a", "type": "process", "label": "' || event_type || '"}], "edges": [{"source": "a", "target": "a", "direction": null}]}'
            WHEN 9 THEN '{"title": "t", "diagram_type": "flowchart", "orientation": "left_to_right", "nodes": [{"id": "a", "type": "process", "label": "' || event_type || '"}], "edges": [{"source": "a", "target": "zz", "relation": "data"}]}'
            WHEN 10 THEN '{"title": "t", "diagram_type": "flowchart", "orientation": "left_to_right", "nodes": [{"id": "a", "type": "process", "label": "' || event_type || '"}, {"id": "a", "type": "process", "label": "' || event_type || '"}], "edges": []}'
            ELSE '{"title": "t", "diagram_type": "flowchart", "orientation": "left_to_right", "nodes": [5], "edges": []}' END AS content,
          CASE WHEN k % 2 = 1 THEN 'r' || CAST(event_id AS STRING) END AS request_id, CASE WHEN k % 3 <> 0 THEN value END AS elapsed_ms
        FROM flow_events""",
    # designs of the orders as responses, and reviews of them
    "design_attempts": """
        SELECT diagram_id AS run_id, n AS attempt_no, CAST(l_partkey % 12 AS INT) AS kind, CAST(NULL AS STRING) AS request_id, 1e0 AS elapsed_ms,
          CASE l_partkey % 12
            WHEN 0 THEN '{"graph": {"title": "t", "diagram_type": "flowchart", "orientation": "left_to_right", "nodes": [{"id": "a", "type": "process", "label": "' || l_returnflag || '"}], "edges": []}, "layout": {"composition": "radial", "page_width": 9, "page_height": 7, "placements": [{"node_id": "a", "x": 2, "y": 2, "width": 1, "height": 1}]}, "rationale": "r"}'
            WHEN 1 THEN '{"graph": {"title": "t", "diagram_type": "flowchart", "orientation": "left_to_right", "nodes": [{"id": "a", "type": "process", "label": "' || l_returnflag || '"}, {"id": "b", "type": "process", "label": "' || l_returnflag || '"}], "edges": []}, "layout": {"composition": "radial", "page_width": 9, "page_height": 7, "placements": [{"node_id": "a", "x": 2, "y": 2, "width": 1, "height": 1}, {"node_id": "b", "x": 2.5, "y": 2, "width": 1, "height": 1}]}, "rationale": "r"}'
            WHEN 2 THEN '{"graph": {"title": "t", "diagram_type": "flowchart", "orientation": "left_to_right", "nodes": [{"id": "a", "type": "process", "label": "' || l_returnflag || '"}], "edges": []}, "layout": {"composition": "radial", "page_width": 9, "page_height": 7, "placements": [{"node_id": "a", "x": 2, "y": 2, "width": 1, "height": 1, "importance": "vital"}]}, "rationale": "r"}'
            WHEN 3 THEN '{"graph": {"title": "t", "diagram_type": "flowchart", "orientation": "left_to_right", "nodes": [{"id": "a", "type": "process", "label": "' || l_returnflag || '"}], "edges": []}, "layout": {"composition": "radial", "page_width": 9, "page_height": 7, "placements": [{"node_id": "a", "x": 2, "y": 2, "width": 1, "height": 1}]}}'
            WHEN 4 THEN '{"graph": {"title": "t", "diagram_type": "flowchart", "orientation": "left_to_right", "nodes": [{"id": "a", "type": "process", "label": "' || l_returnflag || '"}], "edges": []}, "layout": {"composition": "radial", "page_width": 9, "page_height": 7, "placements": [{"node_id": "a", "x": 2, "y": 2, "width": 0, "height": 1}]}, "rationale": "r"}'
            WHEN 5 THEN '{"graph": {"title": "t", "diagram_type": "flowchart", "orientation": "left_to_right", "nodes": [], "edges": []}, "layout": {"composition": "radial", "page_width": 9, "page_height": 7, "placements": []}, "rationale": "r"}'
            WHEN 6 THEN '{"graph": {"title": "t", "diagram_type": "flowchart", "orientation": "left_to_right", "nodes": [{"id": "a", "type": "process", "label": "' || l_returnflag || '"}], "edges": [{"source": "zz", "target": "a"}]}, "layout": {"composition": "radial", "page_width": 9, "page_height": 7, "placements": [{"node_id": "a", "x": 2, "y": 2, "width": 1, "height": 1}]}, "rationale": "r"}'
            WHEN 7 THEN '{"graph": {"title": "t", "diagram_type": "flowchart", "orientation": "left_to_right", "nodes": [{"id": "a", "type": "process", "label": "' || l_returnflag || '"}], "edges": []}, "layout": {"composition": "radial", "page_width": "9", "page_height": 7, "placements": [{"node_id": "a", "x": 2, "y": 2, "width": 1, "height": 1}]}, "rationale": "r"}'
            WHEN 8 THEN '{"graph": {"title": "t", "diagram_type": "flowchart", "orientation": "left_to_right", "nodes": [{"id": "a", "type": "process", "label": "' || l_returnflag || '"}], "edges": []}, "layout": {"composition": "radial", "page_width": 9, "page_height": 7, "placements": []}, "rationale": "r"}'
            WHEN 9 THEN '{"graph": {"title": "t", "diagram_type": "flowchart", "orientation": "left_to_right", "nodes": [{"id": "a", "type": "process", "label": "' || l_returnflag || '"}], "edges": []}, "layout": {"composition": "radial", "page_width": 9, "page_height": 7, "placements": [{"node_id": "a", "x": 8.9, "y": 2, "width": 1, "height": 1}]}, "rationale": "r"}'
            WHEN 10 THEN '{"graph": {"title": "t", "diagram_type": "flowchart", "orientation": "left_to_right", "nodes": [{"id": "a", "type": "process", "label": "' || l_returnflag || '"}], "edges": [{"source": "a", "target": "a"}]}, "layout": {"composition": "radial", "page_width": 9, "page_height": 7, "placements": [{"node_id": "a", "x": 2, "y": 2, "width": 1, "height": 1}], "connector_hints": [{"edge_id": "e1", "target_side": "top"}]}, "rationale": "r"}'
            ELSE '{"graph": {"title": "t", "diagram_type": "flowchart", "orientation": "left_to_right", "nodes": [{"id": "a", "type": "process", "label": "' || l_returnflag || '"}], "edges": []}, "layout": {"composition": "radial", "page_width": 9, "page_height": 7, "placements": [{"node_id": "a", "x": 2, "y": 2, "width": 1, "height": 1}], "connector_hints": [{"edge_id": "e1"}]}, "rationale": "r"}' END AS content
        FROM order_lines""",
    "reviews": """
        SELECT diagram_id AS run_id, CAST(l_suppkey % 9 AS INT) AS kind, 'i' || diagram_id AS initial,
          CASE l_suppkey % 9
            WHEN 0 THEN '{"approved": true, "summary": "s"}'
            WHEN 1 THEN '{"approved": true, "summary": "s", "issues": [{"severity": "low", "category": "spacing", "description": "d"}], "revised_design": null}'
            WHEN 2 THEN '{"approved": true, "summary": "s", "revised_design": {"graph": {"title": "t", "diagram_type": "flowchart", "orientation": "left_to_right", "nodes": [{"id": "a", "type": "process", "label": "' || l_returnflag || '"}], "edges": []}, "layout": {"composition": "radial", "page_width": 9, "page_height": 7, "placements": [{"node_id": "a", "x": 2, "y": 2, "width": 1, "height": 1}]}, "rationale": "r"}}'
            WHEN 3 THEN '{"approved": false, "summary": "s"}'
            WHEN 4 THEN '{"approved": false, "summary": "s", "revised_design": {"graph": {"title": "t", "diagram_type": "flowchart", "orientation": "left_to_right", "nodes": [{"id": "a", "type": "process", "label": "' || l_returnflag || '"}], "edges": []}, "layout": {"composition": "radial", "page_width": 9, "page_height": 7, "placements": [{"node_id": "a", "x": 2, "y": 2, "width": 1, "height": 1}]}, "rationale": "r"}}'
            WHEN 5 THEN '{"approved": false, "summary": "s", "revised_design": {"graph": {"title": "t", "diagram_type": "flowchart", "orientation": "left_to_right", "nodes": [{"id": "a", "type": "process", "label": "' || l_returnflag || '"}], "edges": []}, "layout": {"composition": "radial", "page_width": 9, "page_height": 7, "placements": []}, "rationale": "r"}}'
            WHEN 6 THEN '{"approved": true, "summary": "s", "issues": [{"severity": "huge", "category": "spacing", "description": "d"}]}'
            WHEN 7 THEN '{"approved": null, "summary": "s"}'
            ELSE '{"approved": true}' END AS content
        FROM order_lines WHERE n = 1""",
    "requests": "SELECT diagram_id AS run_id, CASE WHEN min(user_id) % 17 = 0 THEN '  ' ELSE 'Draw ' || diagram_id END AS text FROM flow_events GROUP BY diagram_id",
    # critiques of the orders' designs
    "critiques": """
        SELECT diagram_id AS run_id, l_returnflag = 'A' AS approved, 'c' || CAST(l_partkey AS STRING) AS summary,
          CASE WHEN l_partkey % 3 > 0 THEN 'r' || CAST(l_suppkey AS STRING) END AS revised_design, l_quantity < 45 AS revision_valid FROM order_lines WHERE n = 1""",
    # evaluation: what was expected, and answers that differ
    "expected_edges": "SELECT diagram_id, row_number() OVER (PARTITION BY diagram_id ORDER BY pos) - 1 AS pos, source, target, relation, direction FROM flow_edges",
    "actual_edges": """
        SELECT diagram_id, pos, source, target, CASE WHEN (pos + length(diagram_id)) % 5 = 0 THEN 'power' ELSE relation END AS relation, direction
        FROM (SELECT *, max(pos) OVER (PARTITION BY diagram_id) AS last_pos FROM expected_edges) AS e WHERE NOT (pos = last_pos AND length(diagram_id) % 2 = 0)""",
    "expected_nodes": "SELECT diagram_id, pos - 1 AS pos, id, type, label, parent_id FROM flow_nodes",
    "actual_nodes": """
        SELECT diagram_id, pos, id, CASE WHEN (pos + length(diagram_id)) % 9 = 2 THEN 'note' ELSE type END AS type, CASE WHEN pos = 1 AND length(diagram_id) % 2 = 0 THEN label || '!' ELSE label END AS label,
          CASE WHEN pos = 2 THEN 'home' END AS parent_id FROM expected_nodes WHERE NOT (pos = 3 AND length(diagram_id) % 2 = 1)
        UNION ALL SELECT diagram_id, CAST(9 AS BIGINT) AS pos, 'extra' AS id, 'note' AS type, 'x' AS label, CAST(NULL AS STRING) AS parent_id FROM flow_diagrams WHERE length(diagram_id) % 4 = 2""",
    "actual_diagrams": """
        SELECT diagram_id, CASE WHEN diagram_id LIKE '2%' THEN 'other' ELSE title END AS title, diagram_type, CASE WHEN diagram_id LIKE '3%' THEN 'left_to_right' ELSE orientation END AS orientation FROM flow_diagrams""",
    # the same with all fields, by which structures are compared
    "expected_full_nodes": """
        SELECT diagram_id, pos, id, type, label, parent_id, CASE WHEN pos % 2 = 0 THEN CAST(pos + 10 AS STRING) END AS reference_number, CASE WHEN pos % 3 = 1 THEN 'seen as "' || id || '"' END AS notes FROM expected_nodes""",
    "actual_full_nodes": """
        SELECT diagram_id, pos, id, type, label, parent_id, CASE WHEN pos % 2 = 0 AND length(diagram_id) % 3 > 0 THEN CAST(pos + 10 AS STRING) WHEN pos = 1 AND length(diagram_id) % 4 = 1 THEN '1' END AS reference_number,
          CASE WHEN pos % 3 = 1 AND length(diagram_id) % 5 = 0 THEN 'other' WHEN pos % 3 = 1 THEN 'seen as "' || id || '"' END AS notes FROM actual_nodes""",
    "expected_full_edges": """
        SELECT diagram_id, pos, source, target, relation, direction, CASE WHEN pos % 2 = 0 THEN 'to ' || target END AS label, CASE WHEN pos % 3 = 0 THEN 'dashed' ELSE 'solid' END AS style FROM expected_edges""",
    "actual_full_edges": """
        SELECT diagram_id, pos, source, target, relation, direction, CASE WHEN pos % 2 = 0 AND length(diagram_id) % 4 > 0 THEN 'to ' || target END AS label, CASE WHEN (pos + length(diagram_id)) % 3 = 0 THEN 'dashed' ELSE 'solid' END AS style FROM actual_edges""",
    # snapshots of drawings before a move, after it, and reopened
    "snapshots": """
        SELECT diagram_id AS drawing, n AS root_pos, 0 AS dfs_pos, CASE WHEN n % 3 = 0 THEN 'Part\t' || CAST(l_partkey % 50 AS STRING) ELSE ' Part  ' || CAST(l_partkey % 50 AS STRING) END AS label,
          1e0 + n AS before_x, 2e0 + l_tax AS before_y, CASE WHEN n <= 2 THEN 1.35e0 + n ELSE 1e0 + n END AS moved_x, CASE WHEN n <= 2 THEN 2.15e0 + l_tax ELSE 2e0 + l_tax END AS moved_y,
          CASE WHEN l_quantity > 45 THEN 1.36e0 + n WHEN n <= 2 THEN 1.35e0 + n ELSE 1e0 + n END AS reopened_x, CASE WHEN n <= 2 THEN 2.15e0 + l_tax ELSE 2e0 + l_tax END AS reopened_y,
          CAST(l_suppkey AS STRING) || '|BeginX|' || CAST(n AS STRING) || '|PinX' AS signature,
          CASE WHEN l_discount > 0.09 THEN 'x' ELSE CAST(l_suppkey AS STRING) END || '|BeginX|' || CAST(n AS STRING) || '|PinX' AS reopened_signature,
          l_quantity <> 7 AS in_moved, l_quantity NOT IN (7, 11) AS in_reopened
        FROM order_lines""",
    # artifacts of runs, and hashes on record of which some are wrong
    "artifacts": """
        SELECT source AS run_id, CAST(doc_id AS STRING) AS path, text AS content, sha2(coalesce(text, '') || CASE WHEN doc_id % 97 = 0 THEN '!' ELSE '' END, 256) AS recorded FROM @documents""",
    "runs": """
        SELECT source AS run_id, count(*) % 2 = 0 AS clean, max(doc_id) % 3 > 0 AS critiqued, CASE WHEN min(doc_id) % 5 = 4 THEN 'other' ELSE 'codex' END AS provider,
          CASE WHEN max(doc_id) % 11 = 1 THEN 'old' ELSE 'new' END AS revision, CASE WHEN max(doc_id) % 11 = 2 THEN 'small' ELSE 'large' END AS model, 'AB12' AS output_sha256,
          CASE WHEN max(doc_id) % 11 = 4 THEN 'ff' ELSE 'ab12' END AS seen_sha256, CASE WHEN max(doc_id) % 11 = 3 THEN 'failed' ELSE 'passed' END AS native_status,
          CASE WHEN max(doc_id) % 11 = 5 THEN 'ff' ELSE 'ab12' END AS native_sha256, CASE WHEN max(doc_id) % 11 = 6 THEN 'ff' ELSE 'ab12' END AS after_sha256 FROM @documents GROUP BY source""",
    # shapes of a template: some markers twice, some not at all
    "template_shapes": f"""
        SELECT DISTINCT CAST(l_suppkey % 23 AS BIGINT) AS shape_id, {sql_case("l_suppkey % 23", {i: MARKERS[i % 21 % len(MARKERS)] for i in range(23)})} AS marker FROM order_lines""",
    # members of packages: the pages of a host
    "members": """
        SELECT regexp_extract(url, '://([^/]+)', 1) AS package, page_id AS pos,
          CASE WHEN page_id % 40 = 0 THEN '[Content_Types].xml' WHEN page_id % 40 = 1 THEN 'visio/document.xml' WHEN page_id % 40 = 2 THEN 'visio/pages/page' || CAST(page_id AS STRING) || '.xml' ELSE url END AS name,
          CASE WHEN page_id % 211 = 7 THEN 1 ELSE 0 END AS flag_bits, CAST(length(html) AS BIGINT) AS file_size, CAST(floor(length(html) / (1 + page_id % 9)) AS BIGINT) AS compress_size,
          page_id % 157 <> 3 AS crc_ok, page_id % 149 <> 2 AS xml_ok
        FROM @pages""",
}


def needed(name: str) -> list[str]:
    """The entries that an entry builds on, and itself, in order."""
    out: list[str] = []
    for word in re.findall(r"\b\w+\b", SEEDS[name]):
        if word in SEEDS and word != name:
            out += [x for x in needed(word) if x not in out]
    return [*out, name]


def common_tables(*names: str) -> str:
    """The entries as WITH items."""
    every = list(dict.fromkeys(x for name in names for x in needed(name)))
    return ",\n".join(f"{x} AS ({SEEDS[x].strip()})" for x in every)


#: What most entries build on: one pass with a window over a given table.
BASES = {"flow_events": "events", "order_lines": "lineitem"}


class Reader:
    """Reads entries; with keep_bases, what they build on is written once and shared by all of them."""

    def __init__(self, spark: SparkSession, sf_dir: str, keep_bases: bool = False):
        self.spark, self.sf_dir, self.keep_bases, self.views = spark, sf_dir, keep_bases, {}

    def run(self, name: str, given: dict[str, DataFrame]) -> DataFrame:
        every = [x for x in needed(name) if x not in given]
        items = ",\n".join(f"{x} AS ({SEEDS[x].strip()})" for x in every)
        sql = re.sub(r"@(\w+)", lambda m: f"parquet.`{self.sf_dir}/{m[1]}.parquet`", f"WITH {items} SELECT * FROM {name}")
        if given:
            sql = sql.replace("{", "{{").replace("}", "}}")
        for base in given:
            sql = re.sub(rf"\b{base}\b", "{" + base + "}", sql)
        return self.spark.sql(sql, **given)

    def __call__(self, name: str) -> DataFrame:
        given = {}
        for base in BASES.keys() & needed(name):
            parts_of(self.spark, f"{self.sf_dir}/{BASES[base]}.parquet")
        if self.keep_bases and name not in BASES:
            for base in BASES:
                if base in needed(name):
                    if base not in self.views:
                        self.views[base] = kept(self.run(base, {}))
                    given[base] = self.views[base]
        return self.run(name, given)


def oracle(body: str, *names: str, recursive: bool = False) -> str:
    """DuckDB SQL: the entries, then further WITH items and the query."""
    sql = f"WITH {'RECURSIVE ' * recursive}{common_tables(*names)}{body}" if names else body
    return re.sub(r"@(\w+)", r"\1", sql).replace("sha2(coalesce(text, '') || CASE WHEN doc_id % 97 = 0 THEN '!' ELSE '' END, 256)", "sha256(coalesce(text, '') || CASE WHEN doc_id % 97 = 0 THEN '!' ELSE '' END)")
