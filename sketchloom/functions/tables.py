"""Fixed values of the data model: domains, visual defaults and limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The enums of the data model.
NODE_TYPES = (
    "terminator", "process", "decision", "input_output", "data_store", "document", "predefined_process", "delay", "note",
    "connector_hub", "component", "subsystem", "controller", "processor", "memory", "database", "sensor", "actuator",
    "transducer", "power_source", "communication_module", "interface", "external_system", "service", "housing",
)
RELATIONS = ("flow", "data", "control", "power", "communication", "mechanical", "association")
DIRECTIONS = ("forward", "reverse", "bidirectional", "none")
STYLES = ("solid", "dashed", "dotted")
DIAGRAM_TYPES = ("flowchart", "system_block", "component_schematic")
ORIENTATIONS = ("top_to_bottom", "left_to_right")
COMPOSITIONS = ("balanced_hierarchy", "compact_flow", "spacious_system", "contained_schematic", "radial", "custom")
SIDES = ("top", "right", "bottom", "left", "auto")
IMPORTANCES = ("primary", "secondary", "supporting")
SEVERITIES = ("low", "medium", "high")
CATEGORIES = (
    "source_fidelity", "hierarchy", "spacing", "overlap", "connector_crossing", "connector_clarity", "obstruction", "label_readability", "balance", "containment", "other",
)
CONTAINER_TYPES = ("housing", "subsystem")

# Node type -> (template marker, default width, default height).
NODE_VISUALS = {
    "terminator": ("__template_terminator__", 2.2, 0.75),
    "process": ("__template_process__", 2.25, 0.65),
    "decision": ("__template_decision__", 2.0, 1.25),
    "input_output": ("__template_input_output__", 2.5, 0.9),
    "data_store": ("__template_database__", 2.2, 1.15),
    "document": ("__template_document__", 2.3, 1.0),
    "predefined_process": ("__template_predefined_process__", 2.5, 0.85),
    "delay": ("__template_delay__", 2.2, 0.9),
    "note": ("__template_note__", 2.3, 1.0),
    "connector_hub": ("__template_connector_hub__", 1.1, 1.1),
    "component": ("__template_component_rectangle__", 2.75, 0.8),
    "subsystem": ("__template_subsystem_container__", 5.0, 2.5),
    "controller": ("__template_controller__", 2.4, 0.9),
    "processor": ("__template_controller__", 2.4, 0.9),
    "memory": ("__template_database__", 2.2, 1.15),
    "database": ("__template_database__", 2.2, 1.15),
    "sensor": ("__template_sensor__", 1.4, 1.4),
    "actuator": ("__template_component_rectangle__", 2.75, 0.8),
    "transducer": ("__template_sensor__", 1.4, 1.4),
    "power_source": ("__template_power_source__", 2.3, 1.1),
    "communication_module": ("__template_component_rectangle__", 2.75, 0.8),
    "interface": ("__template_interface__", 2.4, 0.5),
    "external_system": ("__template_external_system__", 2.6, 1.0),
    "service": ("__template_external_system__", 2.6, 1.0),
    "housing": ("__template_housing_container__", 5.5, 2.6),
}
CONNECTOR_MARKER, CALLOUT_MARKER = "__template_connector__", "__template_reference_callout__"
MARKERS = tuple(sorted({v[0] for v in NODE_VISUALS.values()} | {CONNECTOR_MARKER, CALLOUT_MARKER}))

# Relation -> (default line style, line weight in points, layout weight).
RELATION_VISUALS = {
    "flow": ("solid", 1.0, 4),
    "data": ("solid", 1.0, 3),
    "control": ("solid", 1.25, 4),
    "power": ("solid", 2.0, 5),
    "communication": ("solid", 1.0, 2),
    "mechanical": ("dashed", 1.0, 1),
    "association": ("dotted", 1.0, 1),
}
# Line style -> pattern number, direction -> (arrow at begin, arrow at end), arrow style number.
LINE_PATTERNS = {"solid": 1, "dashed": 2, "dotted": 3}
ARROWS = {"forward": (False, True), "reverse": (True, False), "bidirectional": (True, True), "none": (False, False)}
ARROW_STYLE = 4
# Layout and drawing measures in inches.
NODE_GAP, RANK_GAP, MARGIN = 1.25, 1.5, 1.0
CONTAINER_PAD, CONTAINER_TOP = 0.5, 0.9
CALLOUT_WIDTH, CALLOUT_HEIGHT, CALLOUT_GAP = 2.625, 0.3125, 0.05
CALLOUT_TEXT_WIDTH, CALLOUT_TEXT_HEIGHT = 0.4, 0.25
# Limits of a package.
MAX_MEMBERS, MAX_MEMBER_BYTES, MAX_TOTAL_BYTES, MAX_RATIO = 2_000, 20 * 1024 * 1024, 100 * 1024 * 1024, 200
REQUIRED_PARTS = ("[Content_Types].xml", "visio/document.xml")


# What a finding says; names in braces are filled in.
MESSAGES = {
    "geometry": "extracted graph must not contain layout geometry",
    "duplicate_node": "duplicate node ID '{id}'",
    "duplicate_edge": "duplicate edge ID '{id}'",
    "dangling_edge": "edge {end} '{id}' does not reference an existing node",
    "self_parent": "node '{id}' cannot contain itself",
    "missing_parent": "node '{id}' references missing parent '{parent_id}'",
    "parent_type": "parent '{parent_id}' is not container-capable",
    "containment_cycle": "containment cycle detected from node '{id}'",
    "containment_depth": "node '{id}' exceeds the baseline one level of containment",
    "duplicate_reference": "duplicate reference number '{id}'",
    "duplicate_placement": "duplicate placement for node '{id}'",
    "missing_placement": "missing placement for node '{id}'",
    "unknown_placement": "placement references unknown node '{id}'",
    "duplicate_hint": "Duplicate connector hint for edge '{id}'",
    "unknown_hint": "connector hint references unknown edge '{id}'",
    "outside_page": "placement for node '{id}' is outside page bounds",
    "overlap": "placements for nodes '{id}' and '{other}' overlap",
    "outside_container": "placement for node '{id}' is outside container '{parent_id}'",
}


def looked_up(key: Column, table: dict, field: int | None = None) -> Column:
    """The value of a constant table for a key; null for an unknown key."""
    out = None
    for name, value in table.items():
        value = F.lit(value if field is None else value[field])
        out = F.when(key == name, value) if out is None else out.when(key == name, value)
    return out


def is_container(node_type: Column) -> Column:
    return node_type.isin(*CONTAINER_TYPES)


def node_visuals(spark: SparkSession) -> DataFrame:
    """type, marker, default_width, default_height, container: 25 rows."""
    rows = [(t, *v, t in CONTAINER_TYPES) for t, v in NODE_VISUALS.items()]
    return spark.createDataFrame(rows, "type string, marker string, default_width double, default_height double, container boolean")


def sql_case(key: str, table: dict, field: int | None = None) -> str:
    """The same lookup as SQL text."""
    show = lambda v: f"'{v}'" if isinstance(v, str) else f"{v!r}e0" if isinstance(v, float) else str(v)
    return f"CASE {key} " + " ".join(f"WHEN {show(k)} THEN {show(v if field is None else v[field])}" for k, v in table.items()) + " END"
