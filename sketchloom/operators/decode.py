"""Strict decoding of responses: declared shapes, checked level by level on the parsed JSON.

A response has to be one JSON object and nothing else (functions.json_text has
the grammar; of a repeated key the last one counts); required keys are those
without a default; unknown keys are refused at every level; a key may hold JSON
null only where null is a value of its own; enums and measures have their
domains. Scalars are read leniently: a measure may be a number, a text that
spells one, or a flag (1 or 0); a flag may be true or false, the numbers 1 and
0, or one of the words of TRUTHS. A text is a text only. NaN and the infinities
are numbers of the grammar but in no domain.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..functions import json_text
from ..functions import tables as t
from ..functions import text as tx


@dataclass(frozen=True)
class Field:
    """kind: text, measure (a number above zero), flag, object or list; of: the shape of an object or of a list's elements, text if none."""

    kind: str = "text"
    required: bool = True
    nullable: bool = False
    choices: tuple[str, ...] = ()
    of: dict[str, Field] | None = None


def text(*choices: str, required: bool = True) -> Field:
    return Field(required=required, choices=choices)


def listing(of: dict[str, Field] | None = None, required: bool = False) -> Field:
    return Field("list", required, of=of)


OPTIONAL_TEXT, MEASURE = Field(required=False, nullable=True), Field("measure")
NODE = {"id": text(), "type": text(*t.NODE_TYPES), "label": text(), "parent_id": OPTIONAL_TEXT, "reference_number": OPTIONAL_TEXT, "notes": OPTIONAL_TEXT}
EDGE = {
    "id": OPTIONAL_TEXT, "source": text(), "target": text(), "relation": text(*t.RELATIONS, required=False), "direction": text(*t.DIRECTIONS, required=False),
    "label": OPTIONAL_TEXT, "style": text(*t.STYLES, required=False),
}
GRAPH = {"title": text(), "diagram_type": text(*t.DIAGRAM_TYPES), "orientation": text(*t.ORIENTATIONS), "nodes": listing(NODE), "edges": listing(EDGE)}
PLACEMENT = {"node_id": text(), "x": MEASURE, "y": MEASURE, "width": MEASURE, "height": MEASURE, "importance": text(*t.IMPORTANCES, required=False)}
HINT = {"edge_id": text(), "source_side": text(*t.SIDES, required=False), "target_side": text(*t.SIDES, required=False)}
LAYOUT = {"composition": text(*t.COMPOSITIONS), "page_width": MEASURE, "page_height": MEASURE, "placements": listing(PLACEMENT, required=True), "connector_hints": listing(HINT)}
DESIGN = {"graph": Field("object", of=GRAPH), "layout": Field("object", of=LAYOUT), "rationale": text()}
ISSUE = {"severity": text(*t.SEVERITIES), "category": text(*t.CATEGORIES), "description": text(), "node_ids": listing(), "edge_ids": listing()}
CRITIQUE = {"approved": Field("flag"), "summary": text(), "issues": listing(ISSUE), "revised_design": Field("object", required=False, nullable=True, of=DESIGN)}
SHAPES = {"graph": GRAPH, "design": DESIGN, "critique": CRITIQUE}

#: Reasons in the order in which they are told; a fault is the number of its reason, SOUND where there is none.
REASONS = ("no_json", "no_object", "missing_key", "unknown_key", "wrong_type", "out_of_domain")
MISSING, UNKNOWN, TYPE, DOMAIN = (REASONS.index(r) for r in REASONS[2:])
SOUND = len(REASONS)
# The words for a flag, in any case, and how a text spells a number (single underscores between digits).
TRUTHS = {"true": ("1", "on", "t", "true", "y", "yes"), "false": ("0", "off", "f", "false", "n", "no")}
SPELLED = r"^[+-]?(?:[0-9]+(?:_[0-9]+)*\.?(?:[0-9]+(?:_[0-9]+)*)?|\.[0-9]+(?:_[0-9]+)*)(?:[eE][+-]?[0-9]+)?$"
NUMBER = "^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL|FLOAT|DOUBLE)"

# The expressions for a shape are SQL text, made from it level by level: hundreds of small columns would take longer to put together than to run.


def bound(value: str, name: str, body: str) -> str:
    """body, in which name stands for value, computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def get(value: str, kind: str) -> str:
    return f"try_variant_get({value}, '$', '{kind}')"


def listed(words: tuple[str, ...] | dict) -> str:
    return ", ".join(f"'{w}'" for w in words)


def number(value: str, kind: str) -> str:
    """The double that a value stands for; null if it is no number in any spelling. Spelled infinities and NaN are none either."""
    word = bound(f"regexp_replace({get(value, 'string')}, r'{tx.ENDS}', '')", "w", f"CASE WHEN w RLIKE r'{SPELLED}' THEN try_cast(replace(w, '_', '') AS double) END")
    return f"CASE WHEN {kind} = 'STRING' THEN {word} WHEN {kind} = 'BOOLEAN' THEN CAST({get(value, 'boolean')} AS double) WHEN {kind} RLIKE '{NUMBER}' THEN {get(value, 'double')} END"


def truth(value: str, kind: str) -> str:
    """The flag that a value stands for; null if it is none."""
    said = " ".join(f"WHEN lower({get(value, 'string')}) IN ({listed(words)}) THEN {flag}" for flag, words in TRUTHS.items())
    return f"CASE WHEN {kind} = 'BOOLEAN' THEN {get(value, 'boolean')} WHEN {kind} = 'STRING' THEN CASE {said} END WHEN {kind} RLIKE '{NUMBER}' THEN CASE {get(value, 'double')} WHEN 1 THEN true WHEN 0 THEN false END END"


def of_object(value: str, shape: dict[str, Field], depth: int = 0) -> str:
    """The least fault of a value that has to be an object of a shape."""
    m = f"m{depth}"
    unknown = f"CASE WHEN size(array_except(map_keys({m}), array({listed(shape)}))) > 0 THEN {UNKNOWN} ELSE {SOUND} END"
    faults = ", ".join([unknown, *(of_field(m, name, field, depth + 1) for name, field in shape.items())])
    return bound(get(value, "map<string,variant>"), m, f"CASE WHEN {m} IS NULL THEN {TYPE} ELSE least({faults}) END")


def of_field(fields: str, name: str, field: Field, depth: int) -> str:
    """The fault of a key: its value is looked up and its kind named once. An absent key has no kind, null is of kind VOID."""
    x, value = f"x{depth}", f"{fields}['{name}']"
    read = f"named_struct('value', {value}, 'kind', CASE WHEN map_contains_key({fields}, '{name}') THEN coalesce(schema_of_variant({value}), 'VOID') END)"
    lost, null = MISSING if field.required else SOUND, SOUND if field.nullable else TYPE
    return bound(read, x, f"CASE WHEN {x}.kind IS NULL THEN {lost} WHEN {x}.kind = 'VOID' THEN {null} ELSE {of_value(f'{x}.value', f'{x}.kind', field, depth)} END")


def of_value(value: str, kind: str, field: Field, depth: int) -> str:
    if field.kind == "object":
        return of_object(value, field.of, depth)
    if field.kind == "list":
        v = f"v{depth}"
        one = of_object(v, field.of, depth + 1) if field.of else f"CASE WHEN coalesce(schema_of_variant({v}), '') = 'STRING' THEN {SOUND} ELSE {TYPE} END"
        return f"CASE WHEN {kind} LIKE 'ARRAY%' THEN coalesce(array_min(transform({get(value, 'array<variant>')}, {v} -> {one})), {SOUND}) ELSE {TYPE} END"
    if field.kind == "measure":
        return bound(number(value, kind), "n", f"CASE WHEN n IS NULL THEN {TYPE} WHEN n > 0 AND n < double('Infinity') THEN {SOUND} ELSE {DOMAIN} END")
    if field.kind == "flag":
        return f"CASE WHEN ({truth(value, kind)}) IS NULL THEN {TYPE} ELSE {SOUND} END"
    outside = f" WHEN {get(value, 'string')} NOT IN ({listed(field.choices)}) THEN {DOMAIN}" if field.choices else ""
    return f"CASE WHEN {kind} <> 'STRING' THEN {TYPE}{outside} ELSE {SOUND} END"


def typed(value: str, field: Field, depth: int = 0) -> str:
    """A value without a fault, as a column of its type; absent lists are empty, other absent values null."""
    if field.kind == "object":
        m = f"t{depth}"
        parts = ", ".join(f"'{name}', {typed(f"{m}['{name}']", f, depth + 1)}" for name, f in field.of.items())
        return bound(get(value, "map<string,variant>"), m, f"CASE WHEN {m} IS NOT NULL THEN named_struct({parts}) END")
    if field.kind == "list":
        v, item = f"u{depth}", Field("object", of=field.of) if field.of else Field()
        return f"transform(coalesce({get(value, 'array<variant>')}, CAST(array() AS array<variant>)), {v} -> {typed(v, item, depth + 1)})"
    read = {"measure": number, "flag": truth}.get(field.kind)
    return read(value, f"schema_of_variant({value})") if read else get(value, "string")


def content_as(shape: dict[str, Field], value: str = "value") -> Column:
    """The column `value` (a parsed response that verdict finds ok) as a struct of the shape."""
    return F.expr(typed(value, Field("object", of=shape)))


def parsed(content: Column) -> Column:
    """A document as a variant, null if it is none; for sessions that last_key_counts() has prepared."""
    return F.when(json_text.is_document(content), F.try_parse_json(content))


def verdict(shape: dict[str, Field], content: str = "content", value: str = "value") -> Column:
    """ok, or the first of REASONS for which a response (columns: the text, and parsed) is not of the shape."""
    unread = json_text.is_document(F.col(content))  # a document that holds NaN, an infinity or a number past the parser's limits
    lost = F.when(unread, F.when(F.col(content).rlike(r"^[ \t\n\r]*\{"), "out_of_domain").otherwise("no_object")).otherwise("no_json")
    is_object = F.coalesce(F.schema_of_variant(F.col(value)), F.lit("")).startswith("OBJECT")
    told = F.when(F.col(value).isNull(), lost).when(~is_object, "no_object")
    return told.otherwise(F.coalesce(F.get(F.array(*map(F.lit, REASONS)), F.expr(of_object(value, shape))), F.lit("ok")))


def last_key_counts(spark: SparkSession) -> None:
    """Spark's parser refuses an object with a repeated key unless this is set."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
