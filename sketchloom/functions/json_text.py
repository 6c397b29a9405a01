"""Whether a text is one JSON document, by the grammar itself and nothing looser.

Spark's parser reads a document and never looks at what follows it. Where it
also reads the text as the only item of a list and as the only value of an
object, nothing follows: what could end the list early cannot end the object,
and the other way round. The texts it refuses are judged by the grammar, as
some are documents all the same (numbers and texts over its limits, NaN).

A token pass turns the text into a short outline: every string becomes one
mark, every number or literal another, white space goes, and what no token
explains stays as it is. Then innermost objects and lists fold into one value
at a time; a document folds into a single mark. Text behind the document,
comments, quotes of other kinds, a comma too many and control characters never
fold. Keys may repeat. NaN, Infinity and -Infinity count as numbers, as most
readers take them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

#: Objects and lists deeper than this are no document (the parser's limit).
DEEPEST = 1000
#: Folds that are written out; deeper texts go through a loop.
SHALLOW = 8
STRING = r'"[^"\\\x00-\x1f]*+(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*+)*+"'
ODD = r"NaN|-?Infinity"
VALUE = r"-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?+(?:[eE][+-]?+[0-9]++)?+|true|false|null|" + ODD
S, V = "\x01", "\x02"
ITEM = f"[{S}{V}]"
FOLD = rf"\[(?:{ITEM}(?:,{ITEM})*+)?+\]|\{{(?:{S}:{ITEM}(?:,{S}:{ITEM})*+)?+\}}"


def without_strings(text: Column) -> Column:
    return F.regexp_replace(text, STRING, S)


def outline(text: Column) -> Column:
    """The text with a mark for each string and each other value; null where characters stand that no document has."""
    marked = F.regexp_replace(F.regexp_replace(without_strings(text), VALUE, V), r"[ \t\n\r]++", "")
    return F.when(~text.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]"), marked)


def fold(found: Column) -> Column:
    return F.regexp_replace(found, FOLD, V)


def by_grammar(text: Column) -> Column:
    """True for one JSON document and white space around it, told by folding its outline."""

    def told(found: Column) -> Column:
        # an outline that a fold leaves as it is stays so: the loop runs on, but only for what is deep
        deep = F.aggregate(F.sequence(F.lit(1), F.lit(DEEPEST - SHALLOW)), found, lambda x, _: F.when(F.length(x) > 1, fold(x)).otherwise(x))
        return F.when(~found.rlike(FOLD), found.rlike(f"^{ITEM}$")).otherwise(deep.rlike(f"^{ITEM}$"))

    shallow = outline(text)
    for _ in range(SHALLOW):
        shallow = fold(shallow)
    return let(shallow, told)


def is_document(text: Column) -> Column:
    """True for one JSON document and white space around it; null is none."""
    reads = lambda before, after: F.try_parse_json(F.concat(F.lit(before), text, F.lit(after))).isNotNull()
    return F.coalesce(reads("[", "]") & reads('{"":', "}") | by_grammar(text), F.lit(False))
