"""Text functions over columns: wrapping, whitespace, quoting."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let
from .tables import MESSAGES


def expand_tabs(text: Column, size: int = 8) -> Column:
    """Tabs become spaces up to the next stop; stops count from the last line break."""

    def add(out: Column, part: Column) -> Column:
        column = F.length(F.regexp_extract(out, r"[^\n\r]*\z", 0))
        return F.concat(out, F.repeat(F.lit(" "), F.lit(size) - column % size), part)

    parts = F.split(text, "\t", -1)
    return F.when(F.contains(text, F.lit("\t")), F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), parts[0], add)).otherwise(text)


#: Lines that wrap() gathers in one list before it opens the next, so that a list is not copied for each line of a long text.
BLOCK = 128


def wrap(text: Column, width: int) -> Column:
    """Greedy lines of at most `width` characters; long words are broken, hyphens are not break points.

    White space is dropped at the ends of lines and at their starts, save at
    the start of the first; a line that a broken word completes keeps its own.
    An empty text is one empty line; null gives null. Time grows with the text.
    One pattern tells all lines: a full one where a word longer than a line
    begins in it, else up to the end of the last word that fits. Texts with
    other white space than spaces, or with a run of spaces longer than a line,
    go chunk by chunk instead.
    """
    plain = F.regexp_replace(expand_tabs(text), r"[\t\n\x0b\f\r]", " ")
    none = F.array().cast("array<string>")
    # full: blocks of lines; line: what is gathered; tail: the length of its last chunk if that is blank, -1 where a blank chunk went at the line's start
    state = lambda full, lines, line, tail: F.struct(full.alias("full"), lines.alias("lines"), line.alias("line"), tail.alias("tail"))

    def blank(chunk: Column) -> Column:
        """Only white space, in the Unicode sense; only the space parts chunks."""
        return F.when(F.startswith(chunk, F.lit(" ")) | (chunk == ""), True).when(chunk.between("!", "~~"), False).otherwise(strip(chunk) == "")

    def pieces(rest: Column) -> Column:
        """All full lines of a long word's rest but its last piece, save blank ones."""
        n = F.floor((F.length(rest) - 1) / width).cast("int")
        cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(rest, i * width + 1, F.lit(width)))
        return F.when(n > 0, F.filter(cut, lambda x: ~blank(x))).otherwise(none)

    def last(rest: Column) -> Column:
        return F.substring(rest, F.floor((F.length(rest) - 1) / width).cast("int") * width + 1, F.lit(width))

    def opened(s: Column, closed: Column, chunk: Column, more: Column | None = None) -> Column:
        """The state after the line `closed` (none if it is empty) and more lines; a new line begins with the chunk, or empty where the chunk is blank and no first line."""
        lines = F.when(closed != "", F.concat(s["lines"], F.array(closed))).otherwise(s["lines"])
        lines = lines if more is None else F.concat(lines, more)
        size = F.when(blank(chunk), F.length(chunk)).otherwise(0)
        begin = lambda full, x, begun: F.when((size > 0) & begun, state(full, x, F.lit(""), F.lit(-1))).otherwise(state(full, x, chunk, size))
        packed = lambda x: F.when(F.size(x) < BLOCK, begin(s["full"], x, (F.size(x) > 0) | (F.size(s["full"]) > 0))).otherwise(begin(F.concat(s["full"], F.array(x)), none, F.lit(True)))
        return let(lines, packed)

    def broken(s: Column, chunk: Column, room: Column) -> Column:
        """After a chunk longer than a line: it fills the line (which keeps the blanks before it), and is cut."""
        piece, rest = F.substring(chunk, F.lit(1), room), F.substring(chunk, room + 1, F.length(chunk))
        return opened(s, F.when(blank(piece), s["line"]).otherwise(F.concat(s["line"], piece)), last(rest), pieces(rest))

    def add(s: Column, chunk: Column) -> Column:
        line, size, room = s["line"], F.length(chunk), F.lit(width) - F.length(s["line"])
        begun = (F.size(s["lines"]) > 0) | (F.size(s["full"]) > 0)
        return (
            F.when((line == "") & begun & (s["tail"] >= 0) & blank(chunk), s.withField("tail", F.lit(-1)))
            .when(size <= room, state(s["full"], s["lines"], F.concat(line, chunk), F.when(blank(chunk), size).otherwise(0)))
            .when(size <= width, opened(s, trimmed(s), chunk))
            .otherwise(broken(s, chunk, room))
        )

    trimmed = lambda s: F.left(s["line"], F.length(s["line"]) - F.greatest(s["tail"], F.lit(0)))
    chunks = F.regexp_extract_all(plain, F.lit("( +|[^ ]+)"), F.lit(1))
    start = state(F.array().cast("array<array<string>>"), none, F.lit(""), F.lit(0))
    rest = lambda s: F.when(trimmed(s) != "", F.array(trimmed(s))).otherwise(none)
    lines = F.aggregate(chunks, start, add, lambda s: F.concat(F.flatten(s["full"]), s["lines"], rest(s)))
    lines = let(lines, lambda out: F.when(F.size(out) > 0, out).otherwise(F.array(F.lit(""))))
    short = (F.length(text) <= width) & text.rlike(r"\A[ -~]*\z")  # most labels are one line as they are
    line = rf"(?s)(?:\A|(?=[^ ]))(?:(?=(?:.{{0,{width - 1}}} )?[^ ]{{{width + 1}}}).{{{width}}}|.{{0,{width - 1}}}[^ ](?= |\z))"
    found = let(F.regexp_extract_all(plain, F.lit(line), F.lit(0)), lambda out: F.when(F.size(out) > 0, out).otherwise(F.array(F.lit(""))))
    odd = plain.rlike(rf"(?U)[\s\x1c-\x1f&&[^ ]]| {{{width + 1}}}")
    return F.when(short, F.array(F.rtrim(text))).when(~odd, found).when(text.isNotNull(), lines)


#: White space at both ends, in the Unicode sense.
ENDS = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, ENDS, "")


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def one_line(text: Column) -> Column:
    """Runs of white space become one space, none at the ends; null is empty."""
    spaced = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\f\r", " " * 5)
    return F.trim(F.when(F.contains(spaced, F.lit("  ")), F.regexp_replace(spaced, " +", " ")).otherwise(spaced))


def quoted(text: Column) -> Column:
    """In double quotes, with backslash, quote and line feed escaped."""
    out = F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    out = F.when(F.contains(text, F.lit("\\")) | F.contains(text, F.lit('"')) | F.contains(text, F.lit("\n")), out).otherwise(text)  # a search costs less than what replaces nothing
    return F.concat(F.lit('"'), out, F.lit('"'))


def filled(template: str, **values: Column) -> Column:
    """A template with columns in the places of its names in braces."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*(values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts)))


def message(rule: str, **values: Column) -> Column:
    """What a finding of a rule says."""
    return filled(MESSAGES[rule], **values)


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
