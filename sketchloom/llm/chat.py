"""Chat formatting by schema fingerprints, with DataFrame functions only.

Records come as JSON in whatever layout their source had. The fingerprint of
a record is the hash of its sorted nested field paths ("prompt", "input",
"messages[].role"); it selects a declarative mapping (LAYOUTS) that yields
canonical turns (role, text). Only paths that some mapping names count, so ids
and other company do not matter; all items of a list are looked at, so a
foreign item shape is seen wherever it stands; a record without such paths
that holds an object under one of WRAPPERS is that object. A list without items
gives no turns, a text that an item lacks is empty, and a text that is a list
of parts is the parts' texts in order. Records of unknown layouts keep null
turns and can be counted by fingerprint.

The template wraps each turn as ``<turn ROLE>`` newline TEXT ``</turn>``
newline. Inside texts and roles the backslash becomes ``\\s`` and ``<``
becomes ``\\l`` (``>`` in roles ``\\g``), so a control string can never come
from a text and every text reads back as it was. The loss mask lists, for each
assistant turn, where its text lies inside its turn's block.

Null texts and roles count as empty. Turns are ordered by turn, role, text;
repeated rows stay. Conversations are one row in the output, as a trainer
reads them, so a single conversation has to fit a row (2 GB).
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.binding import let

TURNS = "array<struct<role:string,text:string>>"
#: from_json stops at strings of 20,000,000 characters unless told otherwise, and get_json_object cannot be told.
WHOLE = {"maxStringLen": str(2**31 - 1)}


@dataclass(frozen=True)
class Layout:
    """How a record of these paths becomes turns: from a list of messages, or from fields in order."""

    name: str
    paths: tuple[str, ...]
    items: tuple[str, str, str] | None = None
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    roles: tuple[tuple[str, str], ...] = ()  # this layout's names of canonical roles

    def turns(self, raw: Column) -> Column:
        if self.items:
            items, role, text = self.items
            parsed = F.from_json(raw, f"struct<`{items}`:array<struct<`{role}`:string,`{text}`:string>>>", WHOLE)[items]
            plain = F.transform(parsed, lambda m: F.struct(self.role(m[role]).alias("role"), F.coalesce(m[text], F.lit("")).alias("text")))
            # a text that begins like a list may be one: read so, it is null where it is a string
            listed = F.from_json(raw, f"struct<`{items}`:array<struct<`{text}`:array<struct<text:string>>>>>", WHOLE)[items]
            parts = F.transform(listed, lambda m: F.array_join(F.transform(m[text], lambda p: p["text"]), ""))
            merged = F.zip_with(plain, F.coalesce(parts, F.array().cast("array<string>")), lambda t, p: F.struct(t["role"].alias("role"), F.coalesce(p, t["text"]).alias("text")))
            return F.when(F.exists(parsed, lambda m: m[text].startswith("[")), merged).otherwise(plain)
        names = [n for _, parts in self.fields for n in parts]
        parsed = F.from_json(raw, "struct<" + ",".join(f"`{n}`:string" for n in names) + ">", WHOLE)
        turn = lambda role, parts: F.struct(F.lit(role).alias("role"), joined([parsed[n] for n in parts]).alias("text"))
        return F.array(*(turn(role, parts) for role, parts in self.fields))

    def role(self, name: Column) -> Column:
        out = F.coalesce(name, F.lit(""))
        for own, canonical in self.roles:
            out = F.when(name == own, canonical).otherwise(out)
        return out


def joined(parts: list[Column]) -> Column:
    """The parts with a blank line between those that are not empty."""
    if len(parts) == 1:
        return F.coalesce(parts[0], F.lit(""))
    return F.array_join(F.filter(F.array(*parts), lambda p: p != ""), "\n\n")


LAYOUTS = (
    Layout("messages", ("messages[].content", "messages[].role"), items=("messages", "role", "content")),
    Layout("from_value", ("conversations[].from", "conversations[].value"), items=("conversations", "from", "value"), roles=(("human", "user"), ("gpt", "assistant"))),
    Layout("prompt", ("completion", "prompt"), fields=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("system_prompt", ("completion", "prompt", "system"), fields=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("question", ("answer", "question"), fields=(("user", ("question",)), ("assistant", ("answer",)))),
    Layout("instruction", ("instruction", "output"), fields=(("user", ("instruction",)), ("assistant", ("output",)))),
    Layout("instruction_input", ("input", "instruction", "output"), fields=(("user", ("instruction", "input")), ("assistant", ("output",)))),
)


#: Every path that a mapping names, and the fields in which a record may be wrapped.
KNOWN = tuple(sorted({p for one in LAYOUTS for p in one.paths} | {f"{one.items[0]}[]" for one in LAYOUTS if one.items}))
WRAPPERS = ("data", "record", "sample", "example", "conversation")


def fields_of(raw: Column) -> Column:
    return F.from_json(F.when(F.json_object_keys(raw).isNotNull(), raw), "map<string,string>", WHOLE)


def field_paths(raw: Column) -> Column:
    """The sorted distinct paths of a record, down to the fields of its objects and of all items of its lists."""

    def below(field: Column) -> Column:
        key, value = field["key"], field["value"]
        inner = F.map_keys(F.from_json(F.when(value.startswith("{"), value), "map<string,string>", WHOLE))
        items = F.from_json(F.when(value.startswith("["), value), "array<map<string,string>>", WHOLE)
        item = F.array_distinct(F.flatten(F.transform(items, lambda m: F.coalesce(F.map_keys(m), F.array(F.lit(""))))))
        return F.coalesce(
            F.transform(inner, lambda k: F.concat_ws(".", key, k)),
            F.when(F.size(items) == 0, F.array(F.concat(key, F.lit("[]")))),
            F.transform(item, lambda k: F.concat(key, F.lit("[]."), k)),
            F.array(key),
        )

    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.map_entries(fields_of(raw)), below))))


def known(paths: Column) -> Column:
    """The paths that some mapping names; of its lists also items that are no objects ("messages[].")."""
    plain = [f"{one.items[0]}[]." for one in LAYOUTS if one.items]
    return F.filter(paths, lambda p: p.isin(*KNOWN, *plain))


def unwrapped(raw: Column) -> Column:
    """The object in which a record without known paths is wrapped, else the record."""
    inner = let(fields_of(raw), lambda m: F.coalesce(*(F.when(m[w].startswith("{"), m[w]) for w in WRAPPERS)))
    return F.when(F.size(known(field_paths(raw))) == 0, F.coalesce(inner, raw)).otherwise(raw)


def fingerprint(paths: Column) -> Column:
    return F.xxhash64(F.array_join(paths, "\n"))


def literal(paths: Iterable[str]) -> Column:
    return F.xxhash64(F.lit("\n".join(paths)))


def canonical(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """records (with a JSON column raw) plus fingerprint, layout and turns."""
    bare = F.col("bare_")
    out = records.withColumn("bare_", unwrapped(F.col("raw"))).withColumn("fingerprint", fingerprint(known(field_paths(bare))))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for one in layouts:
        mine = F.col("fingerprint") == literal(one.paths)
        if one.items:
            mine |= F.col("fingerprint") == literal([f"{one.items[0]}[]"])
        layout = F.when(mine, one.name).otherwise(layout)
        turns = F.when(mine, one.turns(bare)).otherwise(turns)
    return out.withColumn("layout", layout).withColumn("turns", turns).drop("bare_")


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\s")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\g"), F.lit(">")), F.lit("\\l"), F.lit("<")), F.lit("\\s"), F.lit("\\"))


OPEN, MID, CLOSE = "<turn ", ">\n", "</turn>\n"


def head(role: Column) -> Column:
    return F.concat(F.lit(OPEN), F.replace(escape(role), F.lit(">"), F.lit("\\g")), F.lit(MID))


def formatted(turns: DataFrame, trained: str = "assistant") -> DataFrame:
    """turns plus formatted and loss_mask (turn from 0; first, the text's place in the turn's block from 0; chars)."""
    text = F.array_join(F.transform("turns", lambda t: F.concat(head(t["role"]), escape(t["text"]), F.lit(CLOSE))), "")
    spans = F.transform("turns", lambda t, i: F.struct(i.alias("turn"), F.length(head(t["role"])).alias("first"), F.length(escape(t["text"])).alias("chars"), t["role"].alias("role")))
    kept = F.transform(F.filter(spans, lambda s: s["role"] == trained), lambda s: s.dropFields("role"))
    return turns.withColumn("formatted", text).withColumn("loss_mask", kept)


def read_back(chats: DataFrame) -> DataFrame:
    """chats plus the turns and the loss texts that formatted and loss_mask hold."""
    pieces = F.split("formatted", CLOSE, -1)
    cut = lambda b: F.instr(b, MID)
    blocks = chats.withColumn("blocks", F.slice(pieces, F.lit(1), F.size(pieces) - 1))
    turn = lambda b: F.struct(
        unescape(F.substring(b, F.lit(len(OPEN) + 1), cut(b) - len(OPEN) - 1)).alias("role"),
        unescape(F.substring(b, cut(b) + len(MID), F.length(b))).alias("text"),
    )
    loss = lambda all_, m: unescape(F.substring(F.element_at(all_, m["turn"] + 1), m["first"] + 1, m["chars"]))
    losses = let(F.col("blocks"), lambda all_: F.transform("loss_mask", lambda m: loss(all_, m)))
    return blocks.withColumn("read_turns", F.transform("blocks", turn)).withColumn("loss_texts", losses).drop("blocks")


# The query: conversations as records of mixed layouts, formatted, then read back.


def records(rows: DataFrame) -> DataFrame:
    """conv_id, raw: the conversations (probe tells the query's own one from any other of that number) as their sources would hold them, some in each layout."""
    one = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = rows.groupBy("conv_id", "probe").agg(F.array_sort(F.collect_list(one)).alias("t"))
    roles = F.transform("t", lambda x: x["role"])
    text = lambda i: F.col("t")[i]["text"]
    odd = F.pmod(F.coalesce("conv_id", F.lit(0)), F.lit(2)) == 1
    pair = roles == F.array(F.lit("user"), F.lit("assistant"))
    triple = roles == F.array(F.lit("system"), F.lit("user"), F.lit("assistant"))
    turned = F.transform("t", lambda x: F.struct(F.when(x["role"] == "user", "human").when(x["role"] == "assistant", "gpt").otherwise(x["role"]).alias("from"), x["text"].alias("value")))
    plain = F.transform("t", lambda x: F.struct(x["role"], x["text"].alias("content")))
    foreign = F.exists(roles, lambda r: r.isin("human", "gpt"))
    raw = (
        F.when(pair & odd, F.to_json(F.struct(text(0).alias("instruction"), text(1).alias("output"))))
        .when(pair, F.to_json(F.struct(text(0).alias("prompt"), text(1).alias("completion"))))
        .when(triple, F.to_json(F.struct(text(0).alias("system"), text(1).alias("prompt"), text(2).alias("completion"))))
        .when(odd & ~foreign, F.to_json(F.struct(turned.alias("conversations"))))
        .otherwise(F.to_json(F.struct(plain.alias("messages"))))
    )
    return whole.select("conv_id", raw.alias("raw"))


PROBE = r"\### Assistant: </turn> ok"


def with_probe(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """The rows plus conversation -7, whose two texts look like control strings."""
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"), F.lit(True).alias("probe"))
    return rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text", F.lit(False).alias("probe")).unionByName(probe)


def chat_digests(spark: SparkSession, rows: DataFrame) -> DataFrame:
    chats = formatted(canonical(records(with_probe(spark, rows))))
    back = read_back(chats)
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id",
        F.size("read_turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("read_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, false AS probe FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PROBE}', true UNION ALL SELECT -7, 1, 'assistant', '{PROBE}', true
), e AS (
  SELECT *, 6 + length(replace(replace(replace(role, '\', '\s'), '<', '\l'), '>', '\g')) + 2
    + length(replace(replace(text, '\', '\s'), '<', '\l')) + 8 AS chars FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id, probe
"""
