"""Removal of repeated byte strings by prefix doubling over names of byte strings.

A byte goes if a LENGTH-byte string over it also starts earlier (in a smaller
doc_id, or earlier in the same document). Names of equal strings double in
length, and Spark sorts (name, name at an offset) pairs at growing lengths;
what is unique at a length never reaches the next:

1. Up to CORE bytes, half of LENGTH, names are 64-bit digests that double where
   the text lies: below that length most strings repeat or a sort would cost
   more than it drops.
   Windows of LENGTH bytes are represented by their minimizer, the least of
   their CORE-byte names, so that equal windows have equal minimizers at equal
   offsets.
2. Sorted at CORE bytes, with the name of all bytes that the place's windows
   cover: a core seen once has no repeated window; a core whose surroundings
   are all equal repeats as a whole, all but its first place; the rest is open.
3. Sorted at LENGTH bytes, for the windows of open places: pairs (name of the
   first half, name of the second); of equal pairs all but the first repeat.

Pairs of names decide, so equality stands on 126 bits of digests keyed anew in
each job; texts are not compared byte by byte. doubled() is the plain method
over every position, with exact names and no digest. It gives the same answer
and costs many times the input (see the README), so the query does not use it.

What many documents share is settled before the shuffle as far as one batch
knows: of equal places or windows only the first is sorted, and of a core with
many surroundings only a few places are, while the others are open anyway.

Null texts count as empty, null doc_ids come after all others. Every row is
answered: rows are ordered by doc_id and text, and rows equal in both by a
number. The repeated ranges of one document come together in a row. No
documents give no rows.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_or_last, id_or_null, stored, whole_text

LENGTH = 100
CORE = LENGTH // 2
#: Windows whose minimizer is looked for at once.
SPREAD = LENGTH - CORE + 1
#: What is known of a place before the sort: the two lowest bits of its name.
ASKED, REPEATS, OPEN = 0, 1, 2
#: at: first window x 64 + number of windows. Rows are narrow, as all places of the corpus are shuffled.
PLACES = "core long, around long, doc_id long, at long"
#: b: of a window that is asked the name of its second half, of a range that repeats the number of windows.
PAIRS = "a long, b long, doc_id long, first int"


class Bounds(NamedTuple):
    """What a task works on at once. The result is the same for all values."""

    part: int = 1 << 19  #: texts longer than this are taken in overlapping parts (2 ** 20 at most)
    held: int = 1 << 20  #: places or windows before they are passed on
    crowd: int = 4  #: places of one core that are passed on to be sorted (2 at least)


def longer(x: np.ndarray, gap: int, salt: int) -> np.ndarray:
    """Hashes of strings from those of their first part and of the part `gap` further on."""
    with np.errstate(over="ignore"):
        out = (x[: len(x) - gap] * np.uint64(0xD6E8FEB86659FD93 + 2 * salt)) ^ (x[gap:] + np.uint64(0x9E3779B97F4A7C15 ^ salt))
        out *= np.uint64(0xBF58476D1CE4E5B9)
        return out ^ (out >> np.uint64(29))


def hashes(data: np.ndarray, length: int, key: int = 0) -> np.ndarray:
    """A 64-bit name of each string of `length` bytes, by doubling; the last step overlaps."""
    x, have = (data.astype(np.uint64) + np.uint64(key)), 1
    while have < length:
        gap = min(have, length - have)
        x, have = longer(x, gap, have * 1000 + gap), have + gap
    return x


def minimizers(data: np.ndarray, key: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(core's name, surroundings' name, first window, number of windows) of each minimizer of a text."""
    cores = hashes(data, CORE, key)
    low = ((cores >> np.uint64(20)) << np.uint64(20)) | np.arange(len(cores), dtype=np.uint64)  # the leftmost of equals
    least, have = low, 1
    while have < SPREAD:
        gap = min(have, SPREAD - have)
        least, have = np.minimum(least[: len(least) - gap], least[gap:]), have + gap
    place = (least & np.uint64((1 << 20) - 1)).astype(np.int64)
    first = np.nonzero(np.diff(place, prepend=-1))[0]
    many = np.diff(np.append(first, len(place)))
    # the surroundings: all bytes of the place's windows, named by the windows at both ends, which overlap or touch
    whole = hashes(data, LENGTH, key)
    last = first + many - 1
    around = mixed(whole[first], whole[last], many, place[first] - first)
    return cores[place[first]], around, first, many


def mixed(a: np.ndarray, b: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """One hash of several columns."""
    with np.errstate(over="ignore"):
        out = a.astype(np.uint64)
        for x in (b, *more):
            out = (out ^ (x.astype(np.uint64) + np.uint64(0x589965CC75374CC3))) * np.uint64(0xE7037ED1A0B428DB)
            out ^= out >> np.uint64(31)
        return out


def parts(data: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(start, bytes) of overlapping parts, so that each window lies in one of them."""
    for i in range(0, max(1, len(data) - LENGTH + 1), size):
        yield i, data[i : i + size + LENGTH - 1]


def with_state(state: np.ndarray, name: np.ndarray, doc: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The name for those that are asked; for the others one that deals them over all partitions. The state is in the lowest bits."""
    name = np.where(state == ASKED, name, mixed(name, doc, first))
    return (name & ~np.uint64(3) | state.astype(np.uint64)).view(np.int64)


def sent(schema: str, *columns: np.ndarray) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c.astype(f"int{32 if k == 'int' else 64}", copy=False)) for c, k in zip(columns, kinds, strict=True)], list(names))


def sorted_places(found: list[tuple[np.ndarray, ...]], crowd: int) -> pa.RecordBatch:
    """PLACES of some texts: copies repeat, the crowd of a core is open, the rest is asked."""
    core, around, doc, first, many = (np.concatenate(c) for c in zip(*found, strict=True))
    core &= ~np.uint64(3)
    order = np.lexsort((first, doc, around, core))
    fresh, new = np.ones(len(core), bool), np.ones(len(core), bool)
    fresh[1:] = core[order][1:] != core[order][:-1]
    new[1:] = fresh[1:] | (around[order][1:] != around[order][:-1])
    nth = np.cumsum(new)
    nth -= np.maximum.accumulate(np.where(fresh, nth, 0))  # distinct surroundings of the core before this one
    state = np.empty(len(core), np.int64)  # rows go on in the order of the texts, in which they compress best
    state[order] = np.where(~new, REPEATS, np.where(nth >= crowd, OPEN, ASKED))
    return sent(PLACES, with_state(state, core, doc, first), around.view(np.int64), doc, first.astype(np.int64) << 6 | many)


def places(docs: DataFrame, key: int, bounds: Bounds) -> DataFrame:
    """Each text's minimizers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                if len(data) >= LENGTH:
                    for at, part in parts(data, bounds.part):
                        core, around, first, many = minimizers(part, key)
                        found.append((core, around, np.full(len(core), doc), first + at, many))
                        n += len(core)
                        if n >= bounds.held:
                            yield sorted_places(found, bounds.crowd)
                            found, n = [], 0
        if found:
            yield sorted_places(found, bounds.crowd)

    return docs.mapInArrow(run, PLACES)


def state_of(name: str) -> Column:
    return F.col(name).bitwiseAND(F.lit(3))


def compared(rows: DataFrame) -> DataFrame:
    """Places that repeat as a whole (settled) and those that are open; the others are gone."""
    same = Window.partitionBy("core")
    run = Window.partitionBy("core", "around").orderBy("doc_id", "at")
    seen = rows.withColumn("n", F.row_number().over(run)).withColumn("low", F.min("around").over(same)).withColumn("high", F.max("around").over(same))
    asked = state_of("core") == ASKED
    repeat = (state_of("core") == REPEATS) | (asked & (F.col("n") > 1))
    open_ = (state_of("core") == OPEN) | (asked & (F.col("low") != F.col("high")))
    first, many = F.shiftright("at", 6).cast("int"), F.col("at").bitwiseAND(F.lit(63)).cast("int")
    return seen.where(repeat | open_).select(repeat.alias("settled"), "doc_id", first.alias("first"), many.alias("many"))


def sorted_windows(found: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """PAIRS of some windows (a, b, doc_id, at): the first of equals is asked, the others are ranges that repeat."""
    a, b, doc, at = (np.concatenate(c) for c in zip(*found, strict=True))
    a &= ~np.uint64(3)
    order = np.lexsort((at, doc, b, a))
    new = np.ones(len(a), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    asked, again = np.sort(order[new]), np.sort(order[~new])
    yield sent(PAIRS, with_state(np.full(len(asked), ASKED), a[asked], doc[asked], at[asked]), b[asked].view(np.int64), doc[asked], at[asked])
    if len(again):
        doc, at, name = doc[again], at[again], a[again]
        head = np.nonzero((np.diff(doc, prepend=doc[0] - 1) != 0) | (np.diff(at, prepend=at[0]) != 1))[0]
        many = np.diff(np.append(head, len(at)))
        yield sent(PAIRS, with_state(np.full(len(head), REPEATS), name[head], doc[head], at[head]), many, doc[head], at[head])


def open_pairs(docs: DataFrame, ranges: DataFrame, key: int, bounds: Bounds) -> DataFrame:
    """(name of the first half, name of the second) of each window of the open places."""
    half = LENGTH // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = [], 0
        for batch in batches:
            for doc, text, first, many in zip(batch.column(0).to_pylist(), batch.column(1), *spans_of(batch.column(2)), strict=True):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                for low, part in parts(data, bounds.part):
                    mine = (first < low + bounds.part) & (first + many > low)
                    if not mine.any():
                        continue
                    a, b = np.maximum(first[mine], low), np.minimum(first[mine] + many[mine], low + bounds.part)
                    at = np.sort(np.repeat(a - np.cumsum(b - a) + (b - a), b - a) + np.arange((b - a).sum()))
                    name = hashes(part, half, key)
                    found.append((name[at - low], name[at - low + half], np.full(len(at), doc), at))
                    n += len(at)
                    if n >= bounds.held:
                        yield from sorted_windows(found)
                        found, n = [], 0
        if found:
            yield from sorted_windows(found)

    return docs.join(ranges, "doc_id").select("doc_id", "text", "spans").mapInArrow(run, PAIRS)


def spans_of(column: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The first and many numbers of each row's spans, none for null."""
    at, inner = column.offsets.to_numpy(), column.values
    rows = [slice(a, b) if ok else slice(0) for a, b, ok in zip(at[:-1].tolist(), at[1:].tolist(), column.is_valid().to_pylist(), strict=True)]
    first, many = (inner.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
    return [first[r] for r in rows], [many[r] for r in rows]


def repeats(docs: DataFrame, bounds: Bounds = Bounds()) -> DataFrame:
    """doc_id and spans (first, many): starts of all windows that also start earlier."""
    key = secrets.randbits(56)
    found = stored(compared(places(docs, key, bounds)))
    spans = lambda rows: rows.groupBy("doc_id").agg(F.collect_list(F.struct("first", "many")).alias("spans"))
    pairs = open_pairs(docs, spans(found.where(~F.col("settled"))), key, bounds)
    nth = F.row_number().over(Window.partitionBy("a", "b").orderBy("doc_id", "first"))
    range_ = state_of("a") == REPEATS
    again = pairs.withColumn("n", nth).where(range_ | (F.col("n") > 1)).select("doc_id", "first", F.when(range_, F.col("b")).otherwise(1).cast("int").alias("many"))
    return spans(found.where("settled").select("doc_id", "first", "many").unionByName(again))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id (a unique key in the order of the documents) and text of every row, and id, the given doc_id, where the key is another."""
    rows = docs.select(id_or_last("doc_id").alias("doc_id"), whole_text("text").alias("text"))
    if rows.groupBy("doc_id").count().where("count > 1").isEmpty():
        return rows
    ordered = rows.withColumn("n", F.monotonically_increasing_id()).orderBy("doc_id", "text", "n")
    return stored(ordered.select(F.monotonically_increasing_id().alias("doc_id"), "text", F.col("doc_id").alias("id")))


def joined_runs(first: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last (exclusive) bytes of the maximal runs that windows of these ranges cover."""
    if not len(first):
        return first, first
    order = np.argsort(first, kind="stable")
    first, last = first[order], np.maximum.accumulate((first + many - 1 + LENGTH)[order])
    head = np.append(True, first[1:] > last[:-1])
    return first[head], last[np.append(np.nonzero(head)[0][1:] - 1, len(last) - 1)]


def removed(docs: DataFrame, bounds: Bounds = Bounds()) -> DataFrame:
    """doc_id, n_bytes, removed (array of first, last of the maximal runs), kept (the other bytes)."""
    rows = keyed(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
        for batch in batches:
            for i in range(0, len(batch), 256):
                part, sizes, runs, kept = batch.slice(i, 256), [], [], []
                for text, first, many in zip(part.column(1), *spans_of(part.column(2)), strict=True):
                    data = text.as_buffer().to_pybytes()
                    gone = list(zip(*(x.tolist() for x in joined_runs(first, many)), strict=True))
                    edges = [0, *(x for g in gone for x in g), len(data)]
                    sizes.append(len(data))
                    runs.append([{"first": a, "last": b} for a, b in gone])
                    kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(runs, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "removed", "kept"])

    found = rows.join(repeats(rows.select("doc_id", "text"), bounds), "doc_id", "left").select(rows.columns[-1] if "id" in rows.columns else "doc_id", "text", "spans")
    return found.mapInArrow(run, "doc_id long, n_bytes long, removed array<struct<first:int,last:int>>, kept binary")


def removal_digests(docs: DataFrame, bounds: Bounds = Bounds()) -> DataFrame:
    """The digests of every row."""
    return removed(docs, bounds).select(
        id_or_null("doc_id").alias("doc_id"),
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def doubled(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, at: starts of all strings of `length` bytes (8 or more) that also start earlier, by doubling over every position.

    A name is the earliest place (doc_id, at) of its string. Equal pairs of
    names are grouped at growing offsets; positions that are unique are dropped,
    and with them those whose second half is. doc_ids have to be unique.
    """
    rows = docs.select(id_or_last("doc_id").alias("doc_id"), F.encode(whole_text("text"), "UTF-8").alias("data"))
    rows = rows.where(F.length("data") >= length).select("doc_id", "data", F.explode(F.sequence(F.lit(0), F.length("data") - 8)).alias("at"))
    rows = rows.select("doc_id", "at", F.substring("data", F.col("at") + 1, 8).alias("a"), F.lit(0).alias("b"))
    have = 8
    while True:
        named = rows.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "at")).alias("name")).where("n > 1")
        rows = stored(rows.join(named, ["a", "b"]).select("doc_id", "at", "name"))
        if have == length:
            return rows.where("name <> struct(doc_id, at)").select("doc_id", "at")
        gap = min(have, length - have)
        second = rows.select("doc_id", (F.col("at") - gap).alias("at"), F.col("name").alias("b"))
        rows, have = rows.withColumnRenamed("name", "a").join(second, ["doc_id", "at"]), have + gap


def brute_force(texts: list[tuple[int, str]], length: int = LENGTH) -> dict[int, tuple[int, int, int, str]]:
    """The same digests by a dictionary of all windows, for small tests."""
    seen, out = set(), {}
    for doc, text in sorted(texts):
        data = text.encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            if data[i : i + length] in seen:
                gone[i : i + length] = b"\1" * length
            else:
                seen.add(data[i : i + length])
        kept = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[doc] = len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()
    return out
