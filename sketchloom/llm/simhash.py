"""SimHash near-dedup by tiled exact comparison.

A fingerprint has the bits that are set in over half of a text's shingle
hashes (repeats count). Distinct fingerprints are dealt into tiles by the
population counts of their four 16-bit quarters. The counts of two
fingerprints differ, in all, by no more than their bits do, so tile pairs
whose counts differ by over the radius are skipped unseen; all others are
compared bit by bit in numpy (exclusive-or, bit counts), so no link is lost
and none is guessed. A tile pair hands on a spanning forest of its links
rather than all of them, so that a large group of near copies stays linear.

Null texts count as empty; texts without words have fingerprint 0 and link
like any other. Null doc_ids come back null and never name a component that
has a real id. No documents give no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, id_or_last, id_or_null, stored, whole_text
from .components import components

SEED = 42
RADIUS = 3
#: Fingerprints of one tile that travel as one block: what is shuffled falls as blocks grow, what is compared stays.
BLOCK = 32_768
LANES = np.uint64(0x0101010101010101)
SPACE = bytes(range(9, 14))


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes; 0 for none."""
    n = len(hashes)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 255 * 4096):  # bytes of a lane hold 255 sums
        part = hashes[i : i + 255 * 4096]
        part = np.concatenate([part, np.zeros(-len(part) % 255, np.uint64)]).reshape(255, -1)
        for bit in range(8):
            lanes = ((part >> np.uint64(bit)) & LANES).sum(axis=0, dtype=np.uint64)
            counts[bit::8] += lanes.astype("<u8").view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.nonzero(2 * counts > n)[0].tolist()))


def fingerprint(text: str, words: int = 3) -> int:
    import xxhash

    data = text.encode().translate(LOWER)
    if b"  " in data or data[:1] == b" " or data[-1:] == b" ":
        data = b" ".join(data.split())
    if not data:
        return 0
    ends = np.nonzero(np.frombuffer(data, np.uint8) == 32)[0]
    if len(ends) < words:
        return majority(np.asarray([xxhash.xxh64_intdigest(data, SEED)], np.uint64))
    starts = [0, *(ends + 1).tolist()]
    stops = [*ends[words - 1 :].tolist(), len(data)]
    digest, view = xxhash.xxh64_intdigest, data
    return majority(np.fromiter((digest(view[a:b], SEED) for a, b in zip(starts, stops, strict=False)), np.uint64, len(stops)))


#: A-Z to a-z, and all white space of the shingle rule to the space.
LOWER = bytes(32 if c in SPACE else c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.asarray([fingerprint(x.as_py(), words) for x in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(id_or_last("doc_id").alias("doc_id"), whole_text("text").alias("text")).mapInArrow(run, "doc_id long, fp long")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links with the same components as the links a-b: each value to the least of its component."""
    values, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(values))
    while True:
        least = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, least)
        np.minimum.at(new, v, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    out = label != np.arange(len(values))
    return values[label[out]], values[out]


def linked(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs within the radius, compared by tiles in bounded memory."""
    a, b = [left[:0]], [right[:0]]
    for i in range(0, len(left), 256):
        for j in range(0, len(right), 4096):
            one, other = left[i : i + 256], right[j : j + 4096]
            x, y = np.nonzero(np.bitwise_count(one[:, None] ^ other[None, :]) <= radius)
            x, y = one[x], other[y]
            if len(x) > len(one) + len(other):
                x, y = forest(x, y)
            a.append(x)
            b.append(y)
    return np.concatenate(a), np.concatenate(b)


def near(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links a, b between distinct fingerprints fp (with the same components as all pairs within the radius)."""
    counts = [F.bit_count(F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))) for i in range(4)]
    code = sum(((c + radius) * 32**i for i, c in enumerate(counts)), F.lit(0)).cast("int")
    dealt = fps.select("fp", code.alias("tile"))
    sizes = dealt.groupBy("tile").agg(F.count("*").alias("n"))  # 17 ** 4 rows at most, whatever the corpus
    dealt = dealt.join(F.broadcast(sizes), "tile").withColumn("part", F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") / BLOCK)).cast("int"))
    blocks = stored(dealt.groupBy("tile", "part").agg(F.collect_list("fp").alias("fps")))
    keys = blocks.select("tile", "part")
    steps = [v for v in itertools.product(range(-radius, radius + 1), repeat=4) if sum(map(abs, v)) <= radius]
    offsets = sorted({d for v in steps if (d := sum(x * 32**i for i, x in enumerate(v))) >= 0})
    there = keys.select(F.col("tile").alias("tile2"), F.col("part").alias("part2"))
    pairs = keys.select("tile", "part", F.explode(F.array(*map(F.lit, offsets))).alias("d")).select("tile", "part", (F.col("tile") + F.col("d")).alias("tile2"))
    pairs = pairs.join(there, "tile2").where("tile2 > tile or part2 >= part")
    other = blocks.select(F.col("tile").alias("tile2"), F.col("part").alias("part2"), F.col("fps").alias("fps2"))
    pairs = pairs.join(blocks, ["tile", "part"]).join(other, ["tile2", "part2"]).select("fps", "fps2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [linked(x.values.to_numpy().view(np.uint64), y.values.to_numpy().view(np.uint64), radius) for x, y in zip(batch.column(0), batch.column(1), strict=True)]
            a, b = (np.concatenate([np.zeros(0, np.uint64), *(f[k] for f in found)]).view(np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], ["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def near_dedup(docs: DataFrame, words: int = 3, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document."""
    rows = stored(fingerprints(docs, words))
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("doc"))
    joined = components(near(nodes.select("fp"), radius)).withColumnRenamed("node", "fp")
    placed = nodes.join(joined, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    firsts = placed.groupBy("component").agg(F.min("doc").alias("first"))
    classes = placed.join(firsts, "component").select("fp", "first")
    return rows.join(classes, "fp").select(
        id_or_null("doc_id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("first") != NO_ID, F.col("first")).alias("component_id"),
    )
